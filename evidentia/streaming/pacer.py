"""Calls of many clients paced to limits a minute: a stateful operator, in streams and in tables."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StructType

MINUTE = 60_000_000
HELD = StructType().add("at", ArrayType(LongType())).add("cost", ArrayType(LongType())).add("last", LongType())
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def wait(now: int, at: list[int], cost: list[int], estimate: int, requests: int, tokens: int, window: int = MINUTE) -> int:
    """Microseconds until a call of ``estimate`` tokens fits beside the calls of the last ``window``; a limit of 0 is none.

    Calls leave in turn, so the wait ends when enough of the first have left: for
    the requests all but ``requests - 1``, for the tokens as many as have to make
    room. A call that alone exceeds the tokens waits for all.
    """
    leave = 0
    if requests:
        leave = max(leave, len(at) - requests + 1)
    if tokens:
        freed = [0, *accumulate(cost)]
        leave = max(leave, min(len(cost), bisect_left(freed, freed[-1] + estimate - tokens)))
    return max(0, at[leave - 1] + window - now) if leave > 0 else 0


class Pacer(StatefulProcessor):
    """For each call when it may go out, in the order of its client's calls; what it really cost then takes the place of the estimate.

    A client's calls wait for one another: one is looked at when it is made or when the
    one before it went out, whichever is later. State is the calls of the last minute,
    and a timer clears it a minute after the last one.
    """

    def __init__(self, requests: int, tokens: int):
        self.requests, self.tokens = requests, tokens

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", HELD)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        at, cost, last = ([], [], 0)
        if self.held.exists():
            at, cost, last = self.held.get()
            at, cost = list(at), list(cost)
        for row in sorted(rows, key=lambda r: (r.at, r.call_id)):
            now = max(row.at, last)
            gone = bisect_left(at, now - MINUTE + 1)
            at, cost = at[gone:], cost[gone:]
            waited = wait(now, at, cost, row.estimate, self.requests, self.tokens)
            last = now + waited
            at.append(last)
            cost.append(row.actual if (row.actual or 0) > 0 else row.estimate)
            yield Row(client=row.client, call_id=row.call_id, wait_us=waited, released_us=last)
        self.held.update((at, cost, last))
        if self.timed:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last // 1000 + MINUTE // 1000)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass

    #: Timers are of event time, which a table has not.
    timed = True


class TablePacer(Pacer):
    timed = False


PACED = "client string, call_id bigint, wait_us bigint, released_us bigint"


def paced(calls: DataFrame, requests: int, tokens: int, *, late: str = "10 minutes") -> DataFrame:
    """``client``, ``call_id``, ``wait_us`` and ``released_us`` for each call of ``client``, ``call_id``, ``ts``, ``estimate``, ``actual``.

    In a stream the watermark ``late`` says how long after others a call may come; later ones are
    left out. Streams keep their state in RocksDB (``spark.sql.streaming.stateStore.providerClass``).
    """
    session = calls.sparkSession
    session.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    assert session.streams.active is not None  # starts what coordinates state, which a table's query does not do itself
    timed = calls.withWatermark("ts", late) if calls.isStreaming else calls
    rows = timed.select(F.col("client").cast("string").alias("client"), F.col("call_id").cast("long").alias("call_id"), F.unix_micros("ts").alias("at"), F.col("estimate").cast("long").alias("estimate"), F.col("actual").cast("long").alias("actual"), *(["ts"] if calls.isStreaming else []))
    kind, mode = (Pacer, "EventTime") if calls.isStreaming else (TablePacer, "None")
    return rows.groupBy("client").transformWithState(kind(requests, tokens), PACED, "Append", mode)
