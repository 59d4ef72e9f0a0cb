"""The pacer against one client's calls taken one after another, in a table and in a stream of several batches."""

import random

import pytest
from pyspark.sql import functions as F

from evidentia.streaming.pacer import MINUTE, paced, wait


def by_turns(calls, requests, tokens):
    """Every call looked at in turn: the clock moves on by a microsecond's worth of leaving calls until it fits."""
    out, events, last = {}, [], 0
    for at, call, estimate, actual in sorted(calls):
        now = start = max(at, last)
        while True:
            events = [(t, c) for t, c in events if now - t < MINUTE]
            full = requests and len(events) >= requests
            heavy = tokens and events and sum(c for _, c in events) + estimate > tokens
            if not full and not heavy:
                break
            now = events[0][0] + MINUTE
        events.append((now, actual if actual else estimate))
        last = now
        out[call] = (now - start, now)
    return out


def made(seed, clients=5, n=60):
    rng = random.Random(seed)
    rows, t = [], 1_700_000_000_000_000
    for call in range(n * clients):
        t += rng.choice([0, 1, 200_000, 3_000_000, 20_000_000 if call % 40 == 0 else 500_000, MINUTE if call % 90 == 0 else 0])
        rows.append((f"c{rng.randrange(clients)}", call, t, rng.choice([10, 50, 400]), rng.choice([0, 5, 80, 600])))
    return rows


def expected(rows, requests, tokens):
    out = {}
    for client in {r[0] for r in rows}:
        out |= by_turns([(at, call, e, a) for c, call, at, e, a in rows if c == client], requests, tokens)
    return out


def table(spark, rows):
    df = spark.createDataFrame(rows, "client string, call_id long, us long, estimate long, actual long")
    return df.withColumn("ts", F.timestamp_micros("us")).drop("us")


@pytest.mark.parametrize("requests, tokens", [(3, 0), (0, 500), (4, 700), (0, 0)])
def test_a_table_of_calls(spark, requests, tokens):
    rows = made(1)
    got = {r.call_id: (r.wait_us, r.released_us) for r in paced(table(spark, rows), requests, tokens).collect()}
    assert got == expected(rows, requests, tokens)
    assert requests + tokens == 0 or any(w for w, _ in got.values())


def test_a_stream_of_calls(spark, tmp_path):
    rows, path = made(2), str(tmp_path / "in")
    for k in range(4):
        table(spark, rows[k * 75 : (k + 1) * 75]).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("client string, call_id long, estimate long, actual long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    out = paced(stream, 4, 700).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
    out.awaitTermination(200)
    got = {r.call_id: (r.wait_us, r.released_us) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == expected(rows, 4, 700)


def test_waits_at_the_edges():
    assert wait(MINUTE, [0], [9], 5, 1, 0) == 0  # just a minute old has left
    assert wait(MINUTE - 1, [0], [9], 5, 1, 0) == 1
    assert wait(10, [0, 5], [60, 50], 40, 0, 100) == MINUTE - 10  # the first one's room is enough
    assert wait(10, [0, 5], [60, 50], 60, 0, 100) == MINUTE - 5
    assert wait(10, [0, 5], [60, 50], 900, 0, 100) == MINUTE - 5  # never fits: it waits for all
    assert wait(10, [], [], 900, 3, 100) == 0 and wait(10, [0, 1, 2], [1, 1, 1], 1, 0, 0) == 0
