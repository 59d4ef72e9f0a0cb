"""Mixing sources to target weights by Pfair scheduling.

The documents of a source come in blocks of ``block_docs`` in the order of a
hash of their id. With W the sum of the weights of the sources that still have
blocks, block i (from 0) of a source of weight w is released at slot
``floor(i W / w)`` and due at ``ceil((i + 1) W / w)``. Each slot goes to the
released block with the earliest deadline (ties by source); every source then
stays less than one block from its share at every slot. The schedule repeats
after W slots, so the driver computes one round of it from the weights alone,
and the slot of any block follows by arithmetic. When a source ends, a new
phase begins with the weights of the others: nothing is left out or repeated.

A null source is one of its own. Ties and repeated rows follow one another; a
null id is hashed as an empty one. An empty table gives no rows. Other columns
are handed on.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import fresh


def round_of(weights: Mapping[int, int]) -> dict[int, list[int]]:
    """For each source the slots it gets in a round of ``sum(weights)`` slots, by earliest deadline first."""
    total = sum(weights.values())
    due = lambda s, i: -(-(i + 1) * total // weights[s])
    waiting = [(0, s, 0) for s in weights]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    slots: dict[int, list[int]] = {s: [] for s in weights}
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (due(s, i), s, i))
        _, s, i = heapq.heappop(ready)
        slots[s].append(slot)
        if i + 1 < weights[s]:
            heapq.heappush(waiting, ((i + 1) * total // weights[s], s, i + 1))
    return slots


def phases(blocks: Mapping[int, int], weights: Mapping[int, int]) -> list[dict]:
    """For each phase and source: the first slot, the range of blocks, the weight, the round's length and its slots."""
    left = {s: n for s, n in blocks.items() if n}
    done = dict.fromkeys(left, 0)
    start, out = 0, []
    while left:
        own = {s: weights[s] for s in left}
        total = sum(own.values())
        slots = round_of(own)
        end = min((left[s] - 1) // own[s] * total + slots[s][(left[s] - 1) % own[s]] for s in left) + 1
        rounds, rest = divmod(end, total)
        for s in own:
            served = rounds * own[s] + sum(x < rest for x in slots[s])
            out.append({"src": s, "start": start, "first": done[s], "end": done[s] + served, "weight": own[s], "total": total, "slots": slots[s]})
            done[s] += served
            left[s] -= served
        left = {s: n for s, n in left.items() if n}
        start += end
    return out


def mix_sources(docs: DataFrame, weights: Mapping[str | None, int], *, default_weight: int = 1, source: str = "source", block_docs: int = 32, most_sources: int = 256) -> DataFrame:
    """``docs`` with ``block``, ``release``, ``deadline``, ``slot`` and ``position``; sorted by the last they are the mix."""
    wanted = ["block", "release", "deadline", "slot", "position", "rank", "order", "part", "name", "digits", "before", "start", "first", "end", "weight", "total", "slots"]
    block, release, deadline, slot, position, rank, order, part, name, digits, before, start, first, end, weight, total, slots = fresh(docs, *wanted)
    spark = docs.sparkSession
    ordered = docs.withColumn(order, F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    # The order's first digits cut each source into parts: ranks need no task with a whole source.
    n_digits = 3
    ordered = ordered.withColumn(part, F.substring(order, 1, n_digits))
    sizes = ordered.groupBy(F.col(source).alias(name), F.col(part).alias(digits)).agg(F.count("*").alias("n"))
    so_far = F.sum("n").over(Window.partitionBy(name).orderBy(digits)) - F.col("n")
    offsets = sizes.select(name, digits, so_far.alias(before))  # at most sources * 16**n_digits rows
    counts = sizes.groupBy(F.col(name).alias("name")).agg(F.sum("n").alias("n")).orderBy(F.col("name").asc_nulls_first()).limit(most_sources + 1).collect()
    if len(counts) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    names = [r["name"] for r in counts]
    plan = phases({k: -(-r["n"] // block_docs) for k, r in enumerate(counts)}, {k: weights.get(x, default_weight) for k, x in enumerate(names)})
    kind = sizes.schema[name].dataType.simpleString()
    schedule = spark.createDataFrame(
        [(names[p["src"]], p["start"], p["first"], p["end"], p["weight"], p["total"], p["slots"]) for p in plan],
        f"`{name}` {kind}, `{start}` long, `{first}` long, `{end}` long, `{weight}` long, `{total}` long, `{slots}` array<int>",
    ).alias("plan")  # at most most_sources**2 rows
    within = Window.partitionBy(source, part).orderBy(order, "doc_id", *(["text"] if "text" in docs.columns else []))
    ranked = ordered.withColumn(rank, F.row_number().over(within) - 1)
    placed = ranked.join(F.broadcast(offsets), F.col(source).eqNullSafe(F.col(name)) & (F.col(part) == F.col(digits))).withColumn(rank, F.col(rank) + F.col(before)).drop(name, digits, before)
    numbered = placed.withColumn(block, F.floor(F.col(rank) / block_docs))
    timed = numbered.join(F.broadcast(schedule), F.col(source).eqNullSafe(F.col(name)) & (F.col(block) >= F.col(first)) & (F.col(block) < F.col(end)))
    i = F.col(block) - F.col(first)
    turn, into = F.floor(i / F.col(weight)), (i % F.col(weight)).cast("int")
    timed = (
        timed.withColumn(release, F.col(start) + F.expr(f"(`{block}` - `{first}`) * `{total}` div `{weight}`"))
        .withColumn(deadline, F.col(start) + F.expr(f"((`{block}` - `{first}` + 1) * `{total}` + `{weight}` - 1) div `{weight}`"))
        .withColumn(slot, F.col(start) + turn * F.col(total) + F.get(slots, into))
        .withColumn(position, F.col(slot) * block_docs + F.col(rank) % block_docs)
    )
    return timed.select(*docs.columns, block, release, deadline, slot, position)
