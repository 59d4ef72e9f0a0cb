"""Gold spans, interval joins and context metrics."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: The last automaton that this Python worker built, by the name of its block.
_BUILT: dict[str, object] = {}


def _automaton(name: str, texts: Iterable[str]):
    """The automaton of a block, built once for all tasks of a worker."""
    import ahocorasick

    if name not in _BUILT:
        machine = ahocorasick.Automaton()
        for text in texts:
            machine.add_word(text, text)
        machine.make_automaton()
        _BUILT.clear()
        _BUILT[name] = machine
    return _BUILT[name]


def contained_passages(docs: DataFrame, passages: DataFrame, *, most_passages: int = 100_000, most_chars: int = 20_000_000) -> DataFrame:
    """``item_id``, ``doc_id``, ``gold_start``, ``gold_end``: where a passage first stands in a document.

    A pass over each document finds all passages of a block together; blocks of
    about ``most_passages`` and ``most_chars`` are broadcast in turn, once to each
    executor and not with each task. Empty passages match nothing.
    """
    asked = passages.select("item_id", "text").filter("text <> ''")
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size["n"] // most_passages), -(-size["chars"] // most_chars))
    parts = [asked.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k) if blocks > 1 else asked for k in range(blocks)]
    return reduce(DataFrame.unionByName, [_contained(docs, part) for part in parts])


def _contained(docs: DataFrame, passages: DataFrame) -> DataFrame:
    by_text: dict[str, list[int]] = {}
    for r in passages.collect():
        by_text.setdefault(r["text"], []).append(r["item_id"])
    sent, name = docs.sparkSession.sparkContext.broadcast(by_text), str(uuid.uuid4())

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        machine = _automaton(name, items) if items else None
        for batch in batches:
            out = []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                first: dict[str, int] = {}
                for last, text in machine.iter(value.as_py() or "") if machine else ():
                    first.setdefault(text, last + 1)
                out += [(i, doc_id, end - len(text), end) for text, end in first.items() for i in items[text]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 4)], ["item_id", "doc_id", "gold_start", "gold_end"])

    return docs.select("doc_id", "text").mapInArrow(found, "item_id long, doc_id long, gold_start long, gold_end long")


def merge_intervals(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """The union of the intervals of each key; those that touch become one."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    furthest = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = rows.withColumn("_new", F.when(furthest.isNull() | (F.col(start) > furthest), 1).otherwise(0))
    island = opened.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def overlap(start: Column, end: Column, gold_start: Column, gold_end: Column) -> Column:
    """Characters in common; touching intervals have none."""
    return F.greatest(F.lit(0), F.least(end, gold_end) - F.greatest(start, gold_start))


def context_metrics(selected: DataFrame, gold: DataFrame, keys: list[str], n_relevant: DataFrame, k: int = 10) -> DataFrame:
    """What a context holds of the gold span, a row for each key.

    ``selected``: keys, ``item_id``, ``rank``, ``doc_id``, ``char_start``,
    ``char_end``, ``n_tokens``. ``gold``: ``item_id``, ``gold_doc``,
    ``gold_start``, ``gold_end``, one row an item. ``n_relevant``: keys less the
    rerank, ``n_rel`` (chunks that overlap the gold span at all).
    """
    met = selected.join(gold, "item_id")
    common = overlap(F.col("char_start"), F.col("char_end"), F.col("gold_start"), F.col("gold_end"))
    met = met.withColumn("common", F.when(F.col("doc_id") == F.col("gold_doc"), common).otherwise(F.lit(0))).withColumn("rel", F.col("common") > 0)
    before = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    met = met.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    covered = merge_intervals(met.filter("rel"), [*keys, "gold_start", "gold_end"], "char_start", "char_end")
    covered = covered.groupBy(*keys).agg(F.sum(overlap(F.col("char_start"), F.col("char_end"), F.col("gold_start"), F.col("gold_end"))).alias("covered"))
    gain = F.when(F.col("rel") & (F.col("rank") <= k), 1 / F.log2(F.col("rank") + 1))
    per = met.groupBy(*keys).agg(
        F.max(F.col("gold_end") - F.col("gold_start")).alias("width"),
        F.count("*").alias("n_chunks"),
        F.sum("n_tokens").alias("tokens_used"),
        F.sum(F.col("char_end") - F.col("char_start")).alias("chars"),
        F.count_if(~F.col("rel")).alias("distractors"),
        F.min(F.when(F.col("rel"), F.col("rank"))).alias("gold_rank"),
        F.min_by("before", F.when(F.col("rel"), F.col("rank"))).alias("tokens_before_gold"),
        F.count_if(F.col("rel") & (F.col("rank") <= k)).alias("hits"),
        F.coalesce(F.sum(gain), F.lit(0.0)).alias("dcg"),
    )
    out = per.join(covered, keys, "left").join(n_relevant, [c for c in n_relevant.columns if c != "n_rel"], "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.col("n_rel").cast("int")))), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + F.lit(1)))
    held = F.coalesce("covered", F.lit(0))
    return out.select(
        *keys, "n_chunks", "tokens_used", "distractors", "gold_rank",
        F.when(F.col("gold_rank").isNotNull(), F.col("tokens_before_gold")).alias("tokens_before_gold"),
        F.round(held / F.col("width"), 6).alias("span_coverage"),
        F.round(held / F.col("chars"), 6).alias("evidence_density"),
        F.round(F.when(F.col("n_rel") > 0, F.col("hits") / F.col("n_rel")).otherwise(0.0), 6).alias("recall"),
        F.round(F.when(F.col("n_rel") > 0, F.col("dcg") / ideal).otherwise(0.0), 6).alias("ndcg"),
    )
