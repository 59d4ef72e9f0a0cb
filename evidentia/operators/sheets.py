"""Sheets that people score: items drawn over all cells, notes beside them, scores as they come back, and labels by evidence or by paragraph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text as T
from evidentia.operators import goldset, spans
from evidentia.operators.reports import distribution
from evidentia.sources.tables import stored

SCALES = ("faithfulness", "relevance", "completeness")
VERDICTS = ("correct", "partially_correct", "incorrect", "abstained")
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def contiguity_note(evidence: Column) -> Column:
    """Why a span is wider than a sentence; empty where it isn't."""
    n = goldset.sentence_count(evidence)
    return F.when(n > 1, F.concat(n.cast("string"), F.lit(" sentences -- the answer is stated in more than one place"))).otherwise(F.lit(""))


def judge_note(note: Column, template: str) -> Column:
    """The template with the stripped note in place of ``{judge_note}``; empty for a blank or missing note.

    A template without the place fails on the first note that needs it.
    """
    bare = T.strip(F.coalesce(note, F.lit("")))
    put = F.replace(F.lit(template), F.lit("{judge_note}"), bare) if "{judge_note}" in template else F.raise_error(F.lit("the template has no place for the note")).cast("string")
    return F.when(bare == "", F.lit("")).otherwise(put)


def number_of(name: Column, prefix: str = "PMC") -> Column:
    """The number after a prefix, to order ids by: PMC9 goes before PMC10."""
    return F.regexp_replace(name, "^" + prefix, "").cast("long")


def draw_items(answers: DataFrame, cell: list[str], key: str, size: int, seed: str = "7") -> DataFrame:
    """``size`` rows dealt evenly over the cells, the first of each by a hash of seed, cell and key.

    Adds ``config`` and ``sheet_id``, a hash that tells neither cell nor order.
    A cell that has fewer rows leaves its turns to the others.
    """
    config = F.concat_ws("-", *cell)
    named = answers.withColumn("config", config)
    order = F.sha2(F.concat_ws(":", F.lit(seed), "config", F.col(key).cast("string")).cast("binary"), 256)
    sheet_id = F.left(F.sha2(F.concat_ws(":", F.lit("item"), "config", F.col(key).cast("string")).cast("binary"), 256), F.lit(16))
    turns = named.withColumn("_order", order).withColumn("_turn", F.row_number().over(Window.partitionBy(*cell).orderBy("_order", key)))
    return turns.filter(F.col("_turn") <= size).orderBy("_turn", "_order").limit(size).drop("_turn", "_order").withColumn("sheet_id", sheet_id)


def sheet_items(drawn: DataFrame, queries: DataFrame, contexts: DataFrame, cell: list[str], key: str) -> DataFrame:
    """The drawn answers with question, reference, note and the whole context, by ``sheet_id``; ``drawn`` is as small as the sheet.

    An answer to a question that ``queries`` lacks is left out; one without chunks has an empty context.
    """
    met = contexts.join(F.broadcast(drawn.select(*cell, key)), [*cell, key])
    rows = drawn.join(queries, key).join(met, [*cell, key], "left")
    return rows.select("sheet_id", "config", key, "question", "reference", "note", "answer", F.coalesce("context", F.lit("")).alias("context")).orderBy("sheet_id")


def returned_scores(rows: DataFrame, scales: tuple[str, ...] = SCALES, verdicts: tuple[str, ...] = VERDICTS) -> DataFrame:
    """``item_id``, ``verdict``, the scales as numbers and ``error``, for the rows of a sheet that came back.

    ``rows``: strings as they were written, and ``line``, their number. Rows without an id and
    rows without any score go. Of several rows for an item the last counts. ``error`` says the
    first fault of a row: a verdict that isn't one of ``verdicts``, or a score that is no number from 1 to 5.
    """
    bare = lambda c: T.strip(F.coalesce(F.col(c), F.lit("")))
    cut = rows.select(bare("item_id").alias("item_id"), "line", F.lower(bare("verdict")).alias("verdict"), *(bare(s).alias(s) for s in scales)).filter("item_id <> ''")
    value = {s: F.when(F.rlike(s, F.lit(_NUMBER)), F.col(s).try_cast("double")) for s in scales}
    faults = F.when(~F.col("verdict").isin("", *verdicts), F.concat(F.lit("unknown verdict "), "verdict"))
    for s in scales:
        faults = faults.when((F.col(s) != "") & value[s].isNull(), F.lit(f"{s} is no number")).when(~value[s].between(1, 5), F.lit(f"{s} is out of range"))
    scored = cut.select("item_id", "line", "verdict", *(value[s].alias(s) for s in scales), faults.alias("error"))
    kept = scored.filter((F.col("verdict") != "") | F.col("error").isNotNull() | F.coalesce(*scales).isNotNull())
    last = F.max_by(F.struct("verdict", *scales, "error"), "line")
    return kept.groupBy("item_id").agg(last.alias("r")).select("item_id", "r.*")


def as_context(labels: DataFrame) -> DataFrame:
    """The same spans labelled by their paragraph: ``context_start`` and ``context_end`` in place of the evidence's ends."""
    return labels.withColumn("gold_start", F.col("context_start")).withColumn("gold_end", F.col("context_end"))


def with_lines(labels: DataFrame, docs: DataFrame) -> DataFrame:
    """``labels`` with ``context_start`` and ``context_end``: the whole lines of the document that the span stands in."""
    rows = labels.join(docs.select(F.col("doc_id").alias("gold_doc"), "text"), "gold_doc")
    before = F.length(F.substring_index(F.left("text", F.col("gold_start").cast("int")), "\n", -1))
    after = F.length(F.substring_index(F.substring("text", F.col("gold_end").cast("int") + 1, F.length("text")), "\n", 1))
    return rows.withColumn("context_start", F.col("gold_start") - before).withColumn("context_end", F.col("gold_end") + after).drop("text")


def cover_report(chunks: DataFrame, labels: DataFrame, arms: list[str], arm: str = "chunking", key: str = "item_id") -> DataFrame:
    """A row for each arm and label (``evidence``, ``paragraph``): chunks that a span needs, how many need several, the mean ceiling, tokens that come along.

    A span that no chunk meets counts with zeros.
    """
    both = labels.withColumn("label", F.lit("evidence")).unionByName(as_context(labels).withColumn("label", F.lit("paragraph")))
    grid = both.select(key, "label", F.explode(F.array(*map(F.lit, arms))).alias(arm))
    met = chunks.join(both, (chunks["doc_id"] == both["gold_doc"]) & (chunks["char_start"] < both["gold_end"]) & (chunks["char_end"] > both["gold_start"]))
    common = spans.overlap(F.col("char_start"), F.col("char_end"), F.col("gold_start"), F.col("gold_end"))
    cover = met.groupBy(arm, key, "label").agg(F.count("*").alias("n_cover"), F.round(F.sum(common) / F.max(F.col("gold_end") - F.col("gold_start")), 6).alias("ceiling"), F.sum("n_tokens").alias("cover_tokens"))
    rows = stored(grid.join(cover, [arm, key, "label"], "left").na.fill(0, ["n_cover", "ceiling", "cover_tokens"]))  # several passes
    keys = [arm, "label"]
    named = lambda value: distribution(rows, keys, value).select(*keys, *(F.col(c).alias(f"{value}_{c}") for c in ("mean", "min", "max", "std", "p10", "p25", "median", "p75", "p90")))
    counted = rows.groupBy(*keys, "n_cover").agg(F.count("*").alias("k"))
    pairs = F.array_sort(F.collect_list(F.struct("n_cover", "k")))
    histogram = counted.groupBy(*keys).agg(F.array_join(F.transform(pairs, lambda p: F.concat_ws(":", p["n_cover"].cast("string"), p["k"].cast("string"))), ",").alias("histogram"))
    whole = rows.groupBy(*keys).agg(F.count("*").alias("n_spans"), F.count_if(F.col("n_cover") > 1).alias("n_split"), F.round(F.avg("ceiling"), 6).alias("mean_ceiling"))
    return whole.join(histogram, keys).join(named("n_cover"), keys).join(named("cover_tokens"), keys)


def selected_questions(candidates: DataFrame, key: str = "item_id") -> DataFrame:
    """The selected candidates as questions, verified or not, by id."""
    return candidates.filter("selected").select(key, "question", "reference", F.coalesce("note", F.lit("")).alias("note"), F.struct("gold_doc", "gold_start", "gold_end").alias("gold"), F.coalesce("verified", F.lit(False)).alias("verified")).orderBy(key)
