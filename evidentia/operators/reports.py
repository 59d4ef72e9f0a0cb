"""Distributions and censuses over chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.text import SENTENCE_END, strip


def distribution(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, min, max, population deviation and five linear quantiles, to one digit; keys without a value have n = 0."""
    quantiles = F.percentile(value, F.array(*map(F.lit, (0.1, 0.25, 0.5, 0.75, 0.9))))
    out = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.round(F.avg(value), 1).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.round(F.stddev_pop(value), 1).alias("std"), quantiles.alias("q"))
    return out.select(*keys, "n", "mean", "min", "max", "std", *(F.round(F.get("q", F.lit(i)), 1).alias(name) for i, name in enumerate(("p10", "p25", "median", "p75", "p90"))))


def retrieval_report(rows: DataFrame, keys: list[str], budget: int) -> DataFrame:
    """A row a cell: three distributions, mean metrics, how often and how early the gold span was found, and why the fills stopped.

    ``rows``: a row a question with ``n_chunks``, ``tokens_used``, ``budget_slack``, ``stopped_reason``,
    ``gold_rank`` and ``tokens_before_gold`` (null: not found) and the metrics.
    """
    metrics = ("span_coverage", "evidence_density", "distractors", "recall", "ndcg")
    reasons = ("overflow", "candidates_exhausted", "no_candidates")
    found = F.col("gold_rank").isNotNull()
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n_queries"),
        F.round(F.round(F.avg("tokens_used"), 4) / budget, 4).alias("realised_budget_share"),
        *(F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4).alias(c) for c in metrics),
        F.count_if(found).alias("gold_found"),
        F.round(F.avg("gold_rank"), 2).alias("mean_gold_rank"),
        F.round(F.avg(F.when(found, F.col("tokens_before_gold"))), 1).alias("mean_tokens_before_gold"),
        *(F.count_if(F.col("stopped_reason") == r).alias(r) for r in reasons),
    )
    for value in ("n_chunks", "tokens_used", "budget_slack"):
        own = distribution(rows, keys, value)
        out = out.join(own.select(*keys, *(F.col(c).alias(f"{value}_{c}") for c in own.columns if c not in keys)), keys)
    return out


def tiny_census(chunks: DataFrame, thresholds: tuple[int, ...] = (10, 25, 50, 100)) -> DataFrame:
    """For each threshold the chunks under it: their share, how many end their document and how many don't."""
    tiny = [F.col("n_tokens") < t for t in thresholds]
    ends = F.col("is_last")
    one = chunks.agg(F.count("*").alias("total"), *(F.count_if(x).alias(f"n{i}") for i, x in enumerate(tiny)), *(F.count_if(x & ends).alias(f"l{i}") for i, x in enumerate(tiny)))
    rows = F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"n{i}").alias("n"), F.col(f"l{i}").alias("n_last")) for i, t in enumerate(thresholds)))
    return one.select("total", F.explode(rows).alias("r")).select("r.*", F.round(F.col("r.n") / F.col("total"), 4).alias("share"), (F.col("r.n") - F.col("r.n_last")).alias("n_mid"))


def mid_sentence(chunks: DataFrame) -> DataFrame:
    """Chunks that don't end with a sentence, in all and among those that aren't their document's last."""
    cut = ~F.rlike(F.col("text"), F.lit(SENTENCE_END))
    inner = ~F.col("is_last")
    out = chunks.agg(F.count("*").alias("n"), F.count_if(cut).alias("n_cut"), F.count_if(inner).alias("n_inner"), F.count_if(cut & inner).alias("n_inner_cut"))
    return out.select("*", F.round(F.col("n_cut") / F.col("n"), 4).alias("share_cut"))


def truncation_census(chunks: DataFrame, limit: int) -> DataFrame:
    over = F.greatest(F.lit(0), F.col("n_tokens") - limit)
    out = chunks.agg(F.count("*").alias("n"), F.count_if(over > 0).alias("n_over"), F.max("n_tokens").alias("max_tokens"), F.max(over).alias("worst_over"), F.round(F.avg("n_tokens"), 1).alias("mean_tokens"))
    return out.withColumn("share_over", F.round(F.col("n_over") / F.col("n"), 4))


def stratified_sample(rows: DataFrame, stratum: str, key: str, size: int, strata: int, seed: str = "7") -> DataFrame:
    """``ceil(size / strata)`` rows of each stratum, the first by a hash of seed and key."""
    from pyspark.sql import Window

    order = F.sha2(F.concat(F.lit(seed + ":"), F.col(key).cast("string")).cast("binary"), 256)
    each = -(-size // strata)
    ranked = rows.withColumn("_o", order).withColumn("rank", F.row_number().over(Window.partitionBy(stratum).orderBy("_o", key)))
    return ranked.filter(F.col("rank") <= each).drop("_o")


def pending(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys the sink doesn't hold yet."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def section_kind(title: Column, patterns: dict[str, list[str]], declared: Column | None = None) -> Column:
    """The first kind, in the order given, with a pattern that the declared type begins with; else one with a pattern in the title; else ``other``. Case and outer blanks don't matter."""

    def first(value: Column, fits, other: Column) -> Column:
        out = other
        for kind, needles in reversed(list(patterns.items())):
            hit = F.lit(False)
            for needle in needles:
                hit = hit | fits(F.lower(strip(F.coalesce(value, F.lit("")))), F.lit(needle))
            out = F.when(hit, F.lit(kind)).otherwise(out)
        return out

    by_title = first(title, F.contains, F.lit("other"))
    return by_title if declared is None else first(declared, F.startswith, by_title)
