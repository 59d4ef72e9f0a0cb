"""Factorial effects, paired tests and rater agreement."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def main_effect(facts: DataFrame, factor: str, low: str, high: str, n_cells: int = 4) -> DataFrame:
    """``metric``, ``query_id``, ``diff``: mean over the other factors' cells of high less low.

    Questions without a value in every cell are left out.
    """
    of = lambda level: F.avg(F.when(F.col(factor) == level, F.col("value")))
    both = facts.filter(F.col(factor).isin(low, high)).groupBy("metric", "query_id").agg((of(high) - of(low)).alias("diff"), F.count("value").alias("n"))
    return both.filter(F.col("n") == 2 * n_cells).select(F.lit(factor).alias("effect"), "metric", "query_id", F.round("diff", 9).alias("diff"))


def interaction(facts: DataFrame, a: tuple[str, str, str], b: tuple[str, str, str], n_cells: int = 2) -> DataFrame:
    """Difference of differences: (factor, low, high) twice, averaged over the remaining factor."""
    mean = lambda x, y: F.avg(F.when((F.col(a[0]) == x) & (F.col(b[0]) == y), F.col("value")))
    diff = (mean(a[2], b[2]) - mean(a[1], b[2])) - (mean(a[2], b[1]) - mean(a[1], b[1]))
    per = facts.groupBy("metric", "query_id").agg(diff.alias("diff"), F.count("value").alias("n"))
    return per.filter(F.col("n") == 4 * n_cells).select(F.lit(f"{a[0]} x {b[0]}").alias("effect"), "metric", "query_id", F.round("diff", 9).alias("diff"))


def binomial_two_sided(successes: Column, trials: Column) -> Column:
    """The exact two-sided tail at one half: twice the smaller tail, 1 at most, summed from logs."""
    low = F.least(successes, trials - successes).cast("int")

    def log_choose(k: Column) -> Column:
        steps = F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, F.lit(0.0), lambda acc, i: acc + F.log((trials - k + i).cast("double")) - F.log(i.cast("double")))

    tail = F.aggregate(F.sequence(F.lit(0), low), F.lit(0.0), lambda acc, k: acc + F.exp(log_choose(k) - trials * F.log(F.lit(2.0))))
    return F.when(trials <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def sign_test(diffs: DataFrame, keys: list[str]) -> DataFrame:
    """``n``, ``n_ties``, ``mean_difference``, ``effect_size`` and ``p_value`` of the signs; null where all tie."""
    per = diffs.groupBy(*keys).agg(F.count_if(F.col("diff") != 0).alias("n"), F.count_if(F.col("diff") == 0).alias("n_ties"), F.count_if(F.col("diff") > 0).alias("pos"), F.round(F.avg("diff"), 6).alias("mean_difference"))
    some = F.col("n") > 0
    return per.select(*keys, "n", "n_ties", "mean_difference", F.round(F.when(some, 2.0 * F.col("pos") / F.col("n") - 1), 6).alias("effect_size"), F.round(F.when(some, binomial_two_sided(F.col("pos"), F.col("n"))), 6).alias("p_value"))


def holm(tests: DataFrame, keys: list[str], p: str = "p_value") -> DataFrame:
    """``p_holm``: step-down over each family, whose size counts tests without a p-value too."""
    family = Window.partitionBy(*keys)
    order = family.orderBy(F.col(p).asc_nulls_last(), *[c for c in tests.columns if c not in (*keys, p)])
    stepped = tests.withColumn("_step", F.when(F.col(p).isNotNull(), (F.count("*").over(family) - F.row_number().over(order) + 1) * F.col(p)))
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    return stepped.withColumn("p_holm", F.when(F.col(p).isNotNull(), F.round(F.least(F.lit(1.0), F.max("_step").over(run)), 6))).drop("_step")


@F.pandas_udf(DoubleType())
def _two_tails(z: pd.Series) -> pd.Series:
    """The chance that a standard normal value is as far from 0 as ``z``."""
    return z.map(lambda x: math.erfc(abs(x) / math.sqrt(2)))


def rank_sum_chances(doubled: Column) -> Column:
    """The chances of each sum, from 0 on, of a random half of the whole numbers ``doubled``: one number after another joins or stays out."""

    def joined(law: Column, r: Column) -> Column:
        at = lambda k: F.coalesce(F.when(k >= 0, F.get(law, k.cast("int"))), F.lit(0.0))
        return F.transform(F.sequence(F.lit(0), F.size(law) - 1 + r), lambda k: (at(k) + at(k - r)) / 2)

    return F.aggregate(doubled, F.array(F.lit(1.0)), joined)


def wilcoxon(diffs: DataFrame, keys: list[str], exact_up_to: int = 50) -> DataFrame:
    """``n``, two-sided signed-rank ``p_value`` and rank-biserial ``effect_size``; null where all differences are 0.

    Equal magnitudes are counted before they are ranked, so a comparison's rows
    are never in one place. Up to ``exact_up_to`` the law of the rank sum is
    exact, ties included: ranks are doubled to whole numbers. Beyond, it is normal.
    """
    sizes = diffs.filter("diff <> 0").groupBy(*keys, F.abs("diff").alias("size")).agg(F.count("*").alias("m"), F.count_if(F.col("diff") > 0).alias("pos"))
    upto = F.sum("m").over(Window.partitionBy(*keys).orderBy("size").rowsBetween(Window.unboundedPreceding, 0))
    ranked = sizes.withColumn("doubled", (2 * upto - F.col("m") + 1).cast("int"))
    few = F.when(F.col("m") <= exact_up_to, F.array_repeat("doubled", F.col("m").cast("int")))
    per = ranked.groupBy(*keys).agg(F.sum("m").alias("n"), F.sum(F.col("pos") * F.col("doubled")).alias("plus"), F.slice(F.flatten(F.collect_list(few)), 1, exact_up_to).alias("ranks"))
    n, plus = F.col("n"), F.col("plus").cast("int")
    law = F.when(n <= exact_up_to, rank_sum_chances(F.col("ranks")))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)
    exact = 2 * F.least(total(F.slice("law", F.lit(1), plus + 1)), total(F.slice("law", plus + 1, F.size("law"))))
    z = (F.col("plus") / 2 - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    p = F.when(n <= exact_up_to, exact).otherwise(_two_tails(z))
    tested = per.withColumn("law", law).select(*keys, "n", F.least(F.lit(1.0), p).alias("p_value"), (2 * F.col("plus") / (n * (n + 1)) - 1).alias("effect_size"))
    return diffs.select(*keys).distinct().join(tested, keys, "left").na.fill(0, ["n"])


def drawn(resample: Column, draw: Column, n: Column, seed: int) -> Column:
    """Which of ``n`` rows a draw of a resample takes: a few rounds of squaring modulo a prime, the same on any engine."""
    prime = F.lit(2_147_483_647).cast("long")
    x = (resample.cast("long") * 1_000_003 + draw.cast("long") * 7_919 + F.lit(seed).cast("long") * 104_729 + 17) % prime
    for k in (12_345, 67_891, 23_456):
        x = (x * x + k) % prime
    return x % n


def bootstrap_interval(diffs: DataFrame, keys: list[str], resamples: int = 10_000, seed: int = 7, level: float = 0.95) -> DataFrame:
    """Percentile interval of the mean over questions, ``mean`` and ``n``; no interval for fewer than two.

    Resamples are rows: for each number of questions that occurs, each resample and
    draw, the place drawn, counted before it meets the differences of that place. So
    all comparisons share the draws, and none of them is in one task. Differences
    count to nine digits, so that sums do not depend on their order.
    """
    spark = diffs.sparkSession
    exact = diffs.filter(F.col("diff").isNotNull()).withColumn("diff", F.col("diff").cast("decimal(18,9)"))
    place = Window.partitionBy(*keys).orderBy("diff")
    numbered = exact.select(*keys, "diff", (F.row_number().over(place) - 1).cast("long").alias("place"), F.count("*").over(Window.partitionBy(*keys)).alias("n"))
    sizes = numbered.filter("n > 1").select("n").distinct()
    draws = spark.range(resamples).withColumnRenamed("id", "resample").join(F.broadcast(sizes)).withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    counts = draws.groupBy("n", "resample", drawn(F.col("resample"), F.col("draw"), F.col("n"), seed).alias("place")).agg(F.count("*").cast("int").alias("k"))  # an int, as a product with a long would lose digits
    means = numbered.join(counts, ["n", "place"]).groupBy(*keys, "resample").agg((F.sum(F.col("diff") * F.col("k")).cast("double") / F.max("n")).alias("m"))
    tails = means.groupBy(*keys).agg(F.percentile("m", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2))).alias("q"))
    per = exact.groupBy(*keys).agg(F.count("*").alias("n"), (F.sum("diff").cast("double") / F.count("*")).alias("mean"))
    both = diffs.select(*keys).distinct().join(per, keys, "left").join(tails, keys, "left")
    low, high = (F.round(F.get("q", F.lit(i)), 9).alias(name) for i, name in enumerate(("ci_low", "ci_high")))
    return both.select(*keys, F.coalesce("n", F.lit(0)).alias("n"), F.round("mean", 6).alias("mean"), low, high)


def planned_tests(diffs: DataFrame, plan: DataFrame, **resampling) -> DataFrame:
    """Every test of the plan, with data or without: the metric's kind picks the test, and the plan says what is corrected together.

    ``diffs``: ``effect``, ``metric``, ``query_id``, ``diff``. ``plan``: ``effect``,
    ``metric``, ``kind`` (``binary`` for the sign test, else signed ranks), ``role`` and
    ``correction`` (tests of the same one are corrected together by Holm; null: not at
    all). A test without a p-value counts in its correction.
    """
    keys = ["effect", "metric"]
    met = diffs.join(F.broadcast(plan.select(*keys, "kind")), keys)  # a plan is written by hand
    signs = sign_test(met.filter("kind = 'binary'"), keys).select(*keys, "n_ties", "effect_size", "p_value", F.lit("sign test").alias("test"))
    ties = met.filter("kind <> 'binary'").groupBy(*keys).agg(F.count_if(F.col("diff") == 0).alias("n_ties"))
    ranks = wilcoxon(met.filter("kind <> 'binary'"), keys).join(ties, keys)
    ranks = ranks.select(*keys, "n_ties", F.round("effect_size", 6).alias("effect_size"), F.round("p_value", 6).alias("p_value"), F.lit("signed ranks").alias("test"))
    spread = bootstrap_interval(met, keys, **resampling)
    every = plan.join(signs.union(ranks), keys, "left").join(spread, keys, "left").na.fill(0, ["n", "n_ties"])
    corrected = holm(every.filter("correction IS NOT NULL").select("correction", *keys, "p_value"), ["correction"]).select(*keys, "p_holm")
    return every.join(corrected, keys, "left").select(*keys, "role", "correction", "test", "n", "n_ties", "mean", "ci_low", "ci_high", "effect_size", "p_value", "p_holm")


def agreement(pairs: DataFrame, keys: list[str], least: float, most: float) -> DataFrame:
    """How ``l`` and ``r`` agree for each of ``keys``, in one pass: ``n``, ``exact``, ``within_one``, ``kappa``, ``rho``, four digits.

    ``pairs`` has ``ordinal`` too: kappa is quadratic where it is true, over the range
    from ``least`` to ``most`` or what lies beyond, and there alone one point apart and
    ranks mean anything. Pairs with a null are left out; a key without others has
    ``n`` = 0 and nulls. Pairs are counted by value first, so a task holds a key's
    different values, never its rows.
    """
    keyed = [*keys, "ordinal"]
    both = pairs.filter("l IS NOT NULL AND r IS NOT NULL").groupBy(*keyed, "l", "r").agg(F.count("*").alias("c"))
    own = Window.partitionBy(*keyed)

    def side(name: str) -> DataFrame:
        """A value's share of the pairs, and its average rank."""
        sizes = both.groupBy(*keyed, name).agg(F.sum("c").alias("m"))
        upto = F.sum("m").over(own.orderBy(name).rowsBetween(Window.unboundedPreceding, 0))
        return sizes.select(*keyed, name, F.col("m").alias("n_" + name), (upto - (F.col("m") - 1) / 2.0).alias("rank_" + name))

    full = side("l").join(side("r"), keyed).join(both, [*keyed, "l", "r"], "left").na.fill(0, ["c"])
    span = F.greatest(F.lit(most), F.max(F.greatest("l", "r")).over(own)) - F.least(F.lit(least), F.min(F.least("l", "r")).over(own))
    apart = F.abs(F.col("l") - F.col("r"))
    full = full.withColumn("penalty", F.when(F.col("ordinal"), F.pow(apart / span, F.lit(2))).otherwise((apart > 0).cast("double")))
    x, y, c = F.col("rank_l"), F.col("rank_r"), F.col("c")
    sums = full.groupBy(*keyed).agg(
        F.sum("c").alias("n"), F.sum(c * (apart == 0).cast("int")).alias("same"), F.sum(c * (apart <= 1).cast("int")).alias("near"),
        F.sum(F.col("penalty") * c).alias("seen"), F.sum(F.col("penalty") * F.col("n_l") * F.col("n_r")).alias("chance"),
        F.sum(c * x).alias("sx"), F.sum(c * y).alias("sy"), F.sum(c * x * y).alias("sxy"), F.sum(c * x * x).alias("sxx"), F.sum(c * y * y).alias("syy"),
    )
    n = F.col("n")
    kappa_ = F.when(F.col("chance") == 0, F.when(F.col("seen") == 0, 1.0).otherwise(0.0)).otherwise(1 - F.col("seen") * n / F.col("chance"))
    spread = (n * F.col("sxx") - F.col("sx") ** 2) * (n * F.col("syy") - F.col("sy") ** 2)
    rho = F.when(F.col("ordinal") & (n > 1) & (spread > 0), (n * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(spread))
    figures = sums.select(*keyed, "n", F.round(F.col("same") / n, 4).alias("exact"), F.round(F.when(F.col("ordinal"), F.col("near") / n), 4).alias("within_one"), F.round(kappa_, 4).alias("kappa"), F.round(rho, 4).alias("rho"))
    return pairs.select(*keyed).distinct().join(figures, keyed, "left").na.fill(0, ["n"]).drop("ordinal")


def kappa(pairs: DataFrame, levels: list[float], weights: str = "quadratic") -> DataFrame:
    """Cohen's kappa of ``l`` and ``r`` over declared and observed levels; one level 1.0, 4 digits."""
    both = pairs.filter("l IS NOT NULL AND r IS NOT NULL").select(F.col("l").cast("double").alias("l"), F.col("r").cast("double").alias("r"))
    cells = both.groupBy("l", "r").agg(F.count("*").alias("n"))  # levels squared at most
    left, right = cells.groupBy("l").agg(F.sum("n").alias("nl")), cells.groupBy("r").agg(F.sum("n").alias("nr"))
    declared = pairs.sparkSession.createDataFrame([(float(x),) for x in levels], "v double")
    scale = declared.union(left.select("l")).union(right.select("r")).distinct()
    size = scale.agg(F.count("*").alias("k"), F.max("v").alias("hi"), F.min("v").alias("lo"))
    total = cells.agg(F.sum("n").alias("total"))
    full = left.crossJoin(right).join(cells, ["l", "r"], "left").crossJoin(total).crossJoin(size)
    apart = F.abs(F.col("l") - F.col("r")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    w = {"quadratic": apart * apart, "linear": apart, "none": F.when(F.col("l") == F.col("r"), 0.0).otherwise(1.0)}[weights]
    sums = full.agg(F.sum(w * F.coalesce("n", F.lit(0)) / F.col("total")).alias("seen"), F.sum(w * F.col("nl") * F.col("nr") / F.col("total") / F.col("total")).alias("chance"), F.max("total").alias("n"), F.max("k").alias("k"))
    value = F.when(F.col("k") <= 1, 1.0).when(F.col("chance") == 0, F.when(F.col("seen") == 0, 1.0).otherwise(0.0)).otherwise(1 - F.col("seen") / F.col("chance"))
    return sums.select(F.lit(weights).alias("weights"), "n", F.round(value, 4).alias("kappa"))


def spearman(pairs: DataFrame) -> DataFrame:
    """Correlation of average ranks of ``l`` and ``r``, 4 digits; null for fewer than two pairs or a constant side.

    Ranks come from counts by value, so only distinct values are ordered in one
    place, and pairs are counted before they are correlated.
    """
    both = pairs.filter("l IS NOT NULL AND r IS NOT NULL").groupBy("l", "r").agg(F.count("*").alias("n"))

    def ranked(side: str) -> DataFrame:
        sizes = both.groupBy(side).agg(F.sum("n").alias("m"))
        upto = F.sum("m").over(Window.orderBy(side).rowsBetween(Window.unboundedPreceding, 0))
        return sizes.select(side, (upto - (F.col("m") - 1) / 2.0).alias("rank_" + side))

    x, y, n = F.col("rank_l"), F.col("rank_r"), F.col("n")
    sums = both.join(ranked("l"), "l").join(ranked("r"), "r").agg(F.sum(n).alias("n"), F.sum(n * x).alias("sx"), F.sum(n * y).alias("sy"), F.sum(n * x * y).alias("sxy"), F.sum(n * x * x).alias("sxx"), F.sum(n * y * y).alias("syy"))
    m = F.col("n")
    spread = (m * F.col("sxx") - F.col("sx") ** 2) * (m * F.col("syy") - F.col("sy") ** 2)
    rho = F.when((m >= 2) & (spread > 0), (m * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(spread))
    return sums.select("n", F.round(rho, 4).alias("rho"))
