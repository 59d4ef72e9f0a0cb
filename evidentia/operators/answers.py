"""Offline answers, judgements and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.text import band, judge_terms, same_refusal, share_of, strip, tokens, words

VERDICTS = ["correct", "partially_correct", "incorrect", "abstained", "unparsed"]


def context_text(selected: DataFrame, keys: list[str], separator: str = "\n") -> DataFrame:
    """The stripped chunk texts of each context in rank order; a context is bounded by its token budget."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: F.trim(x["text"]))
    return selected.groupBy(*keys).agg(F.array_join(texts, separator).alias("context"))


def fill_template(template: str, fields: dict[str, Column]) -> Column:
    """The template with each ``{name}`` replaced in one pass, so that values are never searched again."""
    parts: list[Column] = []
    rest = template
    while rest:
        found = [(rest.index("{" + name + "}"), name) for name in fields if "{" + name + "}" in rest]
        if not found:
            parts.append(F.lit(rest))
            break
        at, name = min(found)
        parts += [F.lit(rest[:at]), fields[name]]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts)


def extractive_answer(rows: DataFrame, refusal: str) -> DataFrame:
    """``answer``: the context's first sentence with the most distinct words of the question, or the refusal."""
    asked = F.array_distinct(words(F.col("question")))
    sentences = F.regexp_extract_all("context", F.lit(r"[^.!?\n]+[.!?]?"), F.lit(0))
    scored = F.transform(sentences, lambda s, i: F.struct(F.size(F.array_intersect(asked, words(s))).alias("hits"), (-i).alias("turn"), F.trim(s).alias("s")))
    best = F.array_max(scored)
    return rows.withColumn("answer", F.when(best["hits"] > 0, best["s"]).otherwise(F.lit(refusal)))


def overlap_judge(rows: DataFrame, refusal: str) -> DataFrame:
    """Three scales from 1 to 5 and a verdict by shared terms; an exact refusal abstains and has no scales.

    ``rows``: ``question``, ``context``, ``answer``, ``reference``.
    """
    named = rows.withColumn("_a", judge_terms(F.col("answer")))
    grounded, asked, held = share_of(judge_terms(F.col("context")), F.col("_a")), share_of(F.col("_a"), judge_terms(F.col("question"))), share_of(F.col("_a"), judge_terms(F.col("reference")))
    abstains = same_refusal(F.col("answer"), F.lit(refusal))
    verdict = F.when(abstains, "abstained").when(held >= 0.7, "correct").when(held >= 0.35, "partially_correct").otherwise("incorrect")
    scale = lambda share: F.when(~abstains, band(share))
    return named.select(*[c for c in rows.columns], verdict.alias("verdict"), scale(grounded).alias("faithfulness"), scale(asked).alias("relevance"), scale(held).alias("completeness")).drop("_a")


def verdict_counts(judged: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of every permitted verdict, zeros too."""
    spark = judged.sparkSession
    vocabulary = spark.createDataFrame([(v,) for v in VERDICTS], "verdict string")
    grid = judged.select(*keys).distinct().crossJoin(F.broadcast(vocabulary))  # five rows
    counts = judged.groupBy(*keys, "verdict").agg(F.count("*").alias("n"))
    return grid.join(counts, [*keys, "verdict"], "left").na.fill(0, ["n"])


def judge_summary(judged: DataFrame, keys: list[str]) -> DataFrame:
    """Scale means over scored answers alone; rates of abstention and correctness over all."""
    share = lambda v: F.round(F.avg(F.when(F.col("verdict") == v, 1.0).otherwise(0.0)), 6)
    return judged.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count("relevance").alias("n_scored"),
        *(F.round(F.avg(c), 6).alias(c) for c in ("faithfulness", "relevance", "completeness")),
        share("correct").alias("correct_rate"),
        share("abstained").alias("abstention_rate"),
    )


def rolling_load(calls: DataFrame, ts: str, cost: Column, seconds: int = 60) -> DataFrame:
    """Requests and tokens of the last ``seconds`` up to each call, of one client (``client``); one just ``seconds`` old has left.

    Calls are dealt out by client and span of ``seconds``; each span also has the
    calls of the one before, so that no task holds all calls of a client.
    """
    width = seconds * 1_000_000
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    timed = calls.withColumn("tokens", cost).withColumn("_at", at).withColumn("_span", F.floor(at / width))
    copies = F.explode(F.array(F.struct(F.col("_span").alias("span"), F.lit(False).alias("guest")), F.struct((F.col("_span") + 1).alias("span"), F.lit(True).alias("guest"))))
    spread = timed.withColumn("_in", copies)
    window = Window.partitionBy("client", "_in.span").orderBy("_at").rangeBetween(1 - width, 0)
    counted = spread.withColumn("window_requests", F.count("*").over(window)).withColumn("window_tokens", F.sum("tokens").over(window))
    return counted.filter("NOT _in.guest").drop("_at", "_span", "_in")


def cut_answer(rows: DataFrame, most: int) -> DataFrame:
    """``answer`` cut off after ``most`` tokens, with ``n_completion_tokens`` and ``finish_reason``: ``length`` if it was cut, else ``stop``."""
    held = rows.withColumn("_t", tokens(F.col("answer")))
    cut = F.size("_t") > most
    out = held.withColumn("answer", F.when(cut, F.array_join(F.slice("_t", 1, most), " ")).otherwise(F.col("answer")))
    return out.withColumn("n_completion_tokens", F.least(F.size("_t"), F.lit(most))).withColumn("finish_reason", F.when(cut, "length").otherwise("stop")).drop("_t")


#: The scales of a judgement, their range, and the reasons why a reply is none.
SCALES = ("faithfulness", "relevance", "completeness")
LOWEST, HIGHEST = 1, 5


def json_object(reply: Column) -> Column:
    """From the first opening brace to the last closing one, of what a fence holds if there is one; null where there is none."""
    bare = strip(reply)
    opened = F.when(F.contains(bare, F.lit("\n")), F.regexp_replace(bare, r"(?s)\A[^\n]*\n", "")).otherwise(bare)
    inside = F.when(F.startswith(bare, F.lit("```")), F.regexp_replace(opened, r"(?s)```(?!.*```).*\z", "")).otherwise(bare)
    return F.nullif(F.regexp_extract(inside, r"(?s)\{.*\}", 0), F.lit(""))


def parse_verdicts(rows: DataFrame, reply: str = "reply") -> DataFrame:
    """``rows`` with ``verdict``, the three scales, ``rationale`` and ``error``.

    A reply outside the vocabulary or the range is ``unparsed`` with the reason:
    nothing is coerced. An abstention has no scales, even where the reply names some.
    """
    found = rows.withColumn("_o", json_object(F.col(reply)))
    field = lambda name: F.get_json_object("_o", f"$.{name}")
    named = F.replace(F.lower(strip(F.coalesce(field("verdict"), F.lit("")))), F.lit(" "), F.lit("_"))
    # A boolean counts as 1 or 0, a text only if it is a number: the type is the JSON value's own.
    boolean = {s: F.expr(f"schema_of_variant(try_variant_get(try_parse_json(_o), '$.{s}', 'variant'))") == "BOOLEAN" for s in SCALES}
    number = {s: F.when(boolean[s], (field(s) == "true").cast("double")).otherwise(F.expr(f"try_cast(get_json_object(_o, '$.{s}') AS double)")) for s in SCALES}
    reason = F.when(F.col("_o").isNull(), "no object").when(F.expr("try_parse_json(_o) IS NULL"), "broken object").when(~named.isin(*VERDICTS[:-1]), "unknown verdict").when(named == "abstained", F.lit(None))
    for s in SCALES:
        reason = reason.when(field(s).isNull(), f"{s} is missing").when(number[s].isNull(), f"{s} is no number").when(~number[s].between(LOWEST, HIGHEST), f"{s} is out of range")
    held = found.withColumn("error", reason).withColumn("verdict", F.when(F.col("error").isNull(), named).otherwise("unparsed"))
    scored = F.col("error").isNull() & (F.col("verdict") != "abstained")
    for s in SCALES:
        held = held.withColumn(s, F.when(scored, number[s]))
    return held.withColumn("rationale", F.when(F.col("error").isNull(), strip(F.coalesce(field("rationale"), F.lit(""))))).drop("_o")


def judge_view(judged: DataFrame, keys: list[str]) -> DataFrame:
    """Scale means over passes and the verdict of the lowest pass, with ``correct`` and ``abstained``; an unparsed one is not correct."""
    means = [F.round(F.avg(s), 6).alias(s) for s in SCALES]
    per = judged.groupBy(*keys).agg(F.count("*").alias("n_passes"), F.min_by("verdict", "pass_index").alias("verdict"), *means)
    flag = lambda v: (F.col("verdict") == v).cast("int")
    return per.withColumn("correct", flag("correct")).withColumn("abstained", flag("abstained"))


def self_consistency(judged: DataFrame, keys: list[str]) -> DataFrame:
    """How the two lowest passes agree on each scale, over the questions of both: a row for each scale and the verdict."""
    passes = judged.select("pass_index").distinct().orderBy("pass_index").limit(2).collect()
    first, second = [r["pass_index"] for r in passes] if len(passes) == 2 else (None, None)
    of = lambda p, side: judged.filter(F.col("pass_index").eqNullSafe(F.lit(p))).select(*keys, F.array(*(F.struct(F.lit(s).alias("scale"), F.col(s).alias("v")) for s in SCALES), F.struct(F.lit("verdict").alias("scale"), F.when(F.col("verdict") != "unparsed", F.array_position(F.array(*map(F.lit, VERDICTS)), F.col("verdict"))).cast("double").alias("v"))).alias(side))
    both = of(first, "l").join(of(second, "r"), keys).select(F.explode(F.arrays_zip("l", "r")).alias("x")).select(F.col("x.l.scale").alias("scale"), F.col("x.l.v").alias("l"), F.col("x.r.v").alias("r"))
    rated = F.col("l").isNotNull() & F.col("r").isNotNull()
    share = lambda c: F.round(F.avg(F.when(rated, c.cast("double"))), 6)
    near = F.when(F.col("scale") != "verdict", F.abs(F.col("l") - F.col("r")) <= 1)
    return both.groupBy("scale").agg(F.count("*").alias("n_items"), F.count_if(rated).alias("n"), share(F.col("l") == F.col("r")).alias("exact"), share(near).alias("within_one"))


def passes_side_by_side(judged: DataFrame, cell: list[str], key: str) -> DataFrame:
    """``scale``, ``ordinal``, ``l`` and ``r`` of the two lowest passes of each cell, for the questions of both; verdicts by their number, none if unparsed."""
    order = F.dense_rank().over(Window.partitionBy(*cell).orderBy("pass_index"))
    lowest = judged.select(*cell, "pass_index").distinct().withColumn("turn", order).filter("turn <= 2")  # a row a pass
    code = F.when(F.col("verdict") != "unparsed", F.array_position(F.array(*map(F.lit, VERDICTS)), F.col("verdict")).cast("double"))
    each = F.array(*(F.struct(F.lit(s).alias("scale"), F.lit(True).alias("ordinal"), F.col(s).alias("v")) for s in SCALES), F.struct(F.lit("verdict").alias("scale"), F.lit(False).alias("ordinal"), code.alias("v")))
    long = judged.join(F.broadcast(lowest), [*cell, "pass_index"]).select(*cell, key, "turn", F.explode(each).alias("x")).select(*cell, key, "turn", "x.*")
    turn = lambda k: F.max(F.when(F.col("turn") == k, F.col("v")))
    held = long.groupBy(*cell, key, "scale", "ordinal").agg(turn(1).alias("l"), turn(2).alias("r"), F.count_distinct("turn").alias("passes"))
    return held.filter("passes = 2").drop("passes")


def judge_report(judged: DataFrame, cell: list[str], key: str) -> DataFrame:
    """A row a cell, over all passes: a scale's mean is that of the questions' means over passes; verdicts and rates are the lowest pass's.

    Rates are 0.0 where there is no answer; a scale that no one rated has a null mean.
    """
    first = F.min("pass_index").over(Window.partitionBy(*cell))
    per = judged.withColumn("first", first).groupBy(*cell, key).agg(
        F.count("*").alias("rows"),
        F.max(F.when(F.col("pass_index") == F.col("first"), F.col("verdict"))).alias("verdict"),
        *(F.avg(s).alias(s) for s in SCALES),
    )
    passes = judged.groupBy(*cell).agg(F.count_distinct("pass_index").alias("n_passes"))
    of = lambda v: F.count_if(F.col("verdict") == v)
    total = F.count("*")
    out = per.groupBy(*cell).agg(
        F.sum("rows").alias("n_judgements"), total.alias("n_answers"),
        *(x for s in SCALES for x in (F.round(F.avg(s), 3).alias(s), F.count(s).alias(f"{s}_n"))),
        *(of(v).alias(v) for v in VERDICTS), (total - of("abstained") - of("unparsed")).alias("n_scored"),
        F.round(of("abstained") / total, 4).alias("abstention_rate"), F.round(of("correct") / total, 4).alias("correct_rate"),
    )
    return out.join(passes, cell)
