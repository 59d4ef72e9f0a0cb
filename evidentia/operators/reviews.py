"""Selection, sections, guards and reports of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text as T


#: How a question with a blank begins, and the blank.
CLOZE_LEAD, BLANK = "Complete the reported finding: ", "____"


def eligibility(kind: Column, allowed: list[str], url: Column, patterns: list[str]) -> Column:
    """The first reason against a document, with its value: its kind, then its license; null for an eligible one. An empty list lets all pass."""
    stated = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("missing"))
    reason = F.lit(None).cast("string")
    if patterns:
        licensed = F.exists(F.array(*map(F.lit, patterns)), lambda p: F.contains(url, p))
        reason = F.when(~F.coalesce(licensed, F.lit(False)), F.concat(F.lit("license="), stated(url)))
    if allowed:
        reason = F.when(~F.coalesce(kind.isin(allowed), F.lit(False)), F.concat(F.lit("article_type="), stated(kind))).otherwise(reason)
    return reason


def take_target(rows: DataFrame, order: list, reason: str, target: int) -> DataFrame:
    """What became of the rows considered until ``target`` passed: ``reason`` (null: taken) and ``n``, with the totals beside each.

    The last row needed is the ``target``-th in the order that has no reason
    against it: a top-k, so nothing is numbered over the whole table. No row, no result.
    """
    keyed = rows.select(F.struct(*order).alias("place"), F.col(reason).alias("reason"))
    taken = keyed.filter("reason IS NULL").orderBy("place").limit(target)
    end = taken.agg(F.count("*").alias("held"), F.max("place").alias("last"))
    seen = keyed.crossJoin(F.broadcast(end)).filter((F.col("held") < target) | (F.col("place") <= F.col("last")))  # one row
    counts = seen.groupBy("reason").agg(F.count("*").alias("n"))
    totals = counts.agg(F.sum("n").alias("considered"), F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.col("n"))), F.lit(0)).alias("taken"))
    return counts.crossJoin(F.broadcast(totals)).withColumn("rejected", F.col("considered") - F.col("taken")).withColumn("short", F.lit(target) - F.col("taken"))  # one row


def survey(rows: DataFrame, key: str, date: str, low: str, high: str) -> DataFrame:
    """Different ids a year between two dates, with the totals beside each: the years are a partition if their ids add up to all hits of the whole range."""
    hits = rows.filter(F.col(date).between(F.lit(low).cast("date"), F.lit(high).cast("date"))).select(F.col(key).alias("id"), F.year(date).alias("year"))
    per = hits.groupBy("year").agg(F.count_distinct("id").alias("n"))
    whole = hits.agg(F.count("*").alias("whole_range"), F.count_distinct("id").alias("unique_total"))
    sums = per.agg(F.sum("n").alias("partition_total"))
    return per.crossJoin(F.broadcast(sums.crossJoin(whole))).withColumn("exact", F.col("partition_total") == F.col("whole_range"))  # one row


def overlapping_titles(chunks: DataFrame, sections: DataFrame, key: list[str]) -> DataFrame:
    """``titles`` of the sections that a chunk overlaps: non-blank, once each, in the order of the sections.

    ``sections``: ``doc_id``, ``pos``, ``title``, ``s_start``, ``s_end``. The join is on the document.
    """
    met = chunks.select("doc_id", *key, "char_start", "char_end").join(sections.filter("title <> ''"), "doc_id").filter("char_start < s_end AND char_end > s_start")
    titles = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "title"))), lambda x: x["title"]))
    held = met.groupBy("doc_id", *key).agg(titles.alias("titles"))
    return chunks.select("doc_id", *key).join(held, ["doc_id", *key], "left").withColumn("titles", F.coalesce("titles", F.array().cast("array<string>")))


def deepest_containing(spans: DataFrame, sections: DataFrame, key: list[str], value: str, wanted: Column, default: str) -> DataFrame:
    """The ``value`` of the deepest section that holds a whole span and is ``wanted``; ties go to the first."""
    met = spans.join(sections.filter(wanted), "doc_id").filter("s_start <= char_start AND char_end <= s_end")
    best = met.groupBy("doc_id", *key).agg(F.max_by(value, F.struct("depth", -F.col("pos"))).alias(value))
    return spans.select("doc_id", *key).join(best, ["doc_id", *key], "left").withColumn(value, F.coalesce(value, F.lit(default)))


def passages(blocks: DataFrame, headings: DataFrame, excluded: list[str], least: int, most: int) -> DataFrame:
    """The blocks that can be passages: no heading, no placeholder, a whole sentence at the end, a section that is not excluded, a fitting size.

    ``blocks``: ``doc_id``, ``char_start``, ``char_end``, ``text``, ``section``.
    """
    size = F.size(T.tokens(F.col("text")))
    barred = F.exists(F.array(*map(F.lit, excluded)), lambda p: F.contains(F.lower("section"), p)) if excluded else F.lit(False)
    fits = F.rlike("text", F.lit(T.SENTENCE_END)) & ~F.rlike("text", F.lit(r"\[TABLE:|\[EQUATION\]")) & ~barred & size.between(least, most)
    titled = headings.select("doc_id", F.col("s_start").alias("char_start"), F.col("title").alias("text")).distinct()
    return blocks.filter(fits).withColumn("n_tokens", size).join(titled, ["doc_id", "char_start", "text"], "left_anti")


def within_room(rows: DataFrame, group: str, order: list, room: int, held: DataFrame) -> DataFrame:
    """The first of each group in ``order`` that there is room for beside those ``held`` already (``group``, ``n_held``)."""
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    free = F.lit(room) - F.coalesce("n_held", F.lit(0))
    return ranked.join(held, group, "left").filter(F.col("rn") <= free).drop("n_held")


def draw(rows: DataFrame, pins: DataFrame, key: str, group: str, n: int, each: int) -> DataFrame:
    """Pinned rows in the order of their pins, then others until there are ``n``, ``each`` of a group at most, pinned ones counted.

    ``rows``: ``on_topic``, ``tier``, ``order`` (a row's turn in its group) and ``mixed``
    (a group's turn) beside ``key`` and ``group``. ``pins``: ``key``, ``pin``. Of the
    others only those on topic are drawn, and pinned ones are taken out before a group's
    tier is read off its first row. A pin without its row is an error: what was reviewed
    must stay drawable. Pinned rows are kept even if they are more than ``n``.
    """
    pinned = rows.join(F.broadcast(pins), key)  # a list written by hand
    held = pinned.groupBy(group).agg(F.count("*").alias("n_held"))
    found, asked = pinned.count(), pins.count()
    if found < asked:
        raise ValueError(f"{asked - found} pinned rows are not there any more")
    fresh = rows.filter("on_topic").join(F.broadcast(pins.select(key)), key, "left_anti")
    fresh = within_room(fresh, group, ["order", key], each, held)
    first = fresh.groupBy(group).agg(F.min_by("tier", "rn").alias("group_tier"))
    chosen = fresh.join(first, group).orderBy("group_tier", "mixed", group, "rn").limit(max(0, n - found)).drop("group_tier", "rn")
    return pinned.unionByName(chosen, allowMissingColumns=True)


def compare_arms(rows: DataFrame, arm: str, value: str, target: Column) -> DataFrame:
    """One row for two arms, none for any other number: medians, their ratio, deviations, mean fill and counts."""
    per = rows.groupBy(arm).agg(F.count("*").alias("n"), F.percentile(value, 0.5).alias("median"), F.stddev_pop(value).alias("std"), F.avg(F.col(value) / target).alias("fill"))
    both = per.agg(F.array_sort(F.collect_list(F.struct(arm, "n", "median", "std", "fill"))).alias("a"), F.max("median").alias("hi"), F.min("median").alias("lo")).filter(F.size("a") == 2)
    named = [F.round(F.col("a")[k][c], 4).alias(f"{c}_{side}") if c != "n" else F.col("a")[k][c].alias(f"n_{side}") for k, side in enumerate(("a", "b")) for c in ("n", "median", "std", "fill")]
    return both.select(F.col("a")[0][arm].alias("arm_a"), F.col("a")[1][arm].alias("arm_b"), *named, F.round(F.when(F.col("lo") > 0, F.col("hi") / F.col("lo")), 2).alias("ratio"))


def changed(stored: DataFrame, now: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """What a run may not go on with: rows of before that are unknown now, or whose digest differs. Empty when all is well."""
    met = stored.select(*keys, F.col(digest).alias("before")).join(now.select(*keys, F.col(digest).alias("after")), keys, "left")
    return met.filter(~F.col("before").eqNullSafe(F.col("after"))).select(*keys, F.when(F.col("after").isNull(), "unknown").otherwise("changed").alias("problem"))


def freeze_refusals(rows: DataFrame, target: int, least_terms: int) -> DataFrame:
    """Seven counts in the order in which a freeze is refused; all 0 when nothing stands against it.

    ``rows``: ``doc_id``, ``verified``, ``drafter``, ``reasons``, ``score``, ``override``, ``note``.
    """
    off = F.col("score") < least_terms
    per = rows.groupBy("doc_id").agg(
        F.count("*").alias("n"),
        F.count_if(~F.col("verified")).alias("a"),
        F.count_if(F.col("drafter") == "stand-in").alias("b"),
        F.count_if(F.col("reasons") != "").alias("c"),
        F.count_if(off & ~F.col("override")).alias("e"),
        F.count_if(F.col("override") & (T.strip(F.col("note")) == "")).alias("f"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return per.agg(
        total("a").alias("unverified"), total("b").alias("stand_in"), total("c").alias("rejected"), F.abs(total("n") - target).alias("wrong_count"),
        total("e").alias("off_topic"), total("f").alias("without_note"), F.count_if(F.col("n") > 1).alias("several_a_document"),
    )


def capped(calls: DataFrame, keys: list[str], order: list, cost: str, estimate: int, cap: int) -> DataFrame:
    """Whether a session has to pause before each call: what it has spent so far and an estimate exceed the cap."""
    run = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(cost).over(run), F.lit(0))
    return calls.withColumn("spent", spent.cast("long")).withColumn("paused", F.col("spent") + estimate > cap)


def cloze(passages_: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """The longest sentence of a passage (the first of equal ones) with its rarest content word blanked, and that word.

    ``df``: ``term``, ``df``. Ties of rarity go by the word.
    """
    sentences = F.filter(F.split("text", r"(?<=[.!?])\s+"), lambda s: T.strip(s) != "")
    longest = F.array_max(F.transform(sentences, lambda s, i: F.struct(F.length(s).alias("n"), (-i).alias("turn"), s.alias("s"))))["s"]
    chosen = passages_.select(key, longest.alias("sentence"))
    terms = chosen.select(key, F.explode(F.array_distinct(T.content_tokens(F.col("sentence")))).alias("term"))
    rarest = terms.join(df, "term", "left").groupBy(key).agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("r")).select(key, F.col("r.term").alias("answer"))
    # The word itself, not a part of another one; where it does not stand alone, nothing is blanked.
    at = F.regexp_instr("sentence", F.concat(F.lit(r"(?iU)\b\Q"), "answer", F.lit(r"\E\b")))
    blanked = F.when(at > 0, F.concat(F.substring("sentence", F.lit(1), at - 1), F.lit(BLANK), F.substring("sentence", at + F.length("answer"), F.length("sentence")))).otherwise(F.col("sentence"))
    return chosen.join(rarest, key).select(key, F.concat(F.lit(CLOZE_LEAD), blanked).alias("question"), "answer")


def draft_reply(reply: Column) -> Column:
    """Question and answer of a drafter's reply, in that order, as a struct; null where either is missing."""
    part = lambda k: T.strip(F.regexp_extract(reply, r"(?s)QUESTION:(.*?)ANSWER:(.*)", k))
    question, answer = part(1), part(2)
    return F.when((question != "") & (answer != ""), F.struct(question.alias("question"), answer.alias("answer")))
