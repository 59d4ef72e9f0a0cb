"""Queries on verdicts, sections, selection, guards and reports, each beside SQL that says the same."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text as T
from evidentia.operators import answers, chunking, effects, reports, reviews
from evidentia.plans.catalogue import _CONTENT_STOP, _DISTRIBUTION, CELL, REFUSAL, SQL_ANSWERS, SQL_BLOCKS, SQL_CHUNKS, SQL_GOLD, SQL_METRICS, answered, block_table, chunk_table, facts, gold, query, table
from evidentia.plans.checks import SQL_CANDIDATES, candidates

# --- judges' replies: two passes over the labelled documents ---------------------

_REPLY = """CASE doc_id % 7 WHEN 0 THEN 'I cannot say.' WHEN 1 THEN '```json' || chr(10) || '{"verdict": "Correct", "faithfulness": 5, "relevance": ' || CAST(4 + pass_index AS STRING) || ', "completeness": 3, "rationale": " fine "}' || chr(10) || '```'
WHEN 2 THEN 'Sure: {"verdict": "partially correct", "faithfulness": 3, "relevance": "4", "completeness": 2}' WHEN 3 THEN '{"verdict": "good", "faithfulness": 3, "relevance": 4, "completeness": 2}' WHEN 4 THEN '{"verdict": "abstained", "faithfulness": null}'
WHEN 5 THEN '{"verdict": "incorrect", "faithfulness": 7, "relevance": 1, "completeness": 1}' ELSE '{"verdict": "' || CASE WHEN quality = 1 AND pass_index = 1 THEN 'correct' ELSE 'incorrect' END || '", "faithfulness": 1, "relevance": ' || CAST(1 + quality AS STRING) || ', "completeness": ' || CAST(2 + toxic + quality * pass_index AS STRING) || '}' END"""
_FIELD = lambda f: f"json_extract_string(o, '$.{f}')"
_NUM = lambda f: f"try_cast({_FIELD(f)} AS DOUBLE)"
_BAD = " ".join(f"WHEN {_FIELD(f)} IS NULL THEN '{f} is missing' WHEN {_NUM(f)} IS NULL THEN '{f} is no number' WHEN {_NUM(f)} NOT BETWEEN 1 AND 5 THEN '{f} is out of range'" for f in answers.SCALES)
SQL_VERDICTS = f"""
rp AS (SELECT doc_id, pass_index, quality, toxic, {_REPLY} AS reply FROM labels, (VALUES (0), (1)) p(pass_index)),
ob AS (SELECT *, nullif(regexp_extract(reply, '(?s)\\{{.*\\}}'), '') AS o FROM rp),
er AS (SELECT *, replace(lower(trim({_FIELD("verdict")})), ' ', '_') AS named, CASE WHEN o IS NULL THEN 'no object' WHEN replace(lower(trim({_FIELD("verdict")})), ' ', '_') NOT IN ('correct', 'partially_correct', 'incorrect', 'abstained') THEN 'unknown verdict'
  WHEN replace(lower(trim({_FIELD("verdict")})), ' ', '_') = 'abstained' THEN NULL {_BAD} END AS error FROM ob),
vd AS (SELECT doc_id, pass_index, CASE WHEN error IS NULL THEN named ELSE 'unparsed' END AS verdict, error, {", ".join(f"CASE WHEN error IS NULL AND named <> 'abstained' THEN {_NUM(f)} END AS {f}" for f in answers.SCALES)} FROM er),
jv AS (SELECT doc_id, count(*) AS n_passes, arg_min(verdict, pass_index) AS verdict, {", ".join(f"round(avg({f}), 6) AS {f}" for f in answers.SCALES)} FROM vd GROUP BY doc_id),
sr AS (SELECT *, CASE WHEN verdict = 'correct' THEN 1 ELSE 0 END AS correct, CASE WHEN verdict = 'abstained' THEN 1 ELSE 0 END AS abstained FROM jv)"""


def verdicts(spark, d) -> DataFrame:
    both = table(spark, d, "labels").withColumn("pass_index", F.explode(F.array(F.lit(0), F.lit(1))))
    return answers.parse_verdicts(both.select("doc_id", "pass_index", F.expr(_REPLY).alias("reply")))


@query(f"WITH {SQL_VERDICTS} SELECT * FROM vd")
def verdict_replies(spark, d):
    return verdicts(spark, d).select("doc_id", "pass_index", "verdict", "error", *answers.SCALES)


@query(f"WITH {SQL_VERDICTS} SELECT doc_id, pass_index, verdict FROM vd WHERE verdict <> 'unparsed'")
def parsed_only(spark, d):
    return verdicts(spark, d).filter("verdict <> 'unparsed'").select("doc_id", "pass_index", "verdict")


@query(f"WITH {SQL_VERDICTS} SELECT * FROM sr")
def stats_rows(spark, d):
    return answers.judge_view(verdicts(spark, d), ["doc_id"])


@query(f"WITH {SQL_VERDICTS} SELECT source, count(*) AS n, count(*) FILTER (relevance IS NOT NULL) AS n_scored, sum(correct)::BIGINT AS n_correct, sum(abstained)::BIGINT AS n_abstained, count(*) FILTER (verdict = 'unparsed') AS n_unparsed FROM sr JOIN documents USING (doc_id) GROUP BY source")
def availability(spark, d):
    rows = answers.judge_view(verdicts(spark, d), ["doc_id"]).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count("relevance").alias("n_scored"), F.sum("correct").alias("n_correct"), F.sum("abstained").alias("n_abstained"), F.count_if(F.col("verdict") == "unparsed").alias("n_unparsed"))


_CODES = "list_position(['correct', 'partially_correct', 'incorrect', 'abstained'], verdict)::DOUBLE"


@query(
    f"""WITH {SQL_VERDICTS}, lg AS (SELECT doc_id, pass_index, unnest(['faithfulness', 'relevance', 'completeness', 'verdict']) AS scale, unnest([faithfulness, relevance, completeness, {_CODES}]) AS v FROM vd),
b AS (SELECT a.scale, a.v AS l, z.v AS r FROM lg a JOIN lg z ON a.doc_id = z.doc_id AND a.scale = z.scale AND a.pass_index = 0 AND z.pass_index = 1)
SELECT scale, count(*) AS n_items, count(*) FILTER (l IS NOT NULL AND r IS NOT NULL) AS n, round(avg(CASE WHEN l = r THEN 1.0 WHEN l IS NULL OR r IS NULL THEN NULL ELSE 0 END), 6) AS exact,
round(avg(CASE WHEN scale = 'verdict' OR l IS NULL OR r IS NULL THEN NULL WHEN abs(l - r) <= 1 THEN 1.0 ELSE 0 END), 6) AS within_one FROM b GROUP BY scale"""
)
def self_consistency(spark, d):
    return answers.self_consistency(verdicts(spark, d), ["doc_id"])


@query(f"WITH {SQL_VERDICTS} SELECT count(*) AS n, round(avg(1 + 4 * quality), 6) AS mean_human, round(avg(completeness), 6) AS mean_judge, round(avg(1 + 4 * quality) - avg(completeness), 6) AS difference, count(*) FILTER (completeness <> floor(completeness)) AS n_half FROM sr JOIN labels USING (doc_id) WHERE completeness IS NOT NULL")
def rater_offset(spark, d):
    met = answers.judge_view(verdicts(spark, d), ["doc_id"]).join(table(spark, d, "labels"), "doc_id").filter("completeness IS NOT NULL")
    human, judge = F.avg(1 + 4 * F.col("quality")), F.avg("completeness")
    return met.agg(F.count("*").alias("n"), F.round(human, 6).alias("mean_human"), F.round(judge, 6).alias("mean_judge"), F.round(human - judge, 6).alias("difference"), F.count_if(F.col("completeness") != F.floor("completeness")).alias("n_half"))


@query(
    f"""WITH {SQL_VERDICTS}, sheet AS (SELECT substr(sha256('sheet:' || doc_id), 1, 12) AS item_id, 1 + 4 * quality AS human FROM labels WHERE toxic = 0), key AS (SELECT substr(sha256('sheet:' || doc_id), 1, 12) AS item_id, doc_id FROM documents WHERE lang = 'en')
SELECT s.item_id, k.doc_id, s.human, j.verdict, CASE WHEN k.doc_id IS NULL THEN 'no key' WHEN j.doc_id IS NULL THEN 'no judgement' ELSE 'matched' END AS status FROM sheet s LEFT JOIN key k USING (item_id) LEFT JOIN sr j ON j.doc_id = k.doc_id"""
)
def calibration_join(spark, d):
    opaque = F.substring(F.sha2(F.concat(F.lit("sheet:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 12).alias("item_id")
    sheet = table(spark, d, "labels").filter("toxic = 0").select(opaque, (1 + 4 * F.col("quality")).alias("human"))
    key = table(spark, d, "documents").filter("lang = 'en'").select(opaque, "doc_id")
    judged = answers.judge_view(verdicts(spark, d), ["doc_id"]).select(F.col("doc_id").alias("j_id"), "verdict")
    met = sheet.join(key, "item_id", "left").join(judged, F.col("doc_id") == F.col("j_id"), "left")
    return met.select("item_id", "doc_id", "human", "verdict", F.when(F.col("doc_id").isNull(), "no key").when(F.col("j_id").isNull(), "no judgement").otherwise("matched").alias("status"))


# --- sections ----------------------------------------------------------------------

SQL_SECTIONS = r"""
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
sec AS (SELECT doc_id, i AS pos, 1 AS depth, array_to_string(list_filter(string_split(l, ' '), lambda w: w <> '')[1:2], ' ') AS title, CAST(sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(l) - 1 AS BIGINT) AS s_start, CAST(sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS BIGINT) AS s_end FROM ln
  UNION ALL SELECT doc_id, 0, 0, source, 0, length(text) FROM documents)"""
_KIND = lambda t: f"CASE WHEN contains(lower({t}), 'src') THEN 'background' WHEN contains(lower({t}), 'th') OR contains(lower({t}), 'die') THEN 'results' WHEN contains(lower({t}), 'an') THEN 'methods' ELSE 'other' END"
_KINDS = {"background": ["src"], "results": ["th", "die"], "methods": ["an"]}


def sections(spark, d) -> DataFrame:
    """A section for each line, titled by its first two words, within one for the document, titled by its source."""
    docs = table(spark, d, "documents")
    lines = F.transform(F.split("text", "\n"), lambda l: F.struct(F.length(l).alias("n"), F.array_join(F.slice(F.filter(F.split(l, " "), lambda w: w != ""), 1, 2), " ").alias("title")))
    each = docs.select("doc_id", F.posexplode(lines).alias("i", "l"))
    run = Window.partitionBy("doc_id").orderBy("i")
    start = F.sum(F.col("l.n") + 1).over(run) - F.col("l.n") - 1
    own = each.select("doc_id", (F.col("i") + 1).alias("pos"), F.lit(1).alias("depth"), F.col("l.title").alias("title"), start.alias("s_start"), (start + F.col("l.n")).alias("s_end"))
    return own.union(docs.select("doc_id", F.lit(0), F.lit(0), "source", F.lit(0).cast("long"), F.length("text").cast("long")))


@query(
    f"""WITH {SQL_CHUNKS}, {SQL_SECTIONS}, m AS (SELECT c.doc_id, c.chunk_index, title, min(pos) AS p FROM chunks c JOIN sec s ON c.doc_id = s.doc_id AND c.char_start < s.s_end AND c.char_end > s.s_start WHERE chunking = 'coarse' AND title <> '' GROUP BY ALL)
SELECT c.doc_id, c.chunk_index, coalesce(sha256(string_agg(title, '|' ORDER BY p)), sha256('')) AS titles_sha256, count(title) AS n_titles FROM chunks c LEFT JOIN m ON m.doc_id = c.doc_id AND m.chunk_index = c.chunk_index WHERE chunking = 'coarse' GROUP BY ALL"""
)
def chunk_sections(spark, d):
    held = reviews.overlapping_titles(chunking.fixed_chunks(table(spark, d, "documents"), 256), sections(spark, d), ["chunk_index"])
    return held.select("doc_id", "chunk_index", F.sha2(F.array_join("titles", "|").cast("binary"), 256).alias("titles_sha256"), F.size("titles").alias("n_titles"))


def _gold_spans(spark, d) -> DataFrame:
    return gold(spark, d).select("item_id", F.col("gold_doc").alias("doc_id"), F.col("gold_start").alias("char_start"), F.col("gold_end").alias("char_end"))


@query(f"WITH {SQL_GOLD}, {SQL_SECTIONS}, m AS (SELECT g.item_id, arg_max(title, depth * 1000000 - pos) AS title FROM gold g JOIN sec s ON s.doc_id = g.gold_doc AND s_start <= gold_start AND gold_end <= s_end WHERE title <> '' GROUP BY 1) SELECT gold_doc AS doc_id, item_id, coalesce(title, '') AS title FROM gold LEFT JOIN m USING (item_id)")
def deepest_sections(spark, d):
    return reviews.deepest_containing(_gold_spans(spark, d), sections(spark, d), ["item_id"], "title", F.col("title") != "", "")


@query(f"WITH {SQL_GOLD}, {SQL_SECTIONS}, k AS (SELECT *, {_KIND('title')} AS kind FROM sec), m AS (SELECT g.item_id, arg_max(kind, depth * 1000000 - pos) AS kind FROM gold g JOIN k ON k.doc_id = g.gold_doc AND s_start <= gold_start AND gold_end <= s_end WHERE kind <> 'other' GROUP BY 1) SELECT gold_doc AS doc_id, item_id, coalesce(kind, 'other') AS kind FROM gold LEFT JOIN m USING (item_id)")
def passage_kinds(spark, d):
    kinds = sections(spark, d).withColumn("kind", reports.section_kind(F.col("title"), _KINDS))
    return reviews.deepest_containing(_gold_spans(spark, d), kinds, ["item_id"], "kind", F.col("kind") != "other", "other")


@query(
    rf"""WITH {SQL_BLOCKS}, b AS (SELECT blk.*, source AS section, len(regexp_extract_all(blk.text, '\S+')) AS n_tokens FROM blk JOIN documents d USING (doc_id))
SELECT doc_id, char_start, n_tokens FROM b WHERE regexp_matches(text, '{T.SENTENCE_END.replace("'", "''")}') AND NOT regexp_matches(text, '\[TABLE:|\[EQUATION\]') AND NOT contains(lower(section), 'src3') AND n_tokens BETWEEN 40 AND 400
AND NOT EXISTS (SELECT 1 FROM documents h WHERE h.doc_id = b.doc_id AND b.char_start = 0 AND h.source = b.text)"""
)
def passage_blocks(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("section"))
    heads = docs.select("doc_id", F.lit(0).cast("long").alias("s_start"), F.col("section").alias("title"))
    return reviews.passages(block_table(spark, d).join(docs, "doc_id"), heads, ["src3"], 40, 400).select("doc_id", "char_start", "n_tokens")


# --- selection -----------------------------------------------------------------------

_REASON = "CASE WHEN lang IN ('en', 'de') THEN CASE WHEN contains(source, 'src0') OR contains(source, 'src1') THEN NULL ELSE 'license=' || coalesce(nullif(source, ''), 'missing') END ELSE 'article_type=' || coalesce(nullif(lang, ''), 'missing') END"
_ELIGIBLE = lambda: reviews.eligibility(F.col("lang"), ["en", "de"], F.col("source"), ["src0", "src1"])
_HASH = lambda c: F.sha2(F.concat(F.lit("7:"), F.col(c).cast("string")).cast("binary"), 256)


@query(f"SELECT doc_id, {_REASON} AS reason FROM documents")
def eligibility_reasons(spark, d):
    return table(spark, d, "documents").select("doc_id", _ELIGIBLE().alias("reason"))


@query(
    f"""WITH o AS (SELECT sha256('7:' || doc_id) AS h, doc_id, {_REASON} AS reason FROM documents), c AS (SELECT *, count(*) FILTER (reason IS NULL) OVER (ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS cum FROM o), s AS (SELECT * FROM c WHERE cum < 25 OR (cum = 25 AND reason IS NULL))
SELECT reason, count(*) AS n, (SELECT count(*) FROM s) AS considered, (SELECT count(*) FILTER (reason IS NULL) FROM s) AS taken, (SELECT count(reason) FROM s) AS rejected, 25 - (SELECT count(*) FILTER (reason IS NULL) FROM s) AS short FROM s GROUP BY reason"""
)
def selection_report(spark, d):
    rows = table(spark, d, "documents").select(_HASH("doc_id").alias("h"), "doc_id", _ELIGIBLE().alias("reason"))
    return reviews.take_target(rows, ["h", "doc_id"], "reason", 25)


@query(
    """WITH held AS (SELECT source, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY source), r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('7:' || doc_id), doc_id) AS rn FROM documents)
SELECT r.source, doc_id, rn FROM r LEFT JOIN held h ON h.source = r.source WHERE rn <= 9 - coalesce(h.n, 0)"""
)
def within_room(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id")
    held = docs.join(table(spark, d, "labels").filter("toxic = 1").select("doc_id"), "doc_id").groupBy("source").agg(F.count("*").alias("n_held"))
    return reviews.within_room(docs, "source", [_HASH("doc_id"), "doc_id"], 9, held)


@query(
    """WITH r AS (SELECT source, doc_id, n_chars % 4 > 0 AS on_topic, CAST(n_chars % 3 AS INT) AS tier, sha256('7:' || doc_id) AS h, sha256('7:' || source) AS mixed, CASE WHEN doc_id % 97 = 0 THEN -doc_id END AS pin FROM documents WHERE source IS NOT NULL),
held AS (SELECT source, count(*) AS n FROM r WHERE pin IS NOT NULL GROUP BY source), f AS (SELECT r.*, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS rn FROM r WHERE pin IS NULL AND on_topic),
k AS (SELECT f.* FROM f LEFT JOIN held USING (source) WHERE rn <= 3 - coalesce(n, 0)), t AS (SELECT source, arg_min(tier, rn) AS gt FROM k GROUP BY source)
SELECT source, doc_id, true AS pinned FROM r WHERE pin IS NOT NULL UNION ALL (SELECT source, doc_id, false FROM k JOIN t USING (source) ORDER BY gt, mixed, source, rn LIMIT (SELECT greatest(0, 40 - count(*)) FROM r WHERE pin IS NOT NULL))"""
)
def drawn_passages(spark, d):
    """Forty of the tiers, pinned ones first: a top-k."""
    docs = table(spark, d, "documents").filter("source IS NOT NULL")
    rows = docs.select("doc_id", "source", (F.col("n_chars") % 4 > 0).alias("on_topic"), (F.col("n_chars") % 3).cast("int").alias("tier"), _HASH("doc_id").alias("order"), _HASH("source").alias("mixed"))
    pins = docs.filter("doc_id % 97 = 0").select("doc_id", (-F.col("doc_id")).alias("pin"))
    return reviews.draw(rows, pins, "doc_id", "source", 40, 3).select("source", "doc_id", F.col("pin").isNotNull().alias("pinned"))


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderdate AS d FROM orders WHERE o_orderdate BETWEEN DATE '1993-03-01' AND DATE '1997-06-30'), p AS (SELECT year(d) AS y, count(DISTINCT id) AS n FROM o GROUP BY y)
SELECT y AS year, n, sum(n) OVER ()::BIGINT AS partition_total, (SELECT count(DISTINCT id) FROM o) AS unique_total, (SELECT count(*) FROM o) AS whole_range, sum(n) OVER () = (SELECT count(*) FROM o) AS exact FROM p""")
def survey_by_year(spark, d):
    return reviews.survey(table(spark, d, "orders"), "o_orderkey", "o_orderdate", "1993-03-01", "1997-06-30")


# --- guards --------------------------------------------------------------------------


@query("SELECT doc_id, CASE WHEN d.doc_id IS NULL THEN 'unknown' ELSE 'changed' END AS problem FROM (SELECT CASE WHEN quality = 0 AND toxic = 1 THEN -doc_id ELSE doc_id END AS doc_id, CASE WHEN quality = 0 THEN 'x' ELSE '' END AS more FROM labels) s LEFT JOIN documents d USING (doc_id) WHERE d.doc_id IS NULL OR sha256(coalesce(d.text, '')) <> sha256(concat(coalesce(d.text, ''), s.more))")
def changed_answers(spark, d):
    """Labelled rows as a run of before: some of other texts, some of documents that are not there."""
    now = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    bad = table(spark, d, "labels").select("doc_id", F.when((F.col("quality") == 0) & (F.col("toxic") == 1), -F.col("doc_id")).otherwise(F.col("doc_id")).alias("id"), F.when(F.col("quality") == 0, "x").otherwise("").alias("more"))
    digest = lambda c: F.sha2(c.cast("binary"), 256).alias("sha")
    stored = bad.join(now, "doc_id").select(F.col("id").alias("doc_id"), digest(F.concat("t", "more")))
    return reviews.changed(stored, now.select("doc_id", digest(F.col("t"))), ["doc_id"], "sha")


@query(
    """WITH r AS (SELECT d.source AS doc_id, quality = 1 AS verified, CASE WHEN toxic = 1 THEN 'stand-in' ELSE 'model' END AS drafter, CASE WHEN d.lang = 'fr' THEN 'in_abstract' ELSE '' END AS reasons, n_chars % 2 AS score, n_chars % 5 = 0 AS override, CASE WHEN n_chars % 3 = 0 THEN ' ' ELSE 'seen' END AS note FROM documents d JOIN labels USING (doc_id)),
p AS (SELECT doc_id, count(*) AS n FROM r GROUP BY doc_id)
SELECT count(*) FILTER (NOT verified) AS unverified, count(*) FILTER (drafter = 'stand-in') AS stand_in, count(*) FILTER (reasons <> '') AS rejected, abs(count(*) - 100) AS wrong_count, count(*) FILTER (score < 1 AND NOT override) AS off_topic, count(*) FILTER (override AND trim(note) = '') AS without_note, (SELECT count(*) FROM p WHERE n > 1) AS several_a_document FROM r"""
)
def freeze_refusals(spark, d):
    met = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    rows = met.select(F.col("source").alias("doc_id"), (F.col("quality") == 1).alias("verified"), F.when(F.col("toxic") == 1, "stand-in").otherwise("model").alias("drafter"), F.when(F.col("lang") == "fr", "in_abstract").otherwise("").alias("reasons"), (F.col("n_chars") % 2).alias("score"), (F.col("n_chars") % 5 == 0).alias("override"), F.when(F.col("n_chars") % 3 == 0, " ").otherwise("seen").alias("note"))
    return reviews.freeze_refusals(rows, 100, 1)


@query("SELECT event_id, CAST(coalesce(sum(CAST(user_id AS BIGINT)) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS spent, coalesce(sum(CAST(user_id AS BIGINT)) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 50 > 400 AS paused FROM events")
def daily_cap(spark, d):
    calls = table(spark, d, "events").withColumn("day", F.to_date("ts")).withColumn("cost", F.col("user_id").cast("long"))
    return reviews.capped(calls, ["user_id", "day"], ["ts", "event_id"], "cost", 50, 400).select("event_id", "spent", "paused")


# --- reports -------------------------------------------------------------------------


@query(f"WITH {SQL_CHUNKS} SELECT chunking, n_tokens, count(*) AS n FROM chunks GROUP BY ALL")
def chunk_histogram(spark, d):
    return chunk_table(spark, d).groupBy("chunking", "n_tokens").agg(F.count("*").alias("n"))


@query(rf"WITH {SQL_CHUNKS} SELECT chunking, regexp_matches(text, '\[TABLE:|\[EQUATION\]|https?://') AS marked, {_DISTRIBUTION} FROM chunks GROUP BY ALL")
def marked_chunks(spark, d):
    """Lengths of the chunks with a placeholder or an address, and of those without."""
    return reports.distribution(chunk_table(spark, d).withColumn("marked", F.rlike("text", F.lit(r"\[TABLE:|\[EQUATION\]|https?://"))), ["chunking", "marked"], "n_tokens")


@query(
    f"""WITH {SQL_CHUNKS}, p AS (SELECT chunking, count(*) AS n, quantile_cont(n_tokens, 0.5) AS m, stddev_pop(n_tokens) AS s, avg(n_tokens / target) AS f FROM chunks JOIN targets USING (chunking) GROUP BY chunking)
SELECT a.chunking AS arm_a, b.chunking AS arm_b, a.n AS n_a, round(a.m, 4) AS median_a, round(a.s, 4) AS std_a, round(a.f, 4) AS fill_a, b.n AS n_b, round(b.m, 4) AS median_b, round(b.s, 4) AS std_b, round(b.f, 4) AS fill_b, round(greatest(a.m, b.m) / least(a.m, b.m), 2) AS ratio FROM p a JOIN p b ON a.chunking < b.chunking"""
)
def arm_comparison(spark, d):
    return reviews.compare_arms(chunk_table(spark, d), "chunking", "n_tokens", F.when(F.col("chunking") == "coarse", 256).otherwise(128))


@query(f"WITH {SQL_CHUNKS} SELECT chunking, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs, round(count(*) / count(DISTINCT doc_id), 4) AS chunks_a_doc, CAST(sum(n_tokens) AS BIGINT) AS n_tokens, count(*) FILTER (n_tokens > target) AS over_target, count(DISTINCT sha256(text)) AS n_distinct FROM chunks JOIN targets USING (chunking) GROUP BY chunking")
def arm_report(spark, d):
    target = F.when(F.col("chunking") == "coarse", 256).otherwise(128)
    out = chunk_table(spark, d).groupBy("chunking").agg(F.count("*").alias("n_chunks"), F.count_distinct("doc_id").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.count_if(F.col("n_tokens") > target).alias("over_target"), F.count_distinct("content_sha256").alias("n_distinct"))
    return out.withColumn("chunks_a_doc", F.round(F.col("n_chunks") / F.col("n_docs"), 4))


@query(
    f"""WITH {SQL_CHUNKS}, {SQL_GOLD}, c AS (SELECT chunking, item_id, count(*) AS n, sum(n_tokens) AS t, round(sum(least(char_end, gold_end) - greatest(char_start, gold_start)) / max(gold_end - gold_start), 6) AS m FROM chunks JOIN gold ON doc_id = gold_doc AND char_start < gold_end AND char_end > gold_start GROUP BY ALL)
SELECT chunking, count(*) AS n_spans, count(*) FILTER (n > 1) AS n_split, max(n) AS most_chunks, round(avg(m), 6) AS mean_ceiling, CAST(sum(t) AS BIGINT) AS cover_tokens FROM c GROUP BY chunking"""
)
def cover_by_arm(spark, d):
    from evidentia.plans.catalogue import minimum_cover

    return minimum_cover(spark, d).groupBy("chunking").agg(F.count("*").alias("n_spans"), F.count_if(F.col("n_cover") > 1).alias("n_split"), F.max("n_cover").alias("most_chunks"), F.round(F.avg("max_coverage"), 6).alias("mean_ceiling"), F.sum("cover_tokens").alias("cover_tokens"))


#: Tokens that an answer may have before it is cut off.
MOST_TOKENS = 16


@query(
    rf"""WITH {SQL_ANSWERS}, w AS (SELECT chunking, embedding, rerank, item_id, len(regexp_extract_all(answer, '\S+')) AS n_all, len(regexp_extract_all(context, '\S+')) AS n_prompt, rtrim(regexp_replace(answer, '^\s+|\s+$', '', 'g'), '.') = '{REFUSAL.rstrip('.')}' AS refused FROM answered),
k AS (SELECT *, least(n_all, {MOST_TOKENS}) AS n_tokens FROM w)
SELECT chunking, embedding, rerank, {_DISTRIBUTION}, round(avg(n_prompt), 4) AS mean_prompt, count(*) FILTER (refused) AS n_refused, count(*) FILTER (n_all > {MOST_TOKENS}) AS n_truncated,
coalesce(string_agg(item_id::VARCHAR, ',' ORDER BY item_id) FILTER (n_all > {MOST_TOKENS}), '') AS truncated FROM k GROUP BY ALL"""
)
def generation_report(spark, d):
    """Lengths of the answers after the cut, what the prompts hold, refusals, and which answers were cut off."""
    rows = answers.cut_answer(answered(spark, d).withColumn("refused", T.same_refusal(F.col("answer"), F.lit(REFUSAL))), MOST_TOKENS)
    rows = rows.withColumn("n_tokens", F.col("n_completion_tokens")).withColumn("n_prompt", F.size(T.tokens(F.col("context"))))
    cut = F.col("finish_reason") == "length"
    others = rows.groupBy(*CELL[:3]).agg(F.round(F.avg("n_prompt"), 4).alias("mean_prompt"), F.count_if("refused").alias("n_refused"), F.count_if(cut).alias("n_truncated"), F.array_join(F.array_sort(F.collect_list(F.when(cut, F.col("item_id")))), ",").alias("truncated"))
    return reports.distribution(rows, CELL[:3], "n_tokens").join(others, CELL[:3])


@query("""SELECT source, count(*) AS n, count(quality) AS written, count(*) - count(quality) AS outstanding, CAST(sum(n_chars) AS BIGINT) AS chars_total, CAST(coalesce(sum(n_chars) FILTER (quality IS NOT NULL), 0) AS BIGINT) AS chars_written FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def run_summary(spark, d):
    met = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    done = F.col("quality").isNotNull()
    return met.groupBy("source").agg(F.count("*").alias("n"), F.count("quality").alias("written"), F.count_if(~done).alias("outstanding"), F.sum("n_chars").alias("chars_total"), F.coalesce(F.sum(F.when(done, F.col("n_chars"))), F.lit(0)).alias("chars_written"))


@query(
    f"""WITH {SQL_METRICS}, x AS (SELECT 'chunking x embedding' AS effect, metric, query_id, (avg(value) FILTER (chunking = 'fine' AND embedding = 'd64') - avg(value) FILTER (chunking = 'coarse' AND embedding = 'd64')) - (avg(value) FILTER (chunking = 'fine' AND embedding = 'd32') - avg(value) FILTER (chunking = 'coarse' AND embedding = 'd32')) AS diff, count(value) AS n FROM facts GROUP BY ALL
UNION ALL SELECT 'embedding x rerank', metric, query_id, (avg(value) FILTER (embedding = 'd64' AND rerank = 'on') - avg(value) FILTER (embedding = 'd32' AND rerank = 'on')) - (avg(value) FILTER (embedding = 'd64' AND rerank = 'off') - avg(value) FILTER (embedding = 'd32' AND rerank = 'off')), count(value) FROM facts GROUP BY ALL)
SELECT effect, metric, query_id, round(diff, 9) AS diff FROM x WHERE n = 8"""
)
def other_interactions(spark, d):
    from evidentia.sources.tables import stored

    f = stored(facts(spark, d))
    return reduce(DataFrame.unionByName, [effects.interaction(f, ("chunking", "coarse", "fine"), ("embedding", "d32", "d64")), effects.interaction(f, ("embedding", "d32", "d64"), ("rerank", "off", "on"))])


# --- drafts --------------------------------------------------------------------------


@query(f"WITH {SQL_CANDIDATES}, r AS (SELECT item_id, CASE WHEN item_id % 5 = 0 THEN question ELSE 'QUESTION: ' || question || ' ' || chr(10) || 'ANSWER: ' || answer END AS reply FROM cand) SELECT item_id, CASE WHEN contains(reply, 'ANSWER:') THEN trim(regexp_extract(reply, '(?s)QUESTION:(.*?)ANSWER:', 1), ' ' || chr(10)) END AS question, CASE WHEN contains(reply, 'ANSWER:') THEN trim(regexp_extract(reply, '(?s)ANSWER:(.*)', 1), ' ' || chr(10)) END AS answer FROM r")
def draft_replies(spark, d):
    reply = F.when(F.col("item_id") % 5 == 0, F.col("question")).otherwise(F.concat(F.lit("QUESTION: "), "question", F.lit(" \nANSWER: "), "answer"))
    parsed = candidates(spark, d).select("item_id", reviews.draft_reply(reply).alias("r"))
    return parsed.select("item_id", F.col("r.question").alias("question"), F.col("r.answer").alias("answer"))


@query(
    rf"""WITH df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9\-'']*|\d+(?:\.\d+)?'))) AS term FROM documents) GROUP BY term),
sn AS (SELECT item_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM benchmark), su AS (SELECT item_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM sn),
lg AS (SELECT item_id, s AS sentence FROM su WHERE trim(s, ' ' || chr(10)) <> '' QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY length(s) DESC, i) = 1),
tm AS (SELECT DISTINCT item_id, lower(unnest(regexp_extract_all(sentence, '[A-Za-z][A-Za-z0-9\-'']*|\d+(?:\.\d+)?'))) AS term FROM lg),
rr AS (SELECT item_id, term AS answer FROM tm LEFT JOIN df USING (term) WHERE term NOT IN ({_CONTENT_STOP}) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY coalesce(df, 0), term) = 1)
SELECT item_id, '{reviews.CLOZE_LEAD}' || regexp_replace(sentence, '(?i)(^|[^\p{{L}}\p{{N}}_])' || regexp_escape(answer) || '($|[^\p{{L}}\p{{N}}_])', '\1{reviews.BLANK}\2') AS question, answer FROM lg JOIN rr USING (item_id)"""
)
def cloze_questions(spark, d):
    passages = table(spark, d, "benchmark").select("item_id", "text")
    terms = F.explode(F.array_distinct(T.content_tokens(F.col("text")))).alias("term")
    df = table(spark, d, "documents").select(terms).groupBy("term").agg(F.count("*").alias("df"))
    return reviews.cloze(passages, df, "item_id")
