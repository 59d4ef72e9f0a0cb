"""Queries on candidate questions, evidence, topics, each beside SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions import text as T
from evidentia.operators import goldset
from evidentia.plans.catalogue import REFUSAL, SQL_ANSWERS, SQL_GOLD, answered, gold, query, table

UNITS = ["rows", "items", "samples", "people", "dollars", "days", "hours", "years"]
MARKERS = {"vendor": ["inc.", " gmbh"], "kit": [" kit ", "package", "software"]}
RETRACTIONS = ["did not", "no significant", "not significant"]
RESULTS = ["increase", "decrease", "higher", "lower", "associated", "result"]
TERMS = ["data", "model", "license", "system", "market", "water", "history"]
COVERAGE, LEAST_TERMS = 0.8, 1
_KIND_OF = "CASE WHEN item_id % 3 = 0 THEN 'results' WHEN item_id % 3 = 1 THEN 'methods' ELSE 'other' END"


def candidates(spark, d) -> DataFrame:
    """Passages with their document: the first words ask, the last words answer, the document without the passage is the abstract."""
    words = F.filter(F.split(F.col("b.text"), r"\s"), lambda w: w != "")
    docs, passages = table(spark, d, "documents"), table(spark, d, "benchmark")
    met = passages.alias("b").join(gold(spark, d), "item_id").join(docs.alias("d"), F.col("d.doc_id") == F.col("gold_doc"))
    last = F.slice(words, F.greatest(F.lit(1), F.size(words) - 7), F.lit(8))
    return met.select("item_id", F.col("gold_doc").alias("source"), F.col("b.text").alias("span"), F.array_join(F.slice(words, 1, 8), " ").alias("question"), F.array_join(last, " ").alias("answer"), F.concat(F.substring("d.text", F.lit(1), F.col("gold_start").cast("int")), F.lit(" "), F.substring("d.text", F.col("gold_end").cast("int") + 1, F.length("d.text"))).alias("abstract"), F.col("d.text").alias("body"), F.expr(_KIND_OF).alias("kind"))


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_CT = lambda c: rf"list_filter(list_transform(regexp_extract_all({c}, '[A-Za-z][A-Za-z0-9\-'']*|\d+(?:\.\d+)?'), lambda w: lower(w)), lambda w: w NOT IN ({_STOP}))"
_LIST = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in sorted(xs)) + "]"
_PRESENT = lambda c, xs: f"list_filter({_LIST(xs)}, lambda n: contains(lower({c}), lower(n)))"
_ANY = "|".join(sorted(UNITS, key=len, reverse=True))
_INPUTS = lambda c: (
    rf"list_sort(list_distinct(list_concat(regexp_extract_all({c}, '(?i)\b{goldset.NUMBER}\b(?:\s+[A-Za-z][\w''-]*){{0,2}}\s+\b(?:{_ANY})\b'), regexp_extract_all({c}, '(?i)\b(?:{_ANY})\b\s+{goldset.OF}\s+\b{goldset.NUMBER}\b'))))"
)
_PROVENANCE = lambda c: (
    "list_sort(list_filter(["
    + ", ".join(f"CASE WHEN contains(concat(' ', lower({c}), ' '), '{n}') THEN '{k}:{n}' END" for k, ns in MARKERS.items() for n in ns)
    + f", CASE WHEN regexp_matches({c}, '{goldset.VERSION}') THEN 'version-string' END], lambda x: x IS NOT NULL))"
)
_SENTENCES = lambda c: rf"list_filter(string_split(regexp_replace({c}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ' || chr(10)) <> '')"
_WITHDRAWN = lambda c: (
    f"CASE WHEN len(list_filter({_SENTENCES(c)}, lambda s: len({_PRESENT('s', RETRACTIONS)}) = 0 AND len({_PRESENT('s', RESULTS)}) > 0)) > 0 THEN [] "
    f"ELSE list_sort(list_distinct(flatten(list_transform({_SENTENCES(c)}, lambda s: {_PRESENT('s', RETRACTIONS)})))) END"
)
SQL_CANDIDATES = (
    SQL_GOLD
    + r""",
bw AS (SELECT item_id, text, list_filter(string_split_regex(text, '\s'), lambda w: w <> '') AS w FROM benchmark),
cand AS (SELECT bw.item_id, gold_doc AS source, bw.text AS span, array_to_string(w[1:8], ' ') AS question, array_to_string(w[greatest(1, len(w) - 7):len(w)], ' ') AS answer, concat(substr(d.text, 1, gold_start), ' ', substr(d.text, gold_end + 1)) AS abstract, d.text AS body,
  array_to_string(w[1:3], ' ') AS prefix, array_to_string(w[greatest(1, len(w) - 2):len(w)], ' ') AS suffix FROM bw JOIN gold USING (item_id) JOIN documents d ON d.doc_id = gold_doc)"""
    + f""",
tok AS (SELECT *, {_CT("answer")} AS ta, {_CT("question")} AS tq, {_CT("span")} AS ts, {_CT("abstract")} AS tb FROM cand),
an AS (SELECT item_id, source, greatest(1, CAST(round_even({COVERAGE} * len(ta), 0) AS BIGINT)) AS needed, unnest(ta) AS term FROM tok),
dt AS (SELECT DISTINCT doc_id, unnest({_CT("text")}) AS term FROM documents),
oth AS (SELECT item_id, doc_id FROM an JOIN dt USING (term) WHERE doc_id <> source GROUP BY item_id, doc_id, needed HAVING count(*) >= needed),
n_oth AS (SELECT item_id, count(*) AS n FROM oth GROUP BY item_id),
other AS (SELECT tok.item_id, coalesce(n, 0) AS n_other FROM tok LEFT JOIN n_oth USING (item_id)),
tl AS (SELECT item_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM tok), tr AS (SELECT item_id, unnest(tb) AS t, generate_subscripts(tb, 1) AS j FROM tok),
dg AS (SELECT item_id, i - j AS g, i - row_number() OVER (PARTITION BY item_id, i - j ORDER BY i) AS z FROM tl JOIN tr USING (item_id, t)),
rn AS (SELECT item_id, max(n) AS n FROM (SELECT item_id, g, z, count(*) AS n FROM dg GROUP BY ALL) GROUP BY item_id),
run AS (SELECT tok.item_id, coalesce(n, 0) AS n_shared FROM tok LEFT JOIN rn USING (item_id))"""
)


@query(f"WITH {SQL_CANDIDATES} SELECT item_id, n_other FROM other")
def answerable_elsewhere(spark, d):
    tokens = candidates(spark, d).select("item_id", "source", T.content_tokens(F.col("answer")).alias("tokens"))
    return goldset.held_elsewhere(tokens, table(spark, d, "documents"), COVERAGE)


@query(f"WITH {SQL_CANDIDATES} SELECT item_id, n_shared FROM run")
def shared_ngram(spark, d):
    rows = candidates(spark, d).select("item_id", T.content_tokens(F.col("span")).alias("a"), T.content_tokens(F.col("abstract")).alias("b"))
    return goldset.longest_shared_run(rows, "item_id", "a", "b")


_SHARE = lambda a, b: f"CASE WHEN len({a}) > 0 THEN len(list_filter({a}, lambda x: list_contains({b}, x))) / len({a}) ELSE 0.0 END"


SQL_CHECKS = (
    SQL_CANDIDATES
    + rf""",
sig AS (SELECT item_id, {_SHARE("ta", "ts")} AS g, {_SHARE("ta", "tq")} AS l, {_SHARE("ta", "tb")} AS o, n_other, n_shared, array_to_string({_PROVENANCE("answer")}, ',') AS provenance,
array_to_string({_INPUTS("answer")}, ',') AS inputs, array_to_string({_WITHDRAWN("span")}, ',') AS withdrawn, array_to_string({_PRESENT("answer", RESULTS)}, ',') AS result_language, {_KIND_OF} AS kind, regexp_matches(span, '\[TABLE:|\[EQUATION\]') OR regexp_matches(question, '{goldset.ARTEFACT}') OR regexp_matches(answer, '{goldset.ARTEFACT}') AS artefact FROM tok JOIN other USING (item_id) JOIN run USING (item_id)),
checked AS (SELECT *, reasons <> '' AS auto_rejected FROM (SELECT item_id, round(g, 4) AS grounding, round(l, 4) AS leakage, round(o, 4) AS overlap, n_other, n_shared, provenance, inputs, result_language, withdrawn, CASE WHEN kind = 'methods' AND result_language = '' THEN '{goldset.METHODS_WARNING}' ELSE '' END AS warnings,
array_to_string(list_filter([CASE WHEN l >= 0.5 OR n_other > 0 OR g < 0.7 THEN 'answerable_without_span' END, CASE WHEN o >= 0.9 OR n_shared >= 12 THEN 'in_abstract' END, CASE WHEN provenance <> '' OR inputs <> '' THEN 'methods_provenance' END, CASE WHEN artefact THEN 'needs_placeholder' END, CASE WHEN withdrawn <> '' THEN 'non_effect_answer' END], lambda x: x IS NOT NULL), ',') AS reasons FROM sig))"""
)


@query(f"WITH {SQL_CHECKS} SELECT * FROM checked")
def candidate_checks(spark, d):
    return goldset.check_candidates(candidates(spark, d), table(spark, d, "documents"), units=UNITS, markers=MARKERS, retractions=RETRACTIONS, results=RESULTS, coverage=COVERAGE)


@query(
    f"""WITH {SQL_CANDIDATES}, p AS (SELECT *, (length(body) - length(replace(body, prefix, ''))) / length(prefix) AS np, strpos(body, prefix) - 1 AS s FROM cand), q AS (SELECT *, substr(body, s + 1) AS tail FROM p)
SELECT item_id, s AS char_start, s + strpos(tail, suffix) - 1 + length(suffix) AS char_end FROM q WHERE np = 1 AND (length(tail) - length(replace(tail, suffix, ''))) / length(suffix) = 1"""
)
def evidence_anchors(spark, d):
    words = F.filter(F.split("span", r"\s"), lambda w: w != "")
    prefix, suffix = F.array_join(F.slice(words, 1, 3), " "), F.array_join(F.slice(words, F.greatest(F.lit(1), F.size(words) - 2), F.lit(3)), " ")
    rows = candidates(spark, d).select("item_id", "body", prefix.alias("prefix"), suffix.alias("suffix"))
    found = rows.select("item_id", goldset.anchored(F.col("body"), F.col("prefix"), F.col("suffix")).alias("a")).filter("a IS NOT NULL")
    return found.select("item_id", F.col("a.start").alias("char_start"), F.col("a.end").alias("char_end"))


@query(
    r"""SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE 1 + CAST(((length(t) - length(replace(t, '. ', ''))) + (length(t) - length(replace(t, '? ', ''))) + (length(t) - length(replace(t, '! ', '')))) / 2 AS BIGINT) END AS n_sentences
FROM (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents)"""
)
def sentence_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", goldset.sentence_count(F.col("text")).alias("n_sentences"))


@query(f"SELECT source, count(*) AS n, count(*) FILTER (s >= {LEAST_TERMS}) AS n_on, round(avg(CASE WHEN s >= {LEAST_TERMS} THEN 1.0 ELSE 0 END), 4) AS share_on, max(s) AS most FROM (SELECT source, len({_PRESENT('text', TERMS)}) AS s FROM documents) GROUP BY source")
def topic_drift(spark, d):
    scored = table(spark, d, "documents").select("source", goldset.topic_score(F.col("text"), TERMS).alias("s"))
    on = F.col("s") >= LEAST_TERMS
    return scored.groupBy("source").agg(F.count("*").alias("n"), F.count_if(on).alias("n_on"), F.round(F.avg(on.cast("double")), 4).alias("share_on"), F.max("s").alias("most"))


@query(f"SELECT doc_id, array_to_string({_PROVENANCE('text')}, ',') AS provenance, array_to_string({_INPUTS('text')}, ',') AS inputs FROM documents")
def provenance_marks(spark, d):
    text = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.array_join(goldset.provenance(text, MARKERS), ",").alias("provenance"), F.array_join(goldset.input_counts(text, UNITS), ",").alias("inputs"))


@query(f"SELECT doc_id, array_to_string({_WITHDRAWN('text')}, ',') AS withdrawn FROM documents")
def withdrawn_results(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(goldset.withdrawn(F.col("text"), RETRACTIONS, RESULTS), ",").alias("withdrawn"))


@query(rf"WITH {SQL_ANSWERS} SELECT chunking, embedding, rerank, count(*) AS n, count(*) FILTER (rtrim(regexp_replace(answer, '^\s+|\s+$', '', 'g'), '.') = '{REFUSAL.rstrip('.')}') AS n_refused FROM answered GROUP BY ALL")
def refusals(spark, d):
    rows = answered(spark, d)
    return rows.groupBy("chunking", "embedding", "rerank").agg(F.count("*").alias("n"), F.count_if(T.same_refusal(F.col("answer"), F.lit(REFUSAL))).alias("n_refused"))


@query(rf"SELECT page_id, rtrim(regexp_extract(html, '{T.URL}'), ').,;') AS first_url FROM pages")
def first_urls(spark, d):
    return table(spark, d, "pages").select("page_id", F.rtrim(F.regexp_extract("html", T.URL, 0), F.lit(").,;")).alias("first_url"))


#: What an author adds to the checks: who was selected, verified and so on, by rules on the candidate's number and its signals.
_AUTHORED = {"selected": "reasons = '' AND item_id % 2 = 0", "verified": "item_id % 4 = 0", "warned": "overlap >= 0.5", "on_topic": "item_id % 5 > 0", "overridden": "item_id % 10 = 0 AND reasons = ''", "pinned": "item_id % 11 = 0"}
SQL_AUTHORED = SQL_CHECKS + f""",
au AS (SELECT item_id, CASE WHEN reasons = '' THEN [] ELSE string_split(reasons, ',') END AS reasons, {_KIND_OF} AS kind, {", ".join(f"{rule} AS {name}" for name, rule in _AUTHORED.items())}, CASE WHEN item_id % 7 = 0 THEN 'unclear' ELSE '' END AS rejection, CASE WHEN item_id % 3 = 1 THEN 'seen twice' ELSE '' END AS note FROM checked)"""


def authored(spark, d) -> DataFrame:
    rows = candidate_checks(spark, d)
    reasons = F.filter(F.split("reasons", ","), lambda r: r != "")
    return rows.select("item_id", reasons.alias("reasons"), F.expr(_KIND_OF).alias("kind"), *(F.expr(rule).alias(name) for name, rule in _AUTHORED.items()), F.expr("CASE WHEN item_id % 7 = 0 THEN 'unclear' ELSE '' END").alias("rejection"), F.expr("CASE WHEN item_id % 3 = 1 THEN 'seen twice' ELSE '' END").alias("note"))


_COUNTERS = {"drafted": "true", "auto_rejected": "len(reasons) > 0", "surviving": "len(reasons) = 0", "selected": "selected", "verified": "selected AND verified", "with_warnings": "warned", "off_topic_selected": "selected AND NOT on_topic", "off_topic_overrides": "overridden", "pinned": "pinned"}


@query(
    f"""WITH {SQL_AUTHORED} SELECT 'rejected_by_reason' AS counter, reason AS value, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM au) GROUP BY reason
UNION ALL SELECT 'reasons_a_candidate', CAST(len(reasons) AS VARCHAR), count(*) FROM au WHERE len(reasons) > 0 GROUP BY len(reasons) UNION ALL SELECT 'section_kind', kind, count(*) FROM au GROUP BY kind UNION ALL SELECT 'selected_section_kind', kind, count(*) FROM au WHERE selected GROUP BY kind
UNION ALL {" UNION ALL ".join(f"SELECT '{name}', '', count(*) FILTER ({rule}) FROM au" for name, rule in _COUNTERS.items())}"""
)
def candidate_summary(spark, d):
    return goldset.candidate_counts(authored(spark, d))


@query(f"WITH {SQL_AUTHORED} SELECT coalesce(nullif(rejection, ''), array_to_string(reasons, ',')) AS reason, count(*) AS n, coalesce(string_agg(CASE WHEN note <> '' THEN item_id || ': ' || note END, chr(10) ORDER BY item_id || ': ' || note), '') AS notes FROM au WHERE NOT selected GROUP BY 1")
def candidate_selection(spark, d):
    return goldset.selection_counts(authored(spark, d))
