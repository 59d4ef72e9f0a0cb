"""Queries on a whole run: judges' replies in two passes, the tables of a run by cell, the fact table and the planned tests."""

from __future__ import annotations

import uuid
from functools import lru_cache, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions import text as T
from evidentia.operators import answers, effects, reports, retrieval, spans
from evidentia.plans.catalogue import BUDGET, CELL, DIMS, REFUSAL, RERANK, SQL_EFFECTS, SQL_JUDGED, SQL_METRICS, TARGETS, effect_rows, gold, query, questions, ranked, relevant, selected
from evidentia.sources.runs import RunTable
from evidentia.sources.tables import shared_folder, stored

# --- replies --------------------------------------------------------------------------

#: What a judge may reply, by a number that question, cell and pass give: the offline verdict in forms that are parsed, refused or half right.
_K = "(item_id * 13 + pass_index * 5 + CASE WHEN chunking = 'fine' THEN 1 ELSE 0 END + CASE WHEN embedding = 'd64' THEN 2 ELSE 0 END + CASE WHEN rerank = 'on' THEN 4 ELSE 0 END) % 17"
_INT = lambda c: f"coalesce(CAST(CAST({c} AS INT) AS STRING), 'null')"
_F, _R, _C = _INT("faithfulness"), _INT("least(5, relevance + CASE WHEN pass_index = 1 AND item_id % 3 = 0 THEN 1 ELSE 0 END)"), _INT("completeness")
_BODY = lambda v="verdict", f=_F, r=_R: f"""'{{"verdict": "' || {v} || '", "faithfulness": ' || {f} || ', "relevance": ' || {r} || ', "completeness": ' || {_C} || ', "rationale": " so it is "}}'"""
_QUOTED = "'\"' || " + _R + " || '\"'"
REPLY = f"""CASE {_K} WHEN 0 THEN 'I cannot say.' WHEN 1 THEN '```json' || chr(10) || {_BODY()} || chr(10) || '```' || chr(10) || 'That is all.' WHEN 2 THEN replace({_BODY()}, '": ', '" ')
WHEN 3 THEN {_BODY(r=_QUOTED)} WHEN 4 THEN {_BODY(r="'\"true\"'")} WHEN 5 THEN {_BODY(r="'true'")} WHEN 6 THEN {_BODY(v="replace(upper(verdict), '_', ' ')")} WHEN 7 THEN {_BODY(f="'7'")} WHEN 8 THEN {_BODY(v="'good'")} WHEN 9 THEN 'Well: ' || {_BODY()} ELSE {_BODY()} END"""
_VALUE = lambda f: f"CASE WHEN json_valid(o) THEN json_extract_string(o, '$.{f}') END"
_NUMBER = lambda f: f"CASE WHEN json_valid(o) THEN CASE WHEN json_type(o, '$.{f}') = 'BOOLEAN' THEN CASE WHEN {_VALUE(f)} = 'true' THEN 1.0::DOUBLE ELSE 0.0 END ELSE try_cast({_VALUE(f)} AS DOUBLE) END END"
_FAULTS = " ".join(f"WHEN v_{f} IS NULL THEN '{f} is missing' WHEN n_{f} IS NULL THEN '{f} is no number' WHEN n_{f} NOT BETWEEN 1 AND 5 THEN '{f} is out of range'" for f in answers.SCALES)
SQL_PASSES = (
    SQL_JUDGED
    + rf""",
rp AS (SELECT chunking, embedding, rerank, item_id, pass_index, {REPLY} AS reply FROM judged, (VALUES (0), (1)) p(pass_index)),
ob AS (SELECT *, nullif(regexp_extract(reply, '(?s)\{{.*\}}'), '') AS o FROM rp),
fl AS (SELECT *, replace(lower(trim({_VALUE("verdict")})), ' ', '_') AS named, {", ".join(f"{_VALUE(f)} AS v_{f}, {_NUMBER(f)} AS n_{f}" for f in answers.SCALES)} FROM ob),
er AS (SELECT *, CASE WHEN o IS NULL THEN 'no object' WHEN NOT json_valid(o) THEN 'broken object' WHEN named IS NULL OR named NOT IN ('correct', 'partially_correct', 'incorrect', 'abstained') THEN 'unknown verdict' WHEN named = 'abstained' THEN NULL {_FAULTS} END AS error FROM fl),
vd AS (SELECT chunking, embedding, rerank, item_id, pass_index, CASE WHEN error IS NULL THEN named ELSE 'unparsed' END AS verdict, error, {", ".join(f"CASE WHEN error IS NULL AND named <> 'abstained' THEN n_{f} END AS {f}" for f in answers.SCALES)} FROM er)"""
)


def evaluation(spark, d) -> dict[str, DataFrame]:
    """The run's tables: what each cell retrieved, how it meets the gold span, what it answered, and two passes of judgements."""
    g, taken = stored(gold(spark, d)), stored(selected(spark, d))
    metrics = spans.context_metrics(taken.drop("text", "item", "score", "used"), g, CELL, relevant(spark, d, g))
    answered = answers.extractive_answer(answers.context_text(taken, CELL).join(questions(spark, d), "item_id"), REFUSAL)
    offline = answers.overlap_judge(answered, REFUSAL).withColumn("pass_index", F.explode(F.array(F.lit(0), F.lit(1))))
    judgements = answers.parse_verdicts(offline.select(*CELL, "pass_index", F.expr(REPLY).alias("reply")))
    return {"results": taken, "metrics": metrics, "answers": answered, "judgements": judgements.drop("reply")}


def passes(spark, d) -> DataFrame:
    return evaluation(spark, d)["judgements"]


@query(f"WITH {SQL_PASSES} SELECT * FROM vd")
def judged_passes(spark, d):
    return passes(spark, d).select(*CELL, "pass_index", "verdict", "error", *answers.SCALES)


@query(f"WITH {SQL_PASSES} SELECT * EXCLUDE (error) FROM vd WHERE verdict <> 'unparsed' OR (chunking = 'coarse' AND verdict = 'unparsed' AND rerank = 'off')")
def judgements_retried(spark, d):
    """The unparsed rows are dropped cell by cell, and two cells are judged again."""
    runs = RunTable(spark, f"{shared_folder(spark)}/run-{uuid.uuid4()}", "judgements")
    judged = stored(passes(spark, d))
    runs.write(judged)
    runs.drop(F.col("verdict") == "unparsed")
    runs.append(judged.filter("chunking = 'coarse' AND rerank = 'off'"))
    return runs.read().select(*CELL, "pass_index", "verdict", *answers.SCALES)


_ORDER = "list_position(['correct', 'partially_correct', 'incorrect', 'abstained'], verdict)::DOUBLE"


@query(
    f"""WITH {SQL_PASSES}, lg AS (SELECT chunking, embedding, rerank, item_id, pass_index, unnest(['faithfulness', 'relevance', 'completeness', 'verdict']) AS scale, unnest([faithfulness, relevance, completeness, {_ORDER}]) AS v FROM vd),
pr AS (SELECT a.chunking, a.embedding, a.rerank, a.scale, a.scale <> 'verdict' AS ordinal, a.v AS l, b.v AS r FROM lg a JOIN lg b USING (chunking, embedding, rerank, item_id, scale) WHERE a.pass_index = 0 AND b.pass_index = 1),
ok AS (SELECT * FROM pr WHERE l IS NOT NULL AND r IS NOT NULL),
rk AS (SELECT *, rank() OVER (PARTITION BY chunking, embedding, rerank, scale ORDER BY l) + (count(*) OVER (PARTITION BY chunking, embedding, rerank, scale, l) - 1) / 2.0 AS x, rank() OVER (PARTITION BY chunking, embedding, rerank, scale ORDER BY r) + (count(*) OVER (PARTITION BY chunking, embedding, rerank, scale, r) - 1) / 2.0 AS y FROM ok),
ag AS (SELECT chunking, embedding, rerank, scale, ordinal, count(*) AS n, avg(CASE WHEN l = r THEN 1.0 ELSE 0 END) AS exact, avg(CASE WHEN abs(l - r) <= 1 THEN 1.0 ELSE 0 END) AS near, avg(CASE WHEN ordinal THEN power((l - r) / 4, 2) WHEN l = r THEN 0 ELSE 1 END) AS seen, CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN corr(x, y) END AS rho FROM rk GROUP BY ALL),
ch AS (SELECT a.chunking, a.embedding, a.rerank, a.scale, avg(CASE WHEN a.ordinal THEN power((a.l - b.r) / 4, 2) WHEN a.l = b.r THEN 0 ELSE 1 END) AS chance FROM ok a JOIN ok b USING (chunking, embedding, rerank, scale) GROUP BY ALL)
SELECT g.chunking, g.embedding, g.rerank, g.scale, coalesce(n, 0) AS n, round(exact, 4) AS exact, round(CASE WHEN ordinal THEN near END, 4) AS within_one, round(CASE WHEN chance = 0 THEN CASE WHEN seen = 0 THEN 1.0 ELSE 0 END ELSE 1 - seen / chance END, 4) AS kappa, round(CASE WHEN ordinal THEN rho END, 4) AS rho
FROM (SELECT DISTINCT chunking, embedding, rerank, scale FROM pr) g LEFT JOIN ag USING (chunking, embedding, rerank, scale) LEFT JOIN ch USING (chunking, embedding, rerank, scale)"""
)
def agreement_by_cell(spark, d):
    pairs = answers.passes_side_by_side(stored(passes(spark, d)), CELL[:3], "item_id")
    return effects.agreement(pairs, [*CELL[:3], "scale"], answers.LOWEST, answers.HIGHEST)


@query(
    f"""WITH {SQL_PASSES}, pq AS (SELECT chunking, embedding, rerank, item_id, count(*) AS k, arg_min(verdict, pass_index) AS verdict, {", ".join(f"avg({s}) AS {s}" for s in answers.SCALES)} FROM vd GROUP BY ALL)
SELECT chunking, embedding, rerank, CAST(sum(k) AS BIGINT) AS n_judgements, count(*) AS n_answers, {", ".join(f"round(avg({s}), 3) AS {s}, count({s}) AS {s}_n" for s in answers.SCALES)}, {", ".join(f"count(*) FILTER (verdict = '{v}') AS {v}" for v in answers.VERDICTS)},
count(*) FILTER (verdict NOT IN ('abstained', 'unparsed')) AS n_scored, round(count(*) FILTER (verdict = 'abstained') / count(*), 4) AS abstention_rate, round(count(*) FILTER (verdict = 'correct') / count(*), 4) AS correct_rate, 2 AS n_passes FROM pq GROUP BY ALL"""
)
def judge_report(spark, d):
    return answers.judge_report(stored(passes(spark, d)), CELL[:3], "item_id")


_DIST = lambda v: ", ".join([f"count({v}) AS {v}_n, round(avg({v}), 1) AS {v}_mean, min({v}) AS {v}_min, max({v}) AS {v}_max, round(stddev_pop({v}), 1) AS {v}_std", *(f"round(quantile_cont({v}, {q}), 1) AS {v}_{n}" for q, n in ((0.1, "p10"), (0.25, "p25"), (0.5, "median"), (0.75, "p75"), (0.9, "p90")))])


@query(
    f"""WITH {SQL_METRICS}, grid AS (SELECT chunking, embedding, rerank, item_id FROM targets, dims, (VALUES ('off'), ('on')) r(rerank), gold),
per AS (SELECT chunking, embedding, rerank, item_id, count(*) AS c, count(*) FILTER (used <= {BUDGET}) AS k, coalesce(max(used) FILTER (used <= {BUDGET}), 0) AS u FROM running GROUP BY ALL),
w AS (SELECT chunking, embedding, rerank, coalesce(k, 0) AS n_chunks, CAST(coalesce(u, 0) AS BIGINT) AS tokens_used, CAST({BUDGET} - coalesce(u, 0) AS BIGINT) AS budget_slack, CASE WHEN coalesce(c, 0) = 0 THEN 'no_candidates' WHEN k < c THEN 'overflow' ELSE 'candidates_exhausted' END AS stop,
  gold_rank, tokens_before_gold, coalesce(span_coverage, 0) AS span_coverage, coalesce(evidence_density, 0) AS evidence_density, coalesce(distractors, 0) AS distractors, coalesce(recall, 0) AS recall, coalesce(ndcg, 0) AS ndcg
  FROM grid LEFT JOIN per USING (chunking, embedding, rerank, item_id) LEFT JOIN (SELECT * EXCLUDE (n_chunks, tokens_used) FROM metrics) USING (chunking, embedding, rerank, item_id))
SELECT chunking, embedding, rerank, count(*) AS n_queries, round(round(avg(tokens_used), 4) / {BUDGET}, 4) AS realised_budget_share, {", ".join(f"round(avg({c}), 4) AS {c}" for c in ("span_coverage", "evidence_density", "distractors", "recall", "ndcg"))}, count(gold_rank) AS gold_found, round(avg(gold_rank), 2) AS mean_gold_rank,
round(avg(tokens_before_gold) FILTER (gold_rank IS NOT NULL), 1) AS mean_tokens_before_gold, {", ".join(f"count(*) FILTER (stop = '{r}') AS {r}" for r in ("overflow", "candidates_exhausted", "no_candidates"))}, {_DIST("n_chunks")}, {_DIST("tokens_used")}, {_DIST("budget_slack")} FROM w GROUP BY ALL"""
)
def retrieval_report(spark, d):
    g, every = stored(gold(spark, d)), ranked(spark, d)
    metrics = spans.context_metrics(retrieval.fill_budget(every, CELL, BUDGET).drop("item", "score", "used"), g, CELL, relevant(spark, d, g)).drop("n_chunks", "tokens_used")
    levels = lambda name, values: F.explode(F.array(*map(F.lit, values))).alias(name)
    grid = g.select("item_id", levels("chunking", TARGETS)).select("*", levels("embedding", DIMS)).select("*", levels("rerank", RERANK))
    rows = retrieval.fill_summary(every, CELL, BUDGET, grid).join(metrics, CELL, "left").na.fill(0, ["span_coverage", "evidence_density", "distractors", "recall", "ndcg"])
    return reports.retrieval_report(rows, CELL[:3], BUDGET)


# --- facts and planned tests -------------------------------------------------------------

RETRIEVAL = ("span_coverage", "evidence_density", "recall", "ndcg", "distractors", "gold_found")
JUDGED = ("correct", "abstained", *answers.SCALES)
SQL_FACTS = (
    SQL_PASSES.replace(SQL_JUDGED, SQL_METRICS + SQL_JUDGED.split("selected AS (SELECT * FROM running WHERE used <= 512)", 1)[1], 1)
    + f""",
jv AS (SELECT chunking, embedding, rerank, item_id AS query_id, CASE WHEN arg_min(verdict, pass_index) = 'correct' THEN 1.0::DOUBLE ELSE 0 END AS correct, CASE WHEN arg_min(verdict, pass_index) = 'abstained' THEN 1.0::DOUBLE ELSE 0 END AS abstained, {", ".join(f"avg({s}) AS {s}" for s in answers.SCALES)} FROM vd GROUP BY chunking, embedding, rerank, item_id),
rv AS (SELECT chunking, embedding, rerank, item_id AS query_id, span_coverage::DOUBLE AS span_coverage, evidence_density::DOUBLE AS evidence_density, recall::DOUBLE AS recall, ndcg::DOUBLE AS ndcg, distractors::DOUBLE AS distractors, CASE WHEN gold_rank IS NULL THEN 0.0::DOUBLE ELSE 1.0 END AS gold_found FROM metrics),
av AS (SELECT chunking, embedding, rerank, item_id AS query_id, len(regexp_extract_all(answer, '\\S+'))::DOUBLE AS answer_tokens FROM answered),
full_facts AS (SELECT chunking, embedding, rerank, query_id, metric, round(value, 6) AS value FROM (
  SELECT * FROM rv UNPIVOT (value FOR metric IN ({", ".join(RETRIEVAL)})) UNION ALL SELECT * FROM jv UNPIVOT (value FOR metric IN ({", ".join(JUDGED)})) UNION ALL SELECT * FROM av UNPIVOT (value FOR metric IN (answer_tokens))))"""
)


def facts(spark, d) -> DataFrame:
    """Every measurement of every question in every cell: retrieval, judgements (verdict of the lowest pass, scales over passes) and answer lengths."""
    run = evaluation(spark, d)

    def long(rows: DataFrame, names) -> DataFrame:
        each = F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names))
        return rows.select(*CELL[:3], F.col("item_id").alias("query_id"), F.explode(each).alias("f")).select(*CELL[:3], "query_id", "f.metric", F.round("f.value", 6).alias("value"))

    views = answers.judge_view(run["judgements"], CELL)
    lengths = run["answers"].withColumn("answer_tokens", F.size(T.tokens(F.col("answer"))))
    found = run["metrics"].withColumn("gold_found", F.col("gold_rank").isNotNull().cast("int"))
    return reduce(DataFrame.unionByName, [long(found, RETRIEVAL), long(views, JUDGED), long(lengths, ["answer_tokens"])]).filter("value IS NOT NULL")


@query(f"WITH {SQL_FACTS} SELECT * FROM full_facts")
def full_facts(spark, d):
    return facts(spark, d)


FACTORS = {"chunking": ("coarse", "fine"), "embedding": ("d32", "d64"), "rerank": ("off", "on")}
PRIMARY = ("span_coverage", "correct")
BINARY = ("correct", "abstained", "gold_found")
PAIRS = (("chunking", "rerank"), ("embedding", "rerank"))


@lru_cache(1)
def plan_rows() -> tuple[tuple, ...]:
    """What was fixed before the results: one metric a family against each factor, corrected together; all else is exploratory."""
    kind = lambda m: "binary" if m in BINARY else "continuous"
    rows = [(f, m, kind(m), "primary", "primary") for f in FACTORS for m in PRIMARY]
    rows += [(f, m, kind(m), "exploratory", None) for f in FACTORS for m in (*RETRIEVAL, *JUDGED, "answer_tokens") if m not in PRIMARY]
    return tuple(rows + [(f"{a} x {b}", m, kind(m), "interaction", None) for a, b in PAIRS for m in PRIMARY])


SQL_BOOTSTRAP = """
bn AS (SELECT effect, metric, CAST(diff AS DECIMAL(18, 9)) AS diff, row_number() OVER (PARTITION BY effect, metric ORDER BY diff) - 1 AS place, count(*) OVER (PARTITION BY effect, metric) AS n FROM diffs),
b0 AS (SELECT n, r, (CAST(r AS BIGINT) * 1000003 + CAST(d AS BIGINT) * 7919 + 7 * 104729 + 17) % 2147483647 AS x FROM (SELECT DISTINCT n FROM bn WHERE n > 1), range(10000) t(r), LATERAL (SELECT unnest(range(n)) AS d) u),
b1 AS (SELECT n, r, (x * x + 12345) % 2147483647 AS x FROM b0), b2 AS (SELECT n, r, (x * x + 67891) % 2147483647 AS x FROM b1), b3 AS (SELECT n, r, (x * x + 23456) % 2147483647 AS x FROM b2),
bk AS (SELECT n, r, x % n AS place, count(*) AS k FROM b3 GROUP BY ALL),
bm AS (SELECT effect, metric, r, CAST(sum(diff * k) AS DOUBLE) / max(n) AS m FROM bn JOIN bk USING (n, place) GROUP BY ALL),
bq AS (SELECT effect, metric, round(quantile_cont(m, (1 - 0.95) / 2), 9) AS ci_low, round(quantile_cont(m, (1 + 0.95) / 2), 9) AS ci_high FROM bm GROUP BY ALL),
boot AS (SELECT effect, metric, any_value(n) AS n, round(CAST(sum(diff) AS DOUBLE) / count(*), 6) AS mean, any_value(ci_low) AS ci_low, any_value(ci_high) AS ci_high FROM bn LEFT JOIN bq USING (effect, metric) GROUP BY effect, metric)"""
#: The law of a rank sum as a list: one rank after another joins or stays out. Ranks are doubled to whole numbers.
SQL_RANKS = """
wz AS (SELECT effect, metric, abs(diff) AS size, count(*) AS m, count(*) FILTER (diff > 0) AS pos FROM diffs WHERE diff <> 0 GROUP BY ALL),
wr AS (SELECT *, CAST(2 * sum(m) OVER (PARTITION BY effect, metric ORDER BY size) - m + 1 AS BIGINT) AS doubled FROM wz),
wp AS (SELECT effect, metric, CAST(sum(m) AS BIGINT) AS n, CAST(sum(pos * doubled) AS BIGINT) AS plus, flatten(list(list_transform(range(m), lambda x: [doubled::DOUBLE]))) AS ranks FROM wr GROUP BY ALL),
wl AS (SELECT effect, metric, n, plus, list_reduce(ranks, lambda law, r: list_transform(range(CAST(len(law) + r[1] AS BIGINT)), lambda k: (coalesce(law[k + 1], 0) + CASE WHEN k >= r[1] THEN coalesce(law[CAST(k - r[1] + 1 AS BIGINT)], 0) ELSE 0 END) / 2), [1.0::DOUBLE]) AS law FROM wp),
signed AS (SELECT effect, metric, n, round(least(1.0, 2 * least(list_sum(law[1:plus + 1]), list_sum(law[plus + 1:]))), 6) AS p_value, round(2.0 * plus / (n * (n + 1)) - 1, 6) AS effect_size FROM wl)"""
_FX = lambda f, low, high: f"SELECT '{f}' AS effect, metric, query_id, avg(value) FILTER ({f} = '{high}') - avg(value) FILTER ({f} = '{low}') AS diff, count(value) AS n FROM full_facts GROUP BY ALL"
_MEAN = lambda a, x, b, y: f"avg(value) FILTER ({a} = '{x}' AND {b} = '{y}')"
_IX = lambda a, b: f"SELECT '{a} x {b}', metric, query_id, ({_MEAN(a, FACTORS[a][1], b, FACTORS[b][1])} - {_MEAN(a, FACTORS[a][0], b, FACTORS[b][1])}) - ({_MEAN(a, FACTORS[a][1], b, FACTORS[b][0])} - {_MEAN(a, FACTORS[a][0], b, FACTORS[b][0])}), count(value) FROM full_facts GROUP BY ALL"
SQL_PLANNED = (
    SQL_FACTS
    + f""",
plan(effect, metric, kind, role, correction) AS (VALUES {", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in row) + ")" for row in plan_rows())}),
fx2 AS ({" UNION ALL ".join([*(_FX(f, *levels) for f, levels in FACTORS.items()), *(_IX(a, b) for a, b in PAIRS)])}),
diffs AS (SELECT effect, metric, query_id, round(diff, 9) AS diff FROM fx2 JOIN plan USING (effect, metric) WHERE n = 8),"""
    + SQL_BOOTSTRAP
    + ","
    + SQL_RANKS
    + """,
sg AS (SELECT effect, metric, count(*) FILTER (diff <> 0) AS n, count(*) FILTER (diff = 0) AS n_ties, count(*) FILTER (diff > 0) AS pos FROM diffs GROUP BY ALL),
tested AS (SELECT effect, metric, CASE WHEN sg.effect IS NOT NULL THEN CASE WHEN kind = 'binary' THEN 'sign test' ELSE 'signed ranks' END END AS test, coalesce(n_ties, 0) AS n_ties,
  CASE WHEN kind <> 'binary' THEN s.effect_size WHEN sg.n > 0 THEN round(2.0 * pos / sg.n - 1, 6) END AS effect_size,
  CASE WHEN kind <> 'binary' THEN s.p_value WHEN sg.n > 0 THEN round(least(1.0, 2 * list_sum(list_transform(range(0, least(pos, sg.n - pos) + 1), lambda k: exp(lgamma(sg.n + 1) - lgamma(k + 1) - lgamma(sg.n - k + 1) - sg.n * ln(2.0))))), 6) END AS p_value
  FROM plan LEFT JOIN sg USING (effect, metric) LEFT JOIN signed s USING (effect, metric)),
whole AS (SELECT p.effect, p.metric, role, correction, test, coalesce(b.n, 0) AS n, n_ties, mean, ci_low, ci_high, effect_size, p_value FROM plan p JOIN tested t USING (effect, metric) LEFT JOIN boot b USING (effect, metric)),
st AS (SELECT effect, metric, correction, p_value, row_number() OVER w AS rn, (count(*) OVER (PARTITION BY correction) - row_number() OVER w + 1) * p_value AS step FROM whole WHERE correction IS NOT NULL WINDOW w AS (PARTITION BY correction ORDER BY p_value NULLS LAST, effect, metric)),
hm AS (SELECT effect, metric, CASE WHEN p_value IS NOT NULL THEN round(least(1.0, max(step) OVER (PARTITION BY correction ORDER BY rn ROWS UNBOUNDED PRECEDING)), 6) END AS p_holm FROM st)"""
)


@query(f"WITH {SQL_PLANNED} SELECT w.*, p_holm FROM whole w LEFT JOIN hm USING (effect, metric)")
def planned_tests(spark, d):
    f = stored(facts(spark, d))
    rows = [effects.main_effect(f, factor, *levels) for factor, levels in FACTORS.items()]
    rows += [effects.interaction(f, (a, *FACTORS[a]), (b, *FACTORS[b])) for a, b in PAIRS]
    plan = spark.createDataFrame(plan_rows(), "effect string, metric string, kind string, role string, correction string")
    return effects.planned_tests(stored(reduce(DataFrame.unionByName, rows)), plan)


@query(f"WITH {SQL_EFFECTS},{SQL_BOOTSTRAP} SELECT * FROM boot")
def bootstrap_intervals(spark, d):
    return effects.bootstrap_interval(effect_rows(spark, d), ["effect", "metric"])


@query(f"WITH {SQL_EFFECTS},{SQL_RANKS} SELECT effect, metric, coalesce(s.n, 0) AS n, p_value, effect_size FROM (SELECT DISTINCT effect, metric FROM diffs) LEFT JOIN signed s USING (effect, metric)")
def wilcoxon_tests(spark, d):
    """Up to 50 questions the law is exact, here and in SQL; beyond it is normal, which SQL has no function for."""
    found = effects.wilcoxon(effect_rows(spark, d), ["effect", "metric"])
    return found.select("effect", "metric", "n", F.round("p_value", 6).alias("p_value"), F.round("effect_size", 6).alias("effect_size"))
