"""Agreement by key, resamples as rows, planned tests, judges' reports and tables of a run against brute force."""

import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.operators import answers, effects
from evidentia.sources.runs import RunTable


def kappa_by_hand(pairs, low, high, ordinal):
    n = len(pairs)
    span = max([high, *map(max, pairs)]) - min([low, *map(min, pairs)])
    penalty = (lambda a, b: ((a - b) / span) ** 2) if ordinal else (lambda a, b: float(a != b))
    seen = sum(penalty(a, b) for a, b in pairs) / n
    chance = sum(penalty(a, b) for a, _ in pairs for _, b in pairs) / n / n
    return round(1 - seen / chance, 4) if chance else float(seen == 0)


def rho_by_hand(pairs):
    ranks = lambda v: np.array([sum(y < x for y in v) + (sum(y == x for y in v) + 1) / 2 for x in v])
    a, b = (ranks([p[k] for p in pairs]) for k in (0, 1))
    return None if len(pairs) < 2 or a.std() == 0 or b.std() == 0 else round(float(np.corrcoef(a, b)[0, 1]), 4)


def test_agreement_by_key(spark):
    rng = random.Random(8)
    rows = []
    for k in range(12):
        for _ in range(rng.choice([1, 2, 30])):
            value = lambda: rng.choice([None, 1.0, 2.0, 2.5, 4.0, 7.0])
            rows.append((f"k{k}", k % 3 > 0, value(), value()))
    rows += [("same", True, 3.0, 3.0)] * 4 + [("none", True, None, 1.0), ("steady", True, 2.0, 2.0), ("steady", True, 2.0, 5.0)]
    got = {r.k: r for r in effects.agreement(spark.createDataFrame(rows, "k string, ordinal boolean, l double, r double"), ["k"], 1, 5).collect()}
    assert set(got) == {r[0] for r in rows}
    for key, group in itertools.groupby(sorted(rows, key=lambda r: r[0]), key=lambda r: r[0]):
        group = list(group)
        pairs, ordinal, r = [(a, b) for _, _, a, b in group if a is not None and b is not None], group[0][1], got[key]
        assert r.n == len(pairs)
        if not pairs:
            assert (r.exact, r.within_one, r.kappa, r.rho) == (None,) * 4
            continue
        assert r.exact == round(sum(a == b for a, b in pairs) / len(pairs), 4) and r.kappa == pytest.approx(kappa_by_hand(pairs, 1, 5, ordinal), abs=1e-4)
        assert r.within_one == (round(sum(abs(a - b) <= 1 for a, b in pairs) / len(pairs), 4) if ordinal else None)
        assert r.rho == (pytest.approx(rho_by_hand(pairs), abs=1e-4) if ordinal and rho_by_hand(pairs) is not None else None)
    # Half points lie between the whole ones: what counts is the distance of the values, not of their numbers.
    halves = spark.createDataFrame([(1.0, 1.0), (1.0, 1.5), (5.0, 5.0)], "l double, r double")
    assert effects.kappa(halves, [1.0, 2.0, 3.0, 4.0, 5.0]).first().kappa == kappa_by_hand([(1, 1), (1, 1.5), (5, 5)], 1, 5, True)


def test_bootstrap_equals_the_same_draws_by_hand(spark):
    rng = random.Random(1)
    groups = {"a": [rng.uniform(-1, 2) for _ in range(9)], "b": [0.5, 0.5], "c": [3.0], "d": [None], "e": [float(k) for k in range(40)]}
    rows = [(g, "m", x) for g, xs in groups.items() for x in xs] + [("a", "m", None)]
    got = {r.effect: r for r in effects.bootstrap_interval(spark.createDataFrame(rows, "effect string, metric string, diff double"), ["effect", "metric"], resamples=500, seed=3).collect()}

    def place(r, d, n):
        x = (r * 1_000_003 + d * 7_919 + 3 * 104_729 + 17) % 2_147_483_647
        for k in (12_345, 67_891, 23_456):
            x = (x * x + k) % 2_147_483_647
        return x % n

    for g, xs in groups.items():
        known = sorted(round(x, 9) for x in xs if x is not None)
        r = got[g]
        assert r.n == len(known)
        if len(known) < 2:
            assert r.ci_low is None and r.mean == (round(known[0], 6) if known else None)
            continue
        means = [sum(known[place(k, d, len(known))] for d in range(len(known))) / len(known) for k in range(500)]
        assert (r.mean, r.ci_low, r.ci_high) == pytest.approx((np.mean(known), *np.quantile(means, [0.025, 0.975])), abs=1e-6)


def test_draws_are_even_and_resamples_differ(spark):
    n = 17
    drawn = spark.range(3000).withColumnRenamed("id", "r").withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    counts = [r["count"] for r in drawn.groupBy(effects.drawn(F.col("r"), F.col("d"), F.lit(n), 7)).count().collect()]
    chi = sum((c - 3000) ** 2 / 3000 for c in counts)
    assert len(counts) == n and chi < 40  # 16 degrees of freedom
    rng = np.random.default_rng(0)
    values = rng.normal(size=n)
    got = effects.bootstrap_interval(spark.createDataFrame([("e", "m", float(v)) for v in values], "effect string, metric string, diff double"), ["effect", "metric"]).first()
    plain = np.quantile([values[rng.integers(0, n, n)].mean() for _ in range(20_000)], [0.025, 0.975])
    assert (got.ci_low, got.ci_high) == pytest.approx(tuple(plain), abs=0.03)


def test_the_plan_picks_the_test_and_the_correction(spark):
    diffs = [("f", "win", float(x)) for x in [1, 1, 1, 1, 1, -1, 0]] + [("f", "score", x) for x in [0.1, 0.2, 0.3, 0.4, -0.05, 0.0]] + [("g", "score", x) for x in [1.0, -1.0]] + [("f", "unplanned", 1.0)]
    plan = [("f", "win", "binary", "primary", "p"), ("f", "score", "continuous", "primary", "p"), ("h", "score", "continuous", "primary", "p"), ("g", "score", "continuous", "exploratory", None)]
    rows = spark.createDataFrame([(e, m, k, x) for k, (e, m, x) in enumerate(diffs)], "effect string, metric string, query_id long, diff double")
    got = {(r.effect, r.metric): r for r in effects.planned_tests(rows, spark.createDataFrame(plan, "effect string, metric string, kind string, role string, correction string"), resamples=100).collect()}
    assert len(got) == 4
    win, score, empty, other = got["f", "win"], got["f", "score"], got["h", "score"], got["g", "score"]
    assert (win.test, win.n, win.n_ties, win.p_value) == ("sign test", 7, 1, 0.21875) and win.effect_size == pytest.approx(4 / 6, abs=1e-6)
    signs = list(itertools.product([-1, 1], repeat=5))
    total = [sum(r for r, s in zip((2, 3, 4, 5, 1), x) if s > 0) for x in signs]
    p = 2 * sum(t >= 14 for t in total) / len(signs)
    assert (score.test, score.n, score.n_ties, score.p_value) == ("signed ranks", 6, 1, p)
    # Three tests are corrected together, though one of them has no data.
    assert score.p_holm == pytest.approx(3 * p) and win.p_holm == pytest.approx(2 * 0.21875)
    assert (empty.n, empty.p_value, empty.p_holm, empty.test) == (0, None, None, None)
    assert other.p_holm is None and other.p_value == 1.0 and other.role == "exploratory"


SCHEMA = "chunking string, embedding string, rerank string, item_id long, pass_index int, verdict string, faithfulness double, relevance double, completeness double, rationale string, error string"


def judgement(cell, item, turn, verdict, scores=(None, None, None)):
    return (*cell, item, turn, verdict, *scores, None, None)


def test_judge_report_and_passes(spark):
    a, b = ("c", "e", "off"), ("c", "e", "on")
    rows = [
        judgement(a, 1, 3, "correct", (5.0, 4.0, 3.0)), judgement(a, 1, 5, "incorrect", (1.0, 2.0, 3.0)), judgement(a, 2, 3, "abstained"), judgement(a, 2, 5, "correct", (2.0, 2.0, 2.0)),
        judgement(a, 3, 5, "correct", (5.0, 5.0, 5.0)), judgement(b, 1, 0, "unparsed"),
    ]
    judged = spark.createDataFrame(rows, SCHEMA)
    got = {r.rerank: r for r in answers.judge_report(judged, ["chunking", "embedding", "rerank"], "item_id").collect()}
    r = got["off"]
    assert (r.n_judgements, r.n_answers, r.n_passes, r.correct, r.abstained, r.incorrect, r.n_scored) == (5, 3, 2, 1, 1, 0, 2)
    assert (r.faithfulness, r.faithfulness_n, r.correct_rate, r.abstention_rate) == (round((3 + 2 + 5) / 3, 3), 3, 0.3333, 0.3333)
    assert (got["on"].unparsed, got["on"].faithfulness, got["on"].correct_rate, got["on"].n_scored) == (1, None, 0.0, 0)
    sides = {(r.item_id, r.scale): (r.l, r.r) for r in answers.passes_side_by_side(judged, ["chunking", "embedding", "rerank"], "item_id").collect()}
    assert set(sides) == {(i, s) for i in (1, 2) for s in ("faithfulness", "relevance", "completeness", "verdict")}
    assert sides[1, "relevance"] == (4.0, 2.0) and sides[2, "faithfulness"] == (None, 2.0) and sides[1, "verdict"] == (1.0, 3.0) and sides[2, "verdict"] == (4.0, 1.0)


@pytest.mark.parametrize("value, score, error", [("true", 1.0, None), ('"true"', None, "relevance is no number"), ('"4"', 4.0, None), ("4.5", 4.5, None), ("false", None, "relevance is out of range"), ("[1]", None, "relevance is no number"), ("null", None, "relevance is missing")])
def test_a_score_is_a_number_or_a_boolean(spark, value, score, error):
    reply = spark.createDataFrame([(f'{{"verdict": "correct", "faithfulness": 1, "relevance": {value}, "completeness": 5}}',)], "reply string")
    r = answers.parse_verdicts(reply).first()
    assert (r.relevance, r.error) == (score, error)


# --- tables of a run -----------------------------------------------------------------


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_one_cell_is_rewritten_and_the_others_keep_their_files(spark, tmp_path):
    cells = [(c, e, r) for c in "xy" for e in "pq" for r in ("off", "on")]
    rows = [judgement(cell, i, t, "unparsed" if cell == cells[3] and i == 2 or cell == cells[5] else "correct", (1.0, 2.0, 3.0)) for cell in cells for i in range(4) for t in (0, 1)]
    runs = RunTable(spark, str(tmp_path), "judgements")
    assert runs.read().count() == 0 and runs.read().columns == SCHEMA_NAMES
    judged = spark.createDataFrame(rows, SCHEMA)
    runs.write(judged)
    before = files(runs.path)
    assert runs.drop(F.col("verdict") == "unparsed") == 10 and runs.drop(F.col("verdict") == "unparsed") == 0
    after = files(runs.path)
    of = lambda held, cell: {f: t for f, t in held.items() if "/".join(f"{k}={v}" for k, v in zip(("chunking", "embedding", "rerank"), cell)) in f}
    for cell in cells:
        same = of(before, cell) == of(after, cell)
        assert same == (cell not in (cells[3], cells[5]))
    assert not of(after, cells[5]) and len(of(after, cells[3])) == 1
    # What is left reads as if the unparsed rows had never been there.
    plain = sorted(r[:9] for r in rows if r[5] != "unparsed")
    assert sorted(tuple(r[c] for c in SCHEMA_NAMES_IN_ROWS) for r in runs.read().collect()) == plain
    # The run goes on: what is missing is what was dropped, and judging it again adds no row twice.
    assert sorted(map(tuple, runs.missing(judged.select("chunking", "embedding", "rerank", "item_id", "pass_index")).collect())) == sorted(r[:5] for r in rows if r[5] == "unparsed")
    again = judged.withColumn("verdict", F.lit("incorrect"))
    runs.append(again.union(again))
    assert runs.read().count() == len(rows) and runs.read().filter("verdict = 'incorrect'").count() == 10


SCHEMA_NAMES = ["item_id", "pass_index", "verdict", "faithfulness", "relevance", "completeness", "rationale", "error", "chunking", "embedding", "rerank"]
SCHEMA_NAMES_IN_ROWS = ["chunking", "embedding", "rerank", "item_id", "pass_index", "verdict", "faithfulness", "relevance", "completeness"]


def test_a_read_of_a_cell_is_pruned(spark, tmp_path):
    runs = RunTable(spark, str(tmp_path), "judgements")
    runs.write(spark.createDataFrame([judgement((c, "e", r), 1, 0, "correct") for c in "xyz" for r in ("off", "on")], SCHEMA))
    one = runs.read(chunking="y", rerank="on")
    plan = one._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "chunking" in filters and "= y" in filters and "= on" in filters
    assert one.count() == 1 and {f"{r.f}".split("chunking=")[1].split("/")[0] for r in one.select(F.input_file_name().alias("f")).collect()} == {"y"}
    with pytest.raises(ValueError):
        runs.read(pass_index="0")


def test_chunks_lie_by_chunking_alone(spark, tmp_path):
    runs = RunTable(spark, str(tmp_path), "chunks")
    row = ("1-0000", 1, 0, 2, 0, 5, "a bcd", "x")
    schema = "chunk_id string, doc_id long, chunk_index int, n_tokens int, char_start int, char_end int, text string, content_sha256 string, chunking string, extra int"
    runs.write(spark.createDataFrame([(*row, "fine", 1), (*row, "coarse", 1)], schema))
    runs.write(spark.createDataFrame([("2-0000", *row[1:], "fine", 1)], schema))
    assert sorted((r.chunking, r.chunk_id) for r in runs.read().collect()) == [("coarse", "1-0000"), ("fine", "2-0000")]
