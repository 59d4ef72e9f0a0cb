import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.functions import text as T
from evidentia.operators import answers, chunking, effects, retrieval, spans
from evidentia.sources.tables import append_new, read_jsonl, read_sheet, write_jsonl


def test_fixed_windows():
    assert list(chunking.windows(25, 10, 0)) == [(0, 10), (10, 20), (20, 25)]
    assert [(a, b - a) for a, b in chunking.windows(10, 4, 2)] == [(0, 4), (2, 4), (4, 4), (6, 4), (8, 2), (9, 1)]
    with pytest.raises(ValueError):
        list(chunking.windows(5, 2, 2))


def test_recursive_pieces():
    text = "\n\n".join(" ".join(f"w{p}{i}" for i in range(7)) for p in range(3))
    pieces = chunking.recursive_pieces(text, 10, ["\n\n", "\n", ". ", " ", ""])
    assert [level for *_, level in pieces] == [0, 0, 0] and pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert chunking.recursive_pieces("a b c", 10, ["\n\n", ""]) == [(0, 5, None)]
    assert [text[a:b] for text in ["a1 a2|b1 b2|c1 c2"] for a, b, _ in chunking.recursive_pieces(text, 2, ["|", ""])] == ["a1 a2|", "b1 b2|", "c1 c2"]
    nine = " ".join("abcdefghi")
    assert [level for *_, level in chunking.recursive_pieces(nine, 3, ["\n\n", ""])] == [1, 1, 1]
    assert chunking.recursive_pieces("", 3, [""]) == []


@pytest.mark.parametrize(
    ("costs", "budget", "taken", "reason"),
    [([400, 400, 900, 100], 1000, 2, "overflow"), ([1900, 600, 50], 2000, 1, "overflow"), ([500, 500], 1000, 2, "candidates_exhausted"), ([1500], 1000, 0, "overflow"), ([], 1000, 0, "no_candidates")],
)
def test_fill(spark, costs, budget, taken, reason):
    ranked = spark.createDataFrame([("q", i + 1, c) for i, c in enumerate(costs)], "q string, rank int, n_tokens int")
    grid = spark.createDataFrame([("q",)], "q string")
    row = retrieval.fill_summary(ranked, ["q"], budget, grid).first()
    assert (row["n_chunks"], row["stopped_reason"]) == (taken, reason)
    assert retrieval.fill_budget(ranked, ["q"], budget).count() == taken


def test_coverage_and_rank(spark):
    gold = spark.createDataFrame([(1, 7, 120, 260)], "item_id long, gold_doc long, gold_start long, gold_end long")
    rows = [("a", 1, 1, 7, 100, 200, 10), ("b", 1, 1, 8, 100, 300, 5), ("b", 1, 2, 7, 200, 300, 9), ("c", 1, 1, 7, 260, 300, 4), ("d", 1, 1, 7, 100, 300, 1), ("d", 1, 2, 7, 150, 280, 1)]
    sel = spark.createDataFrame(rows, "cell string, item_id long, rank int, doc_id long, char_start long, char_end long, n_tokens int")
    n_rel = spark.createDataFrame([(1, 2)], "item_id long, n_rel long")
    got = {r["cell"]: r for r in spans.context_metrics(sel, gold, ["cell", "item_id"], n_rel).collect()}
    assert got["a"]["span_coverage"] == round(80 / 140, 6) and got["b"]["span_coverage"] == round(60 / 140, 6)
    assert got["b"]["gold_rank"] == 2 and got["b"]["tokens_before_gold"] == 5 and got["b"]["distractors"] == 1
    assert got["c"]["gold_rank"] is None and got["c"]["span_coverage"] == 0  # touching is no overlap
    assert got["d"]["span_coverage"] == 1.0


def test_touching_intervals_merge(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (1, 11, 12), (1, 2, 3)], "k int, s int, e int")
    assert sorted((r.s, r.e) for r in spans.merge_intervals(rows, ["k"], "s", "e").collect()) == [(0, 9), (11, 12)]


def test_text(spark):
    rows = spark.createDataFrame([("the tide turned [].  ",), ("gone (; ,) and  left [,]",), ("word []next",), ("a (;] b",)], "t string")
    assert [r[0] for r in rows.select(T.normalise(F.col("t"))).collect()] == ["the tide turned.", "gone and left", "wordnext", "a b"]
    same = spark.createDataFrame([(" Not said... ", "Not said.", True), ("", "", False), ("x", "Not said", False)], "a string, r string, want boolean")
    assert all(r.got == r.want for r in same.withColumn("got", T.same_refusal(F.col("a"), F.col("r"))).collect())


def test_template_values_are_not_searched(spark):
    one = spark.range(1).select(answers.fill_template("{a}-{b}-{a}", {"a": F.lit("{b}"), "b": F.lit("x")}).alias("t")).first()
    assert one.t == "{b}-x-{b}"


def by_enumeration(values):
    """Signed ranks over every way to choose the signs; the normal law beyond 50."""
    if not values:
        return 0, None, None
    size = sorted(map(abs, values))
    rank = {s: sum(i + 1 for i, x in enumerate(size) if x == s) / size.count(s) for s in size}
    n, plus = len(values), sum(rank[abs(v)] for v in values if v > 0)
    effect = 2 * plus / (n * (n + 1) / 2) - 1
    if n > 50:
        return n, math.erfc(abs(plus - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24) / math.sqrt(2)), effect
    sums = [sum(rank[abs(v)] for v, on in zip(values, signs) if on) for signs in itertools.product((0, 1), repeat=n)]
    tail = min(sum(s <= plus for s in sums), sum(s >= plus for s in sums)) / len(sums)
    return n, min(1.0, 2 * tail), effect


def test_sign_wilcoxon_holm(spark):
    diffs = spark.createDataFrame([("all", float(i)) for i in range(1, 6)] + [("even", x) for x in (1.0, 2.0, 3.0, -1.0, -2.0, -3.0)] + [("ties", 0.0)], "effect string, diff double")
    got = {r.effect: r for r in effects.sign_test(diffs, ["effect"]).collect()}
    assert got["all"].p_value == 0.0625 and got["even"].p_value == 1.0 and got["even"].effect_size == 0 and got["ties"].p_value is None
    three = spark.createDataFrame([("x", v) for v in (1.0, 2.0, 3.0, 0.0)], "effect string, diff double")
    row = effects.wilcoxon(three, ["effect"]).first()
    assert (row.n, round(row.p_value, 9), row.effect_size) == (3, 0.25, 1.0)
    rng = np.random.default_rng(4)
    groups = {f"g{n}": [float(x) for x in rng.integers(-3, 4, n)] for n in (1, 2, 5, 8, 10)} | {"many": [float(x) for x in rng.normal(0.2, 1, 80)], "zeros": [0.0, 0.0]}
    rows = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "effect string, diff double")
    for r in effects.wilcoxon(rows, ["effect"]).collect():
        n, p, effect = by_enumeration([v for v in groups[r.effect] if v])
        assert r.n == n and (r.p_value is None) == (p is None)
        assert p is None or (abs(r.p_value - p) < 1e-9 and abs(r.effect_size - effect) < 1e-9)
    tests = spark.createDataFrame([("f", n, p) for n, p in zip("abcdef", (0.01, 0.02, None, None, None, None))], "family string, name string, p_value double")
    assert {r.name: r.p_holm for r in effects.holm(tests, ["family"]).collect()} == {"a": 0.06, "b": 0.1, "c": None, "d": None, "e": None, "f": None}


def test_agreement(spark):
    pairs = [(1.0, 1.0)] * 20 + [(1.0, 0.0)] * 5 + [(0.0, 1.0)] * 5 + [(0.0, 0.0)] * 10 + [(None, 1.0)]
    rows = spark.createDataFrame(pairs, "l double, r double")
    assert effects.kappa(rows, [0.0, 1.0], "none").first().kappa == 0.4667
    assert effects.spearman(spark.createDataFrame([(3.0, 2.0), (3.0, 2.0), (3.0, 2.0), (5.0, 4.0)], "l double, r double")).first().rho == 1.0
    assert effects.spearman(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "l double, r double")).first().rho is None


def test_effects_need_every_cell(spark):
    cells = [(c, e, r) for c in ("fixed", "rec") for e in ("x", "y") for r in ("off", "on")]
    facts = [(*k, q, "m", 0.1 * len(q) + (0.25 if k[0] == "rec" else 0)) for k in cells for q in ("q1", "q02")]
    rows = spark.createDataFrame(facts[:-1], "chunking string, embedding string, rerank string, query_id string, metric string, value double")
    got = effects.main_effect(rows, "chunking", "fixed", "rec").collect()
    assert [(r.query_id, r["diff"]) for r in got] == [("q1", 0.25)]


def test_sources(spark, tmp_path):
    assert read_jsonl(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0
    (tmp_path / "x.jsonl").write_text('{"a": 1, "other": 2}\n{}\n')
    assert sorted((r.a for r in read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").collect()), key=str) == [1, None]
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    for _ in range(2):
        append_new(rows, str(tmp_path / "sink"), ["k"])
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 2


def test_streamed_append_once(spark, tmp_path):
    from evidentia.streaming.resume import append_stream

    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k int, v string").write.parquet(source)
    for run in range(2):
        stream = spark.readStream.schema("k int, v string").parquet(source)
        append_stream(stream, str(tmp_path / "out"), ["k"], str(tmp_path / f"cp{run}")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_verdicts_are_parsed_strictly(spark):
    def reply(**fields):
        return json.dumps({"verdict": "correct", "faithfulness": 5, "relevance": 4, "completeness": 3} | fields)

    cases = {
        "Sure:\n" + reply(): ("correct", None),
        "```json\n" + reply(verdict=" Partially Correct ") + "\n```": ("partially_correct", None),
        "``` " + reply() + " ```": ("correct", None),
        reply(verdict="abstained", relevance=None): ("abstained", None),
        reply(relevance="4"): ("correct", None),
        reply(verdict="good"): ("unparsed", "unknown verdict"),
        reply(relevance=None): ("unparsed", "relevance is missing"),
        reply(completeness="many"): ("unparsed", "completeness is no number"),
        reply(faithfulness=7): ("unparsed", "faithfulness is out of range"),
        "no braces": ("unparsed", "no object"),
        "{broken": ("unparsed", "no object"),
        "{broken}": ("unparsed", "broken object"),
        "": ("unparsed", "no object"),
    }
    rows = spark.createDataFrame([(r,) for r in cases] + [(None,)], "reply string")
    got = {r.reply: r for r in answers.parse_verdicts(rows).collect()}
    assert {r: (got[r].verdict, got[r].error) for r in cases} == cases and got[None].verdict == "unparsed"
    assert got[reply(verdict="abstained", relevance=None)].faithfulness is None


def test_nearest_in_blocks_of_queries(spark):
    rng = np.random.default_rng(0)
    vectors = np.round(rng.normal(size=(300, 8)), 1)
    items = spark.createDataFrame([(f"i{k:03d}", v.tolist()) for k, v in enumerate(vectors)], "item_id string, vector array<double>").repartition(5)
    queries = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors[:40])], "query_id long, vector array<double>")
    got = {}
    for r in retrieval.nearest(queries, items, 7, most_queries=9, block=4).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.item_id
    score = np.round(vectors[:40] @ vectors.T, 6)
    assert got == {k: {i + 1: f"i{j:03d}" for i, j in enumerate(sorted(range(300), key=lambda j: (-score[k, j], j))[:7])} for k in range(40)}


def test_sheet_and_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("item,verdict,score\n1,correct,4\n2,,\n,,\n")
    rows = read_sheet(spark, str(tmp_path / "a.csv"), "item int, verdict string, score double").collect()
    assert sorted((r.item, r.verdict, r.score) for r in rows) == [(1, "correct", 4.0), (2, None, None)]
    for bad in ("item,mark,score\n1,x,2\n", "item,verdict,score\n1,x\n", "item,verdict,score\n1,x,2,3\n"):
        (tmp_path / "b.csv").write_text(bad)
        with pytest.raises(Exception):
            read_sheet(spark, str(tmp_path / "b.csv"), "item int, verdict string, score double").collect()
    write_jsonl(spark.createDataFrame([(1, None)], "b int, a string"), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"a":null,"b":1}']


def test_passages_in_blocks_are_found_alike(spark):
    docs = spark.createDataFrame([(k, f"{'x' * k} alpha beta {'gamma ' * (k % 3)}end") for k in range(40)] + [(90, None), (91, "")], "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "gamma gamma"), (3, "end"), (4, "alpha beta"), (5, ""), (6, None), (7, "beta gamma")], "item_id long, text string")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    want = {(r.item_id, i, t.index(r.text), t.index(r.text) + len(r.text)) for r in asked.collect() if r.text for i, t in text.items() if r.text in t}
    for most, chars in ((100, 10**6), (2, 10**6), (100, 12)):
        found = spans.contained_passages(docs, asked, most_passages=most, most_chars=chars).select("item_id", "doc_id", "gold_start", "gold_end")
        assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
    assert spans.contained_passages(docs, asked.limit(0)).count() == 0
