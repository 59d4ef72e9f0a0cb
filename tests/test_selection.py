"""Selection, drafts, counts over candidates and reports, on the cases where a plausible reading goes wrong."""

import pytest
from pyspark.sql import functions as F

from evidentia.operators import answers, goldset, reports, reviews


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "kind, url, allowed, patterns, reason",
    [
        ("letter", "x/by/4", ["review"], ["by"], "article_type=letter"),
        ("", "x/by/4", ["review"], ["by"], "article_type=missing"),
        (None, None, ["review"], ["by"], "article_type=missing"),
        ("review", "x/BY/4", ["review"], ["by"], "license=x/BY/4"),
        ("review", "", ["review"], ["by"], "license=missing"),
        ("review", None, [], ["by"], "license=missing"),
        ("letter", None, [], [], None),
        ("letter", "x/by/4", [], ["nc", "by"], None),
    ],
)
def test_reasons_have_their_value_and_empty_lists_pass_all(spark, kind, url, allowed, patterns, reason):
    assert one(spark, reviews.eligibility(F.lit(kind).cast("string"), allowed, F.lit(url).cast("string"), patterns)) == reason


def test_the_target_is_met_by_the_first_that_pass(spark):
    rows = spark.createDataFrame([(k, None if k % 3 == 0 else f"r{k % 3}") for k in range(20)], "k long, reason string")
    got = {r.reason: r for r in reviews.take_target(rows, ["k"], "reason", 3).collect()}
    assert {k: r.n for k, r in got.items()} == {None: 3, "r1": 2, "r2": 2}  # 0 to 6
    assert {(r.considered, r.taken, r.rejected, r.short) for r in got.values()} == {(7, 3, 4, 0)}
    assert {(r.considered, r.taken, r.short) for r in reviews.take_target(rows, ["k"], "reason", 50).collect()} == {(20, 7, 43)}
    assert reviews.take_target(rows.limit(0), ["k"], "reason", 3).count() == 0


def test_pinned_rows_come_first_and_set_no_tier(spark):
    # In group a the pinned row is the only one of the good tier; b is of the good tier; c is off topic but for its pin.
    rows = [(1, "a", True, 0, "0", "m1"), (2, "a", True, 1, "1", "m1"), (3, "b", True, 0, "0", "m9"), (4, "b", True, 1, "1", "m9"), (5, "c", False, 0, "0", "m0"), (6, "c", False, 0, "1", "m0"), (7, "d", True, 1, "0", "m2")]
    table = spark.createDataFrame(rows, "id long, paper string, on_topic boolean, tier int, order string, mixed string")
    pins = spark.createDataFrame([(5, 0), (1, 1)], "id long, pin int")
    drawn = lambda n, each, p=pins: {r.id: r.pin for r in reviews.draw(table, p, "id", "paper", n, each).collect()}
    assert drawn(3, 1) == {5: 0, 1: 1, 3: None}  # a is full, 7 is of a worse tier
    assert drawn(4, 2) == {5: 0, 1: 1, 3: None, 4: None}  # b as a whole before a, whose first row left is of the other tier
    assert set(drawn(9, 2)) == {5, 1, 3, 4, 2, 7}
    assert drawn(1, 1) == {5: 0, 1: 1}
    assert set(drawn(2, 1, pins.limit(0))) == {1, 3}
    with pytest.raises(ValueError, match="1 pinned"):
        reviews.draw(table, spark.createDataFrame([(5, 0), (99, 1)], "id long, pin int"), "id", "paper", 3, 1)


def test_years_are_a_partition_only_if_they_add_up_to_the_range(spark):
    rows = [(1, "2001-02-01"), (2, "2001-03-01"), (2, "2002-03-01"), (3, "2003-01-01"), (4, None), (9, "1999-01-01")]
    got = reviews.survey(spark.createDataFrame(rows, "id long, d string").withColumn("d", F.to_date("d")), "id", "d", "2001-01-01", "2003-12-31").collect()
    assert {(r.year, r.n) for r in got} == {(2001, 2), (2002, 1), (2003, 1)}
    assert {(r.partition_total, r.unique_total, r.whole_range, r.exact) for r in got} == {(4, 3, 4, True)}
    twice = spark.createDataFrame([(1, "2001-02-01"), (1, "2001-02-02")], "id long, d string").withColumn("d", F.to_date("d"))
    assert reviews.survey(twice, "id", "d", "2001-01-01", "2001-12-31").first().exact is False


@pytest.mark.parametrize(
    "reply, pair",
    [
        ("QUESTION: a?\nANSWER: b.", ("a?", "b.")),
        ("Sure.\nQUESTION:  why\nnot? \n ANSWER: no\nreason ", ("why\nnot?", "no\nreason")),
        ("ANSWER: x QUESTION: y", None),
        ("QUESTION: a? ANSWER:  ", None),
        ("QUESTION: ANSWER: b", None),
        ("ANSWER: x QUESTION: y ANSWER: z", ("y", "z")),
        ("a question", None),
    ],
)
def test_a_draft_names_its_question_before_its_answer(spark, reply, pair):
    got = one(spark, reviews.draft_reply(F.lit(reply)))
    assert (got and tuple(got)) == pair


def test_a_blank_takes_a_whole_word(spark):
    df = spark.createDataFrame([("tide", 5), ("art", 1), ("party", 9), ("artful", 9), ("sees", 9)], "term string, df long")
    texts = [(1, "Short one. The artful party sees Art, then art."), (2, "The and of."), (3, "Éart is a part of artées x9 tide.")]
    got = {r.item_id: (r.question, r.answer) for r in reviews.cloze(spark.createDataFrame(texts, "item_id long, text string"), df, "item_id").collect()}
    assert got[1] == ("Complete the reported finding: The artful party sees ____, then art.", "art")
    assert 2 not in got
    assert "____" not in got[3][0] or got[3][0].count("____") == 1


@pytest.mark.parametrize(
    "declared, title, kind",
    [("Methods|materials", "Results", "methods"), (" RESULTS ", "x", "results"), ("", "2.4. Statistical Analysis", "methods"), (None, "Discussion of results", "results"), ("intro", "Findings", "other"), ("other", None, "other")],
)
def test_a_declared_type_goes_before_the_title(spark, declared, title, kind):
    patterns = {"methods": ["methods", "analysis"], "results": ["results"]}
    assert one(spark, reports.section_kind(F.lit(title).cast("string"), patterns, F.lit(declared).cast("string"))) == kind


def test_quantiles_have_one_digit(spark):
    rows = spark.createDataFrame([("a", k) for k in (1, 2, 4, 8, 16)] + [("b", None)], "k string, n long")
    got = {r.k: r for r in reports.distribution(rows, ["k"], "n").collect()}
    assert (got["a"].p10, got["a"].median, got["a"].p90, got["a"].mean) == (1.4, 4.0, 12.8, 6.2) and got["b"].n == 0


def test_a_call_a_minute_old_has_left(spark):
    calls = [("c", "2024-01-01 00:00:00"), ("c", "2024-01-01 00:00:59.999999"), ("c", "2024-01-01 00:01:00"), ("c", "2024-01-01 00:01:00.5"), ("d", "2024-01-01 00:01:00")]
    rows = spark.createDataFrame(calls, "client string, t string").withColumn("t", F.col("t").cast("timestamp"))
    got = sorted((r.client, r.t, r.window_requests) for r in answers.rolling_load(rows, "t", F.lit(10)).collect())
    assert [n for _, _, n in got] == [1, 2, 2, 3, 1]


def test_answers_are_cut_off_at_their_tokens(spark):
    rows = spark.createDataFrame([("a b  c d",), ("a b",), ("",)], "answer string")
    got = [tuple(r) for r in answers.cut_answer(rows, 3).collect()]
    assert got == [("a b c", 3, "length"), ("a b", 2, "stop"), ("", 0, "stop")]


def test_candidates_are_counted_once_however_many_reasons_they_have(spark):
    schema = "item_id long, reasons array<string>, kind string, selected boolean, verified boolean, warned boolean, on_topic boolean, overridden boolean, pinned boolean"
    rows = [(1, ["a", "b"], "results", False, False, True, True, False, False), (2, ["a"], "results", False, True, False, True, False, True), (3, [], None, True, True, False, False, True, False), (4, [], "methods", True, False, False, True, False, False)]
    got = {(r.counter, r.value): r.n for r in goldset.candidate_counts(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        ("rejected_by_reason", "a"): 2, ("rejected_by_reason", "b"): 1, ("reasons_a_candidate", "1"): 1, ("reasons_a_candidate", "2"): 1,
        ("section_kind", "results"): 2, ("section_kind", None): 1, ("section_kind", "methods"): 1, ("selected_section_kind", None): 1, ("selected_section_kind", "methods"): 1,
        ("drafted", ""): 4, ("auto_rejected", ""): 2, ("surviving", ""): 2, ("selected", ""): 2, ("verified", ""): 1, ("with_warnings", ""): 1, ("off_topic_selected", ""): 1, ("off_topic_overrides", ""): 1, ("pinned", ""): 1,
    }
    none = {r.counter: r.n for r in goldset.candidate_counts(spark.createDataFrame([], schema)).collect()}
    assert set(none.values()) <= {0}


def test_where_candidates_went(spark):
    schema = "item_id long, reasons array<string>, rejection string, selected boolean, note string"
    rows = [(1, ["a", "b"], None, False, "n1"), (2, ["a", "b"], "", False, "n2"), (3, ["a"], "own", False, None), (4, [], "x", True, "kept")]
    got = {r.reason: (r.n, r.notes) for r in goldset.selection_counts(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"a,b": (2, "1: n1\n2: n2"), "own": (1, "")}


def test_checks_say_what_fired_and_warn_of_methods(spark):
    schema = "item_id long, source long, question string, answer string, span string, abstract string, kind string"
    span = "Rainfall increased river salinity across seven estuaries sampled during winter."
    rows = [
        (1, 1, "What happened there?", "Rainfall increased river salinity", span, "Nothing alike.", "methods"),
        (2, 1, "What happened there?", "seven estuaries sampled during winter", span, "Nothing alike.", "methods"),
        (3, 1, "What happened there?", "seven estuaries sampled during winter", span, "Nothing alike.", "results"),
        (4, 1, "Did rainfall increase river salinity?", "unrelated words entirely", span, span, None),
    ]
    docs = spark.createDataFrame([(1, span)], "doc_id long, text string")
    got = {r.item_id: r for r in goldset.check_candidates(spark.createDataFrame(rows, schema), docs, units=["people"], markers={}, retractions=["did not"], results=["increase", "decrease"]).collect()}
    assert (got[1].result_language, got[1].warnings, got[1].auto_rejected, got[1].reasons) == ("increase", "", False, "")
    assert (got[2].result_language, got[2].warnings, got[2].auto_rejected) == ("", goldset.METHODS_WARNING, False)
    assert got[3].warnings == "" and got[4].warnings == ""
    assert got[4].auto_rejected and got[4].reasons == "answerable_without_span" and got[4].grounding == 0.0


def test_a_retrieval_report_over_questions(spark):
    schema = "cell string, n_chunks int, tokens_used long, budget_slack long, stopped_reason string, gold_rank int, tokens_before_gold long, span_coverage double, evidence_density double, distractors int, recall double, ndcg double"
    rows = [("a", 2, 90, 10, "overflow", 1, 0, 1.0, 0.5, 1, 1.0, 1.0), ("a", 4, 70, 30, "candidates_exhausted", None, None, 0.0, 0.0, 4, 0.0, 0.0), ("a", 0, 0, 100, "no_candidates", None, None, 0.0, 0.0, 0, 0.0, 0.0), ("b", 1, 50, 50, "overflow", None, None, 0.0, 0.0, 1, 0.0, 0.0)]
    got = {r.cell: r for r in reports.retrieval_report(spark.createDataFrame(rows, schema), ["cell"], 100).collect()}
    a, b = got["a"], got["b"]
    assert (a.n_queries, a.overflow, a.candidates_exhausted, a.no_candidates, a.gold_found) == (3, 1, 1, 1, 1)
    assert (a.mean_gold_rank, a.mean_tokens_before_gold, a.span_coverage, a.realised_budget_share) == (1.0, 0.0, 0.3333, 0.5333)
    assert (a.n_chunks_median, a.tokens_used_mean, a.budget_slack_p90, a.n_chunks_std) == (2.0, 53.3, 86.0, 1.6)
    assert (b.mean_gold_rank, b.mean_tokens_before_gold, b.gold_found) == (None, None, 0)
