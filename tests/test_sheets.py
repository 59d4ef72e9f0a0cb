"""Sheets for people: draws, notes, scores that came back, cover by two labels, authored questions."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from evidentia.operators import sheets
from evidentia.sources.tables import read_authored


def test_notes(spark):
    rows = spark.createDataFrame([("One. Two? Three!",), ("One 1.5 only.",), ("  ",), (None,)], "t string").withColumn("c", sheets.contiguity_note(F.col("t")))
    assert [r.c for r in rows.collect()] == ["3 sentences -- the answer is stated in more than one place", "", "", ""]
    shown = lambda note, template: spark.range(1).select(sheets.judge_note(F.lit(note).cast("string"), template).alias("x")).first().x
    assert shown("  as it is\n", "Mind: {judge_note}!") == "Mind: as it is!" and shown(" ", "none") == shown(None, "none") == ""
    with pytest.raises(PySparkException):
        shown("a note", "none")


def test_ids_in_the_order_of_their_numbers(spark):
    rows = spark.createDataFrame([("PMC10",), ("PMC9",), ("PMC100",)], "pmcid string")
    assert [r.pmcid for r in rows.orderBy(sheets.number_of(F.col("pmcid"))).collect()] == ["PMC9", "PMC10", "PMC100"]


def test_items_are_dealt_over_the_cells_and_have_all_their_rows_need(spark):
    rows = [("a", "x", k) for k in range(50)] + [("b", "x", k) for k in range(3)] + [("a", "y", k) for k in range(50)]
    answers = spark.createDataFrame(rows, "arm string, emb string, q int").withColumn("answer", F.concat("arm", F.lit(" says "), "q"))
    drawn = sheets.draw_items(answers, ["arm", "emb"], "q", 21)
    by = {r.config: r["count"] for r in drawn.groupBy("config").count().collect()}
    assert by == {"a-x": 9, "a-y": 9, "b-x": 3}
    assert {r.sheet_id for r in drawn.collect()} == {r.sheet_id for r in sheets.draw_items(answers.repartition(3), ["arm", "emb"], "q", 21).collect()}
    queries = spark.createDataFrame([(k, f"q{k}", f"r{k}", "n" if k else None) for k in range(50)], "q int, question string, reference string, note string")
    contexts = answers.filter("arm = 'a'").select("arm", "emb", "q", F.lit("what it saw").alias("context"))
    items = sheets.sheet_items(drawn, queries, contexts, ["arm", "emb"], "q").collect()
    assert len(items) == 21 and [i.sheet_id for i in items] == sorted(i.sheet_id for i in items)
    assert all(i.context == ("" if i.config == "b-x" else "what it saw") and i.question == f"q{i.q}" and i.answer.endswith(f" {i.q}") for i in items)


def test_scores_as_they_come_back(spark):
    rows = [
        (1, "i1", " Correct ", "5", "4.5", ""),
        (2, " ", "correct", "5", "5", "5"),
        (3, "i2", "", "", " ", None),
        (4, "i3", "good", "9", "", ""),
        (5, "i4", "", "six", "", ""),
        (6, "i5", "abstained", None, "0.5", None),
        (7, "i1", "incorrect", "", "5d", ""),
        (8, "i6", "correct", "1", "", ""),
        (9, "i6", "", "", "", ""),
    ]
    got = {r.item_id: r for r in sheets.returned_scores(spark.createDataFrame(rows, "line int, item_id string, verdict string, faithfulness string, relevance string, completeness string")).collect()}
    assert {k: r.error for k, r in got.items()} == {"i1": "relevance is no number", "i3": "unknown verdict good", "i4": "faithfulness is no number", "i5": "relevance is out of range", "i6": None}
    assert (got["i6"].verdict, got["i6"].faithfulness, got["i6"].relevance) == ("correct", 1.0, None)


def test_cover_by_evidence_and_by_paragraph(spark):
    text = "aa bb\ncc dd ee ff\ngg"
    docs = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    labels = sheets.with_lines(spark.createDataFrame([(7, 1, 9, 14), (8, 2, 0, 2)], "item_id int, gold_doc long, gold_start long, gold_end long"), docs)
    assert {(r.item_id, r.context_start, r.context_end) for r in labels.collect()} == {(7, 6, 17), (8, 0, 5)}
    chunks = spark.createDataFrame([("fine", 1, s, s + 5, 2) for s in (0, 6, 12, 18)] + [("coarse", 1, 0, 20, 7)], "chunking string, doc_id long, char_start long, char_end long, n_tokens long")
    got = {(r.chunking, r.label): r for r in sheets.cover_report(chunks, labels, ["fine", "coarse"]).collect()}
    assert {k: (r.n_spans, r.n_split, r.histogram, r.mean_ceiling) for k, r in got.items()} == {
        ("fine", "evidence"): (2, 1, "0:1,2:1", 0.4),
        ("fine", "paragraph"): (2, 1, "0:1,2:1", 0.454546),
        ("coarse", "evidence"): (2, 0, "0:1,1:1", 0.5),
        ("coarse", "paragraph"): (2, 0, "0:1,1:1", 0.5),
    }
    assert got["fine", "evidence"].cover_tokens_max == 4


def test_authored_questions(spark, tmp_path):
    schema = "passage_id string, question string"
    (tmp_path / "a.jsonl").write_text('{"passage_id": "p1", "question": "old"}\n{"passage_id": "p2", "question": "q"}\n{"passage_id": "p1", "question": "new", "more": 1}\n')
    assert {tuple(r) for r in read_authored(spark, str(tmp_path / "a.jsonl"), schema).collect()} == {("p1", "new"), ("p2", "q")}
    (tmp_path / "none.jsonl").write_text("")
    for name in ("none.jsonl", "missing.jsonl"):
        with pytest.raises(ValueError):
            read_authored(spark, str(tmp_path / name), schema)


def test_selected_questions(spark):
    rows = [(3, "q3", "r", None, 1, 0, 2, True, True), (1, "q1", "r", "n", 1, 0, 2, True, None), (2, "q2", "r", "n", 1, 0, 2, False, True)]
    got = sheets.selected_questions(spark.createDataFrame(rows, "item_id int, question string, reference string, note string, gold_doc long, gold_start long, gold_end long, selected boolean, verified boolean")).collect()
    assert [(r.item_id, r.note, r.verified, r.gold.gold_end) for r in got] == [(1, "n", False, 2), (3, "", True, 2)]
