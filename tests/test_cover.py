"""Covers of gold spans: only the documents that hold one are cut, and they are cut once."""

from evidentia.operators import chunking
from evidentia.plans import calibration, catalogue

ITEMS = [(0, "span one here"), (1, "another span"), (2, "span of nothing"), (3, "another span")]


def test_only_documents_with_a_gold_span_are_cut(spark, tmp_path, monkeypatch):
    filler = "word " * 300
    docs = [(k, filler + ("span one here " if k in (3, 5) else "another span\n" if k == 7 else "") + filler) for k in range(20)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    cut = []
    keep = chunking.chunks_of_sizes
    monkeypatch.setattr(chunking, "chunks_of_sizes", lambda docs, targets: cut.append({r["doc_id"] for r in docs.select("doc_id").collect()}) or keep(docs, targets))
    cover = catalogue.minimum_cover(spark, str(tmp_path)).collect()
    assert cut == [{3, 7}]
    assert {(r["chunking"], r["item_id"]) for r in cover} == {(c, i) for c in catalogue.TARGETS for i in (0, 1, 3)}
    # One cut, although lengths, counts and histograms are several passes over what comes of it.
    report = calibration.cover_by_label(spark, str(tmp_path))
    assert cut == [{3, 7}] * 2 and "MapInArrow" not in report._jdf.queryExecution().executedPlan().toString()
    assert {(r["chunking"], r["label"], r["n_spans"]) for r in report.collect()} == {(c, n, 3) for c in catalogue.TARGETS for n in ("evidence", "paragraph")}
