"""Texts that are not alike make no clusters, however many share a passage."""

import random

from pyspark.sql import functions as F

from evidentia.llm import neardup


def test_texts_that_share_a_passage_are_no_cluster(spark, monkeypatch):
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage, rows, sizes = words(60), [], []
    for k in range(60):
        text = words(340) + passage
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join([*text[:100], "other", *text[101:]]))]
    verified = neardup.verified

    def watched(placed, *rest, **parameters):
        sizes.extend(r["count"] for r in placed.groupBy("root").count().collect())
        return verified(placed, *rest, **parameters)

    monkeypatch.setattr(neardup, "verified", watched)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    kept = sorted(r.doc_id for r in neardup.one_of_each(docs, most_often=1).collect())
    assert kept == list(range(0, 120, 2))
    assert sizes == [2] * 60
