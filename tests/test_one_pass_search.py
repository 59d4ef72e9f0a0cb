"""The search over chunks in one pass, against the stored index and plain loops; words by their bytes."""

import random
import re
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from evidentia.operators import chunking, retrieval
from evidentia.plans import catalogue

TARGETS, DIMS = {"coarse": 6, "fine": 2}, {"d4": 4, "d7": 7}


def documents(spark, n=60):
    rng = random.Random(5)
    rows = [(rng.choice([k, -k, 10**13 + k]), " ".join(rng.choice(["one", "Two", "three", "--", "é"]) for _ in range(rng.randrange(20)))) for k in range(n)]
    return spark.createDataFrame([*rows, (None, "one two three"), (7 * n, None), (8 * n, "")], "doc_id long, text string")


def asked_for(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "query_id long, question string")
    return rows.select("query_id", retrieval.hash_embed(F.col("question"), DIMS).alias("v"))


def test_one_pass_finds_what_the_index_holds(spark):
    docs, depth = documents(spark), 5
    asked = asked_for(spark, ["one", "two three", "", "three é"])
    made = retrieval.embedded_chunks(docs, TARGETS, DIMS).withColumn("item", catalogue._item()).cache()
    want = set()
    for name in TARGETS:
        for arm in DIMS:
            items = made.filter(F.col("chunking") == name).select(F.col("item").alias("item_id"), F.col(f"v.{arm}").alias("vector"))
            want |= {(name, arm, *r) for r in retrieval.nearest(asked.select("query_id", F.col(f"v.{arm}").alias("vector")), items, depth).select("query_id", "item_id", "score", "rank").collect()}
    of = {r["item"]: r["doc_id"] for r in made.collect()}
    for limits in ({}, {"most_chars": 1, "rows": 3, "block": 2}, {"most_queries": 2}):
        found = retrieval.nearest_chunks(asked, docs, TARGETS, DIMS, depth, **limits).collect()
        assert {(r["chunking"], r["embedding"], r["query_id"], r["item_id"], r["score"], r["rank"]) for r in found} == want
        assert all(of[r["item_id"]] == r["doc_id"] for r in found)
    assert len(want) == 4 * len(TARGETS) * len(DIMS) * depth
    assert retrieval.nearest_chunks(asked, docs.limit(0), TARGETS, DIMS, depth).count() == retrieval.nearest_chunks(asked.limit(0), docs, TARGETS, DIMS, depth).count() == 0


def test_names_of_chunks_are_those_of_spark(spark):
    rows = [(d, k) for d in (0, 5, -5, 10**13, None) for k in (0, 12, 10**6)]
    made = spark.createDataFrame(rows, "doc_id long, chunk_index int").select("doc_id", "chunk_index", catalogue._item()).collect()
    assert [chunking.item_name(r["doc_id"], r["chunk_index"]) for r in made] == [r["item"] for r in made]
    assert [chunking.document_of(r["item"]) for r in made] == [r["doc_id"] for r in made]


def test_nothing_that_is_stored_grows_with_the_documents(spark, tmp_path, monkeypatch):
    docs = [(k, f"a text of its own {k} " * 3) for k in range(400)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "text of its own 7")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows, keep = [], catalogue.stored
    monkeypatch.setattr(catalogue, "stored", lambda df: rows.append((out := keep(df)).count()) or out)
    assert catalogue.retrieval_by_config(spark, str(tmp_path)).count() == 8
    # The candidates of both reranks and of all cells; the index would have 800 chunks.
    assert max(rows) == 2 * len(catalogue.TARGETS) * len(catalogue.DIMS) * catalogue.DEPTH


def test_an_item_below_the_bound_is_not_rounded_but_a_tie_is_held():
    names = np.array([f"n{k:04d}" for k in range(4000)], object)
    rng = np.random.default_rng(2)
    score = np.round(rng.random((3, 4000)), 2) + rng.choice([-4e-7, 0, 4e-7], (3, 4000))
    blocks = [(np.arange(3), names[at : at + 10], score[:, at : at + 10]) for at in range(3990, -10, -10)]
    found = [(int(q), s, n) for part in retrieval.best_of_each(blocks, 4, most=60) for q, s, n in zip(*part)]
    want = [(q, -s, n) for q in range(3) for s, n in sorted((-s, n) for s, n in zip(np.round(score[q], 6), names))[:4]]
    assert sorted(found) == sorted(want)


def test_words_by_their_bytes(monkeypatch):
    rng, letters = random.Random(1), "aAbZ09 \n.,-éüßİK一\U0001f600_\x00\x7fñ"
    handed = []
    monkeypatch.setattr(retrieval, "_HALVES", type("Counted", (retrieval._Halves,), {"__getitem__": lambda self, w: handed.append(w) or dict.__getitem__(self, w)})())
    for _ in range(100):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(rng.randrange(12))]
        for dim, got in zip((5, 32), retrieval.hash_counts(texts, [5, 32])):
            want = np.zeros((len(texts), dim))
            for row, text in enumerate(texts):
                for w in re.findall("[a-z0-9]+", text.lower()):
                    digest = sha256(w.encode()).hexdigest()
                    want[row, int(digest[:8], 16) % dim] += 1
                    want[row, int(digest[8:16], 16) % dim] -= 0.5
            assert got.shape == want.shape and (got == want).all()
    handed.clear()
    retrieval.hash_counts(["same word " * 1000] * 5, [4])
    assert sorted(handed) == [b"same", b"word"]
    assert pa.types.is_large_binary(retrieval._word_table(["x"])[2].type)


def test_a_question_is_read_once_a_pair_and_not_for_each_word_of_a_text(spark):
    rows = [("One two two", "two one TWO three two"), ("one", ""), ("", "one"), ("--", "one"), (None, "one"), ("one", None), ("four", "one two")]
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def asked(text):
        read.add(1)
        return text

    pairs = spark.createDataFrame(rows, "question string, text string")
    got = [r["s"] for r in pairs.select(retrieval.lexical_score(asked("question"), F.col("text")).alias("s")).collect()]
    assert got == [round(4 / np.log(5 + np.e), 6), *[0.0] * 6]
    assert read.value == len(rows)
