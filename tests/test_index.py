"""The index from one pass over the tokens, against plain loops; what a search holds."""

import math
import random
import re

import numpy as np
from hashlib import sha256

from evidentia.operators import chunking, retrieval
from evidentia.plans import catalogue

DOCS = [(1, "One two,  three\nFour five six seven. "), (2, None), (3, " \t\n"), (4, "é ü x\x1fy " * 9), (5, "alone"), (6, "w1 w2 w3 w4 w5 w6"), (7, "Ünter -- ?! ñandú"), (None, "no id here")]
TARGETS, DIMS = {"coarse": 6, "fine": 2, "odd": 4}, {"d4": 4, "d7": 7}


def plain_vector(text: str, dim: int) -> list[float]:
    v = [0.0] * dim
    for w in re.findall("[a-z0-9]+", text.lower()):
        digest = sha256(w.encode()).hexdigest()
        v[int(digest[:8], 16) % dim] += 1
        v[int(digest[8:16], 16) % dim] -= 0.5
    norm = math.sqrt(sum(x * x for x in v)) or 1
    return [x / norm for x in v]


def test_one_pass_makes_the_chunks_of_each_size_and_their_vectors(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").coalesce(1)
    for most in (1, 30, 10**6):
        made = retrieval.embedded_chunks(docs, TARGETS, DIMS, most_chars=most).collect()
        assert {r["chunking"] for r in made} == set(TARGETS)
        for name, target in TARGETS.items():
            want = {(r["doc_id"], r["chunk_index"], r["n_tokens"], r["char_start"], r["char_end"], r["text"]) for r in chunking.fixed_chunks(docs, target).collect()}
            assert {(r["doc_id"], r["chunk_index"], r["n_tokens"], r["char_start"], r["char_end"], r["text"]) for r in made if r["chunking"] == name} == want
        for r in made:
            for arm, dim in DIMS.items():
                assert np.allclose(r["v"][arm], plain_vector(r["text"], dim), atol=1e-12)
    bare = chunking.chunks_of_sizes(docs, TARGETS).collect()
    assert sorted(map(str, bare)) == sorted(str(r) for r in retrieval.embedded_chunks(docs, TARGETS, DIMS).drop("v").collect())


def test_a_table_without_tokens_has_no_chunks(spark):
    docs = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert retrieval.embedded_chunks(docs, TARGETS, DIMS).count() == chunking.chunks_of_sizes(docs, TARGETS).count() == 0


def test_a_search_holds_no_item_that_is_worse_than_the_best_so_far(monkeypatch):
    rng, sorted_rows, leading = random.Random(3), [], retrieval._leading
    monkeypatch.setattr(retrieval, "_leading", lambda q, *rest: sorted_rows.append(len(q)) or leading(q, *rest))
    blocks, rows = [], []
    for k in range(200):
        names = np.array([f"i{rng.randrange(10**6):06d}-{k}-{j}" for j in range(20)], object)
        score = np.array([[rng.randrange(40) / 40 for _ in names] for _ in range(3)])  # many ties
        blocks.append((np.arange(3), names, score))
        rows += [(q, -s, n) for q in range(3) for n, s in zip(names, score[q])]
    found = [(int(q), s, n) for part in retrieval.best_of_each(blocks, 5, most=300) for q, s, n in zip(*part)]
    want = [(q, -s, n) for k in range(3) for q, s, n in sorted(r for r in rows if r[0] == k)[:5]]
    assert sorted(found) == sorted(want)
    # Without the bound, each block adds at least its own five best of each query.
    assert sum(sorted_rows) < 200 * 3 * 5


def test_the_index_meets_words_in_one_python_step(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "some words of a text")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plans = []
    monkeypatch.setattr(catalogue, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    assert catalogue.index(spark, str(tmp_path)).count() == 2
    assert plans[0].count("MapInArrow") == 1 and "ArrowEvalPython" not in plans[0]
