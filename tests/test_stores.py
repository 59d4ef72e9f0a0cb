"""Stores that are written, changed and read again."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.operators import retrieval
from evidentia.sources.vectors import VectorStore, fit_centroids


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(15, 24))
    data = [(f"v{k:04d}", (centres[k % 15] + 0.6 * rng.normal(size=24)).tolist(), f"text {k}") for k in range(1500)]
    return spark.createDataFrame(data, "id string, vector array<double>, text string").cache()


def asked(rows):
    return rows.filter(F.col("id").endswith("00")).select(F.col("id").alias("query_id"), "vector")


def listed(df):
    return sorted(map(tuple, df.select("query_id", "rank", "item_id", "score").collect()))


def exact(rows, depth=30):
    return listed(retrieval.nearest(asked(rows), rows.select(F.col("id").alias("item_id"), "vector"), depth))


def test_all_lists_are_exact_and_few_are_nearly_so(spark, rows, tmp_path):
    store = VectorStore.create(rows, str(tmp_path / "s"))
    assert store and not VectorStore(spark, str(tmp_path / "none"))
    full = exact(rows)
    assert listed(store.search(asked(rows), 30)) == full and listed(store.search(asked(rows), 30, most_queries=4)) == full
    few = store.probes(0.95)
    assert 1 < few < 20 and store.probes(2.0) == 39 and store.probes(0.0) == 1
    near = {(q, i) for q, _, i, _ in listed(store.search(asked(rows), 30, probes=few))}
    assert len(near & {(q, i) for q, _, i, _ in full}) >= 0.9 * len(full)
    one = store.search(asked(rows).limit(1), 30, probes=2)
    read = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in read and "list#" in read.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_upsert_replaces_by_id_wherever_the_row_was(spark, rows, tmp_path):
    store = VectorStore.create(rows.filter("id < 'v1000'"), str(tmp_path / "s"), lists=20)
    before = {f: os.stat(f[7:]).st_mtime_ns for f in store.rows().inputFiles()}
    turned = rows.filter("id >= 'v0995' AND id < 'v1003'").select("id", F.transform("vector", lambda x: -x).alias("vector"), F.lit("new").alias("text"))
    store.upsert(turned)
    store.upsert(turned)
    now = rows.filter("id < 'v0995'").unionByName(turned)
    assert sorted(map(tuple, store.rows().select("id", "text").collect())) == sorted(map(tuple, now.select("id", "text").collect()))
    assert listed(store.search(asked(rows), 30)) == listed(retrieval.nearest(asked(rows), now.select(F.col("id").alias("item_id"), "vector"), 30))
    after = set(store.rows().inputFiles())
    assert 0 < len(after & set(before)) < len(before)  # lists that no row left or entered keep their files
    assert sorted(r.id for r in store.existing(rows.filter("id > 'v0999'")).collect()) == ["v1000", "v1001", "v1002"]
    store.upsert(turned.limit(0))
    assert store.rows().count() == 1003


def test_a_list_that_runs_empty_holds_nothing_any_more(spark, tmp_path):
    two = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vector array<double>")
    store = VectorStore.create(two, str(tmp_path / "s"), lists=2)
    assert store.rows().select("list").distinct().count() == 2
    store.upsert(spark.createDataFrame([(2, [1.0, 0.1])], "id long, vector array<double>"))
    assert [(r.id, r.vector) for r in store.rows().orderBy("id").collect()] == [(1, [1.0, 0.0]), (2, [1.0, 0.1])]
    assert store.rows().select("list").distinct().count() == 1
    assert store.search(two.limit(0).select(F.col("id").alias("query_id"), "vector"), 3).count() == 0


@pytest.mark.parametrize("size", ["0.01", "0.1"])
def test_recall_on_the_whole_table_of_embeddings(spark, tmp_path, size):
    """These vectors point in all directions: nine tenths of the best need most of the lists."""
    from evidentia.plans import stores

    vectors = stores._vectors(spark, f"/root/testdata/sf{size}")
    store = VectorStore.create(vectors, str(tmp_path / "s"))
    full = {(r.query_id, r.item_id) for r in store.search(stores._asked(vectors), 30).collect()}
    part = {(r.query_id, r.item_id) for r in store.search(stores._asked(vectors), 30, probes=store.probes(stores.RECALL)).collect()}
    assert len(full & part) >= 0.9 * len(full)


def test_ties_go_by_name_in_every_block():
    names = np.array([f"n{k}" for k in range(9, -1, -1)], object)
    blocks = [(np.array([0, 1]), names[at : at + 5], np.ones((2, 5))) for at in (0, 5)]
    parts = list(retrieval.best_of_each(blocks, 3, most=4))
    assert [(int(q), n) for part in parts for q, _, n in zip(*part)] == [(q, f"n{k}") for q in (0, 1) for k in range(3)]
    assert list(retrieval.best_of_each([], 3)) == []


def test_centroids_of_few_rows():
    assert fit_centroids(np.eye(3), 8).shape == (3, 3)
    same = fit_centroids(np.ones((10, 2)), 4)
    assert same.shape == (4, 2) and np.isfinite(same).all()
