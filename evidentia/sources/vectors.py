"""A store of vectors as an inverted file: lists of neighbours, searched in part or in whole, with rows replaced by id.

Centroids are fitted on a bounded sample; each vector lies in the list of its
nearest centroid, a partition of the table. A search compares a query with the
vectors of the lists nearest to it, and the scan reads no other partition; with
all lists it is exact. How many lists hold a wanted share of the best depends on
the vectors: it is measured on the sample and kept beside the centroids. An upsert takes the rows of the
new ids out of the lists that hold them and writes only the lists that change.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from evidentia.operators.retrieval import best_of_each, flat_vectors
from evidentia.sources.tables import exists, stored


def fit_centroids(vectors: np.ndarray, lists: int, *, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids of ``vectors`` (rows) by Lloyd's rounds on unit vectors; a list that runs empty takes the row that fits worst."""
    rng = np.random.default_rng(seed)
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    centre = unit[rng.permutation(len(unit))[:lists]]
    for _ in range(rounds):
        score = unit @ centre.T
        nearest = score.argmax(axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, nearest, unit)
        counts = np.bincount(nearest, minlength=len(centre))
        worst = iter(np.argsort(score.max(axis=1), kind="stable"))
        for k in np.flatnonzero(counts == 0):
            sums[k] = unit[next(worst)]
        centre = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centre


def recall_curve(vectors: np.ndarray, centre: np.ndarray, depth: int = 30, queries: int = 1000, among: int = 20_000) -> np.ndarray:
    """The share of the ``depth`` best of some of the vectors, among the others, that the nearest 1, 2, ... lists hold."""
    some = vectors[:among]
    asked = some[:queries]
    own = (some @ centre.T).argmax(axis=1)
    score = asked @ some.T
    np.fill_diagonal(score, -np.inf)
    best = np.argsort(-score, axis=1)[:, : min(depth, max(0, len(some) - 1))]
    place = np.argsort(np.argsort(-(asked @ centre.T), axis=1, kind="stable"), axis=1)
    needed = np.take_along_axis(place, own[best], axis=1).ravel()
    met = np.cumsum(np.bincount(needed, minlength=len(centre)))
    return met / max(1, len(needed)) if len(needed) else np.ones(len(centre))


def sampled(rows: DataFrame, most: int, vector: str = "vector") -> np.ndarray:
    """About ``most`` of the vectors, chosen by the hash of their id, so that the same ones are taken again."""
    share = min(1.0, most / max(1, rows.count()))
    taken = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))) if share < 1 else rows
    return flat_vectors(taken.filter(F.col(vector).isNotNull()).select(F.col(vector)).toArrow().column(0).combine_chunks())


class VectorStore:
    """``centroids``, ``recall`` and ``vectors`` (``id``, ``vector``, other columns, ``list``) under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def create(cls, rows: DataFrame, path: str, *, lists: int | None = None, sample: int = 50_000) -> VectorStore:
        """A store of ``rows`` (``id``, ``vector``); by default as many lists as the square root of their number, 4,096 at most.

        Vectors are of one length and not null; ids are not null and stand there once.
        """
        store = cls(rows.sparkSession, path)
        lists = lists or max(1, min(4096, round(rows.count() ** 0.5)))
        known = sampled(rows, sample)
        centre = fit_centroids(known, lists)
        curve = [(k + 1, float(r)) for k, r in enumerate(recall_curve(known, centre))]
        store.spark.createDataFrame(curve, "probes int, recall double").coalesce(1).write.parquet(f"{path}/recall")
        store.spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centre)], "list int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
        # Each list is written by one or a few tasks, in files of a bounded number of rows.
        store._listed(rows).repartition("list").write.partitionBy("list").option("maxRecordsPerFile", 1_000_000).parquet(f"{path}/vectors")
        return store

    def centroids(self) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.path}/centroids").orderBy("list").collect()
        return np.array([r["centroid"] for r in rows])

    def probes(self, recall: float) -> int:
        """The fewest lists that held this share of the best in the sample; all of them where none did."""
        curve = self.spark.read.parquet(f"{self.path}/recall")
        return curve.agg(F.coalesce(F.min(F.when(F.col("recall") >= recall, F.col("probes"))), F.max("probes"))).first()[0]

    def rows(self) -> DataFrame:
        """What the store holds; rows without an id only keep a list's folder from being skipped when it runs empty."""
        return self.spark.read.parquet(f"{self.path}/vectors").filter("id IS NOT NULL")

    def _listed(self, rows: DataFrame) -> DataFrame:
        centre = self.spark.sparkContext.broadcast(self.centroids().T.astype(np.float64))

        @F.arrow_udf("int")
        def nearest(vectors: pa.Array) -> pa.Array:
            return pa.array((flat_vectors(vectors) @ centre.value).argmax(axis=1) if len(vectors) else [], pa.int32())

        return rows.withColumn("list", nearest("vector"))

    def existing(self, ids: DataFrame) -> DataFrame:
        """Those of ``ids`` (``id``) that the store holds."""
        return ids.select("id").distinct().join(self.rows().select("id"), "id", "left_semi")

    def upsert(self, rows: DataFrame) -> None:
        """Adds ``rows`` and replaces those of the same id, wherever they were; of rows of one id here, any one is taken.

        The new rows are stored first, and so are those that stay in a changed list: if the
        write is cut off, it can be run again with the same rows.
        """
        new = stored(self._listed(rows.dropDuplicates(["id"])))
        held = self.spark.read.parquet(f"{self.path}/vectors")
        replaced = held.filter("id IS NOT NULL").join(new.select("id"), "id", "left_semi").select("list")
        touched = [r["list"] for r in replaced.union(new.select("list")).distinct().collect()]  # no more than there are lists
        if not touched:
            return
        stay = held.filter(F.col("list").isin(touched) & F.col("id").isNotNull()).join(new.select("id"), "id", "left_anti")
        keep = self.spark.createDataFrame([(k,) for k in touched], "list int")
        kept = stored(stay.select(*held.columns).unionByName(new.select(*held.columns)))
        out = kept.unionByName(keep, allowMissingColumns=True).repartition("list")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", 1_000_000).partitionBy("list").parquet(f"{self.path}/vectors")

    def search(self, queries: DataFrame, depth: int, *, probes: int | None = None, most_queries: int = 20_000) -> DataFrame:
        """``query_id``, ``item_id``, ``score`` (6 digits) and ``rank`` of the best of the ``probes`` lists nearest to each query, or of all.

        Queries (``query_id``, ``vector``) go to every task in blocks of about ``most_queries``. Ties go by id.
        """
        blocks = max(1, -(-queries.count() // most_queries))
        parts = [queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k) if blocks > 1 else queries for k in range(blocks)]
        found = reduce(DataFrame.unionByName, [self._search(part, depth, probes) for part in parts])
        by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
        return found.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= depth)

    def _search(self, queries: DataFrame, depth: int, probes: int | None) -> DataFrame:
        asked = queries.orderBy("query_id").select("query_id", "vector").toArrow()
        ids = asked.column(0).to_pylist()
        matrix = flat_vectors(asked.column(1).combine_chunks())
        centre = self.centroids()
        take = len(centre) if probes is None else min(probes, len(centre))
        near = np.argsort(-(matrix @ centre.T), axis=1, kind="stable")[:, :take] if ids else np.zeros((0, take), int)
        of_list = {int(k): np.flatnonzero((near == k).any(axis=1)) for k in np.unique(near)}
        known = self.spark.sparkContext.broadcast((ids, matrix, of_list))
        rows = self.rows().filter(F.col("list").isin(list(of_list))) if take < len(centre) else self.rows()

        def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _, vectors, probed = known.value

            def pairs():
                for batch in batches:
                    lists = batch.column(2).to_numpy(zero_copy_only=False)
                    held = flat_vectors(batch.column(1))
                    names = np.array(batch.column(0).to_pylist(), object)
                    for k in np.unique(lists):
                        if len(mine := probed.get(int(k), ())):
                            yield mine, np.flatnonzero(lists == k), names, held

            for part in best_of_each(((q, names[at], vectors[q] @ held[at].T) for q, at, names, held in pairs()), depth):
                yield pa.RecordBatch.from_arrays([pa.array([ids[q] for q in part[0]], kinds[0]), pa.array(part[2].tolist(), kinds[1]), pa.array(part[1], pa.float64())], ["query_id", "item_id", "score"])

        kinds = [to_arrow_type(queries.schema["query_id"].dataType), to_arrow_type(rows.schema["id"].dataType)]
        named = f"query_id {queries.schema['query_id'].dataType.simpleString()}, item_id {rows.schema['id'].dataType.simpleString()}, score double"
        return rows.select("id", "vector", "list").mapInArrow(compared, named)

    def __bool__(self) -> bool:
        return exists(self.spark, f"{self.path}/centroids")
