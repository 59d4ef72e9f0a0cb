"""SimHash fingerprints and their exact join within a Hamming radius.

A fingerprint has bit i where more than half of the text's shingle hashes have
it. Two fingerprints at most ``radius`` bits apart agree on ``agree`` of
``blocks`` blocks of their bits as long as ``blocks - radius >= agree``; so
every choice of that many blocks, with their bits, is a bucket, and any two
that link meet in a bucket. A bucket is compared exactly in tiles: numpy
exclusive-or and bit counts over all pairs of a tile. Large buckets are split
into tiles by population count and a salt, and pairs of tiles whose population
counts differ by more than the radius are never made. A tile gives a spanning
forest of its links, not all pairs; components come from the union of these.

Texts without words have the fingerprint zero, which links like any other.
Nulls are empty texts. Equal texts share a fingerprint and are compared once.
A null ``doc_id`` gets a fingerprint but names no component. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import cut_lineage, fresh
from evidentia.llm.graph import connected_components


def majority(hashes: np.ndarray) -> int:
    """The unsigned number whose bits are those that more than half of the hashes have; 0 for none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def simhash(text: str, shingle: int) -> int:
    """The unsigned 64-bit fingerprint of the words of ``text``, A-Z lower-cased."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    width = min(shingle, len(words))
    n = len(words) - width + 1
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[width - 1 :].tolist())
    return majority(np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, n))


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``doc_id``, ``text_key`` (a hash of the text) and ``fp`` (the fingerprint as a signed long), a row per document."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([simhash(t.as_py() or "", shingle) for t in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64))], ["doc_id", "text_key", "fp"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text")
    return slim.mapInArrow(hashed, "doc_id long, text_key long, fp long")


def bucket_keys(fp, blocks: int, agree: int) -> list:
    """A long for each choice of ``agree`` blocks: the number of the choice and a hash-free packing of its bits where they fit."""
    bounds = [round(64 * k / blocks) for k in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), agree)):
        mask = sum(((1 << (bounds[k + 1] - bounds[k])) - 1) << bounds[k] for k in chosen)
        mask -= (mask >> 63) << 64  # as a signed long
        keys.append(F.struct(F.lit(number).cast("short").alias("choice"), fp.bitwiseAND(F.lit(mask).cast("long")).alias("bits")))
    return keys


def spanning(nodes: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a forest that connects ``nodes`` as the links between places ``i`` and ``j`` do: each node and its component's first."""
    root = np.arange(len(nodes))
    while True:  # labels sink to the smallest of their component
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]


def _forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within a tile, or between two."""
    other = left if right is None else right
    i, j = np.nonzero(np.bitwise_count(left[:, None] ^ other[None, :]) <= radius)
    if right is None:
        up = i < j
        i, j = i[up], j[up]
    if not len(i):
        return left[:0], left[:0]
    return spanning(left, i, j) if right is None else spanning(np.concatenate([left, right]), i, j + len(left))


def tiles(met: DataFrame, columns: list[str], *, radius: int, tile: int) -> DataFrame:
    """Tiles in which any two rows of one ``key`` within ``radius`` bits meet once: ``left``, ``right``, ``within``.

    ``met`` has ``key``, ``size`` (how many rows have it), ``fp`` and the ``columns``
    that the tiles hold. A tile meets itself (``within``) or another. Small keys
    are one tile. A large one has tiles by population count and salt; pairs of
    tiles whose population counts differ by more than the radius are not made.
    """
    held = met.select("key", "size", F.bit_count("fp").cast("int").alias("pop"), F.xxhash64("fp", *columns).alias("mixed"), F.struct(*columns).alias("item"))
    salts = F.ceil(F.col("size") / (4 * tile)).cast("int")
    salted = held.withColumn("salts", salts).withColumn("salt", F.pmod(F.col("mixed"), salts).cast("int"))
    no = F.lit(0)
    one = salted.filter(F.col("size") <= tile).select("key", no.alias("p"), no.alias("s"), no.alias("q"), no.alias("t"), F.lit(True).alias("first"), "item")
    cells = salted.filter(F.col("size") > tile).withColumn("u", F.explode(F.sequence(no, F.col("salts") - 1)))
    ahead = cells.withColumn("q", F.explode(F.sequence(F.col("pop"), F.col("pop") + radius)))
    ahead = ahead.filter((F.col("q") > F.col("pop")) | (F.col("u") >= F.col("salt")))
    ahead = ahead.select("key", F.col("pop").alias("p"), F.col("salt").alias("s"), "q", F.col("u").alias("t"), F.lit(True).alias("first"), "item")
    behind = cells.withColumn("p", F.explode(F.sequence(F.col("pop") - radius, F.col("pop"))))
    behind = behind.filter((F.col("p") < F.col("pop")) | (F.col("u") < F.col("salt")))
    behind = behind.select("key", "p", F.col("u").alias("s"), F.col("pop").alias("q"), F.col("salt").alias("t"), F.lit(False).alias("first"), "item")
    return (
        one.union(ahead)
        .union(behind)
        .groupBy("key", "p", "s", "q", "t")
        .agg(F.collect_list(F.when(F.col("first"), F.col("item"))).alias("left"), F.collect_list(F.when(~F.col("first"), F.col("item"))).alias("right"))
        .withColumn("within", (F.col("p") == F.col("q")) & (F.col("s") == F.col("t")))
        .filter("size(left) > 0 AND (size(right) > 0 OR within AND size(left) > 1)")
        .select("left", "right", "within")
    )


def facing(left, right, within: bool, step: int) -> Iterator[tuple]:
    """The parts of a tile that meet, ``step`` rows a side at most; None for a part that meets itself."""
    for at in range(0, len(left), step):  # cells that a rare popcount makes large stay small in memory
        part = left[at : at + step]
        if within:
            yield part, None
        other = left if within else right
        for to in range(at + step if within else 0, len(other), step):
            yield part, other[to : to + step]


def links(distinct: DataFrame, *, radius: int = 4, blocks: int = 6, agree: int = 2, tile: int = 512) -> DataFrame:
    """Edges ``a``, ``b`` that connect all of the distinct ``fp`` within ``radius`` bits of each other."""
    assert blocks - radius >= agree, "the blocks would lose links"
    rows = distinct.select("fp", F.explode(F.array(*bucket_keys(F.col("fp"), blocks, agree))).alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for left, right, within in zip(batch.column(0), batch.column(1), batch.column(2)):
                left, right = (x.values.field("fp").to_numpy(zero_copy_only=False).view(np.uint64) for x in (left, right))
                for part, other in facing(left, right, within.as_py(), 4 * tile):
                    x, y = _forest(part, other, radius)
                    a.append(x)
                    b.append(y)
            cols = [np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (a, b)]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), ["a", "b"])

    return tiles(rows.join(sizes, "key"), ["fp"], radius=radius, tile=tile).mapInArrow(compared, "a long, b long")


def components(fps: DataFrame, **parameters) -> DataFrame:
    """``fp`` and ``component_id``, the smallest ``doc_id`` reachable over links; ``fps`` has ``doc_id`` and ``fp``."""
    smallest = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(links(smallest.select("fp"), **parameters))
    placed = smallest.join(roots, smallest["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return placed.join(named, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, *, shingle: int = 4, **parameters) -> DataFrame:
    """``doc_id``, ``text_key``, ``fp`` and ``component_id``, a row per document."""
    fps = cut_lineage(fingerprints(docs, shingle))
    return fps.join(components(fps, **parameters), "fp")


def one_of_each(docs: DataFrame, *, shingle: int = 5, **parameters) -> DataFrame:
    """The rows of ``docs`` with one row of each component: that of the smallest id and, in a tie, of the smallest text hash."""
    found = near_duplicates(docs, shingle=shingle, **parameters)
    key, w_id, w_key = fresh(docs, "key", "w_id", "w_key")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    winner = found.withColumn("class", F.coalesce("component_id", "fp")).groupBy("class", F.col("component_id").isNull()).agg(F.min(order).alias("w"))
    winner = winner.select(F.col("w.doc_id").alias(w_id), F.col("w.text_key").alias(w_key))
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = keyed.join(winner, F.col("doc_id").cast("long").eqNullSafe(F.col(w_id)) & (F.col(key) == F.col(w_key)), "left_semi")
    return kept.dropDuplicates(["doc_id", key]).select(*docs.columns)
