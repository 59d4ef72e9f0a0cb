"""One document of each group of near copies, by SimHash tiles over texts that share a rare shingle.

Two texts link when the Jaccard resemblance of their sets of hashed shingles is
0.8 or more. Their fingerprints alone can't say so: at that resemblance they
differ by some 10 of 64 bits and often more, and no set of buckets of bits is both
whole and small at such a radius. So a bucket is the texts that share one of
their first shingles: in any fixed order of the shingles, two texts that link
share one of their first ``n - ceil(0.8 n) + 1``, so that buckets lose no link. The
order puts shingles that a sample finds in many texts last, so that passages of
many texts make no buckets; the sample changes what the search costs, not what
it finds. A bucket is compared in tiles (``simhash.tiles``): numpy exclusive-or
and bit counts of the fingerprints within a wide ``radius`` (six deviations
beyond what 0.8 gives), with the sizes of the sets and the places of the shared
shingle, which bound what two texts can share. Fingerprints are majorities over
the different shingles, as the resemblance is, so a run that repeats within a text
moves neither. They have 256 bits and are made only for texts that share a first
shingle: with 64 of them a fifth of all unlike pairs would pass a radius that loses
no link, and their chains grow into one cluster of a large part of the input. Of sets
that resemble each other by just 0.8 the bits differ with a chance of 0.15 to 0.16,
more than 80 of them in one of some 10^9 pairs; of unlike sets so few differ in one
of 10^9. Sets of up to ``SMALL`` shingles pass whatever their fingerprints. A tile
hands on a forest of what it leaves possible, not all pairs.

The components of these forests are clusters. In a cluster all fingerprints are
compared again in tiles, and the pairs within the radius are verified on the
sets themselves; a tile hands on a forest of the links. A cluster with more than
``cell`` shingles is split by salts, and each of its sets goes to as many tiles.

Equal texts are one; texts without words link to one another. Nulls are empty
texts. Repeated rows and ties leave one row. A null id comes after all others.
An empty table gives no rows. Other columns are handed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import cut_lineage, fresh, stored
from evidentia.llm.graph import connected_components
from evidentia.llm.simhash import facing, majority, spanning, tiles


class _WordHashes(dict):
    """Word -> its 64-bit hash; starts anew at ``limit`` words."""

    def __init__(self, limit: int = 500_000):
        import xxhash

        super().__init__()
        self.digest, self.limit = xxhash.xxh64_intdigest, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.digest(word, 42)
        return value


_WORDS: list[_WordHashes] = []


def hashes(text: str | None, width: int) -> np.ndarray:
    """The hashes of the runs of ``width`` words in turn, A-Z lower-cased, mixed from those of the words; one zero for no words."""
    if not _WORDS:
        _WORDS.append(_WordHashes())
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(1, np.uint64)
    w = np.fromiter(map(_WORDS[0].__getitem__, words), np.uint64, len(words))
    width = min(width, len(w))
    n = len(w) - width + 1
    h = np.full(n, width, np.uint64)
    for i in range(width):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + w[i : i + n]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct hashes."""
    return np.unique(hashes(text, width).view(np.int64))


def _often(texts: DataFrame, width: int, sample: int, most: int) -> np.ndarray:
    """Sorted hashes of shingles that stand in three or more of about ``sample`` texts; ``most`` at most."""
    share = max(1, texts.count() // sample)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                found = [shingles(text.as_py(), width) for text in batch.column(0).slice(at, 500)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], ["h"])

    rows = texts.filter(F.pmod("key", F.lit(share)) == 0).select("text").mapInArrow(hashed, "h long")
    top = rows.groupBy("h").count().filter("count > 2").orderBy(F.desc("count"), "h").limit(most).select("h").toArrow()
    return np.sort(top.column(0).to_numpy())


def _within(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of the values are in ``ordered``, by binary search."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def first_shingles(texts: DataFrame, width: int, often: np.ndarray) -> DataFrame:
    """A row for each of a text's first shingles: ``h``, ``key``, ``n`` (the size of the set), ``at`` (the place in the order)."""
    late = texts.sparkSession.sparkContext.broadcast(often)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                out = []
                for key, text in zip(batch.column(0).slice(first, 500).to_pylist(), batch.column(1).slice(first, 500)):
                    own = shingles(text.as_py(), width)
                    n = len(own)
                    own = own[np.argsort(_within(own, late.value), kind="stable")[: n - (4 * n + 4) // 5 + 1]]
                    same = np.ones(len(own), np.int64)
                    out.append((own, key * same, (n * same).astype(np.int32), np.arange(len(own), dtype=np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["h", "key", "n", "at"])

    return texts.select("key", "text").mapInArrow(cut, "h long, key long, n int, at int")


#: The fingerprint, 64 bits each.
FP = ["fp", "fp1", "fp2", "fp3"]


def fingerprint(hashed: np.ndarray) -> list[int]:
    """Majorities over the hashes, and over three more hashes of each, as signed numbers."""
    out, h = [], hashed.view(np.uint64)
    for _ in FP:
        out.append(majority(h))
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return np.array(out, np.uint64).view(np.int64).tolist()


def fingerprints(texts: DataFrame, keys: DataFrame, width: int, broadcast_rows: int) -> DataFrame:
    """``key`` and the fingerprint of the texts of ``keys``, stored."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [fingerprint(shingles(text.as_py(), width)) for text in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in zip(*found))], ["key", *FP])

    keys = stored(keys.distinct())
    keys = F.broadcast(keys) if keys.count() <= 10 * broadcast_rows else keys
    return stored(texts.select("key", "text").join(keys, "key", "left_semi").mapInArrow(made, "key long, " + ", ".join(f"{f} long" for f in FP)))


def _must_share(m, n):
    """How many shingles sets of ``m`` and ``n`` share at least when they resemble each other by 0.8."""
    return (4 * (m + n) + 8) // 9


_HELD = [*FP, "id", "n", "at"]
_ID, _N, _AT = (len(FP) + k for k in range(3))

#: Sets of so few shingles are compared whatever their fingerprints.
SMALL = 16


def clusters(shared: DataFrame, *, radius: int, first_radius: int = 28, tile: int = 4096, step: int = 1024) -> DataFrame:
    """``node``, ``root`` of texts that may link; ``shared``: the first shingles that more than one text has, with the ``size`` of each and the texts' fingerprints.

    ``first_radius`` is that of the first 64 bits, by which the tiles of a large bucket are made.
    """

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [np.stack([c.flatten().field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in _HELD], axis=1) for c in batch.columns[:2]]
            sizes = [c.value_lengths().to_numpy(zero_copy_only=False) for c in batch.columns[:2]]
            ends = [np.cumsum(x) for x in sizes]
            within = batch.column(2).to_numpy(zero_copy_only=False)
            small = within & (sizes[0] <= 32)
            found = [_small(sides[0], (ends[0] - sizes[0])[small], sizes[0][small], radius)]
            for k in np.flatnonzero(~small):
                left, right = (rows[end[k] - size[k] : end[k]] for rows, end, size in zip(sides, ends, sizes))
                for part, other in facing(left, right, within[k], step):
                    found.append(_between(part, other, radius))
            every = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in every.T.copy()], ["a", "b"])

    met = shared.select(F.col("h").alias("key"), F.col("key").alias("id"), "size", *FP, "n", "at")
    return connected_components(tiles(met, _HELD, radius=first_radius, tile=tile).mapInArrow(compared, "a long, b long"))


def _near(f: np.ndarray, g: np.ndarray, m: np.ndarray, n: np.ndarray, radius: int) -> np.ndarray:
    """Which fingerprints (in the last axis) are near enough for sets of these sizes to resemble each other."""
    apart = sum(np.bitwise_count((f[..., k] ^ g[..., k]).view(np.uint64)).astype(np.int16) for k in range(len(FP)))
    return (apart <= radius) | (np.maximum(m, n) <= SMALL)


def _possible(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Which of the rows left and right fingerprints, sizes and places leave possible."""
    f, g = left[:, : len(FP)], right[:, : len(FP)]
    (a, m, i), (b, n, j) = left[:, len(FP) :].T, right[:, len(FP) :].T
    # The first shingle that both have leaves room behind it for the others that they must share.
    least = _must_share(m, n)
    return _near(f, g, m, n, radius) & (a != b) & (5 * np.minimum(m, n) >= 4 * np.maximum(m, n)) & (i + least <= m) & (j + least <= n)


def _between(left: np.ndarray, right: np.ndarray | None, radius: int) -> np.ndarray:
    """Edges of a forest of one part of a tile and another, or (None) itself."""
    other = left if right is None else right
    near = _near(left[:, None, : len(FP)], other[None, :, : len(FP)], left[:, None, _N], other[None, :, _N], radius)
    x, y = np.nonzero(np.triu(near, 1) if right is None else near)
    ok = _possible(left[x], other[y], radius)
    x, y = x[ok], y[ok]
    nodes = left[:, _ID] if right is None else np.concatenate([left[:, _ID], right[:, _ID]])
    return np.stack(spanning(nodes, x, y if right is None else y + len(left)), axis=1)


def _small(rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int) -> np.ndarray:
    """The possible pairs within many small tiles at once; a tile is ``sizes`` rows from ``starts`` on."""
    found = [np.zeros((0, 2), np.int64)]
    for size in np.unique(sizes):
        x, y = np.triu_indices(size, 1)
        at = starts[sizes == size]
        for k in range(0, len(at), 4096):
            part = at[k : k + 4096, None]
            i, j = (part + x).ravel(), (part + y).ravel()
            ok = _possible(rows[i], rows[j], radius)
            found.append(np.stack([rows[i[ok], _ID], rows[j[ok], _ID]], axis=1))
    return np.concatenate(found)


def in_common(left: list[np.ndarray], right: list[np.ndarray], block: int = 4096) -> np.ndarray:
    """How many values the sorted sets left and right share, a row for each on the left."""
    values = np.concatenate([np.zeros(0, np.int64), *left, *right])
    distinct, number, count = np.unique(values, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(count > 1)
    place = np.full(len(distinct), -1)
    place[twice] = np.arange(len(twice))
    row = np.repeat(np.arange(len(left) + len(right)), list(map(len, [*left, *right])))
    column = place[number]
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(twice), block):
        here = slice(*np.searchsorted(column, [at, at + block]))
        held = np.zeros((len(left) + len(right), min(block, len(twice) - at)), np.float32)
        held[row[here], column[here] - at] = 1
        out += held[: len(left)] @ held[len(left) :].T
    return out


def _links(left: dict, right: dict | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a forest of the texts that resemble each other by 0.8 or more, of one part of a tile and another, or itself."""
    other = left if right is None else right
    sizes = [np.array(list(map(len, x["set"]))) for x in (left, other)]
    m, n = sizes[0][:, None], sizes[1][None, :]
    near = _near(left["fp"][:, None], other["fp"][None, :], m, n, radius) & (5 * np.minimum(m, n) >= 4 * np.maximum(m, n)) & (left["key"][:, None] != other["key"][None, :])
    x, y = np.nonzero(np.triu(near, 1) if right is None else near)
    if len(x) <= 64:
        common = np.array([int(_within(left["set"][i], other["set"][j]).sum()) for i, j in zip(x, y)], np.int64)
    else:
        common = in_common(left["set"], other["set"])[x, y]
    ok = 9 * common >= 4 * (sizes[0][x] + sizes[1][y])
    x, y = x[ok], y[ok]
    nodes = left["key"] if right is None else np.concatenate([left["key"], right["key"]])
    return spanning(nodes, x, y if right is None else y + len(left["key"]))


def verified(placed: DataFrame, texts: DataFrame, fps: DataFrame, width: int, *, radius: int, cell: int = 400_000, step: int = 512, broadcast_rows: int = 100_000) -> DataFrame:
    """Edges ``a``, ``b`` that connect the texts of each cluster (``node``, ``root``) as their links do."""
    placed = cut_lineage(placed)
    n = placed.count()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                every = [shingles(t.as_py(), width) for t in part.column(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(every, pa.list_(pa.int64()))], ["root", "key", *FP, "set"])

    needed = placed.select(F.col("node").alias("key"), "root").join(fps, "key")
    if n <= broadcast_rows:
        needed = F.broadcast(needed)
    sets = stored(texts.select("key", "text").join(needed, "key").select("root", "key", *FP, "text").mapInArrow(hashed, f"root long, key long, {', '.join(f'{f} long' for f in FP)}, set array<long>"))
    salts = sets.groupBy("root").agg(F.ceil(F.sum(F.size("set")) / cell).cast("int").alias("k"))
    if n <= broadcast_rows:
        salts = F.broadcast(salts)
    own = F.pmod(F.xxhash64("key"), F.col("k")).cast("int")
    spread = sets.join(salts, "root").withColumn("s", own).withColumn("u", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    item = F.struct("key", *FP, "set")
    first = F.col("s") <= F.col("u")
    cells = spread.groupBy("root", F.least("s", "u").alias("p"), F.greatest("s", "u").alias("q")).agg(F.collect_list(F.when(first, item)).alias("left"), F.collect_list(F.when(~first, item)).alias("right"))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k in range(batch.num_rows):
                left, right = ([batch.column(c)[k].values.field(f) for f in ("key", *FP, "set")] for c in (0, 1))
                left, right = ({"key": x[0].to_numpy(), "fp": np.stack([v.to_numpy() for v in x[1:-1]], axis=1), "set": [v.values.to_numpy() for v in x[-1]]} for x in (left, right))
                sides = [[{f: v[at : at + step] for f, v in x.items()} for at in range(0, len(x["key"]), step)] for x in (left, right)]
                if batch.column(2)[k].as_py():
                    pairs = [(x, y if x is not y else None) for i, x in enumerate(sides[0]) for y in sides[0][i:]]
                else:
                    pairs = [(x, y) for x in sides[0] for y in sides[1]]
                for x, y in pairs:
                    i, j = _links(x, y, radius)
                    a.append(i)
                    b.append(j)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], ["a", "b"])

    return cells.select("left", "right", (F.col("p") == F.col("q")).alias("within")).mapInArrow(linked, "a long, b long")


def similar_texts(texts: DataFrame, *, width: int = 5, radius: int = 80, sample: int = 5_000, most_often: int = 500_000, broadcast_rows: int = 100_000, **parameters) -> DataFrame:
    """Edges ``a``, ``b`` that connect all texts of one component; ``texts`` has distinct ``key`` and ``text``."""
    rows = first_shingles(texts, width, _often(texts, width, sample, most_often))
    shared = stored(rows.withColumn("size", F.count("*").over(Window.partitionBy("h"))).filter("size > 1"))
    fps = fingerprints(texts, shared.select("key"), width, broadcast_rows)
    return verified(clusters(shared.join(fps, "key"), radius=radius), texts, fps, width, radius=radius, broadcast_rows=broadcast_rows, **parameters)


def one_of_each(docs: DataFrame, *, width: int = 5, broadcast_rows: int = 100_000, **parameters) -> DataFrame:
    """The rows of ``docs`` with one row of each component: that of the smallest id and, in a tie, of the smallest text hash."""
    key, turn = fresh(docs, "key", "turn")
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    # The first of each text; a task keeps no more before the rows are dealt out.
    by_text = Window.partitionBy(key).orderBy(F.col("doc_id").asc_nulls_last())
    distinct = stored(keyed.withColumn(turn, F.row_number().over(by_text)).filter(F.col(turn) == 1).drop(turn))
    texts = distinct.select(F.col(key).alias("key"), "doc_id", "text")
    roots = connected_components(similar_texts(texts.select("key", "text"), width=width, broadcast_rows=broadcast_rows, **parameters))
    placed = roots.join(texts.select(F.col("key").alias("node"), "doc_id"), "node")
    order = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "node")
    winner = placed.groupBy("root").agg(F.min(order).alias("w")).select("root", F.col("w.node").alias("keep"))
    gone = cut_lineage(placed.select("node", "root").join(winner, "root").filter("node <> keep").select(F.col("node").alias(key)))
    if gone.count() <= broadcast_rows:
        gone = F.broadcast(gone)
    return distinct.join(gone, key, "left_anti").select(*docs.columns)
