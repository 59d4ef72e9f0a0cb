"""Embedding, nearest neighbours, reranking and budgeted contexts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from evidentia.functions.text import words
from evidentia.operators import chunking


class _Halves(dict):
    """A word's bytes -> the first 64 bits of its SHA-256; starts anew at ``limit`` words."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.sha256(word).digest()[:8], "big")
        return value


_HALVES = _Halves()


#: For each byte, whether it belongs to a word; in UTF-8 no byte of another character does.
_WORD_BYTES = np.zeros(256, bool)
_WORD_BYTES[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True


def _word_table(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The words (``[a-z0-9]+`` in lower case) of all texts in order: the row of each, its place among the different words, and those."""
    encoded = [text.lower().encode("utf-8", "replace") for text in texts]
    data = np.frombuffer(b" ".join([*encoded, b""]), np.uint8)
    inside = _WORD_BYTES[data]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    row = np.searchsorted(np.cumsum([len(e) + 1 for e in encoded]), starts, side="right")
    # The bytes of all words one after the other are a column of texts by their offsets.
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
    return row, column.indices.to_numpy(zero_copy_only=False), column.dictionary


def hash_counts(texts: Sequence[str], dims: Sequence[int]) -> list[np.ndarray]:
    """For each size a matrix, a row a text: a word adds 1 at one place and takes 0.5 at another, both by its hash."""
    row, which, different = _word_table(texts)
    hashed = np.fromiter(map(_HALVES.__getitem__, different.to_numpy(zero_copy_only=False)), np.uint64, len(different))
    up, down = (hashed >> np.uint64(32)).astype(np.int64), (hashed & np.uint64(0xFFFFFFFF)).astype(np.int64)
    count = lambda half, dim: np.bincount(row * dim + (half % dim)[which], minlength=len(texts) * dim).reshape(-1, dim)
    return [count(up, dim) - 0.5 * count(down, dim) for dim in dims]


def unit_length(matrix: np.ndarray) -> np.ndarray:
    """Rows of length 1; a row of zeros stays."""
    norm = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return matrix / np.where(norm == 0, 1, norm)


def _lists(matrix: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1) * matrix.shape[1], pa.int32()), pa.array(matrix.ravel()))


def hash_embed(text: Column, dims: dict[str, int], block: int = 1024) -> Column:
    """A structure of the text's vectors, one of each size, from one pass over its words; unit length, or zero without words."""

    @F.arrow_udf(_vectors_type(dims))
    def embed(texts: pa.Array) -> pa.Array:
        parts = [[unit_length(m) for m in hash_counts([t.as_py() or "" for t in texts.slice(at, block)], list(dims.values()))] for at in range(0, len(texts), block)]
        return pa.StructArray.from_arrays([_lists(np.concatenate([np.zeros((0, dim)), *(p[k] for p in parts)])) for k, dim in enumerate(dims.values())], list(dims))

    return embed(text)


def _vectors_type(dims: dict[str, int]) -> str:
    return "struct<" + ", ".join(f"{name}: array<double>" for name in dims) + ">"


def embedded_chunks(docs: DataFrame, targets: dict[str, int], dims: dict[str, int], most_chars: int = 500_000) -> DataFrame:
    """The chunks of ``chunking.chunks_of_sizes`` with their vectors as ``v``, as ``hash_embed`` makes them.

    Words lie within tokens, so the counts of a chunk are the sums of those of its
    units, and words are hashed once for all sizes of chunks and of vectors. A task
    holds the chunks of about ``most_chars`` characters.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut in chunking.cut_documents(batches, targets, most_chars):
            counts = hash_counts(cut.units, list(dims.values()))
            for name in targets:
                firsts, columns = cut.chunks(name)
                vectors = [_lists(unit_length(np.add.reduceat(m, firsts, axis=0))) for m in counts]
                yield pa.RecordBatch.from_arrays([*columns, pa.StructArray.from_arrays(vectors, list(dims))], [*chunking.SIZED_NAMES, "v"])

    return docs.select("doc_id", "text").mapInArrow(made, f"{chunking.SIZED_SCHEMA}, v {_vectors_type(dims)}")


def flat_vectors(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as a matrix, without a Python value for each number."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _leading(query: np.ndarray, score: np.ndarray, name: np.ndarray, depth: int) -> np.ndarray:
    """Places of the ``depth`` best of each query, ties by name."""
    order = np.lexsort((np.unique(name, return_inverse=True)[1], -score, query))
    rank = np.arange(len(order)) - np.searchsorted(query[order], query[order])
    return order[rank < depth]


def nearest(queries: DataFrame, items: DataFrame, depth: int, *, most_queries: int = 20_000, block: int = 512) -> DataFrame:
    """``query_id``, ``item_id``, ``score`` (6 digits) and ``rank`` of the ``depth`` items of largest dot product.

    Queries (``query_id``, ``vector``) go to every task in blocks of about
    ``most_queries``, a pass over the items (``item_id``, ``vector``) for each
    block. A task keeps the best of each query over all its items and hands them
    on once, at its end; a window ranks what is left. Ties go by ``item_id``.
    """
    blocks = max(1, -(-queries.count() // most_queries))
    passes = [queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k) if blocks > 1 else queries for k in range(blocks)]
    return reduce(DataFrame.unionByName, [_nearest(part, items, depth, block) for part in passes])


def best_of_each(blocks: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], depth: int, most: int = 100_000) -> Iterator[list[np.ndarray]]:
    """The ``depth`` best items of each query over all blocks, ties by name, as parts of (query, score, name).

    A block is queries by number, names of items, and the score of each query and item. What
    is held is cut down to the best whenever it exceeds ``most``; from then on an item that
    is worse than the last of a query's best is not held at all.
    """
    waiting, count = [[np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object)]], 0
    floor = np.zeros(0)  # by query, the score of the last of its best so far

    def settled() -> list[np.ndarray]:
        query, score, name = (np.concatenate(x) for x in zip(*waiting))
        keep = _leading(query, score, name, depth)
        return [query[keep], score[keep], name[keep]]

    for query, names, score in blocks:
        if not score.size:
            continue
        if query.max() >= len(floor):
            floor = np.append(floor, np.full(query.max() + 1 - len(floor), -np.inf))
        least = floor[query][:, None]
        if np.isfinite(least).all():
            # Most items are worse than all that is held: only those near the bound or above are rounded.
            q, c = np.nonzero(score >= least - 1e-6 * (1 + np.abs(least)))
            near = np.round(score[q, c], 6)
            held = near >= floor[query[q]]
            q, c, near = q[held], c[held], near[held]
        else:
            score = np.round(score, 6)
            if len(names) > depth:
                # All that are no worse than the last of the best, so that ties are settled by name later.
                least = np.maximum(least, -np.partition(-score, depth - 1, axis=1)[:, depth - 1 : depth])
            q, c = np.nonzero(score >= least)
            near = score[q, c]
        waiting.append([query[q], near, names[c]])
        count += len(q)
        if count > most:
            waiting = [settled()]
            count = len(waiting[0][0])
            most = max(most, 2 * count)
            held, first, n = np.unique(waiting[0][0], return_index=True, return_counts=True)
            full = n == depth
            floor[held[full]] = waiting[0][1][(first + n - 1)[full]]
    found = settled()
    for at in range(0, len(found[0]), 50_000):
        yield [x[at : at + 50_000] for x in found]


def _nearest(queries: DataFrame, items: DataFrame, depth: int, block: int, rows: int = 2048) -> DataFrame:
    asked = queries.orderBy("query_id").select("query_id", "vector").toArrow()
    ids = asked.column(0).to_pylist()
    matrix = queries.sparkSession.sparkContext.broadcast(flat_vectors(asked.column(1).combine_chunks()))
    kinds = {f.name: f.dataType.simpleString() for f in [*queries.schema.fields, *items.schema.fields]}

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks():
            for whole in batches:
                for first in range(0, whole.num_rows, rows):
                    batch = whole.slice(first, rows)
                    names, vectors = np.array(batch.column(0).to_pylist(), object), flat_vectors(batch.column(1))
                    for at in range(0, len(ids), block):
                        part = matrix.value[at : at + block]
                        yield np.arange(at, at + len(part)), names, part @ vectors.T

        for query, score, name in best_of_each(blocks(), depth):
            yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in query]), pa.array(name.tolist()), pa.array(score)], ["query_id", "item_id", "score"])

    found = items.select("item_id", "vector").mapInArrow(best, f"query_id {kinds['query_id']}, item_id {kinds['item_id']}, score double")
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return found.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= depth)


def nearest_chunks(queries: DataFrame, docs: DataFrame, targets: dict[str, int], dims: dict[str, int], depth: int, *, most_queries: int = 20_000, block: int = 512, rows: int = 2048, most_chars: int = 500_000) -> DataFrame:
    """``nearest`` over the chunks of all ``targets`` and their vectors of all ``dims``, which are made, compared and let go in one pass over ``docs``.

    ``queries`` has ``query_id`` and ``v``, as ``hash_embed`` makes it. Returns ``chunking``,
    ``embedding``, ``query_id``, ``item_id`` (``chunking.item_name``), ``doc_id``, ``score`` and
    ``rank``. A task holds the chunks of about ``most_chars`` characters and the best of each
    query, and hands on names alone: what it holds depends on queries and depth, not on the documents.
    """
    blocks = max(1, -(-queries.count() // most_queries))
    passes = [queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k) if blocks > 1 else queries for k in range(blocks)]
    return reduce(DataFrame.unionByName, [_nearest_chunks(part, docs, targets, dims, depth, block, rows, most_chars) for part in passes])


def _nearest_chunks(queries: DataFrame, docs: DataFrame, targets: dict[str, int], dims: dict[str, int], depth: int, block: int, rows: int, most_chars: int) -> DataFrame:
    asked = queries.orderBy("query_id").select("query_id", *(f"v.{arm}" for arm in dims)).toArrow()
    ids = asked.column(0).to_pylist()
    sent = queries.sparkSession.sparkContext.broadcast([flat_vectors(column.combine_chunks()) for column in asked.columns[1:]])
    cells = [(name, arm) for name in targets for arm in dims]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks():
            for cut in chunking.cut_documents(batches, targets, most_chars):
                counts = hash_counts(cut.units, list(dims.values()))
                for k, name in enumerate(targets):
                    firsts, names = cut.named(name)
                    for j, matrix in enumerate(sent.value):
                        vectors, base = unit_length(np.add.reduceat(counts[j], firsts, axis=0)), (k * len(dims) + j) * len(ids)
                        for first in range(0, len(names), rows):
                            for at in range(0, len(ids), block):
                                part = matrix[at : at + block]
                                yield np.arange(base + at, base + at + len(part)), names[first : first + rows], part @ vectors[first : first + rows].T

        for query, score, name in best_of_each(blocks() if ids else (), depth):
            of_cell = [cells[k] for k in query // max(1, len(ids))]
            columns = [[c for c, _ in of_cell], [a for _, a in of_cell], [ids[k] for k in query % max(1, len(ids))], name.tolist(), [chunking.document_of(n) for n in name], score]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names_out)

    names_out = ["chunking", "embedding", "query_id", "item_id", "doc_id", "score"]
    types = [pa.string(), pa.string(), to_arrow_type(queries.schema["query_id"].dataType), pa.string(), pa.int64(), pa.float64()]
    found = docs.select("doc_id", "text").mapInArrow(best, f"chunking string, embedding string, query_id {queries.schema['query_id'].dataType.simpleString()}, item_id string, doc_id long, score double")
    by_query = Window.partitionBy("chunking", "embedding", "query_id").orderBy(F.desc("score"), "item_id")
    return found.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= depth)


def lexical_score(query: Column, text: Column) -> Column:
    """Occurrences of the query's words over the log length; 0 where either has no word."""

    def score(both: Column) -> Column:
        hits = F.size(F.filter(both["words"], lambda w: F.array_contains(both["terms"], w)))
        n = F.size(both["words"])
        return F.when((F.size(both["terms"]) > 0) & (n > 0), F.round(hits / F.log(n + F.lit(float(np.e))), 6)).otherwise(F.lit(0.0))

    # Both are an element's fields, as an expression within the filter would be worked out anew for each word of the text.
    return F.transform(F.array(F.struct(F.array_distinct(words(query)).alias("terms"), words(text).alias("words"))), score)[0]


def rerank(ranked: DataFrame, keys: list[str], score: Column) -> DataFrame:
    """``rank`` anew by ``score``, ties in the order of before."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "rank")
    return ranked.withColumn("score", score).withColumn("new", F.row_number().over(order)).drop("rank").withColumnRenamed("new", "rank")


def fill_budget(ranked: DataFrame, keys: list[str], budget: int, cost: str = "n_tokens") -> DataFrame:
    """The leading candidates whose running cost stays within the budget.

    Costs are not negative, so the first that overflows ends the context:
    nothing is cut, and nothing after it is taken.
    """
    run = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("used", F.sum(cost).over(run)).filter(F.col("used") <= budget)


def fill_summary(ranked: DataFrame, keys: list[str], budget: int, grid: DataFrame, cost: str = "n_tokens") -> DataFrame:
    """Chunks and tokens taken and why the fill stopped, a row for each row of ``grid``."""
    run = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    used = ranked.withColumn("used", F.sum(cost).over(run))
    fits = F.col("used") <= budget
    per = used.groupBy(*keys).agg(F.count("*").alias("n_candidates"), F.count_if(fits).alias("n_chunks"), F.coalesce(F.max(F.when(fits, F.col("used"))), F.lit(0)).alias("tokens_used"))
    out = grid.join(per, keys, "left").na.fill(0, ["n_candidates", "n_chunks", "tokens_used"])
    reason = F.when(F.col("n_candidates") == 0, "no_candidates").when(F.col("n_chunks") < F.col("n_candidates"), "overflow").otherwise("candidates_exhausted")
    return out.withColumn("budget_slack", budget - F.col("tokens_used")).withColumn("stopped_reason", reason)
