"""Ranked lexical search over dual-sorted wavelet trees, one a shard of documents.

A shard holds the documents of a task up to a number of terms, in the order of
their ids. Its postings stand term after term, those of a term by falling
impact: that is one order. The other is by document: a wavelet tree halves the
range of documents level by level and keeps the order of impact within each
half. So the postings of a term in any node's documents are one run, and the
first of the run has the largest impact there. The sum of those over a query's
terms, each times its weight, bounds the score of every document in the node;
at a leaf it is the score. Nodes are opened best first, many at a time, and the
search ends when no node left can reach the documents found: the top is exact.

An impact is ``10**9 * tf div (1000 * tf + 8 * m)``, with
``m = 10 + 90 * n * N div L``: ``n`` terms in the document, ``N`` documents with
a term, ``L`` terms in all. A term's weight is
``floor(1000 * ln((2 * N + 2) / (2 * df + 1)))``.

Texts that are null, empty or without a term are in no shard. Repeated rows are
documents of their own. Equal scores go by id, a null id after all others. An
empty table, or one of queries, gives no rows. Of documents only ``doc_id`` and
``text`` are read, of queries ``item_id`` and ``text``.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import shared_folder

#: What terms consist of: anything but these.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
INDEX = "shard long, doc_ids array<long>, n_postings long, terms binary, starts binary, impacts binary, bits binary"

#: UTF-8 bytes with A-Z lower-cased and blanks between terms.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """The documents with a term, and the terms of all."""
    n = F.coalesce(F.regexp_count("text", F.lit(TERM)), F.lit(0)).cast("long")
    row = docs.select(n.alias("n")).agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    return row["docs"], row["terms"] or 0


def build_tree(seq: np.ndarray, levels: int) -> np.ndarray:
    """The bits of each level, packed: documents by their bits from the highest on, in a stable order."""
    out = []
    for level in range(levels - 1, -1, -1):
        bit = (seq >> level & 1).astype(bool)
        out.append(np.packbits(bit))
        seq = np.concatenate([seq[~bit], seq[bit]])
    return np.concatenate(out) if out else np.zeros(0, np.uint8)


def _shard(shard: int, doc_ids: list, sizes: list[int], words: list[np.ndarray], vocabulary: dict[bytes, int], n_docs: int, n_terms: int) -> tuple:
    """One row of the index."""
    order = sorted(range(len(doc_ids)), key=lambda k: (doc_ids[k] is None, doc_ids[k] or 0))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    doc = np.repeat(place, sizes)
    key, tf = np.unique(np.concatenate(words).astype(np.int64) << 32 | doc, return_counts=True)
    term, doc = key >> 32, key & 0xFFFFFFFF
    m = np.array([10 + 90 * sizes[k] * n_docs // n_terms for k in order], np.int64)
    impact = 10**9 * tf // (1000 * tf + 8 * m[doc])
    by_impact = np.argsort(term << 20 | (1 << 20) - 1 - impact, kind="stable")
    starts = np.append(0, np.cumsum(np.bincount(term, minlength=len(vocabulary))))
    bits = build_tree(doc[by_impact], (len(order) - 1).bit_length())
    ids = [doc_ids[k] for k in order]
    return shard, ids, len(key), b" ".join(vocabulary), starts.astype("<i4").tobytes(), impact[by_impact].astype("<i4").tobytes(), bits.tobytes()


def index_shards(docs: DataFrame, n_docs: int, n_terms: int, *, shard_terms: int = 2_000_000) -> DataFrame:
    """The index, a row a shard. A task makes a shard of each ``shard_terms`` terms that it reads; nothing is shuffled."""
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.int64(), *[pa.binary()] * 4]
    names = [c.split()[0] for c in INDEX.split(", ")]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        held: tuple = ([], [], [], defaultdict(count().__next__))
        total = 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(_shard(shard, *held, n_docs, n_terms), kinds)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = terms_of(text.as_py() or b"")
                if not found:
                    continue
                ids, sizes, words, vocabulary = held
                ids.append(doc_id)
                sizes.append(len(found))
                words.append(np.fromiter(map(vocabulary.__getitem__, found), np.int32, len(found)))
                total += len(found)
                if total >= shard_terms:
                    yield row()
                    shard, total, held = shard + 1, 0, ([], [], [], defaultdict(count().__next__))
        if held[0]:
            yield row()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(made, INDEX)


def store_index(index: DataFrame, path: str) -> DataFrame:
    """The index written as a table and read back. Its rows are megabytes long, so the writer looks at its size after each."""
    index.write.options(**{"compression": "zstd", "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1, "parquet.enable.dictionary": "false"}).parquet(path)
    return index.sparkSession.read.schema(INDEX).parquet(path)


class Shard:
    """A shard made ready for search: for each level how many ones come before each place, and the impacts in the level's order."""

    def __init__(self, row: dict):
        self.ids = row["doc_ids"]
        self.levels, n = (len(self.ids) - 1).bit_length(), row["n_postings"]
        self.terms = {t: k for k, t in enumerate(row["terms"].split(b" "))}
        self.starts = np.frombuffer(row["starts"], "<i4")
        packed = np.frombuffer(row["bits"], np.uint8).reshape(self.levels, -(-n // 8))
        self.ones, self.zeros = np.zeros((self.levels, n + 1), np.int32), np.zeros(self.levels, np.int64)
        self.impacts = np.empty((self.levels + 1, n), np.int32)
        self.impacts[0] = np.frombuffer(row["impacts"], "<i4")
        for level in range(self.levels):
            bit = np.unpackbits(packed[level], count=n).astype(bool)
            np.cumsum(bit, out=self.ones[level, 1:])
            self.zeros[level] = n - self.ones[level, n]
            self.impacts[level + 1] = np.concatenate([self.impacts[level][~bit], self.impacts[level][bit]])

    def top(self, weights: dict[bytes, int], k: int, floor: int = 1, batch: int = 256) -> list[tuple[int, int]]:
        """(score, document's place) of the ``k`` best of at least ``floor``, by falling score, then place. Weights are not negative.

        A node is (level, the first bits of its documents); its postings are runs
        (weight, from, to), one for each term that it still holds.
        """
        known = [(self.terms[t], w) for t, w in weights.items() if w > 0 and t in self.terms]
        if not known:
            return []
        term, weight = np.array(known, np.int64).T
        low, high, owner = self.starts[term].astype(np.int64), self.starts[term + 1].astype(np.int64), np.zeros(len(term), np.int64)
        level, prefix = np.zeros(1, np.int64), np.zeros(1, np.int64)
        bound = np.array([(weight * self.impacts[0, low]).sum()])
        best: list[tuple[int, int]] = []
        while len(bound):
            done = level == self.levels
            if done.any():
                best = sorted([*best, *zip((-bound[done]).tolist(), prefix[done].tolist())])[:k]
            last, place = (-best[-1][0], best[-1][1]) if len(best) == k else (floor, len(self.ids))
            open_ = ~done & ((bound > last) | (bound == last) & (prefix << (self.levels - level) < place))
            at = np.flatnonzero(open_)
            if not len(at):
                break
            if len(at) > batch:
                at = at[np.argpartition(-bound[at], batch - 1)]
            # The best nodes are opened, the others stay; nodes that cannot reach the top any more go.
            number = np.full(len(bound), -1)
            number[at] = np.arange(len(at))
            owner = number[owner]
            mine = owner >= 0
            owner, weight, low, high = owner[mine], weight[mine], low[mine], high[mine]
            level, prefix, bound = level[at], prefix[at], bound[at]
            n, opened = min(len(at), batch), owner < batch
            rows, o, w = level[owner[opened]], owner[opened], weight[opened]
            one_low, one_high = self.ones[rows, low[opened]].astype(np.int64), self.ones[rows, high[opened]].astype(np.int64)
            child = np.concatenate([2 * o, 2 * o + 1])
            c_low = np.concatenate([low[opened] - one_low, self.zeros[rows] + one_low])
            c_high = np.concatenate([high[opened] - one_high, self.zeros[rows] + one_high])
            c_weight, c_rows = np.tile(w, 2), np.tile(rows, 2) + 1
            some = c_high > c_low
            child, c_low, c_high, c_weight, c_rows = child[some], c_low[some], c_high[some], c_weight[some], c_rows[some]
            bounds = np.bincount(child, c_weight * self.impacts[c_rows, c_low], minlength=2 * n).astype(np.int64)
            held = np.flatnonzero(bounds)
            number = np.full(2 * n, -1)
            number[held] = np.arange(len(held))
            child = number[child]
            keep = child >= 0  # a run whose impacts are all 0 adds nothing
            rest = ~opened
            owner = np.concatenate([child[keep], owner[rest] - n + len(held)])
            weight, low, high = (np.concatenate([x[keep], y[rest]]) for x, y in ((c_weight, weight), (c_low, low), (c_high, high)))
            prefix = np.concatenate([2 * prefix[held // 2] + held % 2, prefix[n:]])
            level = np.concatenate([level[held // 2] + 1, level[n:]])
            bound = np.concatenate([bounds[held], bound[n:]])
        return [(-score, place) for score, place in best if -score >= floor]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def document_frequencies(index: DataFrame, terms: set[bytes]) -> DataFrame:
    """``term``, ``df``: how many documents hold each of ``terms``."""
    asked = index.sparkSession.sparkContext.broadcast(terms)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            starts = np.frombuffer(row["starts"], "<i4")
            met = [(t, int(starts[k + 1] - starts[k])) for k, t in enumerate(row["terms"].split(b" ")) if t in asked.value]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in met], pa.binary()), pa.array([n for _, n in met], pa.int64())], ["term", "df"])

    return index.select("terms", "starts").mapInArrow(found, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))


def search(index: DataFrame, queries: DataFrame, n_docs: int, k: int = 10, *, most_queries: int = 20_000) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id`` and ``score`` of the ``k`` best documents of each query.

    Queries go to every task in blocks of about ``most_queries``, a pass over the
    index for each block. A task keeps the best of each query over all its shards,
    and what it has found bounds the search of the next one; a window ranks what the tasks hand on.
    """
    blocks = max(1, -(-queries.count() // most_queries))
    parts = [queries.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else queries for b in range(blocks)]
    found = reduce(DataFrame.unionByName, [_search(index, part, n_docs, k) for part in parts])
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _search(index: DataFrame, queries: DataFrame, n_docs: int, k: int) -> DataFrame:
    asked = [(r["item_id"], list(dict.fromkeys(terms_of((r["text"] or "").encode())))) for r in queries.select(F.col("item_id").cast("long"), "text").collect()]
    df = {bytes(r["term"]): r["df"] for r in document_frequencies(index, {t for _, terms in asked for t in terms}).collect()}
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    known = index.sparkSession.sparkContext.broadcast([(item, {t: weight[t] for t in terms if t in weight}) for item, terms in asked])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in known.value]
        for row in _rows(batches):
            shard = Shard(row)
            for own, (_, weights) in zip(held, known.value):
                for score, place in shard.top(weights, k, -own[-1][0] if len(own) == k else 1):
                    doc_id = shard.ids[place]
                    own.append((-score, doc_id is None, doc_id or 0))
                own.sort()
                del own[k:]
        rows = [(item, None if none else doc_id, -score) for (item, _), own in zip(known.value, held) for score, none, doc_id in own]
        for at in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[at : at + 50_000])], ["item_id", "doc_id", "score"])

    return index.mapInArrow(best, "item_id long, doc_id long, score long")


def rank_documents(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best documents of each query, from an index that is written to the shared folder first."""
    n_docs, n_terms = corpus_size(docs)
    index = store_index(index_shards(docs, n_docs, max(1, n_terms)), f"{shared_folder(docs.sparkSession)}/{uuid.uuid4()}")
    return search(index, queries, n_docs, k)
