"""Cross-tokenizer alignment: groups of tokens of two tokenizers that cover the same bytes, and the links between them.

Tokens are intervals of bytes of a space and the text. The intervals of the
second tokenizer (B) are a static index, sorted by their starts and ends; two
bisections for each token of the first (A) give the B tokens that it overlaps.
A gap between two B tokens that no A token spans is where a group ends. An A and
a B token that end together are linked.

Of two tokens that end together the shorter one is the end of the longer one, so
the pairs of ids that can ever be linked follow from the two vocabularies: a few
hundred thousand, whatever the corpus. Links are stored as places in that list,
a task counts its own, and only one count for each pair goes to the driver and
back to the tasks.

Null and empty texts, and those whose tokens do not give back the bytes (a text
that holds U+2581), have no tokens: zeros and an empty digest. Repeated rows
count as often as they stand there. A null ``doc_id`` stays null. An empty table
gives no rows. Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.binpack import byte_letters
from evidentia.llm.common import stored

#: How a byte-level tokenizer splits a text before it merges.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<int>"
COUNTED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Tokenizers:
    """Both tokenizers, the bytes of their tokens, and the pairs of ids that can be linked, sorted."""

    def __init__(self, a: str, b: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.full = Tokenizer.from_file(a)
        self.full.encode_special_tokens = True
        with open(a, encoding="utf-8") as f:
            whole = json.load(f)
        model, before = whole["model"], whole["pre_tokenizer"]
        byte = {c: k for k, c in byte_letters().items()}
        vocabulary = {t: k for t, k in model["vocab"].items() if all(c in byte for c in t)}
        self.a_bytes = [b""] * self.full.get_vocab_size()
        for token, k in vocabulary.items():
            self.a_bytes[k] = bytes(byte[c] for c in token)
        # Where ids follow the order of the merges, ranks are ids and the same merges can be run faster.
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        plain = not whole["normalizer"] and before["type"] == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
        in_order = plain and all(vocabulary.get(t) == 256 + k for k, t in enumerate(merged)) and all(len(x) == 1 for x in self.a_bytes[:256])
        ranks = {self.a_bytes[k]: k for k in vocabulary.values() if k < 256 + len(merged)}
        self.fast = tiktoken.Encoding("a", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}) if in_order else None
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.pairs = self._pairs()
        self.digits, self.shown = self._decimals(max(len(self.a_bytes), len(self.b_bytes)))

    def _pairs(self) -> np.ndarray:
        """``a * (number of B ids) + b`` for all ids of which one ends as the other one does."""
        by_a, by_b = {}, {}
        for held, tokens in ((by_a, self.a_bytes), (by_b, self.b_bytes)):
            for k, x in enumerate(tokens):
                if x:
                    held.setdefault(x, []).append(k)
        met = [(a, b) for x, bs in by_b.items() for i in range(len(x)) for a in by_a.get(x[i:], ()) for b in bs]
        met += [(a, b) for x, as_ in by_a.items() for i in range(1, len(x)) for b in by_b.get(x[i:], ()) for a in as_]
        a, b = np.array(met, np.int64).reshape(-1, 2).T
        return np.sort(a * len(self.b_bytes) + b)

    @staticmethod
    def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
        """For each number below ``n`` its digits with a place for a mark after them, and which of the places are used."""
        width = len(str(n))
        numbers = np.arange(n)[:, None] // 10 ** np.arange(width - 1, -1, -1)
        digits = np.concatenate([numbers % 10 + ord("0"), np.zeros((n, 1), np.int64)], axis=1).astype(np.uint8)
        shown = np.concatenate([numbers > 0, np.ones((n, 1), bool)], axis=1)
        shown[0, width - 1] = True
        return digits, shown

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of a space and each text, and of each text; both empty where they do not give back its bytes."""
        spaced = [" " + t for t in texts]
        a = self._fast(spaced) if self.fast else [e.ids for e in self.full.encode_batch(spaced, add_special_tokens=False)]
        b = self.b.encode(texts, num_threads=1)
        for k, text in enumerate(spaced):
            raw = text.encode()
            if len(raw) == 1 or b"".join(map(self.b_bytes.__getitem__, b[k])) != raw or b"".join(map(self.a_bytes.__getitem__, a[k])) != raw:
                a[k], b[k] = [], []
        return [np.array(x, np.int64) for x in a], [np.array(x, np.int64) for x in b]

    def _fast(self, texts: list[str]) -> list[list[int]]:
        out = []
        for text in texts:
            try:
                out.append(self.fast.encode_ordinary(text))
            except Exception:  # the pattern gives up on a run of some hundred thousand blanks
                out.append(self.full.encode(text, add_special_tokens=False).ids)
        return out


@lru_cache(1)
def _tokenizers(a: str, b: str) -> Tokenizers:
    return Tokenizers(a, b)


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and last B token that each A token overlaps; both lists of tokens cover the same bytes without a gap."""
    a_starts, b_starts = np.append(0, a_ends)[:-1], np.append(0, b_ends)[:-1]
    return np.searchsorted(b_ends, a_starts, side="right"), np.searchsorted(b_starts, a_ends, side="left") - 1


def group_ends(first: np.ndarray, last: np.ndarray, n_b: int) -> np.ndarray:
    """Whether no A token spans the gap after each of the ``n_b`` B tokens."""
    return np.cumsum(np.bincount(first, minlength=n_b) - np.bincount(last, minlength=n_b)) == 0


def _aligned(tok: Tokenizers, doc_ids: list, texts: list[str]) -> pa.RecordBatch:
    """All documents of a slice at once, their bytes in a row: where a document ends, both kinds of tokens do."""
    a_ids, b_ids = tok.encode(texts)
    n_a, n_b = (np.array(list(map(len, x)), np.int64) for x in (a_ids, b_ids))
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a_ids, b_ids))
    a_to, b_to = np.append(0, np.cumsum(n_a)), np.append(0, np.cumsum(n_b))
    a_ends, b_ends = np.cumsum(tok.a_sizes[a]), np.cumsum(tok.b_sizes[b])
    first, last = overlaps(a_ends, b_ends)
    ends = group_ends(first, last, len(b))
    upto = np.append(0, np.cumsum(ends))  # groups that ended before each B token
    groups = upto[b_to[1:]] - upto[b_to[:-1]]
    linked = b_ends[last] == a_ends
    codes = np.searchsorted(tok.pairs, a[linked] * len(tok.b_bytes) + b[last[linked]])
    link_to = np.append(0, np.cumsum(linked))[a_to]
    digests = _digests(tok, a, b, upto[last], upto[:-1], ends, a_to, b_to)
    lists = pa.ListArray.from_arrays(pa.array(link_to, pa.int32()), pa.array(codes, pa.int32()))
    return pa.RecordBatch.from_arrays(
        [pa.array(doc_ids, pa.int64()), pa.array(n_a), pa.array(n_b), pa.array(groups), pa.array(link_to[1:] - link_to[:-1]), pa.array(digests), lists],
        [c.split()[0] for c in ALIGNED.split(", ")],
    )


def _digests(tok: Tokenizers, a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, ends: np.ndarray, a_to: np.ndarray, b_to: np.ndarray) -> list[str]:
    """SHA-256 of each document's groups, written out as ``a,a|b;a|b,b``."""
    n = int(ends.sum())
    a_end, b_end = np.cumsum(np.bincount(a_group, minlength=n)), np.flatnonzero(ends) + 1
    b_start = np.append(0, b_end)[:-1]
    value, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    value[np.arange(len(a)) + b_start[a_group]] = a
    value[np.arange(len(b)) + a_end[b_group]] = b
    mark[a_end + b_start - 1], mark[a_end + b_end - 1] = ord("|"), ord(";")
    digits, shown = tok.digits[value], tok.shown[value]
    digits[:, -1] = mark
    written = digits[shown]
    to = np.append(0, np.cumsum(shown.sum(axis=1)))[a_to + b_to]
    view = memoryview(written)
    return [hashlib.sha256(view[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(to[:-1].tolist(), to[1:].tolist())]


def align(docs: DataFrame, a: str, b: str, *, slice_chars: int = 1_000_000) -> DataFrame:
    """A row a document: its numbers of tokens, groups and links, the digest of its groups, and its links as places in the list of pairs."""

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizers(a, b)
        for batch in batches:
            ids, texts, held = [], [], 0
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(doc_id)
                texts.append(value.as_py() or "")
                held += len(texts[-1])
                if held >= slice_chars:
                    yield _aligned(tok, ids, texts)
                    ids, texts, held = [], [], 0
            if ids:
                yield _aligned(tok, ids, texts)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(aligned, ALIGNED)


def link_counts(aligned: DataFrame, n_pairs: int) -> DataFrame:
    """``pair`` (its place) and ``n``, for the pairs that are linked anywhere. A task adds its own links up first."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_pairs, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=n_pairs)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met])], ["pair", "n"])

    return aligned.select("links").mapInArrow(counted, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def align_and_count(docs: DataFrame, a: str, b: str) -> DataFrame:
    """``align`` with ``n_best``, the links whose pair is the most frequent of its B id, and ``count_sum``, the pairs' counts over all links."""
    aligned = stored(align(docs, a, b))
    tok = _tokenizers(a, b)
    counts = np.zeros(len(tok.pairs), np.int64)
    met = link_counts(aligned, len(counts)).toArrow()  # no more rows than there are pairs
    counts[met["pair"].to_numpy()] = met["n"].to_numpy()
    of_b = tok.pairs % len(tok.b_bytes)
    highest = np.zeros(len(tok.b_bytes), np.int64)
    np.maximum.at(highest, of_b, counts)
    known = docs.sparkSession.sparkContext.broadcast((counts, counts == highest[of_b]))
    names = [c.split()[0] for c in COUNTED.split(", ")]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, best = known.value
        for batch in batches:
            links = batch.column(6).flatten().to_numpy(zero_copy_only=False)
            to = np.append(0, np.cumsum(batch.column(4).to_numpy()))
            total = lambda x: (run := np.append(0, np.cumsum(x)))[to[1:]] - run[to[:-1]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(total(best[links])), pa.array(total(count[links])), batch.column(5)], names)

    return aligned.mapInArrow(summed, COUNTED)
