"""Cost-balanced packing of documents into training sequences.

A document of n tokens costs ``linear * n + quadratic * n * n``: the linear
layers and the attention within it. Every task packs the documents of its own
partition in blocks of a bounded number of tokens, so there is no shuffle and
no group that grows with the input. In a block, whole sequences are cut off
long documents first; what is left of each document is assigned in descending
order to the sequence of lowest cost that still holds it. When none holds it
whole, the sequence of lowest cost with any room is filled and the rest goes
on. A block opens just as many sequences as its tokens need, so it wastes less
than one sequence.

Nulls and empty texts make one piece with the end id alone. Repeated rows are
packed one by one. A null ``doc_id`` stays null. An empty table gives no rows.
Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.binpack import byte_letters

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"

#: Words of this form are one run of letters and one of marks for the tokenizer; an apostrophe may belong to letters.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")

#: No byte of a text in UTF-8, so it can stand for the end of a word.
_END = b"\xff"


def word_merges(path: str):
    """The merges of a tokenizer that marks the last byte of a word, run on bytes by ``tiktoken``; None where ids don't follow the order of the merges."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    suffix, vocabulary = model.get("end_of_word_suffix"), model["vocab"]
    if not suffix:
        return None
    byte = {c: k for k, c in byte_letters().items()}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ids = [{vocabulary.get(c + end) for c in byte} for end in ("", suffix)]
    if ids != [set(range(256)), set(range(256, 512))] or [vocabulary.get(t) for t in merged] != list(range(512, 512 + len(merged))):
        return None
    tokens = [*byte, *(c + suffix for c in byte), *merged]
    ranks = {bytes(byte[c] for c in t.removesuffix(suffix)) + _END * t.endswith(suffix): vocabulary[t] for t in tokens}
    return tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class WordIds(dict):
    """Word -> its ids as little-endian unsigned 32-bit bytes.

    Only for tokenizers that drop white space and let no token span it, such as
    ``word_bpe_49k.json``: there a text's ids are those of its words in a row.
    Holds ``limit`` words at most and then starts anew.
    """

    def __init__(self, path: str, limit: int = 500_000):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.full, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.merges = word_merges(path)
        self.parts: dict[str, bytes] = {}
        self.limit = limit

    def part(self, text: str) -> bytes:
        ids = self.parts.get(text)
        if ids is None:
            if len(self.parts) >= self.limit:
                self.parts.clear()
            found = self.merges(text.encode() + _END) if self.merges else self.bare.encode(text, add_special_tokens=False).ids
            ids = self.parts[text] = struct.pack(f"<{len(found)}I", *found)
        return ids

    def __missing__(self, word: str) -> bytes:
        if plain := _PLAIN.fullmatch(word):
            head, tail = plain.groups()
            ids = self.part(head.lower()) + (self.part(tail) if tail else b"")
        else:
            ids = np.array(self.full.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) >= self.limit:
            self.clear()
        self[word] = ids
        return ids

    def text(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(1)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def assign(lengths: np.ndarray, seq_len: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(item, start in the item, length, sequence, offset) for items of ``lengths`` tokens, none over ``seq_len``."""
    n = -(-int(lengths.sum()) // seq_len)
    cost, room = np.zeros(n), np.full(n, seq_len)
    out = []
    for item in np.argsort(-lengths, kind="stable"):
        start, left = 0, int(lengths[item])
        while left:
            if (fits := room >= left).any():
                at = int(np.argmin(np.where(fits, cost, np.inf)))
                take = left
            else:
                at = int(np.argmin(np.where(room > 0, cost, np.inf)))
                take = int(room[at])
            out.append((int(item), start, take, at, seq_len - int(room[at])))
            room[at] -= take
            cost[at] += linear * take + quadratic * take * take
            start, left = start + take, left - take
    return out


def _block(docs: list[tuple[int | None, bytes]], first: int, seq_len: int, linear: float, quadratic: float) -> tuple[list[tuple], int]:
    """The pieces of a block, whose sequences are numbered from ``first``; the next free number."""
    out, tails = [], []
    for doc_id, ids in docs:
        n = len(ids) // 4
        whole = n - n % seq_len
        for start in range(0, whole, seq_len):
            out.append((doc_id, start, seq_len, zlib.crc32(ids[4 * start : 4 * (start + seq_len)]), n, first, 0, linear * seq_len + quadratic * seq_len**2))
            first += 1
        if n > whole:
            tails.append((doc_id, whole, ids, n))
    placed = assign(np.array([n - whole for _, whole, _, n in tails], dtype=np.int64), seq_len, linear, quadratic)
    for item, start, length, at, offset in placed:
        doc_id, whole, ids, n = tails[item]
        a = whole + start
        out.append((doc_id, a, length, zlib.crc32(ids[4 * a : 4 * (a + length)]), n, first + at, offset, linear * length + quadratic * length**2))
    return out, first + 1 + max((p[3] for p in placed), default=-1)


def _in_order(pieces: list[tuple], docs: list[int], first: int) -> list[tuple]:
    """The pieces with the sequences of a block numbered by the mean place of their tokens; ``docs``: the place of each piece's document."""
    sums: dict[int, list[int]] = {}
    for piece, at in zip(pieces, docs):
        held = sums.setdefault(piece[5], [0, 0])
        held[0] += at * piece[2]
        held[1] += piece[2]
    number = {s: first + k for k, s in enumerate(sorted(sums, key=lambda s: (sums[s][0] / sums[s][1], s)))}
    return sorted(((*p[:5], number[p[5]], *p[6:]) for p in pieces), key=lambda p: (p[5], p[6]))


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    *,
    end_id: int = 2,
    seq_len: int = 4096,
    linear: float = 1.0,
    quadratic: float = 1 / 4096,
    block_tokens: int = 3_000_000,
    keep_order: bool = False,
) -> DataFrame:
    """One row per piece: where its ids lie in the document and in its sequence.

    ``sequence_id`` holds the task's partition in its upper bits, so numbers
    are unique and a task that runs again over the same rows gives the same ones.
    With ``keep_order`` they follow the order of the rows: by partition, by block,
    and in a block by the mean place of a sequence's tokens.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _word_ids(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        number = TaskContext.get().partitionId() << 32
        block, held = [], 0
        names = [c.split()[0] for c in SCHEMA.split(", ")]

        def rows():
            nonlocal number
            before = number
            if keep_order:
                # Documents go by their place, as ids may repeat.
                pieces, number = _block([(k, ids) for k, (_, ids) in enumerate(block)], number, seq_len, linear, quadratic)
                pieces = [(block[p[0]][0], *p[1:]) for p in _in_order(pieces, [p[0] for p in pieces], before)]
            else:
                pieces, number = _block(block, number, seq_len, linear, quadratic)
            for at in range(0, len(pieces), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if n == "cost" else pa.int64()) for n, c in zip(names, zip(*pieces[at : at + 20_000]))], names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = words.text(text.as_py() or "") + end
                block.append((doc_id, ids))
                held += len(ids) // 4
                if held >= block_tokens:
                    yield from rows()
                    block, held = [], 0
        if block:
            yield from rows()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(packed, SCHEMA)
