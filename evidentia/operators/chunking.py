"""Documents to chunks. A document never leaves its task: there is no shuffle."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id long, chunk_index int, chunk_id string, n_tokens int, char_start int, char_end int, level int, text string, content_sha256 string, is_last boolean"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_TYPES = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_()]
_TOKEN = re.compile(r"\S+")

Span = tuple[int, int]

#: From coarse to fine; the empty one cuts between tokens.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def windows(n: int, target: int, overlap: int) -> Iterator[Span]:
    """Token windows; near the end, where one holds no more than the overlap, they advance by one."""
    if not 0 <= overlap < target:
        raise ValueError("the overlap must be at least 0 and under the target")
    at = 0
    while at < n:
        take = min(target, n - at)
        yield at, at + take
        at += max(1, take - overlap)


class Tokens:
    """The places of a text's tokens, found once; what lies between two offsets is then a matter of bisection."""

    def __init__(self, text: str):
        self.starts, self.ends = zip(*found) if (found := [m.span() for m in _TOKEN.finditer(text)]) else ((), ())

    def within(self, a: int, b: int) -> tuple[int, int]:
        """The first token that ends after ``a`` and the first that starts at ``b`` or later: those between lie in the span, cut off at its ends."""
        return (bisect_right(self.ends, a), bisect_left(self.starts, b)) if a < b else (0, 0)

    def count(self, a: int, b: int) -> int:
        first, end = self.within(a, b)
        return max(0, end - first)

    def spans(self, a: int, b: int) -> list[Span]:
        first, end = self.within(a, b)
        return [(max(a, self.starts[k]), min(b, self.ends[k])) for k in range(first, end)]


def count_tokens(text: str) -> int:
    return len(_TOKEN.findall(text))


def fixed_pieces(text: str, target: int, overlap: int) -> list[tuple[int, int, int | None]]:
    tokens = Tokens(text)
    return [(tokens.starts[a], tokens.ends[b - 1], None) for a, b in windows(len(tokens.starts), target, overlap)]


def recursive_pieces(text: str, target: int, separators: Sequence[str]) -> list[tuple[int, int, int | None]]:
    """Cut at the coarsest separator that occurs, pack neighbours up to the target, go finer where one is too long.

    The separator stays with what is before it. An empty separator, or none
    left, cuts between tokens. A text that fits is one piece without a level.
    Tokens are found once; each piece is counted by bisection.
    """
    tokens = Tokens(text)

    def by_tokens(a: int, b: int, level: int) -> Iterator[tuple[int, int, int | None]]:
        spans = tokens.spans(a, b)
        if not spans:
            yield a, b, level
        for i in range(0, len(spans), target):
            yield spans[i][0], spans[min(i + target, len(spans)) - 1][1], level

    def edges(a: int, b: int, separator: str) -> list[int]:
        """The ends of the parts between ``a`` and ``b``."""
        out, at = [], text.find(separator, a, b)
        while at >= 0:
            out.append(at + len(separator))
            at = text.find(separator, out[-1], b)
        return out if out and out[-1] == b else [*out, b]

    if tokens.count(0, len(text)) <= target:
        return [(0, len(text), None)] if text else []
    # A stack in place of recursion: pieces that are whole wait their turn beside parts that are still too long.
    waiting: list[tuple[int, int, int, bool]] = [(0, len(text), 0, False)]
    done: list[tuple[int, int, int | None]] = []
    while waiting:
        a, b, level, whole = waiting.pop()
        if whole:
            done.append((a, b, level))
            continue
        while level < len(separators) and separators[level] and text.find(separators[level], a, b) < 0:
            level += 1
        if level == len(separators) or not separators[level]:
            done += by_tokens(a, b, min(level, len(separators) - 1))
            continue
        ends = edges(a, b, separators[level])
        if len(ends) == 1:  # it stands at the end only
            waiting.append((a, b, level + 1, False))
            continue
        parts: list[tuple[int, int, int, bool]] = []
        held = 0  # tokens of the open piece
        for x, y in zip([a, *ends], ends):
            n = tokens.count(x, y)
            if n > target:
                parts.append((x, y, level + 1, False))
            elif parts and parts[-1][3] and held + n <= target:
                parts[-1] = (parts[-1][0], y, level, True)
                held += n
                continue
            else:
                parts.append((x, y, level, True))
            held = n
        waiting += reversed(parts)
    return done


def bare_spans(text: str, pieces: list[tuple[int, int, int | None]]) -> list[Span]:
    """The pieces without white space at their ends, blank ones left out."""
    out = []
    for a, b, *_ in pieces:
        piece = text[a:b]
        if bare := piece.strip():
            a += len(piece) - len(piece.lstrip())
            out.append((a, a + len(bare)))
    return out


def chunks(docs: DataFrame, pieces: Callable[[str], list[tuple[int, int, int | None]]]) -> DataFrame:
    """Non-blank pieces, stripped, numbered in order, with offsets in code points and whether they are their document's last. A null text has none."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text, index = value.as_py() or "", 0
                own = []
                for a, b, level in pieces(text):
                    for a, b in bare_spans(text, [(a, b, level)]):
                        piece = text[a:b]
                        own.append((doc_id, index, f"{doc_id}-{index:04d}", count_tokens(piece), a, b, level, piece, hashlib.sha256(piece.encode()).hexdigest()))
                        index += 1
                rows += [(*row, k + 1 == index) for k, row in enumerate(own)]
                if len(rows) > 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)

    return docs.select("doc_id", "text").mapInArrow(made, SCHEMA)


def item_name(doc_id: int | None, index: int) -> str:
    """The name of a chunk among all, as ``format_string("%012d-%06d", ...)`` makes it."""
    return f"{'null' if doc_id is None else format(doc_id, '012d'):>12}-{index:06d}"


def document_of(name: str) -> int | None:
    """The document of a chunk's name."""
    doc_id = name.rpartition("-")[0].strip()
    return None if doc_id == "null" else int(doc_id)


SIZED_SCHEMA = "chunking string, doc_id long, chunk_index int, n_tokens int, char_start int, char_end int, text string"
SIZED_NAMES = [c.split()[0] for c in SIZED_SCHEMA.split(", ")]


class CutDocuments:
    """Documents cut into units of as many tokens as the greatest common divisor of all targets, so that a chunk of any target is some units in turn."""

    def __init__(self, targets: dict[str, int]):
        self.targets, self.unit = targets, math.gcd(*targets.values())
        self._pattern = re.compile(r"\S++(?:\s++\S++){0,%d}+" % (self.unit - 1))
        self.clear()

    def clear(self) -> None:
        self.texts: list[tuple[int | None, str, int]] = []  # with the number of units before it
        self.spans: list[Span] = []
        self.units: list[str] = []
        self.chars = 0

    def add(self, doc_id: int | None, text: str) -> None:
        self.texts.append((doc_id, text, len(self.spans)))
        self.spans += [m.span() for m in self._pattern.finditer(text)]
        self.units += [text[a:b] for a, b in self.spans[len(self.units) :]]
        self.chars += len(text)

    def named(self, name: str) -> tuple[list[int], np.ndarray]:
        """The first unit of each chunk, and its name."""
        each, names, firsts = self.targets[name] // self.unit, [], []
        for (doc_id, _, first), end in zip(self.texts, [*(t[2] for t in self.texts[1:]), len(self.spans)]):
            firsts += range(first, end, each)
            names += [item_name(doc_id, index) for index in range(-(-(end - first) // each))]
        return firsts, np.array(names, object)

    def chunks(self, name: str) -> tuple[list[int], list[pa.Array]]:
        """The first unit of each chunk, and the columns of ``SIZED_SCHEMA``."""
        each, rows, firsts = self.targets[name] // self.unit, [], []
        for (doc_id, text, first), end in zip(self.texts, [*(t[2] for t in self.texts[1:]), len(self.spans)]):
            for index, at in enumerate(range(first, end, each)):
                last = min(at + each, end) - 1
                # All units are full but a document's last.
                n = (last - at) * self.unit + (self.unit if last + 1 < end else len(self.units[last].split()))
                a, b = self.spans[at][0], self.spans[last][1]
                firsts.append(at)
                rows.append((name, doc_id, index, n, a, b, text[a:b]))
        return firsts, [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()))]


def cut_documents(batches: Iterator[pa.RecordBatch], targets: dict[str, int], most_chars: int) -> Iterator[CutDocuments]:
    """The documents of ``batches`` (``doc_id``, ``text``), about ``most_chars`` characters at a time; those without a token are left out."""
    cut = CutDocuments(targets)
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            cut.add(doc_id.as_py(), text.as_py() or "")
            if cut.chars >= most_chars:
                if cut.units:
                    yield cut
                cut.clear()
    if cut.units:
        yield cut


def chunks_of_sizes(docs: DataFrame, targets: dict[str, int], most_chars: int = 500_000) -> DataFrame:
    """The chunks of ``fixed_chunks`` for each of ``targets`` (``chunking`` by name), from one pass over the tokens."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut in cut_documents(batches, targets, most_chars):
            for name in targets:
                yield pa.RecordBatch.from_arrays(cut.chunks(name)[1], SIZED_NAMES)

    return docs.select("doc_id", "text").mapInArrow(made, SIZED_SCHEMA)


def fixed_chunks(docs: DataFrame, target: int = 128, overlap: int = 0) -> DataFrame:
    return chunks(docs, lambda text: fixed_pieces(text, target, overlap))


def recursive_chunks(docs: DataFrame, target: int = 128, separators: Sequence[str] = SEPARATORS) -> DataFrame:
    return chunks(docs, lambda text: recursive_pieces(text, target, separators))


CHUNK_ROW = "chunk_index int, n_tokens int, char_start int, char_end int, level int, text string"


class ChunkTable:
    """The table function ``recursive_chunks(text, target)``: a row for each chunk of a text; none for a null one."""

    def eval(self, text: str, target: int) -> Iterator[tuple]:
        index = 0
        for a, b, level in recursive_pieces(text or "", target, SEPARATORS):
            for a, b in bare_spans(text, [(a, b, level)]):
                yield index, count_tokens(text[a:b]), a, b, level, text[a:b]
                index += 1


def register_chunk_table(spark: SparkSession, name: str = "recursive_chunks") -> None:
    """From now on SQL can say ``FROM documents, LATERAL recursive_chunks(text, 128)``."""
    spark.udtf.register(name, F.udtf(ChunkTable, returnType=CHUNK_ROW, useArrow=True))
