"""Best-fit packing: documents into as few sequences as possible, by minimum bin slack.

Only documents longer than a sequence are cut, into whole sequences and a rest.
What has to be packed are then items of 1 to ``seq_len`` tokens, and all that
matters of an item is its length: the driver gets one count for each length, at
most ``seq_len`` rows whatever the corpus. For each bin it takes the longest item
left and looks for the fullest combination of others that fits beside it, by
subset sums held as the bits of an integer; the combination is repeated while its
lengths last, so that the number of searches grows with the logarithm of the
counts. Items of a length are interchangeable: they are numbered (within their
task, and by the counts of the tasks before it), and the number says the bin.

Nulls and empty texts make one piece with the end id alone. Repeated rows are
packed one by one. A null ``doc_id`` stays null. An empty table gives no rows.
Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import stored

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

#: What stands for the end of a word, and between words, in the byte form of the vocabulary.
_END, _GAP = "\x00", "\x01"
#: Words of printable ASCII and precomposed letters: lower case is all that a normaliser does to them.
_PLAIN = regex.compile(r"[!-~À-ÖØ-öø-ÿ]+")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it can be printed, else the next of those from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class WordEncoder:
    """Text -> its ids as little-endian unsigned 32-bit bytes, for a byte-level tokenizer with word ends that drops white space.

    Words are looked up; those of a text that are new go through the merges
    together, in one call. Words of other than plain characters, or with what may
    be a special token, go to the tokenizer itself. Some ``limit`` words are held.
    """

    def __init__(self, path: str, limit: int = 300_000):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.full, self.limit, self.words = Tokenizer.from_file(path), limit, {}
        with open(path, encoding="utf-8") as f:
            model, letters = json.load(f), byte_letters()
        vocabulary, merges, suffix = model["model"]["vocab"], model["model"]["merges"], model["model"]["end_of_word_suffix"]
        split = model["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(split.replace(r"[^\s", rf"[^{_GAP}\s"))
        byte = {c: bytes([b]) for b, c in letters.items()}

        def raw(token: str) -> bytes:
            body = token.removesuffix(suffix)
            return b"".join(byte[c] for c in body) + _END.encode() * (body != token)

        # Single bytes, the same at a word's end (which come before all merges), then merges in their order.
        order = [*(letters[b] for b in range(256)), *(letters[b] + suffix for b in range(256))]
        order += ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
        self.ids = np.array([vocabulary[t] for t in order], "<u4")
        self.merged = tiktoken.Encoding("words", pat_str=f"{_GAP}|[^{_GAP}{_END}]+{_END}", mergeable_ranks={raw(t): k for k, t in enumerate(order)}, special_tokens={})

    def learn(self, words: list[str]) -> None:
        plain = [w for w in words if _PLAIN.fullmatch(w) and "<|" not in w]
        if plain:
            marked = self.split.sub(rf"\g<0>{_END}", (_GAP.join(plain) + _GAP).lower())
            ranks = np.array(self.merged.encode_ordinary(marked), np.int64)
            gaps = np.flatnonzero(ranks == ord(_GAP))
            ids, at = self.ids[ranks].tobytes(), 0
            for word, gap in zip(plain, gaps.tolist()):
                self.words[word] = ids[4 * at : 4 * gap]
                at = gap + 1
        for word in set(words).difference(plain):
            self.words[word] = np.array(self.full.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        words = text.replace("\n", " ").split(" ")
        if new := [w for w in dict.fromkeys(words) if w not in self.words]:
            if len(self.words) + len(new) > self.limit:
                self.words.clear()
                new = list(dict.fromkeys(words))
            self.learn(new)
        return b"".join(map(self.words.__getitem__, words))


@lru_cache(1)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length make up the largest sum within ``capacity``, by subset sums over bits; long items before short ones.

    Several items of one length join in doubling parts. The search ends as soon as
    the capacity itself is met.
    """
    within, reach, trail = (1 << (capacity + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        left, part = min(counts[length], capacity // length), 1
        while left > 0:
            take = min(part, left)
            trail.append((length, take, reach))
            reach |= (reach << (length * take)) & within
            left, part = left - take, part * 2
        if reach >> capacity:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(trail):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def combinations(counts: dict[int, int], seq_len: int) -> list[tuple[dict[int, int], int]]:
    """The bins' combinations of lengths with how often each is made, until nothing is left of ``counts`` (lengths of 1 to ``seq_len``)."""
    left, out = {n: c for n, c in counts.items() if c > 0}, []
    while left:
        longest = max(left)
        rest = {n: c - (n == longest) for n, c in left.items()}
        chosen = fullest(rest, seq_len - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[n] // k for n, k in chosen.items())
        out.append((chosen, times))
        for n, k in chosen.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return out


def schedule(counts: dict[int, int], seq_len: int) -> np.ndarray:
    """Rows (length, first item of that length, items a bin, first bin, offset in the bin), sorted: where the items of each length go."""
    rows, bins, taken = [], 0, dict.fromkeys(counts, 0)
    for chosen, times in combinations(counts, seq_len):
        offset = 0
        for length in sorted(chosen, reverse=True):
            rows.append((length, taken[length], chosen[length], bins, offset))
            taken[length] += chosen[length] * times
            offset += length * chosen[length]
        bins += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def cut_documents(docs: DataFrame, tokenizer: str, *, end_id: int = 0, seq_len: int = 2048) -> DataFrame:
    """One row per piece, with the task that made it (``part``) and its number among the task's pieces of that length (``nth``)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, part = _encoder(tokenizer), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        seen = [0] * (seq_len + 1)
        names = [c.split()[0] for c in PIECES.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, seq_len)):
                    length = min(seq_len, n - start)
                    rows.append((doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, seen[length]))
                    seen[length] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def pack_best_fit(docs: DataFrame, tokenizer: str, *, end_id: int = 0, seq_len: int = 2048) -> DataFrame:
    """One row per piece with its sequence and its place there; sequences are numbered from 0.

    The pieces are stored, so that their numbers hold however often they are read.
    Counts by task and length are summed up length by length over the tasks, and
    joined back by both. The schedule is broadcast: its size depends on
    ``seq_len`` and the logarithm of the counts, not on the documents.
    """
    pieces = stored(cut_documents(docs, tokenizer, end_id=end_id, seq_len=seq_len))
    counts = stored(pieces.groupBy("length", "part").agg(F.count("*").alias("n")))
    rows = schedule({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, seq_len)
    plan = docs.sparkSession.sparkContext.broadcast(rows)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    names = [c.split()[0] for c in PLACED.split(", ")]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, each, bins, offset = plan.value.T
        width = 1 << 50
        key = length * width + first
        for batch in batches:
            n, item = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(key, n * width + item, side="right") - 1
            past = item - first[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(bins[at] + past // each[at]), pa.array(offset[at] + past % each[at] * n)], names)

    numbered = pieces.join(before, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("item"))
    return numbered.mapInArrow(placed, PLACED)
