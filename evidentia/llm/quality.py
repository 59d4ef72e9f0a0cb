"""Quality rules from line frequencies across documents.

Lines are normalised (lower case, everything but letters and digits to one
space) and hashed. A line that more than ``max_docs`` documents of one host
hold is boilerplate there and is removed; a document that loses more than
``max_removed`` of its words that way, or keeps fewer than ``min_words``, is
depleted and rejected. Rules on single documents come first: too few words, or
too many words inside repeated three-word windows.

A null text has no words and fails the word rule. A null host is a host of its
own. Repeated rows count as documents of their own and get equal results. A
document without words has no lines to remove. An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOLS = b"#*$%&|<>"
_WHITE = b" \t\n\v\f\r"


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found twice or more, the first one included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) >= 2**20:
        keys = np.unique(np.stack([codes[i : i + n] for i in range(width)]), axis=1, return_inverse=True)[1].ravel()
    else:
        keys = codes[:n].copy()
        for i in range(1, width):
            keys = keys * len(number) + codes[i : i + n]
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    same = sorted_keys[1:] == sorted_keys[:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for i in range(width):
        covered[i : i + n] |= twice
    return int(covered.sum())


def document_metrics(text: str) -> tuple[int, int, int, int, int]:
    """The values of ``METRICS`` for one text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    letters = np.frombuffer(data.translate(None, _WHITE), np.uint8)
    lines = Counter(line for line in data.split(b"\n") if line.strip(_WHITE))
    return (
        len(words),
        int(((letters & 0xC0) != 0x80).sum()),
        len(data) - len(data.translate(None, _SYMBOLS)),
        sum(lines.values()) - len(lines),
        repeated_words(words),
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [document_metrics(t.as_py() or "") for t in batch.column("text")]
        columns = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(METRICS))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), batch.column("text_key"), batch.column("lines"), *columns], ["doc_id", "host", "text_key", "lines", *METRICS])


def normalised_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


def _lines(text: Column) -> Column:
    """The lines with a letter or digit: hash of the normalised line, and its words."""
    lines = F.filter(F.transform(F.split(text, "\n"), normalised_line), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("line"), (F.length(x) - F.length(F.replace(x, F.lit(" "))) + 1).alias("words")))


def quality_rules(
    docs: DataFrame,
    *,
    host: str = "source",
    max_docs: int = 10,
    max_removed: float = 0.5,
    min_words: int = 50,
    max_repeated: float = 0.5,
) -> DataFrame:
    """``doc_id``, the metrics, words in removed lines, ``base_failed``, ``depleted`` and ``kept``, a row per document."""
    text = F.coalesce("text", F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.xxhash64(text).alias("text_key"), text.alias("text"))

    frequent = (
        slim.select("host", F.explode(F.array_distinct(F.transform(_lines(F.col("text")), lambda x: x["line"]))).alias("line"))
        .groupBy("host", "line")
        .count()
        .filter(F.col("count") > max_docs)
        .select(F.col("host").alias("f_host"), F.col("line").alias("f_line"))
    )
    measured = slim.withColumn("lines", _lines(F.col("text"))).mapInArrow(
        _measured,
        "doc_id long, host string, text_key long, lines array<struct<line:bigint,words:int>>, " + ", ".join(f"{m} long" for m in METRICS),
    )
    head = F.struct(*METRICS)
    exploded = measured.select("doc_id", "host", "text_key", head.alias("all"), F.posexplode_outer("lines").alias("pos", "item"))
    per_line = exploded.select(
        "doc_id", "host", "text_key",
        F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("all")).alias("head"),
        F.col("item.line").alias("line"), F.col("item.words").alias("words"),
    )
    hits = per_line.join(frequent, F.col("host").eqNullSafe(F.col("f_host")) & (F.col("line") == F.col("f_line")), "left")
    # Rows that are equal throughout share a key; `copies` brings each of them back.
    grouped = hits.groupBy("doc_id", "host", "text_key").agg(
        F.first("head", ignorenulls=True).alias("head"),
        F.count("head").alias("copies"),
        F.coalesce(F.sum(F.when(F.col("f_line").isNotNull(), F.col("words"))), F.lit(0)).alias("removed"),
        F.coalesce(F.sum("words"), F.lit(0)).alias("line_words"),
    )
    removed = (F.col("removed") / F.col("copies")).cast("long")
    each = grouped.select(
        "doc_id", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"), "head.*",
        removed.alias("removed_words"), (F.col("line_words") / F.col("copies")).cast("long").alias("line_words"),
    )
    base_failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > max_repeated * F.col("n_words"))
    depleted = (F.col("removed_words") > max_removed * F.col("line_words")) | ((F.col("removed_words") > 0) & (F.col("line_words") - F.col("removed_words") < min_words))
    return (
        each.withColumn("base_failed", base_failed)
        .withColumn("depleted", depleted)
        .withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
        .drop("_copy", "line_words")
    )
