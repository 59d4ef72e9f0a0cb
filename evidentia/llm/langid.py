"""Hierarchical language identification.

Texts are hashed letter n-grams. One linear model per family, trained against
the rest, gives the family; within it one-versus-one linear support vector
machines vote on the language. ``score`` is the share of the family times the
mean probability of the winner's duels.

The models learn from a sample of labelled rows: ``sample_rows`` in all, the same
number of each of the ``most_languages`` most frequent languages, the first by a
hash of their id. So the driver holds one matrix of a fixed size; rarer languages
are not learnt. Every row is predicted from its whole text alone. A null text or
one without a letter is ``und`` with score 0, as is everything when no row can be
learnt from. One known language is predicted for all. Repeated rows get equal
results. Other columns are not read, and handed on only where they are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from evidentia.llm.common import fresh
from evidentia.llm.linear import margin, sigmoid, squared_hinge_svm

BITS = 12
SIZE = 1 << BITS

#: Families of languages by ISO 639-1 code. Others are families of their own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk",
    "uralic": "fi et hu",
    "sinitic": "zh yue wuu",
    "semitic": "ar he mt am",
    "indic": "hi ur bn mr pa gu ne",
    "turkic": "tr az kk uz tk",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def ngram_counts(text: str) -> np.ndarray:
    """Hashed counts of one to three consecutive UTF-8 bytes of the lower-cased text, its non-letters as blanks."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass") + b" ", np.uint8)
    data = np.where((data >= 97) & (data <= 122) | (data >= 128), data, 32).astype(np.uint32)
    data = data[np.append(True, (data[1:] != 32) | (data[:-1] != 32))]  # runs of blanks as one
    pairs = data[:-1] * 257 + data[1:]
    triples = pairs[:-1] * 257 + data[2:]
    out = np.zeros(SIZE, np.int64)
    for k, grams in enumerate((data, pairs, triples)):
        out += np.bincount(((grams + k) * np.uint32(2654435761)) >> np.uint32(32 - BITS), minlength=SIZE)
    return out


def features(counts: np.ndarray) -> np.ndarray:
    """Square roots of the shares of the n-grams: unit length."""
    counts = np.atleast_2d(counts).astype(np.float32)
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))


@dataclass
class Model:
    languages: list[list[str]]  # by family
    family: np.ndarray  # a row of weights for each family
    duels: dict[tuple[str, str], np.ndarray]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        z = x @ self.family[:, :-1].T + self.family[:, -1]
        share = np.exp(4 * (z - z.max(axis=1, keepdims=True)))
        share /= share.sum(axis=1, keepdims=True)
        best = z.argmax(axis=1)
        out = np.empty(len(x), object)
        score = share[np.arange(len(x)), best].astype(float)
        for f, names in enumerate(self.languages):
            rows = np.flatnonzero(best == f)
            if not len(rows):
                continue
            votes = np.zeros((len(rows), len(names)))
            for (a, b), w in self.duels.items():
                if a in names:
                    p = sigmoid(4 * margin(x[rows], w))
                    votes[:, names.index(a)] += p
                    votes[:, names.index(b)] += 1 - p
            win = votes.argmax(axis=1)
            out[rows] = np.array(names, object)[win]
            if len(names) > 1:
                score[rows] *= votes[np.arange(len(rows)), win] / (len(names) - 1)
        return list(out), score


def train(x: np.ndarray, lang: np.ndarray, ridge: float = 1e-4) -> Model | None:
    names = sorted(set(lang))
    if not names:
        return None
    groups: dict[str, list[str]] = {}
    for name in names:
        groups.setdefault(FAMILY_OF.get(name, name), []).append(name)
    families = [groups[k] for k in sorted(groups)]
    if len(families) == 1:
        weights = np.zeros((1, SIZE + 1), np.float32)
    else:
        weights = np.stack([squared_hinge_svm(x, np.where(np.isin(lang, f), 1, -1), ridge) for f in families])
    duels = {}
    for f in families:
        for a, b in combinations(f, 2):
            duels[a, b] = squared_hinge_svm(x, (lang == a).astype(int) - (lang == b), ridge)
    return Model(families, weights, duels)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, order, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if has_letter(text := text.as_py()):
                counts = ngram_counts(text)
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([order]), pa.array([at.astype(np.int32)]), pa.array([counts[at].astype(np.int32)])], ["lang", "order", "at", "n"])


def fit_languages(docs: DataFrame, usable: Column, *, sample_rows: int = 4000, most_languages: int = 64) -> Model | None:
    """A model from the rows where ``usable`` holds, ``lang`` is there and the text is not null.

    Of each language the sample has the smallest of a hash of id and text. A
    bound on the hash, from the counts, first leaves about twice as many rows, so
    the ranking never sees a whole language.
    """
    spark = docs.sparkSession
    order = F.xxhash64(F.col("doc_id"), F.col("text"))
    known = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), order.alias("order"), "text")
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    if not counts:
        return None
    each = max(1, sample_rows // len(counts))
    bounds = [(r["lang"], int(-(2**63) + min(1.0, (2 * each + 200) / r["count"]) * (2**64 - 2**12))) for r in counts]
    near = known.join(F.broadcast(spark.createDataFrame(bounds, "lang string, bound long")), "lang").filter("order <= bound").drop("bound")
    first = Window.partitionBy("lang").orderBy("order")
    chosen = near.select("lang", "order").withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= each).select("lang", "order").distinct()
    # At most sample_rows rows; copies of a row have one order and count once.
    sample = near.join(F.broadcast(chosen), ["lang", "order"], "left_semi").mapInArrow(_counted, "lang string, order long, at array<int>, n array<int>").dropDuplicates(["lang", "order"]).toArrow()
    sample = sample.sort_by([("lang", "ascending"), ("order", "ascending")])
    x = np.zeros((sample.num_rows, SIZE), np.float32)
    for row, at, n in zip(x, sample["at"], sample["n"]):
        values = n.values.to_numpy()
        row[at.values.to_numpy()] = np.sqrt(values / values.sum())
    lang = np.array(sample["lang"].to_pylist(), object)
    del sample
    return train(x, lang)


def identify_languages(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, ``lang_pred`` and ``score``, a row per document; where ``keep`` has such a name, ours gets underscores."""
    kept = docs.select(*keep, F.col("text").alias("_text"))
    lang_pred, score_ = fresh(docs.select(*keep), "lang_pred", "score")
    schema = StructType([*kept.schema.fields[:-1], StructField(lang_pred, StringType()), StructField(score_, DoubleType())])
    names = [*keep, lang_pred, score_]

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                lang, score = ["und"] * part.num_rows, np.zeros(part.num_rows)
                counts, rows = [], []
                for i, text in enumerate(part.column(part.num_columns - 1)):
                    if model and has_letter(text := text.as_py()):
                        counts.append(ngram_counts(text).astype(np.int32))
                        rows.append(i)
                if rows:
                    names_, values = model.predict(features(np.stack(counts)))
                    for i, name, value in zip(rows, names_, values):
                        lang[i], score[i] = name, value
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1))], names)

    return kept.mapInArrow(predicted, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept from training; a null id is."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))
