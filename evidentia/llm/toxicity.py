"""Toxicity by a chain of classifiers.

The categories are predicted one after another. Each has a logistic model over
the presence of words and over the probabilities of the categories before it;
in training those probabilities are out-of-fold predictions, so that a later
model sees earlier ones as wrong as they will be on new texts. The words are
those that best tell a category from the rest (chi-squared) in the sample.

The models learn from a sample of at most ``sample_rows`` labelled documents,
the first by a hash of their id; all documents are scored over their whole
texts. A null or empty text has no words and gets the models' base rates.
Without labelled rows all probabilities are 0 and nothing is flagged. Repeated
rows get equal results; null labels are left out. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.linear import logistic, margin, sigmoid

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


@dataclass
class Chain:
    categories: list[str]
    vocabulary: dict[str, int]
    weights: list[np.ndarray]

    def matrix(self, texts: list[set[str]]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.vocabulary)), np.float32)
        for row, words in zip(x, texts):
            row[[self.vocabulary[w] for w in words & self.vocabulary.keys()]] = 1
        return x

    def predict(self, x: np.ndarray) -> np.ndarray:
        """A column of probabilities for each category."""
        for w in self.weights:
            x = np.hstack([x, sigmoid(margin(x, w))[:, None].astype(np.float32)])
        return x[:, len(self.vocabulary) :]


def fit_chain(x: np.ndarray, labels: np.ndarray, fold: np.ndarray, ridge: float = 1e-5, folds: int = 4) -> list[np.ndarray]:
    """The weights of each category in turn; labels has a column for each."""
    out = []
    for y in labels.T:
        guess = np.full(len(x), y.mean(), np.float32)
        for k in range(folds):
            train, test = fold % folds != k, fold % folds == k
            if test.any() and train.any():
                guess[test] = sigmoid(margin(x[test], logistic(x[train], y[train], ridge)))
        out.append(logistic(x, y, ridge))
        x = np.hstack([x, guess[:, None]])
    return out


def train_toxicity(docs: DataFrame, labels: DataFrame, categories: dict[str, object], *, sample_rows: int = 10_000, vocabulary: int = 600, least_df: int = 5) -> Chain | None:
    """``categories`` maps a name to the condition on ``labels`` that makes a document one of it, in the order of the chain."""
    names = list(categories)
    flags = [F.expr(c).cast("int").alias(f"y{k}") for k, c in enumerate(categories.values())]
    chosen = (
        labels.filter(F.col("doc_id").isNotNull())
        .select("doc_id", *flags)
        .na.drop()
        .groupBy("doc_id")
        .agg(*(F.max(f"y{k}").alias(f"y{k}") for k in range(len(names))))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    # A document's row can be repeated: one of them will do.
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter("text IS NOT NULL")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)[^\W\d_]+"), F.lit(0)))
    sample = joined.select("doc_id", words.alias("words"), *(f"y{k}" for k in range(len(names)))).dropDuplicates(["doc_id"]).persist()
    try:
        totals = sample.agg(F.count("*").alias("n"), *(F.sum(f"y{k}").alias(f"y{k}") for k in range(len(names)))).first()
        n = totals["n"]
        if not n:
            return None
        counts = sample.select(F.explode("words").alias("w"), *(f"y{k}" for k in range(len(names)))).groupBy("w").agg(F.count("*").alias("df"), *(F.sum(f"y{k}").alias(f"y{k}") for k in range(len(names)))).filter(F.col("df") >= least_df)
        kept: set[str] = set()
        for k in range(len(names)):
            pos = totals[f"y{k}"]
            a, df = F.col(f"y{k}").cast("double"), F.col("df").cast("double")
            spread = F.greatest(df * (n - df) * pos * (n - pos), F.lit(1.0))
            chi = F.pow(a * n - df * pos, F.lit(2.0)) * n / spread
            kept.update(r["w"] for r in counts.orderBy(chi.desc(), "w").limit(vocabulary).collect())
        index = {w: i for i, w in enumerate(sorted(kept))}
        known = F.array(*map(F.lit, sorted(kept))) if kept else F.array().cast("array<string>")
        rows = sample.select("doc_id", F.array_intersect("words", known).alias("words"), *(f"y{k}" for k in range(len(names)))).toPandas().sort_values("doc_id")
    finally:
        sample.unpersist()
    chain = Chain(names, index, [])
    x = chain.matrix([set(w) for w in rows["words"]])
    y = rows[[f"y{k}" for k in range(len(names))]].to_numpy()
    fold = np.array([int(d) * 2654435761 >> 7 & 1023 for d in rows["doc_id"]])
    chain.weights = fit_chain(x, y, fold)
    return chain


def score_toxicity(docs: DataFrame, chain: Chain | None, categories: list[str], threshold: float = 0.5) -> DataFrame:
    """``doc_id``, a probability for each category and whether the last one is over ``threshold``."""
    schema = "doc_id long, " + ", ".join(f"p_{c} double" for c in categories) + f", is_{categories[-1]} boolean"
    names = ["doc_id", *(f"p_{c}" for c in categories), f"is_{categories[-1]}"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                if chain:
                    p = chain.predict(chain.matrix([words_of(t.as_py() or "") for t in part.column(1)]))
                else:
                    p = np.zeros((part.num_rows, len(categories)))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c.astype(float)) for c in p.T), pa.array(p[:, -1] > threshold)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, schema)
