"""From raw documents to packed training sequences, one operator a stage.

Each stage takes what the one before kept, as a table of documents, and all but
the last return the columns of documents; the mix adds each one's position.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import langid, linededup, mixing, neardup, packing
from evidentia.llm.common import shared_folder
from evidentia.llm.queries import SOURCE_WEIGHTS, word_tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that could be told; ``lang`` becomes the predicted one.

    Null and empty texts and those without a letter go. Where no row says its
    language, there is nothing to learn from: then only these go, and ``lang``
    stays null. Repeated rows stay as they are; an empty table gives no rows.
    """
    model = langid.fit_languages(docs, ~langid.held_out())
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}")).select(COLUMNS)
    found = langid.identify_languages(docs.select(COLUMNS), model, tuple(COLUMNS))
    return found.filter(F.col("lang_pred") != "und").withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand elsewhere already; those with no word left go.

    Null and empty texts have no word. Of repeated rows one keeps its lines. Ties go by
    id, then by text and place; an empty table gives no rows.
    """
    less = linededup.dedup_lines(docs.select(COLUMNS))
    return less.filter(F.col("text").rlike(r"[\p{L}\p{N}]")).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles resemble each other by 0.8 or more.

    It is that of the smallest id, and one row of it. Texts without words, null ones
    too, are one group. An empty table gives no rows.
    """
    return neardup.one_of_each(docs.select(COLUMNS), width=5)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ``position`` in the mix, which files do not keep.

    A weight says how often a source has its turn while it lasts: once it is out, the
    others share its turns by their weights, and no document is left out or repeated.
    A null source is one of its own; an empty table gives no rows.
    """
    return mixing.mix_sources(docs.select(COLUMNS), SOURCE_WEIGHTS).select(*COLUMNS, "position")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences, which are numbered in the order of the mix.

    A null or empty text is its end mark alone. An empty table gives no rows.
    """
    mixed = docs.repartitionByRange("position").sortWithinPartitions("position")
    return packing.pack_documents(mixed, word_tokenizer(), keep_order=True)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("pack", pack),
]

#: Trained models, edit distances and tokenizers have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the others keep is written to the shared folder and read again."""
    folder = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{uuid.uuid4()}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
