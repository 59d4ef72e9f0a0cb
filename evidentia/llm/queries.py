"""One query for each operator of this folder over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import alignment, binpack, fingerprints, langid, licenses, linededup, mixing, packing, pii, quality, simhash, toxicity, wavelet
from evidentia.llm.common import table
from evidentia.llm.oracles import ORACLE_SQL  # noqa: F401  for the entry point


#: Target weights of the sources that differ from 1.
SOURCE_WEIGHTS = {"src0": 4, "src1": 2, "src2": 2}


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix_sources(docs, SOURCE_WEIGHTS)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), word_tokenizer())


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


#: The chain of op6: a condition on `labels` for each category, in order.
TOXICITY = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels"), TOXICITY)
    return toxicity.score_toxicity(docs, chain, list(TOXICITY))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit_languages(docs, ~langid.held_out())
    return langid.identify_languages(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binpack.pack_best_fit(table(spark, sf_dir, "documents"), word_tokenizer(), end_id=0, seq_len=2048)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align_and_count(table(spark, sf_dir, "documents"), a, b)


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_packing": op2_packing,
    "op3_fingerprints": op3_fingerprints,
    "op4_simhash": op4_simhash,
    "op5_licenses": op5_licenses,
    "op6_toxicity": op6_toxicity,
    "op7_language_id": op7_language_id,
    "op8_line_dedup": op8_line_dedup,
    "op9_pii": op9_pii,
    "op10_quality_rules": op10_quality_rules,
    "op11_lexical_search": op11_lexical_search,
    "op12_best_fit": op12_best_fit,
    "op13_alignment": op13_alignment,
}
