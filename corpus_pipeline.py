"""The corpus pipeline: documents to packed sequences, each stage over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import crf_language, packing, pii, signature_tree, suffix_decontamination
from pulsegrid.llm.common import set_aside, written

#: Words of a shingle and the similarity, in percent, from which documents are near copies.
COPY_WORDS, COPY_PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters, null and empty ones too, and those that no learned language fits. Without
    any labelled document there is no language to fit, and only the former go."""
    model = crf_language.fit(docs)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    docs, own = set_aside(docs, ("lang_pred", "score", "fits"))
    scored = crf_language.with_languages(docs, model)
    return scored.where((F.col("lang_pred") != crf_language.UNKNOWN) & F.col("fits")).select(*own)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id."""
    return signature_tree.keep_one(docs, words=COPY_WORDS, percent=COPY_PERCENT)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null and empty texts hold none and stay."""
    return suffix_decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and words that disclose it, give way to their kind in brackets; every document stays, null
    texts null and empty ones empty."""
    return pii.sanitise(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their token ids, placed in sequences; a null or empty text is its end id alone."""
    return packing.pack(docs, keep_ids=True)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontaminated),
    ("PII", sanitised),
    ("best-fit packing", packed),
]

#: Learned models, components and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
