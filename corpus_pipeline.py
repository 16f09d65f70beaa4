"""The corpus pipeline: raw documents to token ids, in five stages.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; what it returns is written
as Parquet and read again as the next one's ``docs``.  All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import decontaminate, jaccard, language, pieces, secrets
from veilspark.llm.common import lean, stored


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose text is in none of the languages, go."""
    lean(spark)
    return language.understood(docs, "text", "lang", "source")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    lean(spark)
    return jaccard.representatives(docs, "doc_id", "text")


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    lean(spark)
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "text")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, and n_chars follows the text; every document stays."""
    lean(spark)
    out = secrets.redacted(docs, "text")
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with whether they decode to its text."""
    lean(spark)
    return pieces.encode(docs.select("doc_id", "lang", "source", "text"), "text").drop("text")


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", deduplicate),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("secret_scan", redact_secrets),
    ("sentencepiece", encode_pieces),
]

#: Learned language models, vocabularies and transitive links have no form in SQL; tests/llm holds a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
