"""A training corpus, from raw documents to a mix: five operators in a row.

Every stage takes (spark, docs, sf_dir), works on all documents that the stage
before it kept, and returns the columns of `documents` (the last one returns the
mix). `run` writes what each stage returns and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.decontaminate import find_leaks
from millrace.llm.jaccard_join import keep_one_of_each
from millrace.llm.mixing import mix_sources
from millrace.llm.quality_rules import document_counts, mark_outliers
from millrace.llm.secrets import redact_secrets, train_secret_grammar
from millrace.llm.work import row_key, stored, without


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their group's estimate reject go.

    A verdict holds for its row, not for others of the same doc_id or of none.
    """
    keyed = docs.withColumn("_row", row_key(docs))
    judged = mark_outliers(document_counts(keyed, "doc_id", "lang", "source", "_row"))
    return without(keyed, judged.where("NOT kept"), "pipeline-rejected", key="_row").drop("_row")


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document of the least doc_id stays.

    Near copies share four fifths of their five-word shingles.
    """
    return keep_one_of_each(docs, size=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a test item is found go, each by its own row."""
    keyed = docs.withColumn("_row", row_key(docs))
    leaks = find_leaks(keyed.select(F.col("_row").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(keyed, leaks.select(F.col("doc_id").alias("_row")), "pipeline-leaks", key="_row").drop("_row")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are masked; every document stays."""
    masked = redact_secrets(docs, train_secret_grammar(docs))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document."""
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scan", secret_scan),
    ("mixing", mix),
]

#: Estimates, automata and hashed draws cannot be put into SQL; tests hold the
#: stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
