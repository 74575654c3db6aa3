"""The corpus pipeline over `documents`: each stage reads what the one before has kept, all but the last give its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tocsin.llm.common import TABLES, free_name, swept, table, written
from tocsin.llm.decontaminate import contamination
from tocsin.llm.jaccard import deduplicated
from tocsin.llm.language import identify
from tocsin.llm.pieces import sentencepiece_ids
from tocsin.llm.pii import redact


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without text (null or empty) or any letter go. Repeated rows and very long texts are
    treated like others; an empty table stays empty."""
    name = free_name(docs, "_language")
    return identify(docs, name=name).filter(F.col(f"{name}.lang") != "und").select(*docs.columns)


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id, nulls last; of rows that repeat id and text one. Rows of one id with
    other texts are rows of their own; texts without words have no copies. Very long texts are
    compared whole. An empty table stays empty."""
    return deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs. Null texts have none and stay; so do all rows where the benchmark is empty.
    Repeated rows are judged alike; very long texts are searched whole; an empty table stays empty."""
    name = free_name(docs, "_contamination")
    found = contamination(docs, table(spark, sf_dir, "benchmark"), name=name)
    return found.filter(F.size(f"{name}.hits") == 0).select(*docs.columns)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars is counted anew. Null texts stay null; repeated rows stay.
    Very long texts are read whole; an empty table stays empty."""
    out = redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, restored and ids of every document; null texts have no ids. Repeated rows have equal
    results; very long texts are coded whole; an empty table stays empty."""
    return sentencepiece_ids(docs.select("doc_id", "text")).select("doc_id", "pieces.*")


STAGES = [
    ("language", language_stage),
    ("duplicates", duplicates_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("tokens", token_stage),
]

#: Language ID, and the merges of BPE, have no SQL form; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what each stage gives is written as Parquet before the next reads it."""
    docs, others = table(spark, sf_dir, "documents"), set(TABLES)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        swept(spark, others, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
