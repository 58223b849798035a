"""A training corpus from raw documents: five stages, each written to the shared folder and read again by the next.

Defined results, for every stage: a null text is an empty one; nulls in other columns stay and are values of their own;
repeated rows are judged alike, and of them one stays after near_dedup; long texts are read whole; an empty table gives
an empty one; further columns, whatever their names, pass to the last stage, which leaves out all but doc_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import mixing, packing, pii, quality, simhash
from rankloom.llm._shared import scratch, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie beyond a fence of their language and source go; those without words too."""
    return quality.filtered(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least doc_id; shingles of five words.

    Rows without an identifier stay once for each text, unless their group has one."""
    return simhash.dedup(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each span of personal data becomes its kind in angle brackets."""
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document."""
    return mixing.sampled(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece in sequences of at most 1024 tokens."""
    return packing.packed(packing.pieces(docs.select("doc_id", "text"), packing.vocabulary("byte_bpe_50k.json")))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: Neither fingerprints nor packing can be written in SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        at = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
