"""The corpus pipeline: each stage reads what its predecessor kept and returns the documents it keeps.

language ID (rejects documents without a known language), MinHash near-dedup (one document of a group
stays), benchmark decontamination (documents with a hit go), PII (spans are replaced by their kind),
mixing to target weights (documents repeat by a Poisson draw, in shuffled order, with columns copy and
place; under copy_1, place_1, ... where documents have such columns). Between stages documents are written as
Parquet and read again. Every other column passes through unchanged, whatever its name. Of rows that
repeat id and text one stays, with null ids as well; different texts under one id are different documents. Null
and empty texts: language ID rejects them. An empty table gives an empty table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corpuslab.llm import decontam, langid, minhash, mixing, pii
from corpuslab.session import ensure_checkpoint_dir

NEAR = 80  # percent of shingles that near copies share


def _language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.reject_unknown(docs)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs, percent=NEAR)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def _redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs, pii.fit(docs))


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.replicate(docs, made=("copy", "place"))


STAGES = [("language_id", _language), ("near_dedup", _near_dedup), ("decontamination", _decontaminate), ("pii", _redact), ("mixing", _mix)]

ORACLE_SQL = None  # a trained network, trained trees and shingle components are not SQL: tested by brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
