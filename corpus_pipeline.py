"""Corpus pipeline: five stages over `documents`, each by one operator of keyloom.llm.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; run()
writes it as Parquet and rereads it as the next stage's docs.  All but the last return the columns of docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from keyloom.llm import line_dedup, near_dup, packing, quality_rules, resampling
from keyloom.llm.tables import folder, read, remove


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling does not sample go; as many stay as the labels' share of good ones says."""
    return resampling.resample(docs, read(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines similar to an earlier line go, and documents that keep no line with a word."""
    return line_dedup.remove_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return near_dup.deduplicate(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of tokens."""
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality), ("quality_classifier", classifier), ("line_dedup", lines), ("near_dup", near_duplicates), ("packing", sequences)]

#: No stage but the first could be written in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  What a stage has written is removed once the next one's output is there; the last output stays in
    the shared folder, for the caller to read."""
    docs, at, before = read(spark, sf_dir, "documents"), f"{folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for number, (name, stage) in enumerate(STAGES):
        path = f"{at}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
