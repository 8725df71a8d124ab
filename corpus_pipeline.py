"""Corpus pipeline: five of the training-data operators over ``documents``.

Every stage is (spark, docs, sf_dir) -> DataFrame, written as Parquet and read
again as the next stage's input; all but the last return the columns of
``documents`` and, in a filtering stage, the rows that it keeps.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actaflow.llm.decontam import clean_rows
from actaflow.llm.jaccard import one_of_each
from actaflow.llm.langid import keep_known_languages
from actaflow.llm.lines import dedup_lines
from actaflow.llm.mixing import mix_sources
from actaflow.llm.store import remove, shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter and those like no text of a known language go; ``lang`` is
    the predicted language of those that stay."""
    return keep_known_languages(docs.select(*COLUMNS)).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines go from the texts; a document that has nothing
    else goes as well, since each of its lines stays in another one."""
    found = dedup_lines(docs.select(*COLUMNS))
    left = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return found.filter(left | (F.col("_n_removed") == 0)).withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest doc_id;
    rows without an id or with a repeated one are told apart by their texts."""
    return one_of_each(docs.select(*COLUMNS)).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go, each row by its own text,
    whether its doc_id is null, repeated or neither."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return clean_rows(docs.select(*COLUMNS), benchmark).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the copies and words that the mix takes of it."""
    return mix_sources(docs.select(*COLUMNS)).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]

#: Model predictions and random rounding have no SQL; the tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return docs
