"""Queries of the training-data operators, as __spark_entry__.py registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actaflow.llm.chat import CHAT_SQL, format_chats
from actaflow.llm.decontam import decontaminate
from actaflow.llm.extract import EXTRACT_SQL, extract_text
from actaflow.llm.fim import FIM_SQL, fill_in_middle, restore_texts
from actaflow.llm.jaccard import JACCARD_SQL, jaccard_components
from actaflow.llm.langid import identify_languages
from actaflow.llm.lines import LINE_DEDUP_SQL, dedup_lines
from actaflow.llm.mixing import mix_sources
from actaflow.llm.negatives import NEGATIVES_SQL, hard_negatives
from actaflow.llm.quality import QUALITY_SQL, quality_rules
from actaflow.llm.substrings import SUBSTRING_SQL, substring_dedup
from actaflow.llm.urls import RULES_SQL, URL_FILTER_SQL, url_filter
from actaflow.llm.warc import ARCHIVE_SQL, archive_pages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(_table(spark, sf_dir, "pages"), spark.sql(RULES_SQL))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(_table(spark, sf_dir, "conversations"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    kept = F.sha2(F.coalesce("text", F.lit("")), 256)
    return found.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), kept.alias("kept_sha256"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(_table(spark, sf_dir, "pages"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = restore_texts(fill_in_middle(_table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op12_extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(_table(spark, sf_dir, "embeddings"), relabel="case when vec_id % 7 = 0 then (label + 1) % 10 else label end")


QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_url_filter": op2_url_filter,
    "op3_mix_sources": op3_mix_sources,
    "op4_chat_format": op4_chat_format,
    "op5_language_id": op5_language_id,
    "op6_quality_rules": op6_quality_rules,
    "op7_line_dedup": op7_line_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_warc_archive": op9_warc_archive,
    "op10_decontaminate": op10_decontaminate,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_extract_text": op12_extract_text,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op1_jaccard_join": JACCARD_SQL,
    "op2_url_filter": URL_FILTER_SQL,
    "op4_chat_format": CHAT_SQL,
    "op6_quality_rules": QUALITY_SQL,
    "op7_line_dedup": LINE_DEDUP_SQL,
    "op8_substring_dedup": SUBSTRING_SQL,
    "op9_warc_archive": ARCHIVE_SQL,
    "op11_fill_in_middle": FIM_SQL,
    "op12_extract_text": EXTRACT_SQL,
    "op13_hard_negatives": NEGATIVES_SQL,
}
