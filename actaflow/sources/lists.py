"""Readers and writers of small side tables: watchlists, tokens, noise, word lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actaflow.functions.text import name_key, plain
from actaflow.operators.tables import first_by

WATCHLIST = ("group", "name", "address", "city", "status", "purpose", "activity", "sheet", "province", "capital", "incorporated", "head", "joined")


def read_watchlist(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, of which only ``name`` must be there; blanks are null, the group
    defaults to the name, and the first row of a name key wins.  A value that can't be read
    as its type is an error."""
    lines = spark.read.option("header", True).option("encoding", "UTF-8").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    lines = lines.toDF(*[c.lstrip("﻿").strip() for c in lines.columns])
    if "name" not in lines.columns:
        raise ValueError("a watchlist needs a name column")
    text = {c: (F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) if c in lines.columns else F.lit(None).cast("string")) for c in WATCHLIST}

    def typed(c: str, kind: str):
        read = text[c].try_cast(kind)
        return F.when(text[c].isNotNull() & read.isNull(), F.raise_error(F.concat(F.lit(f"bad {c}: "), text[c])).cast(kind)).otherwise(read)

    year = F.when(text["joined"].isNotNull() & ~text["joined"].rlike("^[0-9]{4}$"), F.raise_error(F.concat(F.lit("bad joined: "), text["joined"])).cast("int")).otherwise(text["joined"].cast("int"))
    rows = lines.withColumn("_line", F.monotonically_increasing_id()).select(
        "_line", text["name"].alias("name"), F.coalesce(text["group"], text["name"]).alias("group"), *[text[c].alias(c) for c in ("address", "city", "status", "purpose", "activity", "sheet", "province")],
        typed("capital", "decimal(18,2)").alias("capital"), typed("incorporated", "date").alias("incorporated"),
        F.coalesce(F.lower(text["head"]).isin("1", "yes", "true"), F.lit(False)).alias("head"), year.alias("joined"), name_key(text["name"]).alias("name_key"),
    )
    return first_by(rows.filter("name is not null"), ["name_key"], ["_line"]).drop("_line")


def read_tokens(spark: SparkSession, path: str, groups: DataFrame | None = None) -> DataFrame:
    """(token, group_id) of an approved file {token: group}; with ``groups`` (group_id,
    label) labels become ids, and an unknown one is an error."""
    pairs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("token", "group"))
    pairs = pairs.select(plain(F.col("token")).alias("token"), "group")
    if groups is None:
        return pairs
    found = pairs.join(groups.select(F.col("label").alias("group"), "group_id"), "group", "left")
    return found.select("token", F.when(F.col("group_id").isNull(), F.raise_error(F.concat(F.lit("unknown group: "), F.col("group"))).cast("long")).otherwise(F.col("group_id")).alias("group_id"))


def read_noise(spark: SparkSession, path: str) -> DataFrame:
    """(label, n) of a file {label: count}."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,bigint>")).alias("label", "n"))


def read_precisions(spark: SparkSession, path: str, truth: str = "relations_or_shared_officers") -> dict[str, float]:
    """The precision of each signal from an evaluation; one that it doesn't rate counts by
    its place in the order of signals."""
    from actaflow.functions.catalogue import SIGNALS

    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json(F.get_json_object("value", "$.signals"), "array<struct<truth:string,reason:string,precision:double>>")).alias("s")).select("s.*")
    rated = {r["reason"]: r["precision"] for r in rows.filter((F.coalesce("truth", F.lit(truth)) == truth) & F.col("precision").isNotNull()).collect()}
    return {s: rated.get(s, 1 / i) for i, s in enumerate(SIGNALS, 1)}


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """(word, second): the first two words of each line; ``#`` starts a comment."""
    w = spark.read.text(path).select(F.split(F.trim(F.regexp_replace("value", "#.*$", "")), r"\s+").alias("w"))
    return w.select(F.get("w", F.lit(0)).alias("word"), F.get("w", F.lit(1)).alias("second")).filter("word <> ''")


def write_words(words: DataFrame, path: str, rule: str) -> None:
    """A word list with the rule it was made by on top."""
    top = words.sparkSession.range(1).select(F.lit(f"# {rule}").alias("value"))
    top.unionByName(words.select(F.col("word").alias("value")).orderBy("value")).coalesce(1).write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, by: str | None = None) -> None:
    """Parquet, replaced; with ``by``, only the partitions that ``df`` has are replaced."""
    w = df.write.mode("overwrite")
    if by is not None:
        w = w.partitionBy(by).option("partitionOverwriteMode", "dynamic")
    w.parquet(path)
