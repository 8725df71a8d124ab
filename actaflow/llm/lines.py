"""Line dedup by distinct-site spread.

Each line hash carries a HyperLogLog sketch of the sites (sources) that have it;
sketches merge by aggregation.  A line whose estimate is clearly at or above the
threshold is boilerplate, one clearly below is not, and one near it gets an
exact distinct count, so the outcome does not depend on the sketch's error.
A boilerplate line stays in the document with the smallest doc_id that has it
and goes from all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actaflow.llm.store import checkpoint

MIN_SITES = 10
LG_K = 10
#: Relative distance from the threshold within which sites are counted exactly
#: (over six standard errors of a sketch of 2**LG_K registers).
NEAR = 0.25
#: Boilerplate lines that may be broadcast (about 40 bytes each); beyond, the join shuffles.
MAX_BROADCAST = 200_000
_BLANKS = " \t\x0b\x0c\r"


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANKS))


def _text_keys(text: Column) -> list[Column]:
    """Two hashes that tell texts apart, as rows may share a doc_id or have none."""
    return [F.xxhash64(text).alias("t"), F.xxhash64(text, F.lit(1)).alias("t2")]


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, source, t, t2, at, h, h2): every line with a character, its place in the
    text, the keys of the text and those of the line."""
    texts = docs.select("doc_id", "source", *_text_keys(F.col("text")), "text")
    lines = texts.select("doc_id", "source", "t", "t2", F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).withColumn("line", _bare(F.col("line")))
    return lines.filter("line <> ''").select("doc_id", "source", "t", "t2", "at", F.xxhash64("line").alias("h"), F.xxhash64("line", F.lit(1)).alias("h2"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(h, h2, first): lines of at least ``min_sites`` distinct sites; null is no site."""
    lines = _lines(docs)
    spread = lines.groupBy("h", "h2").agg(F.hll_sketch_agg("source", F.lit(LG_K)).alias("sketch"), F.min("doc_id").alias("first"))
    spread = spread.select("h", "h2", "first", F.hll_sketch_estimate("sketch").alias("sites")).filter(F.col("sites") >= min_sites * (1 - NEAR))
    spread = checkpoint(spread)
    near = spread.filter(F.col("sites") <= min_sites * (1 + NEAR))
    small = F.broadcast if spread.count() <= max_broadcast else lambda df: df
    pairs = lines.join(small(near.select("h", "h2")), ["h", "h2"], "left_semi").filter("source is not null").groupBy("h", "h2", "source").agg(F.lit(1).alias("one"))
    exact = pairs.groupBy("h", "h2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_sites).select("h", "h2")
    sure = spread.filter(F.col("sites") > min_sites * (1 + NEAR)).select("h", "h2", "first")
    return sure.unionByName(near.join(exact, ["h", "h2"]).select("h", "h2", "first"))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """All columns of ``docs`` with the cleaned ``text``, and n_lines and n_removed
    (named ``_n_lines`` and ``_n_removed``; columns of ``docs`` with these names are replaced).

    Lines are split at ``\\n`` and compared without blanks at their ends; lines
    without a character never count.  A null text stays null with 0 lines.  Rows
    that share a doc_id are cleaned alike; a null doc_id is never the first.  An empty
    table gives no rows.

    Every line is joined by itself; a text gets back the places of the lines that it
    loses, so the work for a text is linear in its lines however many of them go, and
    rows without a doc_id meet by their texts alone.
    """
    docs = docs.drop("_n_lines", "_n_removed")
    plain = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    found = checkpoint(boilerplate(plain, min_sites, max_broadcast))
    small = F.broadcast if found.count() <= max_broadcast else lambda df: df
    hits = _lines(plain).join(small(found), ["h", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("first")))
    # the places of equal rows are the same
    gone = hits.groupBy(F.col("doc_id").alias("_doc"), F.col("t").alias("_t"), F.col("t2").alias("_t2")).agg(F.collect_set("at").alias("_gone"))
    # columns get names of their own while the two tables are joined
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.toDF(*names.values())
    doc_id, text = F.col(names["doc_id"]), F.col(names["text"]).cast("string")
    t, t2 = _text_keys(text)
    joined = rows.join(gone, doc_id.eqNullSafe(F.col("_doc")) & (t == F.col("_t")) & (t2 == F.col("_t2")), "left")

    def kept(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
        return F.transform(stay, lambda i: F.get(lines, i))

    # the lambda splits a text once for all of its lines
    cleaned = F.get(F.transform(F.array(F.split(text, "\n", -1)), lambda lines: F.array_join(kept(lines), "\n")), F.lit(0))
    n_lines = F.coalesce(F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    n_removed = F.when(F.col("_gone").isNull(), F.lit(0)).otherwise(F.size("_gone")).cast("long")
    columns = [F.when(F.col("_gone").isNull(), text).otherwise(cleaned) if c == "text" else F.col(n) for c, n in names.items()]
    return joined.select(*columns, n_lines, n_removed).toDF(*docs.columns, "_n_lines", "_n_removed")


LINE_DEDUP_SQL = f"""
WITH l AS (
  SELECT doc_id, source, i, line, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS key
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
),
b AS (SELECT key, min(doc_id) AS first FROM l WHERE key <> '' GROUP BY key HAVING count(DISTINCT source) >= {MIN_SITES}),
k AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE b.key IS NOT NULL AND first <> doc_id) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE b.key IS NULL OR first = doc_id), '') AS kept
  FROM l LEFT JOIN b ON l.key = b.key GROUP BY doc_id
)
SELECT doc_id, n_lines, n_removed, sha256(kept) AS kept_sha256 FROM k
"""
