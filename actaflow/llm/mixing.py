"""Mixing sources to target weights by pivotal dependent rounding.

A source's target divided by its size is the number of copies that each of its
documents should have.  The whole part is given outright; the fractional parts
are rounded together: two documents with fractional probabilities ``p``, ``q``
and sizes ``a``, ``b`` exchange mass so that ``a*p + b*q`` stays the same and one
of them becomes integral, the direction being drawn so that each probability
keeps its expectation.  A block of documents ends with at most one fractional
document per source; these residuals meet again, level by level, until one per
source is left, which is rounded by a draw.  The taken words of a source hence
differ from its target by less than one document.

Documents are dealt to blocks by a hash, whatever their source, so a source with a
third of all rows is spread over as many tasks as any other.  From the second level
on a block is of a few sources (by their hash) and of FAN_IN blocks of the level
before, so that its rows are bounded however many sources there are.  Rows that are
equal in every respect are one row with their number, of which all but one are
rounded by arithmetic alone.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actaflow.llm.store import checkpoint

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MAX_COPIES = 2
BLOCK_ROWS = 1000
FAN_IN = 40
#: Sources whose targets may be broadcast (about 100 bytes each); beyond, the join shuffles.
MAX_BROADCAST = 10_000
#: Equal rows that one row of the reduction unfolds to at once.
UNFOLD = 1000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _with_place(sources: DataFrame) -> DataFrame:
    """``sources`` with ``place``: 0, 1, ... by code point, null last.  Each partition of a
    sorted table counts its own rows; only the partitions' sizes meet."""
    ordered = sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    # an id holds the partition in its upper bits and the row's place in its lower 33
    ordered = checkpoint(ordered.withColumn("_id", F.monotonically_increasing_id()))
    part, at = F.shiftright("_id", 33).cast("int"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    begin, before = [F.lit(0).cast("long")], 0
    sizes = {r["part"]: r["n"] for r in ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    for k in range(max(sizes, default=0)):
        before += sizes.get(k, 0)
        begin.append(F.lit(before))
    return ordered.withColumn("place", F.element_at(F.array(*begin), part + 1) + at).drop("_id")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share_percent: int = SHARE_PERCENT, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, size) rows.

    A target is the level times the weight, or the cap if that is less.  Newton's steps
    find the level at which the targets sum up to the share: each is one aggregation
    over the sources and puts those above their caps at them, until no more are.
    """
    by_source = _with_place(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    t = by_source.select("source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * max_copies).alias("cap"))
    total = t.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"]
    level, free = 0.0, None
    while True:
        over = F.col("cap") < F.lit(level) * F.col("weight")
        caps, weighed = t.agg(F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
        if weighed == free or not weighed:
            break
        level, free = (total * share_percent / 100.0 - caps) / weighed, weighed
    return t.select("source", "source_size", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def _draw(seed: int, *parts) -> float:
    return xxhash.xxh3_64_intdigest(repr(parts).encode(), seed=seed) / 2.0**64


def _settle(batch: pa.Table, seed: int, level: int, last: bool) -> pa.Table:
    """Pivotal rounding within one block, source by source, in the order of the keys."""
    rows = sorted(batch.to_pylist(), key=lambda r: (r["source"] is None, r["source"] or "", r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["digest"]))
    held: dict = {}
    for r in rows:
        if r["settled"]:
            continue
        if r["p"] <= 1e-9 or r["p"] >= 1 - 1e-9 or r["size"] == 0:
            r["p"], r["settled"] = float(round(r["p"])), True
            continue
        other = held.get(r["source"])
        if other is None:
            held[r["source"]] = r
            continue
        a, b, p, q = other["size"], r["size"], other["p"], r["p"]
        up = min((1 - p) * a, q * b)  # mass that may move to the first
        down = min(p * a, (1 - q) * b)  # mass that may move to the second
        if _draw(seed, level, other["doc_id"], other["digest"], r["doc_id"], r["digest"]) * (up + down) < down:
            other["p"], r["p"] = p + up / a, q - up / b
        else:
            other["p"], r["p"] = p - down / a, q + down / b
        held[r["source"]] = None
        for x in (other, r):
            if x["p"] <= 1e-9 or x["p"] >= 1 - 1e-9:
                x["p"], x["settled"] = float(round(x["p"])), True
            else:
                held[r["source"]] = x
    if last:
        for r in held.values():
            if r is not None and not r["settled"]:
                r["p"], r["settled"] = float(_draw(seed, "last", r["source"], r["doc_id"], r["digest"]) < r["p"]), True
    return pa.Table.from_pylist(rows, schema=batch.schema)


_COLUMNS = "doc_id long, source string, size long, digest long, n_rows long, source_size long, target double, whole long, sure long, p double, settled boolean, block long"


def _level(rows: DataFrame, seed: int, level: int, last: bool, keys: list[str]) -> DataFrame:
    def fn(table: pa.Table) -> pa.Table:
        return _settle(table, seed, level, last)

    return rows.groupBy(*keys).applyInArrow(fn, rows.schema)


def mix_sources(
    docs: DataFrame, seed: int = 7, weights: tuple = WEIGHTS, share_percent: int = SHARE_PERCENT, max_copies: int = MAX_COPIES, block_rows: int = BLOCK_ROWS, max_broadcast: int = MAX_BROADCAST
) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, source: one row for each input row.

    Documents without words take nothing; a null source is a source of its own,
    the last in order; an empty table gives no rows.  Of equal rows (id, source, size
    and text) any may be the one that takes a copy more.  Reruns agree, since every
    draw is a hash of the seed and the documents that it is about.  Columns other than
    doc_id, source and text are not read.
    """
    digest = F.when(F.col("text").isNotNull(), F.xxhash64("text", F.lit(seed)))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), F.coalesce(digest, F.lit(0)).alias("digest"))
    sized = checkpoint(sized.groupBy("doc_id", "source", "size", "digest").agg(F.count(F.lit(1)).alias("n_rows")))
    targets = checkpoint(source_targets(sized.select("source", (F.col("size") * F.col("n_rows")).alias("size")), weights, share_percent, max_copies))
    n_sources, n = targets.count(), sized.count()
    x = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    blocks = max(1, -(-n // block_rows))
    rows = (
        sized.join(F.broadcast(targets) if n_sources <= max_broadcast else targets, sized["source"].eqNullSafe(targets["source"]))
        .drop(targets["source"])
        .withColumn("whole", F.floor(x + 1e-12).cast("long"))
        .withColumn("_part", F.greatest(x - F.col("whole"), F.lit(0.0)) * F.col("n_rows"))
        .withColumn("sure", F.floor(F.col("_part") + 1e-9).cast("long"))
        .withColumn("p", F.greatest(F.col("_part") - F.col("sure"), F.lit(0.0)))
        .withColumn("settled", F.lit(False))
        .withColumn("block", F.pmod(F.xxhash64("doc_id", "size", "digest"), F.lit(blocks)))
        .select(*[c.split()[0] for c in _COLUMNS.split(", ")])
    )
    out = checkpoint(_level(rows, seed, 0, blocks == 1, ["block"]))
    done, level = [out.filter("settled")], 0
    # later levels: of few sources and of FAN_IN blocks each, so of bounded size
    shares = F.pmod(F.xxhash64("source"), F.lit(max(1, -(-n_sources * FAN_IN // block_rows))))
    while blocks > 1:
        blocks, level = -(-blocks // FAN_IN), level + 1
        left = out.filter("not settled").withColumn("block", F.floor(F.col("block") / FAN_IN).cast("long")).withColumn("share", shares)
        out = checkpoint(_level(left, seed, level, blocks == 1, ["block", "share"]).drop("share"))
        done.append(out.filter("settled"))
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    # equal rows unfold in bounded steps
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_rows") - 1, F.lit(UNFOLD).cast("long")))
    unfolded = result.withColumn("_from", chunk).withColumn("_nth", F.explode(F.sequence(F.col("_from"), F.least(F.col("n_rows"), F.col("_from") + UNFOLD) - 1)))
    copies = F.col("whole") + (F.col("_nth") < F.col("sure") + F.round("p").cast("long")).cast("long")
    return unfolded.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "source")
