"""Only windows whose first words open one of the benchmark's are hashed as a whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from actaflow.llm import decontam

ITEM = "one small green apple fell from the old tree by the quiet river last night"


def _tables(spark):
    texts = [f"before {ITEM} after", "the old tree " * 8, ITEM.replace("by", "near"), "Which City", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return docs, spark.createDataFrame([(1, ITEM), (2, "Which City"), (3, "Solo")], "item_id long, text string")


def test_windows_that_open_nothing_are_not_hashed(spark):
    docs, benchmark = _tables(spark)
    plan = decontam.matches(docs, benchmark)._jdf.queryExecution().optimizedPlan().toString()
    assert "arrays_zip(slice(" not in plan and "xxhash64(slice(" in plan


def test_candidates_are_the_windows_that_the_filters_hold(spark):
    hashed = [F.xxhash64(F.lit(w)) for w in "a b c d e f".split()]
    rows = spark.range(1).select(F.lit("k").alias("key"), F.array(*hashed).alias("hashed"))
    window = spark.range(1).select(F.xxhash64(F.array(*hashed[1:5])).alias("h"))
    opening, other = (spark.range(1).select(F.xxhash64(*hashed[i : i + 3]).alias("h")) for i in (1, 0))
    keys = decontam._bitmap(window, 1 << 12, 1 << 18)
    for n, openings in ((1, decontam._bitmap(opening, 1 << 12, 1 << 18)), (0, decontam._bitmap(other, 1 << 12, 1 << 18)), (1, None)):
        found = decontam._candidates(rows, [(4, keys, openings)]).collect()
        assert [(r.key, r.size, r["at"]) for r in found] == [("k", 4, 2)] * n


def test_every_plan_finds_the_same(spark):
    docs, benchmark = _tables(spark)
    plain = {r.doc_id: r.contaminated for r in decontam.decontaminate(docs, benchmark).collect()}
    assert plain == {0: True, 1: False, 2: False, 3: True, 4: False}
    for limits in ({"max_vocabulary": 0}, {"max_filter_bits": 64}, {"max_broadcast": 0}):
        assert {r.doc_id: r.contaminated for r in decontam.decontaminate(docs, benchmark, **limits).collect()} == plain
