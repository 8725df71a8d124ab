"""Numbers and running sums over ranges, against a plain loop; no task sees all rows."""

from __future__ import annotations

import itertools
import random

from pyspark.sql import functions as F

from actaflow.operators import measure, tables


def test_numbers_follow_the_order(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(40)]), i, f"x{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "a int, b int, c string").repartition(5)
    found = tables.numbered(df, [F.desc("a"), F.col("b")], "place", "of").collect()
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [(r.a, r.b, r.c) for r in sorted(found, key=lambda r: r.place)] == ordered
    assert sorted(r.place for r in found) == list(range(1, 3001)) and {r.of for r in found} == {3000}
    assert tables.numbered(df.limit(0), ["a", "b"]).collect() == []


def test_running_sums(spark):
    rng = random.Random(4)
    rows = [(i, rng.randint(0, 9), rng.randint(0, 9)) for i in rng.sample(range(5000), 900)]
    found = tables.running(spark.createDataFrame(rows, "v int, n long, m long"), "v", ["n", "m"], totals=True).orderBy("v").collect()
    rows.sort()
    assert [(r.v, r.n_run, r.m_run) for r in found] == [(v, n, m) for (v, _, _), n, m in zip(rows, itertools.accumulate(r[1] for r in rows), itertools.accumulate(r[2] for r in rows))]
    assert {(r.n_all, r.m_all) for r in found} == {(sum(r[1] for r in rows), sum(r[2] for r in rows))}


def test_no_window_takes_all_rows_in_one_task(spark):
    """Rows lie in many ranges, and what carries over between them is one row for each."""
    adaptive = "spark.sql.adaptive.coalescePartitions.enabled"  # it would make one range of so few rows
    spark.conf.set(adaptive, "false")
    try:
        _, ranges = tables.in_order(spark.range(10_000).repartition(8), ["id"])
        sizes = [r.rows for r in ranges.collect()]
        placed = tables.numbered(spark.range(10_000).repartition(8), [F.desc("id")]).collect()
    finally:
        spark.conf.unset(adaptive)
    assert sum(sizes) == 10_000 and len(sizes) > 1 and max(sizes) < 6000
    assert all(r.place == 10_000 - r.id for r in placed)
    tally = spark.range(1000).select(F.col("id").alias("days"), F.lit(1).cast("long").alias("n"))
    assert [measure.discrete_quantile(tally, "days", "n", q).first().value for q in (0.001, 0.5, 1.0)] == [0, 499, 999]
    assert measure.discrete_quantile(tally.limit(0), "days", "n", 0.5).first().value is None
    plan = tables.numbered(tally, ["days"])._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan
