"""Small helpers for tables that are kept between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the session's shared folder (a temporary one is set only
    where the session has none)."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="actaflow-"))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the session's shared one, for files that a query writes to read."""
    cut_lineage(spark.range(0))
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key.  Aggregated as a minimum, so that a crowded key is
    combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*[F.col(o) if isinstance(o, str) else o for o in order]))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def ranked(df: DataFrame, keys: list[str], order: list, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


#: Rows of a scan that one task reads with the text rules.
ROWS_A_TASK = 50_000


def spread(df: DataFrame, rows: int = ROWS_A_TASK) -> DataFrame:
    """A scan dealt to all cores before costly text rules, in as many tasks as its rows ask
    for, so that the longest one doesn't grow with the input; a scan that has enough of them
    is left alone."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def in_order(df: DataFrame, order: list) -> tuple[DataFrame, DataFrame]:
    """``df`` dealt to ranges of ``order``, with the number of its range as ``_range``, kept;
    and (_range, rows) of the ranges.  What a running value needs of the ranges before it is
    one row for each of them, so no task sees all rows."""
    dealt = cut_lineage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    return dealt, dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("rows"))


def _carried(dealt: DataFrame, of_range: DataFrame, names: list[str]) -> DataFrame:
    """``dealt`` with the sums of ``names`` over all ranges before its own (``_before_<name>``)
    and over all of them (``_total_<name>``); there are as many rows as partitions."""
    rows = sorted(of_range.select("_range", *names).collect())
    before, out = [0] * len(names), []
    totals = [sum(r[n] or 0 for r in rows) for n in names]
    for r in rows:
        out.append((r["_range"], *before, *totals))
        before = [b + (r[n] or 0) for b, n in zip(before, names)]
    kinds = {f.name: f.dataType.simpleString() for f in of_range.schema}
    schema = ", ".join(["_range int", *(f"_before_{n} {kinds[n]}" for n in names), *(f"_total_{n} {kinds[n]}" for n in names)])
    return dealt.join(F.broadcast(df_of(dealt, out, schema)), "_range")


def df_of(like: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return like.sparkSession.createDataFrame(rows, schema)


def numbered(df: DataFrame, order: list, name: str = "place", total: str | None = None) -> DataFrame:
    """``df`` with its row number in ``order`` (which should tell all rows apart) and, if
    asked for, the number of all rows."""
    dealt, ranges = in_order(df, order)
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    out = _carried(dealt, ranges, ["rows"]).withColumn(name, (own + F.col("_before_rows")).cast("long"))
    if total:
        out = out.withColumn(total, F.col("_total_rows"))
    return out.drop("_range", "_before_rows", "_total_rows")


def running(df: DataFrame, order: str, values: list[str], totals: bool = False) -> DataFrame:
    """``df`` with ``<value>_run``, the sum of each value up to and with its row in ``order`` (one
    row for each), and with ``totals`` the sum over all rows as ``<value>_all``."""
    dealt, _ = in_order(df, [order])
    ranges = dealt.groupBy("_range").agg(*[F.sum(v).alias(v) for v in values])
    own = Window.partitionBy("_range").orderBy(order)
    out = _carried(dealt, ranges, values)
    for v in values:
        out = out.withColumn(f"{v}_run", F.sum(v).over(own) + F.col(f"_before_{v}"))
        if totals:
            out = out.withColumn(f"{v}_all", F.col(f"_total_{v}"))
    return out.select(*df.columns, *[c for v in values for c in ([f"{v}_run", f"{v}_all"] if totals else [f"{v}_run"])])
