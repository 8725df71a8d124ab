"""Tables kept between stages in the folder that all executors share."""

from __future__ import annotations

import tempfile
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


#: Of each thread: the copies taken inside every ``settled`` that it is in.
_scopes = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.  Where none is set, a session on one
    machine, as in tests, gets a temporary one; on a cluster, whose executors could
    not see it, this is an error."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="actaflow-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage at a reliable copy in the shared folder."""
    shared_dir(df.sparkSession)
    copy = df.checkpoint(eager=True)
    if taken := getattr(_scopes, "taken", None):
        taken[-1].append(copy._jdf.queryExecution().logical().rdd().getCheckpointFile().get())
    return copy


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """checkpoint(make()), after which the copies that ``make`` took are deleted: only the
    rows of its result are read later, and they are in a copy of their own.  Copies of
    other threads are not touched."""
    _scopes.taken = [*getattr(_scopes, "taken", []), []]
    try:
        result = checkpoint(make())
    finally:
        *outer, own = _scopes.taken
        _scopes.taken = outer
    if outer:
        outer[-1].append(own[-1])
    for folder in own[:-1]:
        remove(spark, folder)
    return result


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared storage that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
