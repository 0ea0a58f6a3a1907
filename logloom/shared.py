"""The folder that driver and executors share, and what is written there for the time of a session."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of names are broadcast up to so many rows. A key with over a HOT-th of all rows is hot, so there are at most HOT of them.
BROADCAST, HOT = 200_000, 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a single-process session may go without the setting; it then gets a temporary folder.
    """
    if set_dir := spark.conf.get("spark.checkpoint.dir", None):
        return set_dir.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local-cluster") or not master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not hasattr(shared_dir, "own"):
        shared_dir.own = tempfile.mkdtemp(prefix="logloom-")
    return "file://" + shared_dir.own


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder. What is there is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


_made = threading.local()


@contextmanager
def collected() -> Iterator[list[DataFrame]]:
    """The tables that this thread materialises inside, but for those it keeps; for release() once nothing reads them."""
    outer, _made.tables = getattr(_made, "tables", None), []
    try:
        yield _made.tables
    finally:
        _made.tables = outer


def materialise(df: DataFrame, keep: bool = False) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lineage ends here.

    A lost executor then costs only the tasks it ran. The table is deleted by release() or when the driver ends.
    ``keep``: collected() doesn't tell of it.
    """
    spark = df.sparkSession
    path = shared_path(spark, "table")
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    if not keep and (held := getattr(_made, "tables", None)) is not None:
        held.append(table)
    return table


def release(*frames: DataFrame) -> None:
    """Deletes the tables of materialise() that nothing reads any more."""
    for df in frames:
        if files := df.inputFiles():
            _delete(df.sparkSession, files[0].rsplit("/", 1)[0])


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended before
        pass


def look_up(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """``rows``, a table of materialise(), left joined with ``names``, one row for each ``key``.

    Up to BROADCAST names are broadcast, and no row moves. For more of them rows of hot keys still don't move, as the names of these are
    broadcast; the others are shuffled by a key of which none has much.
    """
    names = materialise(names)
    if names.count() <= BROADCAST:
        return rows.join(F.broadcast(names), key, "left")
    counts = materialise(rows.groupBy(key).agg(F.count("*").alias("_n")))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = F.broadcast(counts.where(F.col("_n") > total // HOT).select(key))
    often = rows.join(hot, key, "left_semi").join(F.broadcast(names.join(hot, key, "left_semi")), key, "left")
    return often.unionByName(rows.join(hot, key, "left_anti").join(names, key, "left"))
