"""What the training-data operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.shared import materialise as materialise
from logloom.shared import release as release

#: A word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A key with more rows than HOT, and than a HOT_KEYS-th of all, is hot; so there are at most HOT_KEYS of them.
HOT, HOT_KEYS = 500, 4096
#: Tables of a few numbers a row are broadcast up to so many rows.
NARROW = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text):
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def free_name(wanted: str, taken) -> str:
    """A column name like ``wanted`` that clashes with none of ``taken``, whatever their case."""
    low = {c.lower() for c in taken}
    while wanted.lower() in low:
        wanted += "_"
    return wanted


def quoted(name: str) -> str:
    """A column's name as an identifier, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def columns(names) -> list:
    """Columns of these names, with dots or blanks in them too."""
    return [F.col(quoted(c)) for c in names]


def renamed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with plain names that clash with nothing, and what each column is called there."""
    back = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.select(*[F.col(quoted(c)).alias(b) for c, b in back.items()]), back


def filter_late(df: DataFrame, keep: str) -> DataFrame:
    """``df.where(keep)`` that stays where it is written.

    The optimizer copies the expressions behind a filter's columns down to the scan; those with
    lambdas are then computed again for each element. It can't push a filter below a generator.
    """
    flag = free_name("_keep", df.columns)
    return df.select("*", F.explode_outer(F.when(F.expr(keep), F.array(F.lit(1)))).alias(flag)).where(F.col(flag).isNotNull()).drop(flag)


def join_split(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", counts: DataFrame | None = None, narrow: bool = True) -> DataFrame:
    """``left.join(right, keys, how)`` that deals the rows of hot keys out over several tasks.

    ``narrow``: ``right`` is a table of materialise() with a few numbers a row; with NARROW rows or fewer it is broadcast.
    ``counts``: a table of materialise() with the keys and ``n``, how many rows ``left`` has of them, at least; it is
    made if it isn't given. Hot keys, HOT_KEYS at most, are broadcast: their rows of ``left`` get a salt
    from all columns, and their rows of ``right`` are repeated for each salt. If there are none it is a plain join.
    """
    if narrow and right.count() <= NARROW:
        return left.join(F.broadcast(right), keys, how)
    if counts is None:
        counts = materialise(left.groupBy(*keys).agg(F.count("*").alias("n")))
    total, top = counts.agg(F.sum("n"), F.max("n")).first()
    most = max(HOT, (total or 0) // HOT_KEYS)
    if (top or 0) <= most:
        return left.join(right, keys, how)
    hot = F.broadcast(counts.where(F.col("n") > most).select(*keys, F.ceil(F.col("n") / most).cast("int").alias("_n")))
    dealt = left.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.coalesce("_n", F.lit(1))).cast("int")).drop("_n")
    spread = right.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1))).drop("_n")
    return dealt.join(spread, [*keys, "_salt"], how).drop("_salt")


def in_order(df: DataFrame, group: list[str], order: list[str], place: str = "place", total: str = "total") -> DataFrame:
    """``df``, a table of materialise(), with each row's ``place`` in its group, from 0, and the group's ``total`` of rows.

    Rows are range-sorted, so a group with a third of them lies in as many tasks as it needs; ``order`` must tell
    rows apart. A task's first place comes from the counts of the tasks before it, one number for each task and group.
    Each task then holds runs of consecutive places.
    """
    by = [*group, *order]
    rows = materialise(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    task = F.shiftright("_at", 33).alias("_task")
    counts = materialise(rows.groupBy(task, *group).agg(F.min("_at").alias("_least"), F.count("*").alias("_n")))
    own = Window.partitionBy(*group)
    before = own.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_task", *group, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_least")).alias("_shift"), F.sum("_n").over(own).alias(total))
    few = counts.count() <= NARROW
    told = rows.select("*", task).join(F.broadcast(starts) if few else starts, ["_task", *group])
    told = told if few else told.sortWithinPartitions(*group, "_at")
    return told.withColumn(place, F.col("_at") + F.col("_shift")).drop("_at", "_task", "_shift")
