"""Mixing sources to target weights along a curriculum.

Each source has a weight schedule over training time from 0 to 1, linear between knots. Its
integral is the source's weight; weights share out the budget, and no source gets more than
``repeats`` times its size. Inside a source documents stand in hashed order. A document's place in
the source's running token count is a demand, and the time at which the integrated schedule
reaches this demand is its training position. Documents are range-sorted by position.

Running counts come in two levels. Hashed blocks of a source are summed first, so that a source
with a third of all rows is as many groups as the input is large, and only block sums are scanned
per source.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.common import free_name, renamed, word_count

Schedule = list[tuple[float, float]]
#: Knots (time, weight) whose integrals are 5, 2 and 1; the heavy sources come early, the middling ones late.
CURRICULUM: list[Schedule] = [[(0.0, 6.0), (1.0, 4.0)], [(0.0, 1.0), (0.5, 2.0), (1.0, 3.0)], [(0.0, 1.0), (1.0, 1.0)]]
SHARE, REPEATS = 1.5, 2
#: Blocks in each source: one for so many of all rows, BLOCKS at least.
BLOCK_ROWS, BLOCKS = 20_000, 256
#: The hash of a row without an id.
NO_ID = hashlib.md5(b"null").hexdigest()


def integral(schedule: Schedule) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False))


def source_targets(sizes: DataFrame, schedules: list[Schedule], share: float, repeats: int) -> DataFrame:
    """Of ``src, source, size`` rows: ``src, source_size, target, weight, which`` for each source.

    The table has one row for each source of the mix, so its windows over all rows are small.
    Sources by code point, null last, take the schedules in turn. A source is capped if its cap
    is below what its weight would get once all sources with a lower ratio of cap to weight are.
    """
    weights = F.array(*[F.lit(integral(s)) for s in schedules])
    everything = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", "src").rowsBetween(Window.unboundedPreceding, -1)
    return (
        sizes.groupBy("src").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
        .withColumn("which", F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(schedules))))
        .withColumn("weight", F.get(weights, F.col("which")))
        .withColumn("cap", (F.col("source_size") * repeats).cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0)))
        .withColumn("capped", F.col("cap") * (F.col("all_weight") - F.col("weight_before")) <= F.col("weight") * (F.col("budget") - F.col("cap_before")))
        .withColumn("left", F.col("budget") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0.0)))
        .withColumn("left_weight", F.col("all_weight") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("weight"))).over(everything), F.lit(0.0)))
        .withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * F.col("left") / F.col("left_weight")))
        .select("src", "source_size", "target", "which")
    )


def position(demand: Column, target: Column, which: Column, schedules: list[Schedule]) -> Column:
    """The time in [0, 1] at which a source has asked for ``demand`` of its ``target`` tokens.

    On a segment that starts at (t0, w0) with slope s the integral grows by w0 x + s x^2 / 2;
    its inverse is x = 2 z / (w0 + sqrt(w0^2 + 2 s z)).
    """
    out = F.lit(None).cast("double")
    for k, schedule in enumerate(schedules):
        y = demand / target * F.lit(integral(schedule))
        time, done = F.lit(1.0), integral(schedule)
        for (t0, w0), (t1, w1) in reversed(list(zip(schedule, schedule[1:], strict=False))):
            done -= (t1 - t0) * (w0 + w1) / 2
            z = F.greatest(y - F.lit(done), F.lit(0.0))
            root = F.sqrt(F.greatest(F.lit(w0 * w0) + z * F.lit(2 * (w1 - w0) / (t1 - t0)), F.lit(0.0)))
            here = F.lit(t0) + F.when(root + w0 > 0, z * 2 / (root + w0)).otherwise(0.0)
            time = F.when((y >= F.lit(done)) & (y <= F.lit(done + (t1 - t0) * (w0 + w1) / 2)), here).otherwise(time)
        out = F.when(which == k, F.least(time, F.lit(1.0))).otherwise(out)
    return out


def with_sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``docs`` with ``size`` (words), ``src`` (the source as a key that is never null) and ``h`` (the hashed order)."""
    return docs.withColumns(
        {
            "size": word_count(F.col(text_col)),
            "src": F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("null")),
            "h": F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))),
        }
    )


def plan_takes(sized: DataFrame, rows: int, id_col: str, source_col: str, schedules: list[Schedule] = CURRICULUM, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """Adds ``source_size, target, takes`` to rows of with_sizes(): takes has the position of each time the document is taken.

    A document is taken in a pass over its source if the target reaches its middle, so a source
    misses its target by half a document at most.
    """
    blocks = max(BLOCKS, 1 << math.ceil(math.log2(max(1, rows / BLOCK_ROWS))))
    # the first 32 bits of the hash, scaled, so that blocks stand in the order of their hashes
    dealt = sized.withColumn("block", F.shiftrightunsigned(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * blocks, 32))
    # rows without an id have one hash; they stand by size, so each size is a block of its own
    dealt = dealt.withColumn("part", F.when(F.col(id_col).isNull(), 1).when(F.col("h") <= NO_ID, 0).otherwise(2)).withColumn("sub", F.when(F.col(id_col).isNull(), F.col("size")).otherwise(0))
    at = ["block", "part", "sub"]
    sums = dealt.groupBy("src", *at).agg(F.first(source_col).alias("source"), F.sum("size").alias("size"))
    targets = source_targets(sums, schedules, share, repeats)
    before = Window.partitionBy("src").orderBy(*at).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("source", "size").join(targets, "src")
    inside = Window.partitionBy("src", *at).orderBy("h", F.col(id_col).asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.col("before") + F.sum("size").over(inside) - F.col("size") / 2
    placed = dealt.join(starts, ["src", *at]).withColumn("middle", middle)
    passes = F.array(*[F.lit(k) for k in range(repeats)])
    demands = F.filter(F.transform(passes, lambda k: F.col("middle") + k * F.col("source_size")), lambda d: d < F.col("target"))
    takes = F.when(F.col("size") > 0, F.transform(demands, lambda d: position(d, F.col("target"), F.col("which"), schedules))).otherwise(F.array().cast("array<double>"))
    return placed.withColumn("takes", takes).drop(*at, "before", "middle", "which", "src", "h")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mixed documents, a row for each time one is taken, range-sorted by training position.

    Columns are those of ``docs``. Null sources are one source, last in order. Documents without
    words (null or empty texts too) have nothing to mix and are not taken. Repeated rows are
    documents of their own; equal ones share one place in the order, which of them is the same.
    An empty table gives an empty result.
    """
    names = docs.columns
    clear, own = renamed(docs)
    sized = with_sizes(clear, own[id_col], own[text_col], own[source_col])
    taken = plan_takes(sized, docs.count(), own[id_col], own[source_col], **how).withColumn("at", F.explode("takes"))
    return taken.orderBy("at", own[id_col]).select(*[F.col(own[c]).alias(c) for c in names])


def mix_plan(sized: DataFrame, rows: int, **how) -> DataFrame:
    """Per document of a table of ``doc_id, source, size, src, h``: what the mix takes of it, in order of its first position.

    ``position`` is null for a document that isn't taken; those come last, by id.
    """
    planned = plan_takes(sized, rows, "doc_id", "source", **how)
    first = free_name("position", ["doc_id"])
    return planned.select("doc_id", "size", "source_size", "target", (F.size("takes") * F.col("size")).alias("taken"), F.get("takes", F.lit(0)).alias(first)).orderBy(F.col(first).asc_nulls_last(), "doc_id")
