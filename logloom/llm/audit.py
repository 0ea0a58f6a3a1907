"""How filters act on each other: what each removes in every order, from one pass over the documents.

A document fails some of five filters, which is a mask of five bits. For each part and label the 32 signed parity
sums of these masks are aggregated: in the w-th a document counts -1 if it fails an odd number of the filters in w,
else 1. That is the Walsh-Hadamard transform of the number of documents with each mask; the transform is its own
inverse but for a factor of 32, so dividing gives these numbers exactly. All orders are then told from 32 numbers,
whatever the documents are: a filter removes those whose mask has its bit and none of the bits before it. Over all
120 orders a document that fails k filters is removed by each of them in 120 / k.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import WORD, join_split, materialise

NAMES = "ABCDE"
MEASURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def parity_sums(masks: DataFrame, by: list[str], mask: str = "mask", filters: int = len(NAMES)) -> DataFrame:
    """``by`` and ``sums``, for each w the number of masks that share an even number of bits with w, less those that share an odd one."""
    m = F.col(mask)
    signs = [F.sum(F.when(F.bit_count(m.bitwiseAND(F.lit(w))) % 2 == 1, -1).otherwise(1)).alias(f"_s{w}") for w in range(1 << filters)]
    return masks.groupBy(*by).agg(*signs).select(*by, F.array(*[f"_s{w}" for w in range(1 << filters)]).alias("sums"))


def cells(sums: str = "sums", filters: int = len(NAMES)) -> Column:
    """From parity sums the number of rows with each mask."""
    size = 1 << filters
    one = f"aggregate(sequence(0, {size - 1}), 0L, (a, w) -> a + get({sums}, w) * (1 - 2 * (bit_count(m & w) % 2)))"
    return F.expr(f"transform(sequence(0, {size - 1}), m -> {one} div {size})")


def steps(names: str = NAMES) -> Column:
    """All orders and their steps, as an array of (filter_order, step, bits before, own bit)."""
    bit = {c: 1 << k for k, c in enumerate(names)}
    out = [("".join(order), k + 1, sum(bit[c] for c in order[:k]), bit[order[k]]) for order in permutations(names) for k in range(len(names))]
    return F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(row, ("filter_order", "step", "before", "bit"), strict=True)]) for row in out])


def audit(masks: DataFrame, part: str = "part", good: str = "good", toxic: str = "toxic", names: str = NAMES) -> DataFrame:
    """``part, filter_order, step`` and MEASURES for every part of ``masks``, every order of the filters and every step in it.

    ``mask`` has the bit 2^k where the k-th filter fails; ``good`` and ``toxic`` are booleans, never null.
    Nothing grows with the documents but the parity sums, which combine before they shuffle.
    """
    n, every = len(names), f"sequence(0, {(1 << len(names)) - 1})"

    def over(where: str, value: str = "get(cells, m)") -> str:
        return f"aggregate({every}, 0L, (a, m) -> a + IF({where}, {value}, 0L))"

    told = parity_sums(masks, [part, good, toxic], filters=n).select(part, good, toxic, cells(filters=n).alias("cells"), F.explode(steps(names)).alias("_x")).select(part, good, toxic, "cells", "_x.*")
    figures = told.select(
        part, good, toxic, "filter_order", "step",
        F.expr(over("(m & (before | bit)) = 0")).alias("kept"),
        F.expr(over("(m & bit) <> 0 AND (m & before) = 0")).alias("removed"),
        F.expr(over("(m & bit) <> 0 AND (m & before) <> 0")).alias("redundant"),
        F.expr("get(cells, bit)").alias("unique_fails"),
        F.expr(over("(m & bit) <> 0", f"get(cells, m) * ({factorial(n)} div bit_count(m))")).alias("shapley"),
    )
    lost = {"good_lost": good, "toxic_lost": toxic}
    sums = [F.sum(F.when(F.col(lost[c]), F.col("removed")).otherwise(0) if c in lost else c).alias(c) for c in MEASURES]
    return figures.groupBy(part, "filter_order", "step").agg(*sums)


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, good, toxic`` for each document: which of the five filters its text fails, and how it is labelled.

    A null text is an empty one, a null lang the part ''. Texts are equal if their SHA-256 is; a
    document repeats another if that has a smaller id. One without an id repeats none, is repeated by none and has no label; rows of
    one id don't repeat each other. Of several labels of one id any counts. Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("t"))
    told = told.select("doc_id", "part", "t", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("w"))
    words, different = F.size("w"), F.size(F.array_distinct("w"))
    capitals = F.length("t") - F.length(F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = [words < 200, different.cast("long") * 100 < words.cast("long") * 50, capitals.cast("long") * 100 > F.length("t").cast("long") * 3, F.col("t").rlike("[#$%&*|]")]
    four = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails[1:], 1)), F.when(fails[0], 1).otherwise(0))
    rows = materialise(told.select("doc_id", "part", four.alias("mask"), F.unhex(F.sha2("t", 256)).alias("key")))
    copies = materialise(rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"))
    rows = join_split(rows, copies.select("key", "first"), ["key"], "left", copies.select("key", "n")).drop("key")
    rows = rows.withColumn("mask", F.col("mask") + F.when(F.col("doc_id") > F.col("first"), 1 << len(fails)).otherwise(0)).drop("first")
    known = materialise(labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))]))
    return join_split(rows, known, ["doc_id"], "left").select("part", "mask", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over whole documents; an empty table has no parts, so no rows."""
    return audit(failures(docs, labels))
