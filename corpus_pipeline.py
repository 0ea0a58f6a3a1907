"""The corpus pipeline: STAGES in order, each written as Parquet and read again by the next.

Quality rules drop what they reject; line dedup rewrites texts; of each class of near-duplicates the
document with the smallest id stays; the mix repeats or leaves out documents by source; packing
turns what is left into sequences. ORACLE_SQL is None: the rules are learned and the near-duplicates
aligned, which SQL can't express; the tests hold each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import lines, mixing, near, quality
from logloom.llm.common import filter_late, materialise, renamed, table
from logloom.llm.packing import pack_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    own, at = renamed(docs)  # no column of the documents clashes with a statistic
    judged = filter_late(quality.judge(own, rules, at["text"]), "kept")
    return judged.select(*[F.col(b).alias(c) for c, b in at.items()])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, at = renamed(docs)
    out = lines.dedup_lines(own, at["doc_id"], at["text"])
    if n := at.get("n_chars"):  # tells the length of the text
        out = out.withColumn(n, F.when(F.col("n_removed") > 0, F.length(at["text"])).otherwise(F.col(n)).cast("long"))
    return out.select(*[F.col(b).alias(c) for c, b in at.items()])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("best-fit packing", best_fit_packing),
]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for ``documents``; every stage but it is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
