"""The pipeline: each stage's rows against a brute-force version on the stage's own input, on the small tables."""

import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F
from test_text_operators import brute_lines, check_packing, classes, exact, statistics

import corpus_pipeline as p
from logloom.llm import quality
from logloom.llm import queries as q
from logloom.llm.common import materialise

__all__ = ["exact"]


def kept_by(rules, text):
    """The verdict of the base rules and a decision list, in plain Python."""
    *base, failed = statistics(text)
    x = dict(zip(quality.BASE, base, strict=True))
    x["n_upper"], x["n_marks"] = len(re.findall("[A-Z]", text or "")), len(re.findall("[.,;:!?]", text or ""))
    x["n_lines"] = sum(bool(re.search(r"[^\x20\x09-\x0D]", line)) for line in (text or "").split("\n"))
    value = {n: eval(e.replace("greatest", "max"), {"max": max}, x) for n, e in quality.FEATURES.items()}
    holds = lambda c: value[c.feature] > c.threshold if c.above else value[c.feature] <= c.threshold
    return not failed and not any(all(map(holds, rule)) for rule in rules.rules)


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_stages(spark, small, exact):
    """With columns called like what the stages make."""
    docs = materialise(spark.read.parquet(f"{small}/documents.parquet").withColumns({"n_words": F.lit(-1), "kept": F.lit("own"), "removed": F.col("doc_id") + 1, "_fb": F.lit(7), "a.b": F.lit(1)}))
    columns, stages = docs.columns, dict(p.STAGES)

    def run(name):
        nonlocal docs
        before, docs = rows_of(docs), materialise(stages[name](spark, docs, small))
        assert docs.columns == columns
        assert docs.where("n_words <> -1 or kept <> 'own' or removed <> doc_id + 1 or _fb <> 7 or `a.b` <> 1").count() == 0
        return before, rows_of(docs)

    rules = quality.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))
    before, after = run("quality rules")
    assert sorted(after) == sorted(r for r in before if kept_by(rules, r[1])) and 0 < len(after) < len(before)
    before, after = run("line dedup")
    gone = brute_lines(dict(before))
    assert sorted(after) == sorted((i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])) for i, t in before) and any(gone.values())
    assert docs.where("n_chars <> length(text)").count() == 0
    before, after = run("MinHash near-dedup")
    top = classes(before)
    assert sorted(after) == sorted(r for r in before if top[r[0]] == r[0]) and len(after) < len(before)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toArrow())
    want = Counter({i: taken // size for i, size, taken in con.execute(f"SELECT doc_id, size, taken FROM ({q.MIX_SQL}) WHERE taken > 0").fetchall()})
    before, after = run("mixing sources")
    assert Counter(i for i, _ in after) == want and set(after) <= set(before)
    bins, least = check_packing(stages["best-fit packing"](spark, docs, small).collect(), after, exact)
    assert bins <= least + 1


def test_empty(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        docs = stage(spark, docs, small)
        assert docs.count() == 0


def test_run(spark, small):
    out = p.run(spark, small)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0
    assert len(p.STAGES) == 5 and p.ORACLE_SQL is None
