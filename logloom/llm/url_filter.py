"""URL filters: a blocked Bloom filter passes possible hits to an exact hash join.

A rule is a host and the start of a path; it fits the host, all its subdomains, and each path that
starts so. Listed URLs are rules with a whole path. The canonical key of a rule is host + path; a
URL's candidate keys are all pairs of a suffix of its host and a start of its path of a length
that rules have. Keys that the filter lets through are joined with the rules, which removes false
positives, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.bloom import Bloom
from logloom.llm.common import join_split, materialise, quoted

#: Fixed values of the contract: action, host, path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Rules up to so many are broadcast to the exact join; more are joined by key.
BROADCAST_RULES = 100_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path: after the first ``://`` up to ``/ ? #``, A-Z lower-cased; then up to ``? #``. Both empty without ``://``."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def judge_urls(urls: DataFrame, rules: DataFrame, url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """``url, host, path, rule, verdict, copies`` for each different URL of ``urls``; null is one of them.

    ``rules``: action, host, path. Rules with a null in them are left out; equal rules count once,
    and of equal rules with different actions block wins. A URL that no rule fits gets ``otherwise``.
    """
    keyed = (
        rules.where("action is not null and host is not null and path is not null")
        .groupBy("host", "path").agg(F.max("action").alias("action"))  # block > allow
        .withColumn("key", F.concat("host", "path"))
    )
    n_rules, lengths = keyed.agg(F.count("*"), F.collect_set(F.length("path"))).first()  # a set of path lengths is as small as the longest path
    host, path = url_parts(F.col("url"))
    different = urls.select(F.col(url_col).alias("url")).groupBy("url").agg(F.count("*").alias("copies")).withColumns({"host": host, "path": path})
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = [F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(lengths)] or [F.lit(None).cast("string")]
    paths = F.array_compact(F.array(*starts))
    pairs = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.struct(h.alias("host"), p.alias("path")))))
    tried = different.select("url", "host", F.explode_outer(pairs).alias("c")).select("url", "c", F.concat("c.host", "c.path").alias("key"))
    passed = Bloom(keyed, "key", n_rules).passed(tried, "key").select("url", "c.host", "c.path")
    exact = keyed.select("host", "path", "action")
    if n_rules <= BROADCAST_RULES:
        hits = passed.join(F.broadcast(exact), ["host", "path"])
    else:  # a rule like a whole top domain has very many hits
        asked = passed.groupBy("host", "path").agg(F.count("*").alias("n"))
        hits = join_split(passed, exact, ["host", "path"], "inner", materialise(asked), narrow=False)
    order = F.struct((F.length("host") + F.length("path")).alias("n"), F.length("host").alias("h"), F.concat("host", "path").alias("rule"), "action")
    best = hits.groupBy("url").agg(F.max(order).alias("best"))
    return different.join(best, "url", "left").select("url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(otherwise)).alias("verdict"), "copies")


def filter_pages(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row of ``pages``.

    Each different URL is judged once; its pages are dealt out if they are many. A null URL, or one without ``://``, has an empty host and
    path, which no rule fits. Repeated rows each give a row. Other columns are ignored. An empty
    table gives an empty result, no rules give ``otherwise`` to all.
    """
    rows = pages.select(F.col(quoted(id_col)).alias("page_id"), F.col(quoted(url_col)).alias("url"))
    judged = materialise(judge_urls(rows, rules, otherwise=otherwise).where("url is not null"))
    host, path = url_parts(F.col("url"))
    nothing = rows.where("url is null").select("page_id", host.alias("host"), path.alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    told = join_split(rows.where("url is not null"), judged.drop("copies"), ["url"], "inner", judged.select("url", F.col("copies").alias("n")), narrow=False)
    return told.select("page_id", "host", "path", "rule", "verdict").unionAll(nothing)
