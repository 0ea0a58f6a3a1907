"""Counts, shares and statistics of matching rows. All are exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def term_counts(rows: DataFrame, c: str) -> DataFrame:
    """``key, value``: how many rows have each value of a column; nulls don't count."""
    return rows.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("key")).agg(F.count("*").alias("value"))


def top_terms(rows: DataFrame, c: str, n: int) -> DataFrame:
    """The most frequent values, ties by the value as text."""
    return term_counts(rows, c).orderBy(F.col("value").desc(), F.col("key").cast("string")).limit(n)


def entry_statistics(rows: DataFrame) -> DataFrame:
    """Sums, least and most of bytes and times; averages are over all rows, 0 stands for no value."""
    docs = F.greatest(F.count("*"), F.lit(1))
    zero = lambda x, t: F.coalesce(x, F.lit(0)).cast(t)
    return rows.agg(
        F.count("*").alias("docs"), zero(F.sum("bytes_sent"), "long").alias("bytes_sum"), zero(F.min("bytes_sent"), "long").alias("bytes_min"), zero(F.max("bytes_sent"), "long").alias("bytes_max"),
        (zero(F.sum("bytes_sent"), "double") / docs).alias("bytes_avg"), zero(F.min("request_time"), "double").alias("time_min"), zero(F.max("request_time"), "double").alias("time_max"),
        # whole microseconds are added, so that the sum doesn't depend on the order
        (zero(F.sum(F.round(F.col("request_time") * 1e6).cast("long")), "double") / 1e6 / docs).alias("time_avg"),
    )


def time_range(rows: DataFrame, group: str = "main_log_path") -> DataFrame:
    """Documents, first and last time of each group."""
    return rows.groupBy(group).agg(F.count("*").alias("docs"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def status_class(status: Column) -> Column:
    return F.when(status.between(100, 599), F.floor(status / 100)).otherwise(0).cast("int")


def countries(rows: DataFrame, n: int = 300) -> DataFrame:
    """The most frequent countries; shares are of the listed ones."""
    top = top_terms(rows, "region_code", n)
    return top.withColumn("percent", F.col("value") * 100.0 / F.sum("value").over(Window.partitionBy()))  # n rows at most


def regions(rows: DataFrame, country: str, n: int = 500) -> DataFrame:
    """Subdivisions of both levels; a code at both counts once and keeps level 1; shares are of all rows of the country."""
    here = rows.where(F.col("region_code") == country)
    both = here.select(F.explode(F.array(*[F.struct(F.nullif(F.col(f"sub{k}"), F.lit("")).alias("key"), F.lit(k).alias("level")) for k in (1, 2)])).alias("x")).select("x.*").where("key is not null")
    counted = both.groupBy("key").agg(F.count("*").alias("value"), F.min("level").alias("level"))
    total = here.agg(F.count("*").alias("total"))
    return counted.orderBy(F.col("value").desc(), "key").limit(n).join(F.broadcast(total)).select("key", "level", "value", (F.col("value") * 100.0 / F.col("total")).alias("percent"))  # one row


def city_points(rows: DataFrame, n: int = 500) -> DataFrame:
    """Most frequent points; shares are of all rows with one; keys that can't be read are dropped after the limit."""
    from logloom.functions.geo import parsed_point

    counted = term_counts(rows, "city_point")
    total = rows.agg(F.count("city_point").alias("total"))
    top = counted.orderBy(F.col("value").desc(), "key").limit(min(n, 2000)).join(F.broadcast(total))  # one row
    return top.withColumn("p", parsed_point(F.col("key"))).where("p is not null").select("key", "p.country", "p.city", "p.lat", "p.lon", "value", (F.col("value") * 100.0 / F.col("total")).alias("percent"))


def entries_overview(rows: DataFrame) -> dict[str, DataFrame]:
    """What the statistics page shows: ten of each list, and the figures."""
    lists = {"statuses": "status", "methods": "method", "paths": "path", "ips": "ip", "user_agents": "user_agent"}
    return {name: top_terms(rows, c, 10) for name, c in lists.items()} | {"figures": entry_statistics(rows)}
