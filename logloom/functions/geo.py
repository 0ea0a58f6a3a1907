"""Locations: a range join of different addresses with a table of blocks.

Spark plans an inequality join as a nested loop. A block is therefore cut into the prefixes that
cover it, all of the same number of hexadecimal digits: the digits that its two ends share, and each
digit that may follow. Addresses have one key for each number of digits that blocks have, 32 at most, so the join is
by equality, for IPv4 and IPv6 and blocks of any width alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _digit(text: Column, at: Column) -> Column:
    return F.conv(F.substr(text, at, F.lit(1)), 16, 10).cast("int")


def range_lookup(addresses: DataFrame, blocks: DataFrame, address: str = "ip_hex", attributes: list[str] | None = None) -> DataFrame:
    """``address`` and attributes of the smallest block that holds it, for each different address that one does.

    ``blocks``: lo, hi (32 hexadecimal digits) and attributes; sixteen keys a block at most.
    """
    names = attributes or [c for c in blocks.columns if c not in ("lo", "hi")]
    asked = addresses.select(address).where(F.col(address).isNotNull()).distinct()
    shared = F.size(F.filter(F.sequence(F.lit(1), F.lit(31)), lambda i: F.substr("lo", F.lit(1), i) == F.substr("hi", F.lit(1), i)))
    told = blocks.withColumn("_n", shared + 1)
    digits = F.sequence(_digit(F.col("lo"), F.col("_n")), _digit(F.col("hi"), F.col("_n")))
    keyed = told.withColumn("_key", F.explode(F.transform(digits, lambda d: F.concat(F.substr("lo", F.lit(1), F.col("_n") - 1), F.lower(F.hex(d))))))
    lengths = [r[0] for r in told.select("_n").distinct().orderBy("_n").collect()]  # 32 numbers at most
    starts = F.array(*[F.substring(address, 1, n) for n in lengths]) if lengths else F.array().cast("array<string>")
    tried = asked.withColumn("_key", F.explode(starts))
    hit = tried.join(keyed, "_key").where(F.col(address).between(F.col("lo"), F.col("hi")))
    # of two blocks around an address the later start is the smaller block; of equal starts the earlier end
    width = F.struct(F.col("lo"), F.translate("hi", "0123456789abcdef", "fedcba9876543210"))
    return hit.groupBy(address).agg(F.max_by(F.struct(*names), width).alias("_v")).select(address, *[F.col(f"_v.{n}").alias(n) for n in names])


def folded(country: Column, sub1: Column, sub2: Column) -> tuple[Column, Column, Column]:
    """HK, MO and TW count as subdivisions of CN."""
    china = country.isin("HK", "MO", "TW")
    return F.when(china, "CN").otherwise(country), F.when(china, F.concat(F.lit("CN-"), country)).otherwise(sub1), F.when(china, "").otherwise(sub2)


def city_point(country: Column, city: Column, city_id: Column, lat: Column, lon: Column) -> Column:
    """``country|name|lat|lon[|id]``, two decimals; a bar in the name becomes a slash, an id of 0 is left out."""
    base = F.format_string("%s|%s|%.2f|%.2f", country, F.replace(city, F.lit("|"), F.lit("/")), lat, lon)
    return F.when(city_id > 0, F.concat(base, F.lit("|"), city_id.cast("string"))).otherwise(base)


def parsed_point(key: Column) -> Column:
    """A struct of a city point's parts, null unless there are four or five that can be read."""
    p = F.split(key, r"\|")
    part = lambda k: F.get(p, F.lit(k))
    lat, lon = part(2).try_cast("double"), part(3).try_cast("double")
    sound = F.size(p).between(4, 5) & lat.isNotNull() & lon.isNotNull()
    return F.when(sound, F.struct(part(0).alias("country"), part(1).alias("city"), F.coalesce(part(4).try_cast("long"), F.lit(0).cast("long")).alias("city_id"), lat.alias("lat"), lon.alias("lon")))


def location_label(parts: list[Column], chinese: bool = False) -> Column:
    """Parts that aren't empty, joined; in Chinese CN is written out and a blank stands between."""
    named = [F.nullif(F.when(p == "CN", "中国").otherwise(p) if chinese and k == 0 else p, F.lit("")) for k, p in enumerate(parts)]
    return F.concat_ws(" " if chinese else ", ", *named)
