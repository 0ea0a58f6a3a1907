"""Hits as clients see them: one JSON text a row, read anew from the page's raw lines.

An entry of an access log has all its texts, empty ones too, but custom fields only where they say something and times only
where there are any; an entry of an error log has what its line says. A row is an error's if it has a level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import useragent
from logloom.functions.geo import location_label, parsed_point
from logloom.functions.parse import access_fields, access_parts, error_context, error_fields, error_parts, unfused

CUSTOM = ["c1", "c2", "c3", "c4"]


def _text(c: str | Column) -> Column:
    return F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(""))


def entries(page: DataFrame, zone: str = "UTC", chinese: bool = False) -> DataFrame:
    """``page`` with ``entry``, the hit as JSON, and ``location``, the label of its place. Every line is parsed again, as an access or an error line.

    Names of clients are those of the rows, if they have them: the rules, some hundred patterns, aren't looked for in each row.
    """
    empty = [c for c in ("region_code", "province", "city", "sub1", "city_point", *CUSTOM) if c not in page.columns]
    rows = page.withColumns({c: F.lit(None).cast("string") for c in empty}) if empty else page
    is_access = F.col("level").isNull()
    # each step is a column of its own: fields would otherwise take the line apart once for each use of a part
    rows = rows.withColumn("_l", access_parts(F.when(is_access, F.col("raw")))).withColumn("_a", access_fields(F.col("_l")))
    rows = rows.withColumn("_p", error_parts(F.when(~is_access, F.col("raw")))).withColumn("_c", error_context(F.col("_p"))).withColumn("_e", error_fields(F.col("_p"), F.col("_c"), zone))
    a, e, agent = F.col("_a"), F.col("_e"), _text(F.col("_a.user_agent"))
    rules = {"browser": useragent.browser, "os": useragent.system, "device_type": useragent.device}
    client = {c: _text(c) if c in page.columns else rule(agent) for c, rule in rules.items()}
    known = {c: client[c] if c in page.columns else None for c in rules}
    access = {
        "timestamp": F.col("ts"), "ip": _text(F.coalesce(F.nullif(F.col("ip"), F.lit("")), a.ip)), **{c: _text(a[c]) for c in ("method", "path", "protocol")},
        "status": F.coalesce(a.status, F.lit(0)), "bytes_sent": F.coalesce(a.bytes_sent, F.lit(0)), "referer": _text(a.referer), "user_agent": agent,
        "browser": client["browser"], "browser_version": useragent.browser_version(agent, known["browser"]), "os": client["os"], "os_version": useragent.system_version(agent, known["os"]), "device_type": client["device_type"],
        **{c: _text(c) for c in ("region_code", "province", "city")}, **{c: F.nullif(F.col(c), F.lit("")) for c in CUSTOM}, "sub1": _text("sub1"),
        "city_id": F.coalesce(parsed_point(F.col("city_point")).city_id, F.lit(0)), "request_time": F.when(a.request_time > 0, a.request_time), "upstream_time": a.upstream_time, "raw": F.col("raw"),
    }
    error = {
        "timestamp": F.col("ts"), "level": F.col("level"), "pid": F.coalesce(e.pid, F.lit(0)), "connection": F.coalesce(e.connection, F.lit(0)), "message": _text(e.message), "ip": _text(e.client),
        **{c: _text(e[c]) for c in ("server", "request", "method", "path", "upstream", "host")}, "referer": _text(e.referrer), "raw": F.col("raw"),
    }
    told = lambda fields: F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))  # noqa: E731  leaves nulls out
    label = location_label([F.trim(_text(c)) for c in ("region_code", "province", "city", *CUSTOM)], chinese)
    return rows.withColumn("entry", F.when(unfused(is_access), told(access)).otherwise(told(error))).withColumn("location", label).drop("_l", "_a", "_p", "_c", "_e", *empty)
