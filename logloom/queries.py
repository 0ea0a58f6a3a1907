"""Registered queries of the engine and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import geo, parse, useragent
from logloom.functions.ip import hex_range, ipv4_hex
from logloom.functions.tokens import atoms, has_all_terms, has_phrase, stored_full, tokenize
from logloom.operators import dashboard, rollup, search, stats
from logloom.operators.dashboard import Layout
from logloom.plans.filters import Filter, compile_filter
from logloom.shared import materialise, shared_path
from logloom.sources.logs import main_log_column
from logloom.sources.store import Store
from logloom.views import GROUP, LOG_SQL, error_rows, log_rows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Three days, aligned, and a window that cuts hours and minutes at both ends.
DAYS = Layout.of_dates(date(2024, 1, 10), date(2024, 1, 12), 0)
ODD = Layout(DAYS.start + 1234, DAYS.end - 777)
NOW = 1_800_000_000


def query(name: str, sql: str | None = None, log: bool = True) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = (LOG_SQL if log else "") + sql
        return f

    return keep


def over_log(name: str, sql: str, f: Callable[[DataFrame], DataFrame]) -> None:
    query(name, sql)(lambda spark, d: f(log_rows(spark, d)))


# dashboards

_W = f"ts >= {DAYS.start} AND ts < {DAYS.end}"
_O = f"ts >= {ODD.start} AND ts < {ODD.end}"


def _window_sql(where: str) -> str:
    return f"SELECT count(*) AS pv, count(DISTINCT ip) AS uv, CAST(coalesce(sum(bytes_sent), 0) AS BIGINT) AS bytes FROM log WHERE {where}"


def _hourly_sql(lay: Layout) -> str:
    a, b = lay.scan
    return f"""SELECT b.bucket, {lay.hour_start} + b.bucket * 3600 - ({lay.hour_start} + b.bucket * 3600) % 3600 AS hour, coalesce(pv, 0) AS pv, coalesce(uv, 0) AS uv, coalesce(bytes, 0) AS bytes
    FROM (SELECT unnest(range({lay.hour_count})) AS bucket) b LEFT JOIN (
      SELECT CAST(floor((ts - ts % 3600 - {lay.hour_start}) / 3600) AS BIGINT) AS bucket, count(*) AS pv, count(DISTINCT ip) AS uv, CAST(sum(bytes_sent) AS BIGINT) AS bytes
      FROM log WHERE ts >= {a} AND ts < {b} GROUP BY 1) c USING (bucket)"""


def _daily_sql(lay: Layout) -> str:
    a, b = lay.scan
    days = ", ".join(f"({at}, {m}, {n})" for at, m, n in lay.days())
    return f"""SELECT CAST(d.t0 AS BIGINT) AS timestamp, count(ts) AS pv, count(DISTINCT ip) AS uv, CAST(coalesce(sum(bytes_sent), 0) AS BIGINT) AS bytes
    FROM (VALUES {days}) AS d(t0, a, b) LEFT JOIN (SELECT * FROM log WHERE ts >= {a} AND ts < {b}) r ON r.ts >= d.a AND r.ts < d.b GROUP BY 1"""


def _facet_sql(c: str, n: int, where: str) -> str:
    return f"""SELECT key, value, value * 100.0::DOUBLE / (SELECT count(*) FROM log WHERE {where}) AS percent FROM (
      SELECT {c} AS key, count(*) AS value FROM log WHERE {where} AND {c} IS NOT NULL GROUP BY 1) ORDER BY value DESC, key LIMIT {n}"""


_BROWSER = "CASE k % 6 WHEN 1 THEN 'Chrome' WHEN 2 THEN 'Safari' WHEN 3 THEN 'Firefox' WHEN 4 THEN 'Bot' WHEN 5 THEN 'Edge' END"
_SYSTEM = "CASE k % 6 WHEN 1 THEN 'Windows' WHEN 2 THEN 'iOS' WHEN 3 THEN 'Ubuntu' WHEN 5 THEN 'Android' END"
_DEVICE = "CASE k % 6 WHEN 1 THEN 'Desktop' WHEN 2 THEN 'iPhone' WHEN 3 THEN 'Desktop' WHEN 4 THEN 'Bot' WHEN 5 THEN 'Tablet' END"

over_log("dashboard_summary", _window_sql(_W), lambda r: dashboard.window_figures(r, DAYS))
over_log("dashboard_summary_unaligned", _window_sql(_O), lambda r: dashboard.window_figures(r, ODD))
over_log("dashboard_hourly", _hourly_sql(DAYS), lambda r: dashboard.hourly(r, DAYS))
over_log("dashboard_hourly_unaligned", _hourly_sql(ODD), lambda r: dashboard.hourly(r, ODD))
over_log("dashboard_daily", _daily_sql(DAYS), lambda r: dashboard.daily(r, DAYS).drop("day"))
over_log("dashboard_daily_unaligned", _daily_sql(ODD), lambda r: dashboard.daily(r, ODD).drop("day"))
over_log(
    "dashboard_minute_peak", f"SELECT max(n) AS peak, max(n) / 60.0::DOUBLE AS peak_qps FROM (SELECT (ts - {DAYS.start}) // 60 AS m, count(*) AS n FROM log WHERE {_W} GROUP BY 1)",
    lambda r: dashboard.minutes(r, DAYS).agg(F.max("pv").alias("peak"), (F.max("pv") / 60).alias("peak_qps")),
)
over_log(
    "dashboard_overview",
    f"""SELECT w.*, w.uv / 3.0::DOUBLE AS avg_daily_uv, daily_pv / 3.0::DOUBLE AS avg_daily_pv, h.hour AS peak_hour, h.pv AS peak_hour_pv, peak / 60.0::DOUBLE AS peak_qps, w.pv / {DAYS.end - DAYS.start}.0::DOUBLE AS avg_qps
    FROM ({_window_sql(_W)}) w, (SELECT CAST(sum(pv) AS BIGINT) AS daily_pv FROM ({_daily_sql(DAYS)})) d, (SELECT * FROM ({_hourly_sql(DAYS)}) ORDER BY pv DESC, bucket LIMIT 1) h,
    (SELECT max(n) AS peak FROM (SELECT count(*) AS n FROM log WHERE {_W} GROUP BY (ts - {DAYS.start}) // 60)) m""",
    lambda r: dashboard.overview(dashboard.window_figures(r, DAYS), dashboard.hourly(r, DAYS), dashboard.daily(r, DAYS), dashboard.minutes(r, DAYS), DAYS),
)
over_log("dashboard_top_urls", _facet_sql("path", 100, _W), lambda r: dashboard.facet(r, DAYS, "urls"))
for _name, _c in (("browsers", _BROWSER), ("systems", _SYSTEM), ("devices", _DEVICE)):
    over_log(f"dashboard_{_name}", _facet_sql(_c, 50, _W), lambda r, n=_name: dashboard.facet(useragent.with_clients(r), DAYS, n))


#: Windows without views: the hour before the first row (its scan has some, its series must show none), and one that ends before it starts.
EMPTY, REVERSED = Layout(1704067200 - 3600, 1704067200), Layout(DAYS.end, DAYS.start)


def _response_sql(lay: Layout) -> str:
    return f"""SELECT ({lay.hour_start} + bucket * 3600) % 86400 // 3600 AS hour, {lay.hour_start} + bucket * 3600 AS timestamp, bucket, pv, uv, bytes
    FROM ({_hourly_sql(lay)}) WHERE (SELECT count(*) FROM log WHERE ts >= {lay.start} AND ts < {lay.end}) > 0"""


_NOTHING = """SELECT 0::BIGINT AS pv, 0::BIGINT AS uv, 0::BIGINT AS bytes, 0.0::DOUBLE AS avg_daily_uv, 0.0::DOUBLE AS avg_daily_pv, 0::BIGINT AS peak_hour, 0::BIGINT AS peak_hour_pv,
  0.0::DOUBLE AS peak_qps, 0.0::DOUBLE AS avg_qps"""

# rollups, against the direct answers


def _hybrid(spark: SparkSession, d: str, lay: Layout) -> rollup.Hybrid:
    rows = useragent.with_clients(log_rows(spark, d))
    return rollup.Hybrid(rollup.build(rows), rows, lay)


for _name, _lay, _where in (("", DAYS, _W), ("_unaligned", ODD, _O)):
    query(f"rollup_dashboard_summary{_name}", _window_sql(_where))(lambda s, d, x=_lay: _hybrid(s, d, x).window_figures())
    query(f"rollup_dashboard_hourly{_name}", _hourly_sql(_lay))(lambda s, d, x=_lay: _hybrid(s, d, x).hourly())
    query(f"rollup_dashboard_daily{_name}", _daily_sql(_lay))(lambda s, d, x=_lay: _hybrid(s, d, x).daily().drop("day"))
    query(f"rollup_dashboard_urls{_name}", _facet_sql("path", 100, _where))(lambda s, d, x=_lay: _hybrid(s, d, x).facet("urls"))
    query(f"rollup_dashboard_browsers{_name}", _facet_sql(_BROWSER, 50, _where))(lambda s, d, x=_lay: _hybrid(s, d, x).facet("browsers"))
    query(f"rollup_dashboard_peak{_name}", f"SELECT max(n) AS peak FROM (SELECT count(*) AS n FROM log WHERE {_where} GROUP BY (ts - {_lay.start}) // 60)")(lambda s, d, x=_lay: _hybrid(s, d, x).minutes().agg(F.max("pv").alias("peak")))


for _name, _lay in (("", DAYS), ("_unaligned", ODD)):
    query(f"response_hourly{_name}", _response_sql(_lay))(lambda s, d, x=_lay: dashboard.dashboard(useragent.with_clients(log_rows(s, d)), x)["hourly"])
    query(f"response_hourly_hybrid{_name}", _response_sql(_lay))(lambda s, d, x=_lay: _hybrid(s, d, x).dashboard()["hourly"])
for _name, _lay in (("empty", EMPTY), ("reversed", REVERSED)):
    query(f"response_{_name}_overview", _NOTHING)(lambda s, d, x=_lay: dashboard.dashboard(useragent.with_clients(log_rows(s, d)), x)["overview"])
    query(f"response_{_name}_overview_hybrid", _NOTHING)(lambda s, d, x=_lay: _hybrid(s, d, x).dashboard()["overview"])


def _roll(table: str) -> Query:
    return lambda s, d: getattr(rollup.build(useragent.with_clients(log_rows(s, d))), table)


_CLASSES = ", ".join(f"count(*) FILTER (status // 100 = {k}) AS s{k}" for k in range(1, 6))
query("rollup_hourly", f"SELECT main_log_path, ts - ts % 3600 AS hour, count(*) AS pv, CAST(sum(bytes_sent) AS BIGINT) AS bytes, count(*) FILTER (status // 100 NOT BETWEEN 1 AND 5) AS s0, {_CLASSES} FROM log GROUP BY 1, 2")(_roll("hours"))
query("rollup_minutes", "SELECT main_log_path, ts - ts % 60 AS minute, count(*) AS pv FROM log GROUP BY 1, 2")(_roll("minutes"))
query("rollup_visitors", "SELECT DISTINCT main_log_path, ts - ts % 3600 AS hour, ip FROM log")(_roll("visitors"))
query("rollup_terms", f"""SELECT main_log_path, ts - ts % 3600 AS hour, kind, term, count(*) AS n FROM (
  SELECT *, unnest(['url', 'browser', 'os', 'device']) AS kind, unnest([path, {_BROWSER}, {_SYSTEM}, {_DEVICE}]) AS term FROM log) WHERE term IS NOT NULL GROUP BY 1, 2, 3, 4""")(_roll("terms"))


@query("rollup_merge", "SELECT main_log_path, ts - ts % 3600 AS hour, count(*) AS pv FROM log GROUP BY 1, 2")
def _merged(spark: SparkSession, d: str) -> DataFrame:
    rows = useragent.with_clients(log_rows(spark, d))
    return rollup.merge(*[rollup.build(rows.where(F.col("off") % 3 == k)) for k in range(3)]).hours.select("main_log_path", "hour", "pv")


# search

_SUMMARY = "SELECT count(*) AS docs, CAST(coalesce(sum(bytes_sent), 0) AS BIGINT) AS bytes, count(DISTINCT ip) AS unique_ips, count(DISTINCT path) AS unique_paths FROM log"
_HIT = ["ts", "ip", "status", "method", "path", "bytes_sent", "request_time", "off"]
_HITS = f"SELECT {', '.join(_HIT)} FROM log"
_TIE = "main_log_path, fp, off"
over_log("search_summary", f"{_SUMMARY} WHERE status = 404", lambda r: search.search(_tokened(r), Filter(statuses=[404])).figures)
over_log("search_page_latest", f"{_HITS} ORDER BY ts DESC, {_TIE} LIMIT 50", lambda r: search.page(r).select(*_HIT))
over_log("search_page_sorted_bytes", f"{_HITS} ORDER BY bytes_sent DESC NULLS LAST, {_TIE} LIMIT 100", lambda r: search.page(r, 100, 0, "bytes_sent").select(*_HIT))
over_log("search_page_time_asc", f"{_HITS} ORDER BY request_time ASC NULLS LAST, {_TIE} LIMIT 30", lambda r: search.page(r, 30, 0, "request_time", "asc").select(*_HIT))
over_log("search_unknown_sort_key", f"{_HITS} ORDER BY ts DESC, {_TIE} LIMIT 10", lambda r: search.page(r, 10, 0, "path").select(*_HIT))
over_log("search_offset", f"{_HITS} ORDER BY ts DESC, {_TIE} LIMIT 50 OFFSET 20", lambda r: search.page(r, 50, 20).select(*_HIT))
over_log("search_late_page", f"{_HITS} WHERE status = 500 ORDER BY ts DESC, {_TIE} LIMIT 40", lambda r: search.late_page(r.where("status = 500"), r, limit=40).select(*_HIT))
over_log("entries_tail", f"{_HITS} ORDER BY ts DESC, {_TIE} LIMIT 100", lambda r: search.entries(r).select(*_HIT))
over_log("entries_head", f"{_HITS} ORDER BY ts, {_TIE} LIMIT 7", lambda r: search.entries(r, 7, False).select(*_HIT))


def _tokened(r: DataFrame) -> DataFrame:
    """Token columns of plain paths by built-in functions, and the names of clients."""
    stored = lambda c: F.transform(atoms(F.coalesce(c, F.lit(""))), lambda t, i: F.struct(i.alias("pos"), t.alias("term")))
    raw = F.concat_ws(" ", "method", "path", "referer")
    return useragent.with_clients(r).withColumns({"raw_tok": stored(raw), "path_tok": stored(F.col("path")), "ref_tok": stored(F.col("referer")), "ua_tok": stored(F.col("user_agent"))})


def box(name: str, text: str, where: str, **rest) -> None:
    """A search box (and other parts of a filter) against a SQL condition."""
    over_log(name, f"SELECT off FROM log WHERE {where}", lambda r: _tokened(r).where(compile_filter(Filter(text=text, **rest))).select("off"))


box("filter_status_class", "status:5xx", "status BETWEEN 500 AND 599")
box("filter_status_range", "status:301-404", "status BETWEEN 301 AND 404")
box("filter_status_compare", "status:>=404 -status:500", "status >= 404 AND status <> 500")
box("filter_bytes_open_range", "bytes:5000..", "bytes_sent >= 5000")
box("filter_rt_range", "rt:0.01..0.05", "request_time BETWEEN 0.01 AND 0.05")
box("filter_rt_null_exclude", "-rt:>0.05", "NOT coalesce(request_time > 0.05, false)")
box("filter_ip_cidr", "ip:10.0.2.0/23", "ip LIKE '10.0.2.%' OR ip LIKE '10.0.3.%'")
box("filter_ip_exact", "", "ip = '10.0.1.1'", ips=["10.0.1.1"])
box("filter_method_ci", "method:post", "method = 'POST'")
box("filter_browser_ci", "browser:FIREFOX", "k % 6 = 3")
box("filter_os_device", "os:android device:tablet", "k % 6 = 5")
box("filter_country", "country:cn region:america", "region_code = 'CN' AND lower(province) = 'america'")
box("filter_level_none", "level:error", "false")
box("filter_time_half_open", "", _O, start=ODD.start, end=ODD.end)
box("filter_lists", "", "status IN (200, 404) AND method = 'GET' AND region_code = 'US'", statuses=[200, 404], methods=["GET"], countries=["US"])
box("filter_unknown_level_is_no_filter", "", "true", levels=["loud"])
box("filter_combined", "status:2xx bytes:>1000 -path:/view path:/click", "status BETWEEN 200 AND 299 AND bytes_sent > 1000 AND path LIKE '/click/%'")
box("filter_empty_box", "   ", "true")
box("filter_punctuation_only", "!!!", "false")
box("path_phrase", "path:/error/42", "path = '/error/42'")
box("path_any_phrase", "", "path LIKE '/view/%' OR path = '/click/7'", paths=["/view", "click/7"])
box("referer_phrase", "referer:site3.example", "referer LIKE 'https://site3.example.com/%'")
box("agent_phrase", "ua:Firefox/127", "k % 6 = 3")
box("text_words_of_a_line", "purchase post 13", "method = 'POST' AND path = '/purchase/13' OR method = 'POST' AND path LIKE '/purchase/%' AND referer LIKE '%/13'")

# text of documents: atoms in the JVM against the same expression

_ATOMS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def text_query(name: str, where: str, cond: Callable[[Column], Column]) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        found = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
        stored = F.transform(found, lambda t, i: F.struct(i.alias("pos"), t.alias("term")))
        return _docs(spark, d).select("doc_id", stored.alias("t")).where(cond(F.col("t"))).select("doc_id")

    query(name, f"SELECT doc_id FROM (SELECT doc_id, {_ATOMS} AS t, text FROM documents) WHERE {where}", log=False)(run)


text_query("text_all_tokens", "list_contains(t, 'the') AND list_contains(t, 'thnd')", lambda t: has_all_terms(t, ["the", "thnd"]))
text_query("text_exclude", "list_contains(t, 'the') AND NOT list_contains(t, 'of')", lambda t: has_all_terms(t, ["the"]) & ~has_all_terms(t, ["of"]))
text_query("text_phrase", "contains(' ' || array_to_string(t, ' ') || ' ', ' of the ')", lambda t: has_phrase(t, tokenize("of the", False, True)))


@query("text_dotted_prefix", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^\\p{L}\\p{N}._])19[0-9]\\.[0-9]+\\.[0-9]+\\.[0-9]+([^\\p{L}\\p{N}._]|\\.?$|\\.\\s)')", log=False)
def _dotted(spark: SparkSession, d: str) -> DataFrame:
    """The full tokenizer, over all texts: the first group of a dotted number finds the number."""
    return _docs(spark, d).where(F.exists(stored_full(F.col("text")), lambda t: t["term"].rlike(r"^19[0-9](\.[0-9]+){3}$"))).select("doc_id")


# statistics

over_log(
    "entries_stats",
    """SELECT count(*) AS docs, CAST(sum(bytes_sent) AS BIGINT) AS bytes_sum, min(bytes_sent) AS bytes_min, max(bytes_sent) AS bytes_max, sum(bytes_sent)::DOUBLE / count(*) AS bytes_avg,
    coalesce(min(request_time), 0) AS time_min, coalesce(max(request_time), 0) AS time_max, sum(CAST(round(request_time * 1e6) AS BIGINT))::DOUBLE / 1e6::DOUBLE / count(*) AS time_avg FROM log""",
    stats.entry_statistics,
)
_TOP = "SELECT {c} AS key, count(*) AS value FROM log WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY value DESC, key::VARCHAR LIMIT {n}"
for _name, _c, _n in (("status_distribution", "status", 10), ("method_distribution", "method", 10), ("top_paths", "path", 10), ("top_ips", "ip", 10), ("top_user_agents", "user_agent", 10)):
    over_log(_name, _TOP.format(c=_c, n=_n), lambda r, c=_c, n=_n: stats.top_terms(r, c, n))
over_log("geo_countries_share", "SELECT key, value, value * 100.0::DOUBLE / sum(value) OVER () AS percent FROM (" + _TOP.format(c="region_code", n=300) + ")", stats.countries)
over_log(
    "geo_regions_two_levels",
    """SELECT key, CAST(min(level) AS INT) AS level, count(*) AS value, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM log WHERE region_code = 'CN') AS percent
    FROM (SELECT sub1 AS key, 1 AS level FROM log WHERE region_code = 'CN' UNION ALL SELECT sub2, 2 FROM log WHERE region_code = 'CN') GROUP BY 1""",
    lambda r: stats.regions(r, "CN"),
)
over_log(
    "geo_city_points",
    """SELECT key, 'XX' AS country, split_part(key, '|', 2) AS city, CAST(split_part(key, '|', 3) AS DOUBLE) AS lat, CAST(split_part(key, '|', 4) AS DOUBLE) AS lon, value,
    value * 100.0::DOUBLE / (SELECT count(*) FROM log) AS percent FROM (""" + _TOP.format(c="city_point", n=500) + ") WHERE key <> 'unreadable'",
    stats.city_points,
)
over_log("log_status", "SELECT main_log_path, count(*) AS docs, min(ts) AS first, max(ts) AS last FROM log GROUP BY 1", stats.time_range)


@query("group_time_range", "SELECT main_log_path, count(*) AS docs, min(ts) AS first, max(ts) AS last FROM (SELECT main_log_path, ts FROM log UNION ALL SELECT main_log_path, ts FROM errors) GROUP BY 1")
def _ranges(spark: SparkSession, d: str) -> DataFrame:
    return stats.time_range(log_rows(spark, d).select("main_log_path", "ts").unionByName(error_rows(spark, d).select("main_log_path", "ts")))


query("error_levels", "SELECT level AS key, count(*) AS value FROM errors GROUP BY 1")(lambda s, d: stats.term_counts(error_rows(s, d), "level"))

#: Blocks for the range join, of several widths, one inside another.
BLOCKS = [("10.0.0.0/8", "ten"), ("10.0.4.0/22", "upper"), ("10.0.6.0/24", "six"), ("10.0.0.0/24", "zero")]


@query("geo_range_join", """SELECT ip, CASE WHEN ip LIKE '10.0.0.%' THEN 'zero' WHEN ip LIKE '10.0.6.%' THEN 'six' WHEN ip LIKE '10.0.4.%' OR ip LIKE '10.0.5.%' OR ip LIKE '10.0.7.%' THEN 'upper' ELSE 'ten' END AS name, count(*) AS n FROM log GROUP BY 1, 2""")
def _ranges_joined(spark: SparkSession, d: str) -> DataFrame:
    blocks = spark.sql("VALUES " + ", ".join(str((*hex_range(c), n)) for c, n in BLOCKS)).toDF("lo", "hi", "name")
    rows = log_rows(spark, d).select("ip").withColumn("ip_hex", ipv4_hex(F.col("ip")))
    return rows.join(geo.range_lookup(rows, blocks), "ip_hex").groupBy("ip", "name").agg(F.count("*").alias("n"))


# parsing: lines made of rows, parsed back


def access_lines(r: DataFrame) -> DataFrame:
    time = F.date_format(F.timestamp_seconds("ts"), "dd/MMM/yyyy:HH:mm:ss")
    rt = F.coalesce(F.format_string("%.6f", "request_time"), F.lit("-"))
    line = F.concat("ip", F.lit(" - - ["), time, F.lit(' +0000] "'), "method", F.lit(" "), "path", F.lit(' HTTP/1.1" '), "status", F.lit(" "), "bytes_sent", F.lit(' "'), F.coalesce("referer", F.lit("-")), F.lit('" "'), "user_agent", F.lit('" '), rt, F.lit(" -"))
    return r.select("off", line.alias("raw"))


@query("parse_round_trip", "SELECT off, ts, ip, CAST(status AS INT) AS status, method, path, coalesce(referer, '-') AS referer, user_agent, bytes_sent, CASE WHEN request_time >= 0.0000005 THEN round(request_time, 6) END AS request_time FROM log")
def _round_trip(spark: SparkSession, d: str) -> DataFrame:
    got = parse.access_rows(access_lines(log_rows(spark, d)), NOW)
    return got.select("off", "ts", "ip", "status", "method", "path", "referer", "user_agent", "bytes_sent", "request_time")


def error_lines(r: DataFrame) -> DataFrame:
    time = F.date_format(F.timestamp_seconds("ts"), "yyyy/MM/dd HH:mm:ss")
    line = F.concat(time, F.lit(" ["), "level", F.lit("] 12#34: *"), "off", F.lit(" it broke, client: "), "ip", F.lit(', server: x, request: "GET '), "path", F.lit(' HTTP/1.1", host: "h"'))
    return r.select("off", line.alias("raw"))


@query("parse_error_round_trip", "SELECT off, ts, ip, 'GET' AS method, path, level FROM errors")
def _error_trip(spark: SparkSession, d: str) -> DataFrame:
    return parse.error_rows(error_lines(error_rows(spark, d)), NOW).select("off", "ts", "ip", "method", "path", "level")


@query("parse_invalid_dropped", "SELECT off FROM log WHERE off % 4 = 0")
def _invalid(spark: SparkSession, d: str) -> DataFrame:
    """Lines broken in three ways are no entries: cut short, with escapes in the path, from the far future."""
    lines = access_lines(log_rows(spark, d))
    broken = F.when(F.col("off") % 4 == 1, F.substring("raw", 1, 19)).when(F.col("off") % 4 == 2, F.regexp_replace("raw", '"(GET|POST) ', '"GET \\\\\\\\x16')).when(F.col("off") % 4 == 3, F.regexp_replace("raw", "/2024:", "/2924:"))
    return parse.access_rows(lines.select("off", F.coalesce(broken, "raw").alias("raw")), NOW).select("off")


query("ua_detect", f"SELECT user_agent, any_value(coalesce({_BROWSER}, '')) AS browser, any_value(coalesce({_SYSTEM}, '')) AS os, any_value(coalesce({_DEVICE}, '')) AS device_type FROM log GROUP BY 1")(
    lambda s, d: useragent.clients(log_rows(s, d)).select("user_agent", "browser", "os", "device_type")
)

#: Names of log files and the live log each belongs to.
ROTATIONS = [
    ("/l/access.log", "/l/access.log"), ("/l/access.log.1", "/l/access.log"), ("/l/access.log.12.gz", "/l/access.log"), ("/l/access.1.log", "/l/access.log"), ("/l/access.log-20240101", "/l/access.log"),
    ("/l/access.log-2024-01-01.xz", "/l/access.log"), ("/l/access.log.20240101", "/l/access.log"), ("/l/access.log.2024.01.01", "/l/access.log"), ("/l/20240101", "/l/access.log"),
    ("/l/2024.01.01", "/l/2024.01"), ("/l/access.log.bak", "/l/access.log.bak"), ("/l/error.log.2.bz2", "/l/error.log"), ("/l/site.access.log.202401", "/l/site.access.log"),
]


@query("rotation_collapse", f"SELECT off, '/l' || k || main AS main FROM log JOIN (VALUES {', '.join(str((i, *r)) for i, r in enumerate(ROTATIONS))}) AS t(i, path, main) ON off % {len(ROTATIONS)} = i")
def _rotations(spark: SparkSession, d: str) -> DataFrame:
    """A name for each event, in a folder of its own."""
    name = F.get(F.array(*[F.lit(p) for p, _ in ROTATIONS]), (F.col("off") % len(ROTATIONS)).cast("int"))
    return log_rows(spark, d).select("off", main_log_column(F.concat(F.lit("/l"), "k", name)).alias("main"))


# incremental states: what a store of the whole table holds after appends and replacements

def _stored(spark: SparkSession, d: str) -> tuple[Store, DataFrame, int]:
    """A store of all rows, committed in two parts, the rows, and the offset where the second part starts: half of the last one."""
    # names are looked up once for all commits
    rows = materialise(useragent.with_clients(log_rows(spark, d)))
    cut = (rows.agg(F.max("off")).first()[0] or 0) // 2
    store = Store(spark, shared_path(spark, "store"))
    store.commit(GROUP, rows.where(F.col("off") < cut), [])
    store.commit(GROUP, rows.where(F.col("off") >= cut), [])
    return store, rows, cut


@query("incremental_append", "SELECT main_log_path, count(*) AS docs, CAST(sum(bytes_sent) AS BIGINT) AS bytes FROM log GROUP BY 1")
def _append(spark: SparkSession, d: str) -> DataFrame:
    return _stored(spark, d)[0].rows().groupBy("main_log_path").agg(F.count("*").alias("docs"), F.sum("bytes_sent").alias("bytes"))


def _replaced(spark: SparkSession, d: str, share: int = 0, upto: int = 0) -> DataFrame:
    """All rows of a store whose content from an offset was replaced by new rows, a second later.

    The offset is where the second part starts, and the new rows go to the end; or, told in ``share``-ths of the last offset, they go from one to ``upto`` of these.
    """
    store, rows, cut = _stored(spark, d)
    part = (rows.agg(F.max("off")).first()[0] or 0) // share if share else 0
    start = part if share else cut
    new = rows.where(F.col("off").between(start, part * upto)) if share else rows.where(F.col("off") >= start)
    store.commit(GROUP, new.withColumn("ts", F.col("ts") + 1), [], delete=[("f1", start)])
    store.vacuum()
    return store.rows()


query("incremental_replace", "SELECT off, ts + CASE WHEN off >= last // 4 THEN 1 ELSE 0 END AS ts FROM log, (SELECT max(off) AS last FROM log) WHERE off <= last // 4 * 3")(lambda s, d: _replaced(s, d, 4, 3).select("off", "ts"))
query("incremental_replace_tail", "SELECT off, ts + CASE WHEN off >= (SELECT max(off) // 2 FROM log) THEN 1 ELSE 0 END AS ts, ip, path, bytes_sent FROM log")(
    lambda s, d: _replaced(s, d).select("off", "ts", "ip", "path", "bytes_sent")
)


def _bm25_sql(tokens: str, terms: tuple[str, ...], where: str, shown: str, limit: int | None) -> str:
    """Hits of lines by BM25: frequencies and lengths are those of all lines of ``log``, with ``tokens`` the list of a line's."""
    best = f"ORDER BY {{}} DESC, main_log_path, fp, off LIMIT {limit}" if limit else ""
    tf = [f"len(list_filter(t, lambda x: x = '{w}'))" for w in terms]
    idf = [f"ln(1 + (n - df{k} + 0.5::DOUBLE) / (df{k} + 0.5::DOUBLE))" for k in range(len(terms))]
    one = [f"{idf[k]} * tf{k} * 2.2::DOUBLE / (tf{k} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(t) / (tokens / CAST(n AS DOUBLE))))" for k in range(len(terms))]
    told = ", ".join(f"{x} AS tf{k}" for k, x in enumerate(tf))
    return f"""SELECT {shown}, round({" + ".join(one)}, 6) AS score FROM (SELECT *, {told} FROM (SELECT *, {tokens} AS t FROM log)),
      (SELECT count(*) AS n, CAST(sum(len(t)) AS DOUBLE) AS tokens, {", ".join(f"count(*) FILTER (list_contains(t, '{w}')) AS df{k}" for k, w in enumerate(terms))} FROM (SELECT {tokens} AS t FROM log))
    WHERE {where} {best.format(" + ".join(one))}"""


@query("search_score_order", _bm25_sql("regexp_extract_all(lower(concat_ws(' ', method, path, referer)), '[a-z0-9]+')", ("error", "13"), "tf0 > 0 AND tf1 > 0", "off, path", 20))
def _score(spark: SparkSession, d: str) -> DataFrame:
    """The twenty best hits."""
    rows = _tokened(log_rows(spark, d))
    return search.search(rows, Filter(text="error 13"), 20, 0, "_score").hits.select("off", "path", F.round("score", 6).alias("score"))
