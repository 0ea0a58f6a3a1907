"""A log table over the driver's ``events``: the same schema as indexed rows, without files.

LOG_SQL is the same view for DuckDB, a WITH clause that defines ``log``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP, ERRORS = "/logs/access.log", "/logs/error.log"
AGENTS = [
    "-",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/126.0.0.0 Safari/537.36",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_4 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.4 Mobile/15E148 Safari/604.1",
    "Mozilla/5.0 (X11; Ubuntu; Linux x86_64; rv:127.0) Gecko/20100101 Firefox/127.0",
    "Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)",
    "Mozilla/5.0 (Linux; Android 14; SM-X710) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/125.0.0.0 Safari/537.36 Edg/125.0.0.0",
]
LEVELS = ["error", "warn", "crit", "notice", "alert", "info", "emerg", "debug"]
COLUMNS = [
    "ts", "ip", "status", "method", "path", "referer", "user_agent", "bytes_sent", "request_time", "level", "region_code", "province", "city", "sub1", "sub2", "city_point",
    "main_log_path", "fp", "off", "ip_hex", "k",
]


def base_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log rows, without names of places. The columns are plain expressions, so filters and pruning reach the scan."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    status = F.when(kind == "error", F.when(k % 2 == 0, 500).otherwise(404)).when(kind == "signup", 301).when(kind == "purchase", 201).otherwise(200)
    digits = F.concat(F.lit("00000000000000000000ffff0a00"), F.lpad(F.lower(F.hex(F.col("user_id") % 8)), 2, "0"), F.lpad(F.lower(F.hex(F.col("user_id") % 256)), 2, "0"))
    return e.select(
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("ts"), F.concat(F.lit("10.0."), F.col("user_id") % 8, F.lit("."), F.col("user_id") % 256).alias("ip"),
        status.alias("status"), F.when(kind.isin("purchase", "signup"), "POST").otherwise("GET").alias("method"), F.concat(F.lit("/"), kind, F.lit("/"), k).alias("path"),
        F.when(k % 3 == 0, F.concat(F.lit("https://site"), k % 5, F.lit(".example.com/from/"), k)).alias("referer"), F.get(F.array(*[F.lit(a) for a in AGENTS]), k % 6).alias("user_agent"),
        F.round(F.col("value") * 100).cast("long").alias("bytes_sent"), F.when(k % 10 != 0, F.col("value") / 1000).alias("request_time"), F.lit(None).cast("string").alias("level"),
        F.lit(GROUP).alias("main_log_path"), F.lit("f1").alias("fp"), F.col("event_id").alias("off"), digits.alias("ip_hex"), F.col("user_id").alias("user_id"), k.alias("k"),
    )


def log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With places: a nation is a country's first level, its region the second. Nations are 25 rows."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").join(spark.read.parquet(f"{sf_dir}/region.parquet").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    place = n.select(
        F.col("n_nationkey").cast("long").alias("_nation"), F.when(F.col("n_regionkey") < 2, "CN").otherwise("US").alias("region_code"), F.col("r_name").alias("province"), F.col("n_name").alias("city"),
        F.concat(F.lit("C-"), F.col("n_regionkey")).alias("sub1"), F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("C-"), F.col("n_regionkey"))).otherwise(F.concat(F.lit("N-"), F.col("n_nationkey"))).alias("sub2"),
        F.when(F.col("n_nationkey") % 5 != 0, F.concat(F.lit("XX|"), F.col("n_name"), F.lit("|"), F.col("n_nationkey"), F.lit(".50|1.25"))).otherwise("unreadable").alias("city_point"),
    )
    return base_rows(spark, sf_dir).withColumn("_nation", F.col("user_id") % 25).join(F.broadcast(place), "_nation").select(*COLUMNS)


def error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events as rows of an error log: no status and bytes, a level by k."""
    rows = base_rows(spark, sf_dir).where("path like '/error/%'")
    return rows.select("ts", "ip", "path", F.get(F.array(*[F.lit(x) for x in LEVELS]), F.col("k") % 8).alias("level"), F.lit(ERRORS).alias("main_log_path"), F.lit("f2").alias("fp"), "off", "k")


_CASES = " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(AGENTS))
_LEVELS = " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(LEVELS))
LOG_SQL = f"""
WITH e AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k, epoch_us(ts) // 1000000 AS sec FROM events
), log AS (
  SELECT sec AS ts, '10.0.' || user_id % 8 || '.' || user_id % 256 AS ip,
         CASE event_type WHEN 'error' THEN CASE WHEN k % 2 = 0 THEN 500 ELSE 404 END WHEN 'signup' THEN 301 WHEN 'purchase' THEN 201 ELSE 200 END AS status,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END AS method, '/' || event_type || '/' || k AS path,
         CASE WHEN k % 3 = 0 THEN 'https://site' || k % 5 || '.example.com/from/' || k END AS referer, CASE k % 6 {_CASES} END AS user_agent,
         CAST(round(value * 100) AS BIGINT) AS bytes_sent, CASE WHEN k % 10 <> 0 THEN value / 1000 END AS request_time, CAST(NULL AS VARCHAR) AS level,
         CASE WHEN n_regionkey < 2 THEN 'CN' ELSE 'US' END AS region_code, r_name AS province, n_name AS city, 'C-' || n_regionkey AS sub1,
         CASE WHEN n_nationkey % 3 = 0 THEN 'C-' || n_regionkey ELSE 'N-' || n_nationkey END AS sub2,
         CASE WHEN n_nationkey % 5 <> 0 THEN 'XX|' || n_name || '|' || n_nationkey || '.50|1.25' ELSE 'unreadable' END AS city_point,
         '{GROUP}' AS main_log_path, 'f1' AS fp, event_id AS off, k,
         '00000000000000000000ffff0a00' || lpad(lower(to_hex(user_id % 8)), 2, '0') || lpad(lower(to_hex(user_id % 256)), 2, '0') AS ip_hex
  FROM e JOIN nation ON n_nationkey = user_id % 25 JOIN region ON r_regionkey = n_regionkey
), errors AS (
  SELECT ts, ip, path, CASE k % 8 {_LEVELS} END AS level, '{ERRORS}' AS main_log_path, 'f2' AS fp, off, k FROM log WHERE path LIKE '/error/%'
)
"""
