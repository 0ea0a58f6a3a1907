"""Traffic dashboards: figures of a window, series by hour and local day, the busiest minute, and top lists.

The calendar is laid out on the driver; rows are counted by a few narrow aggregates over one
filtered frame. A series shows its empty buckets too.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators.stats import top_terms
from logloom.shared import materialise

HOUR, MARGIN = 3600, 12 * 3600
#: The lengths of the lists.
TOP_CLIENTS, TOP_URLS = 50, 100
FACETS = {"browsers": ("browser", TOP_CLIENTS), "systems": ("os", TOP_CLIENTS), "devices": ("device_type", TOP_CLIENTS), "urls": ("path", TOP_URLS)}


def from_local(naive: datetime, zone: ZoneInfo) -> int:
    """Epoch seconds of a wall time: of two the first, in a gap an hour later."""
    at = int(naive.replace(tzinfo=zone, fold=0).timestamp())
    if datetime.fromtimestamp(at, zone).replace(tzinfo=None) != naive:
        return from_local(naive + timedelta(hours=1), zone)
    return at


def local_midnight(ts: int, zone: ZoneInfo) -> int:
    day = datetime.fromtimestamp(ts, zone).date()
    return from_local(datetime(day.year, day.month, day.day), zone)


def add_local_day(ts: int, zone: ZoneInfo) -> int:
    return from_local(datetime.fromtimestamp(ts, zone).replace(tzinfo=None) + timedelta(days=1), zone)


@dataclass(frozen=True)
class Layout:
    """A window [start, end) in a zone. The scan reaches 12 hours farther at both ends, its own end excluded.

    The hourly grid starts 12 hours before the window. Days are stepped from the start by local
    days while before the end, so a last part of a day may be missing, and a day's rows outside
    the window but in the scan count.
    """

    start: int
    end: int
    zone: str = "UTC"

    @property
    def scan(self) -> tuple[int, int]:
        return self.start - MARGIN, self.end + MARGIN

    @property
    def hour_start(self) -> int:
        return self.start - MARGIN

    @property
    def hour_count(self) -> int:
        return math.ceil((self.end - self.start + 2 * MARGIN) / HOUR)

    def days(self) -> list[tuple[int, int, int]]:
        """(shown time, midnight, next midnight) of each day."""
        zone, at, out = ZoneInfo(self.zone), self.start, []
        while at < self.end:
            midnight = local_midnight(at, zone)
            out.append((at, midnight, add_local_day(midnight, zone)))
            at = add_local_day(at, zone)
        return out

    @staticmethod
    def of_dates(start: date | None, end: date | None, now: int, zone: str = "UTC") -> Layout:
        """Local midnights of two dates, the last day included; without either the last 30 days to now, unaligned."""
        if start is None or end is None:
            return Layout(now - 30 * 86400, now, zone)
        z = ZoneInfo(zone)
        return Layout(from_local(datetime(start.year, start.month, start.day), z), add_local_day(from_local(datetime(end.year, end.month, end.day), z), z), zone)


def hour_of(ts: Column) -> Column:
    """The UTC hour a time lies in, before 1970 too."""
    return ts - F.pmod(ts, F.lit(HOUR))


def in_window(rows: DataFrame, lay: Layout) -> DataFrame:
    return rows.where((F.col("ts") >= lay.start) & (F.col("ts") < lay.end))


def in_scan(rows: DataFrame, lay: Layout) -> DataFrame:
    return rows.where((F.col("ts") >= lay.scan[0]) & (F.col("ts") < lay.scan[1]))


def _figures(uv: Column) -> list[Column]:
    return [F.count("*").alias("pv"), uv.alias("uv"), F.coalesce(F.sum("bytes_sent"), F.lit(0)).cast("long").alias("bytes")]


def window_figures(rows: DataFrame, lay: Layout) -> DataFrame:
    return in_window(rows, lay).agg(*_figures(F.countDistinct("ip")))


def bucket(lay: Layout) -> Column:
    return F.floor((hour_of(F.col("ts")) - lay.hour_start) / HOUR)


def hour_buckets(spark: SparkSession, lay: Layout) -> DataFrame:
    hour = F.col("id") * HOUR + lay.hour_start
    return spark.range(lay.hour_count).select(F.col("id").alias("bucket"), (hour - F.pmod(hour, F.lit(HOUR))).alias("hour"))


def padded(grid: DataFrame, counted: DataFrame, key: str, values: list[str]) -> DataFrame:
    """All rows of a grid with counts, 0 where there are none. The grid is as long as the window has buckets."""
    return grid.join(counted, key, "left").select(*grid.columns, *[F.coalesce(v, F.lit(0).cast("long")).alias(v) for v in values])


def hourly(rows: DataFrame, lay: Layout) -> DataFrame:
    counted = in_scan(rows, lay).groupBy(bucket(lay).alias("bucket")).agg(*_figures(F.countDistinct("ip"))).where("bucket >= 0")
    return padded(hour_buckets(rows.sparkSession, lay), counted, "bucket", ["pv", "uv", "bytes"])


def local_day(ts: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(F.timestamp_seconds(ts), zone))


def day_grid(spark: SparkSession, lay: Layout) -> DataFrame:
    zone = ZoneInfo(lay.zone)
    days = [(at, datetime.fromtimestamp(midnight, zone).date()) for at, midnight, _ in lay.days()]
    values = ", ".join(f"({at}L, DATE '{day}')" for at, day in days)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(timestamp, day)" if days else "SELECT 0L AS timestamp, DATE '1970-01-01' AS day WHERE false")


def daily(rows: DataFrame, lay: Layout) -> DataFrame:
    counted = in_scan(rows, lay).groupBy(local_day(F.col("ts"), lay.zone).alias("day")).agg(*_figures(F.countDistinct("ip")))
    return padded(day_grid(rows.sparkSession, lay), counted, "day", ["pv", "uv", "bytes"])


def minutes(rows: DataFrame, lay: Layout) -> DataFrame:
    """Views of each minute from the window's start that has any."""
    return in_window(rows, lay).groupBy(F.floor((F.col("ts") - lay.start) / 60).alias("minute")).agg(F.count("*").alias("pv"))


def facet(rows: DataFrame, lay: Layout, name: str) -> DataFrame:
    """A top list of the window; percentages are of all its views."""
    c, n = FACETS[name]
    total = in_window(rows, lay).agg(F.count("*").alias("pv"))
    return top_terms(in_window(rows, lay), c, n).join(F.broadcast(total)).select("key", "value", (F.col("value") * 100.0 / F.col("pv")).alias("percent"))  # one row


def overview(window: DataFrame, hours: DataFrame, days: DataFrame, minute: DataFrame, lay: Layout) -> DataFrame:
    """One row of figures: averages, the busiest hour (the first of equals over the padded grid) and minute.

    The average of daily visitors is the window's visitors by days.
    """
    n = max(1, len(lay.days()))
    most_views = hours.agg(F.max(F.struct("pv", (-F.col("bucket")).alias("b"), "hour")).alias("m"))
    peak = most_views.select(F.when(F.col("m.pv") > 0, F.col("m.hour")).alias("peak_hour"), F.coalesce("m.pv", F.lit(0).cast("long")).alias("peak_hour_pv"))
    most = minute.agg(F.coalesce(F.max("pv"), F.lit(0).cast("long")).alias("peak_minute_pv"))
    daily_pv = days.agg(F.coalesce(F.sum("pv"), F.lit(0).cast("long")).alias("daily_pv"))
    one = window.join(F.broadcast(peak)).join(F.broadcast(most)).join(F.broadcast(daily_pv))  # one row each
    return one.select(
        "pv", "uv", "bytes", (F.col("uv") / n).alias("avg_daily_uv"), (F.col("daily_pv") / n).alias("avg_daily_pv"), "peak_hour", "peak_hour_pv",
        (F.col("peak_minute_pv") / 60).alias("peak_qps"), (F.col("pv") / max(1, lay.end - lay.start)).alias("avg_qps"),
    )


def hour_labels(hours: DataFrame, lay: Layout) -> DataFrame:
    """An hourly series as clients see it: ``hour`` of the UTC day, and ``timestamp`` of the grid, on the hour or not."""
    stamp = F.col("bucket") * HOUR + lay.hour_start
    return hours.withColumn("timestamp", stamp).withColumn("hour", F.floor(F.pmod(stamp, F.lit(86400)) / HOUR))


#: What is counted: ``kind`` of series or list, place ``at`` in it, ``name`` of visitor or term.
COUNTS = ["kind", "at", "name", "n", "bytes"]


def day_number(ts: Column, zone: str) -> Column:
    return F.datediff(local_day(ts, zone), F.lit("1970-01-01").cast("date"))


def told(rows: DataFrame, lay: Layout, minutes: bool = True) -> DataFrame:
    """COUNTS of each row of the scan in every series and list it counts in: with its address in the window, its hour
    and its local day, so that different visitors are as many as there are names in these; in its minute; and under its names.
    """
    inside = (F.col("ts") >= lay.start) & (F.col("ts") < lay.end)
    known = lambda c: F.nullif(F.col(c), F.lit("")).isNotNull()
    none = F.lit(None).cast("string")
    sets = [("window", inside, F.lit(0), F.col("ip")), ("hour", F.lit(True), bucket(lay), F.col("ip")), ("day", F.lit(True), day_number(F.col("ts"), lay.zone), F.col("ip"))]
    sets += [("minute", inside, F.floor((F.col("ts") - lay.start) / 60), none)] if minutes else []
    sets += [(name, inside & known(c), F.lit(0), F.col(c)) for name, (c, _) in FACETS.items()]
    each = [F.when(cond, F.struct(F.lit(kind).alias("kind"), at.cast("long").alias("at"), name.alias("name"))) for kind, cond, at, name in sets]
    out = in_scan(rows, lay).select(F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("x"), F.coalesce("bytes_sent", F.lit(0)).cast("long").alias("bytes"))
    return out.select("x.*", F.lit(1).cast("long").alias("n"), "bytes")


def summed(counts: DataFrame) -> DataFrame:
    """COUNTS added up by one aggregate, which combines before it shuffles, and written to the shared folder."""
    return materialise(counts.groupBy("kind", "at", "name").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")))


def counted(rows: DataFrame, lay: Layout) -> DataFrame:
    """All that a dashboard counts, by one scan of the rows."""
    return summed(told(rows, lay))


def from_counts(counts: DataFrame, lay: Layout) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, dict[str, DataFrame]]:
    """Window, hours, days, minutes and lists, as the single functions give them, from what counted() wrote."""
    spark = counts.sparkSession
    sums = [F.sum("n").alias("pv"), F.count("name").alias("uv"), F.sum("bytes").alias("bytes")]
    of = lambda kind: counts.where(F.col("kind") == kind)
    window = of("window").agg(*[F.coalesce(x, F.lit(0)).cast("long").alias(n) for x, n in zip(sums, ("pv", "uv", "bytes"), strict=True)])
    hours = padded(hour_buckets(spark, lay), of("hour").where("at >= 0").groupBy(F.col("at").alias("bucket")).agg(*sums), "bucket", ["pv", "uv", "bytes"])
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.col("at").cast("int")).alias("day")
    days = padded(day_grid(spark, lay), of("day").groupBy(day).agg(*sums), "day", ["pv", "uv", "bytes"])
    minute = of("minute").select(F.col("at").alias("minute"), F.col("n").alias("pv"))
    lists = {}
    for name, (_, n) in FACETS.items():
        top = of(name).select(F.col("name").alias("key"), F.col("n").alias("value")).orderBy(F.col("value").desc(), "key").limit(n)
        lists[name] = top.join(F.broadcast(window.select("pv"))).select("key", "value", (F.col("value") * 100.0 / F.col("pv")).alias("percent"))  # one row
    return window, hours, days, minute, lists


def response(window: DataFrame, hours: DataFrame, days: DataFrame, minute: DataFrame, lists: dict[str, DataFrame], lay: Layout) -> dict[str, DataFrame]:
    """The frames of a dashboard, however they were counted. Series and lists are empty, and figures 0, if the window has no views. The window is counted once."""
    window = materialise(window)
    some = F.broadcast(window.where("pv > 0").select(F.lit(1).alias("_some")))  # one row or none
    shown = {k: f.join(some).drop("_some") for k, f in {"hourly": hour_labels(hours, lay), "daily": days, **lists}.items()}
    figures = overview(window, shown["hourly"], shown["daily"], minute, lay).withColumn("peak_hour", F.coalesce("peak_hour", F.lit(0).cast("long")))
    return {"overview": figures, **shown}


def dashboard(rows: DataFrame, lay: Layout) -> dict[str, DataFrame]:
    """All frames of a dashboard from the rows themselves, which are scanned once.

    Error rows aren't left out here: a dashboard of all groups counts them as views.
    """
    return response(*from_counts(counted(rows, lay), lay), lay)
