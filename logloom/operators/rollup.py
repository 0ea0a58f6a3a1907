"""Hourly rollups that always agree with a direct scan.

Four narrow tables keyed by group and UTC hour: figures, minutes, visitors and terms. Names are kept as
they are, so distinct counts are exact and tables merge by being aggregated again. A window takes whole
hours from the rollups and the cut hours at its edges from the rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.operators import dashboard as d
from logloom.operators.dashboard import HOUR, Layout, hour_of
from logloom.operators.stats import status_class
from logloom.shared import materialise

GROUP = "main_log_path"
#: The keys of the hours.
HOURS = [GROUP, "hour"]
#: The column of each kind of term.
TERMS = {"url": "path", "browser": "browser", "os": "os", "device": "device_type"}
_KIND = {"browsers": "browser", "systems": "os", "devices": "device", "urls": "url"}


@dataclass(frozen=True)
class Rollup:
    hours: DataFrame
    minutes: DataFrame
    visitors: DataFrame
    terms: DataFrame

    def frames(self) -> dict[str, DataFrame]:
        return {"hours": self.hours, "minutes": self.minutes, "visitors": self.visitors, "terms": self.terms}


def build(rows: DataFrame) -> Rollup:
    """The rollup of log rows; empty terms don't count."""
    h = rows.withColumn("hour", hour_of(F.col("ts")))
    classes = [F.count(F.when(status_class(F.col("status")) == k, 1)).alias(f"s{k}") for k in range(1, 6)]
    other = F.count(F.when(F.coalesce(status_class(F.col("status")), F.lit(0)) == 0, 1)).alias("s0")
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.nullif(F.col(c), F.lit("")).alias("term")) for k, c in TERMS.items()])
    return Rollup(
        h.groupBy(GROUP, "hour").agg(F.count("*").alias("pv"), F.coalesce(F.sum("bytes_sent"), F.lit(0)).cast("long").alias("bytes"), other, *classes),
        h.groupBy(GROUP, (F.col("ts") - F.pmod("ts", F.lit(60))).alias("minute")).agg(F.count("*").alias("pv")),
        h.where("ip is not null").select(GROUP, "hour", "ip").distinct(),
        h.select(GROUP, "hour", F.explode(pairs).alias("x")).select(GROUP, "hour", "x.*").where("term is not null").groupBy(GROUP, "hour", "kind", "term").agg(F.count("*").alias("n")),
    )


def sums(table: DataFrame, keys: list[str]) -> DataFrame:
    """Entries of several rollups by their keys, all else added up."""
    return table.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in table.columns if c not in keys])


def merge(*parts: Rollup) -> Rollup:
    """The rollup of all rows of all parts."""
    union = lambda name: reduce(DataFrame.unionByName, [getattr(p, name) for p in parts])
    return Rollup(
        sums(union("hours"), HOURS), sums(union("minutes"), [GROUP, "minute"]), union("visitors").distinct(), sums(union("terms"), [GROUP, "hour", "kind", "term"]),
    )


def cuts(lay: Layout) -> list[int]:
    """Hours that an edge of the window, the scan or a day cuts: their rows are read, all other hours are taken whole."""
    points = [lay.start, lay.end, *lay.scan, *[p for _, a, b in lay.days() for p in (a, b)]]
    return sorted({p - p % HOUR for p in points if p % HOUR})


class Hybrid:
    """A dashboard over rollups of ``groups`` and rows of the cut hours."""

    def __init__(self, roll: Rollup, rows: DataFrame, lay: Layout, groups: list[str] | None = None) -> None:
        mine = (lambda df: df.where(F.col(GROUP).isin(groups))) if groups else (lambda df: df)
        self.lay, self.cut = lay, cuts(lay)
        self.roll = Rollup(*[mine(f) for f in roll.frames().values()])
        self.rows = mine(rows)
        edges = F.lit(False)
        for h in self.cut:
            edges = edges | F.col("ts").between(h, h + HOUR - 1)
        self.edges = d.in_scan(self.rows.where(edges), lay) if self.cut else self.rows.limit(0)

    def whole(self, name: str) -> DataFrame:
        """Rollup rows of the scan's hours that aren't cut."""
        f, (a, b) = getattr(self.roll, name), self.lay.scan
        out = f.where((F.col("hour") >= a) & (F.col("hour") < b))
        return out.where(~F.col("hour").isin(self.cut)) if self.cut else out

    def _counted(self, key_hour: Column, key_ts: Column, keep_hour: Column, keep_ts: Column) -> DataFrame:
        """pv, uv and bytes by a key told from an hour or a row's time."""
        sums = self.whole("hours").where(keep_hour).select(key_hour.alias("key"), "pv", "bytes").unionByName(
            self.edges.where(keep_ts).select(key_ts.alias("key"), F.lit(1).cast("long").alias("pv"), F.coalesce("bytes_sent", F.lit(0)).cast("long").alias("bytes"))
        ).groupBy("key").agg(F.sum("pv").alias("pv"), F.sum("bytes").alias("bytes"))
        who = self.whole("visitors").where(keep_hour).select(key_hour.alias("key"), "ip").unionByName(self.edges.where(keep_ts).where("ip is not null").select(key_ts.alias("key"), "ip"))
        return sums.join(who.groupBy("key").agg(F.countDistinct("ip").alias("uv")), "key", "left").select("key", "pv", F.coalesce("uv", F.lit(0)).alias("uv"), "bytes")

    def _inside(self) -> tuple[Column, Column]:
        a, b = self.lay.start, self.lay.end
        return (F.col("hour") >= a) & (F.col("hour") < b), (F.col("ts") >= a) & (F.col("ts") < b)

    @cached_property
    def window(self) -> DataFrame:
        """The window's figures, counted once for all that needs them."""
        return materialise(self.window_figures())

    def window_figures(self) -> DataFrame:
        counted = self._counted(F.lit(0), F.lit(0), *self._inside())
        return counted.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("pv", "uv", "bytes")])

    def hourly(self) -> DataFrame:
        place = lambda c: F.floor((c - self.lay.hour_start) / HOUR)
        counted = self._counted(place(F.col("hour")), place(hour_of(F.col("ts"))), F.lit(True), F.lit(True))
        counted = counted.withColumnRenamed("key", "bucket").where("bucket >= 0")
        return d.padded(d.hour_buckets(self.rows.sparkSession, self.lay), counted, "bucket", ["pv", "uv", "bytes"])

    def daily(self) -> DataFrame:
        day = lambda c: d.local_day(F.col(c), self.lay.zone)
        counted = self._counted(day("hour"), day("ts"), F.lit(True), F.lit(True)).withColumnRenamed("key", "day")
        return d.padded(d.day_grid(self.rows.sparkSession, self.lay), counted, "day", ["pv", "uv", "bytes"])

    def minutes(self) -> DataFrame:
        """From the rollup if the window's start is on a minute, else from the rows."""
        a, b = self.lay.start, self.lay.end
        if a % 60:
            return d.minutes(self.rows, self.lay)
        last = b - b % 60  # a minute that the window's end cuts is counted from rows
        whole = self.roll.minutes.where((F.col("minute") >= a) & (F.col("minute") < last)).groupBy(F.floor((F.col("minute") - a) / 60).alias("minute")).agg(F.sum("pv").alias("pv"))
        return whole.unionByName(d.minutes(self.rows.where(F.col("ts") >= last), self.lay))

    def facet(self, name: str) -> DataFrame:
        kind, n = _KIND[name], d.FACETS[name][1]
        hour, row = self._inside()
        counted = self.whole("terms").where(hour & (F.col("kind") == kind)).select(F.col("term").alias("key"), "n").unionByName(
            self.edges.where(row).select(F.nullif(F.col(TERMS[kind]), F.lit("")).alias("key"), F.lit(1).cast("long").alias("n")).where("key is not null")
        ).groupBy("key").agg(F.sum("n").alias("value"))
        total = self.window.select("pv")
        return counted.orderBy(F.col("value").desc(), "key").limit(n).join(F.broadcast(total)).select("key", "value", (F.col("value") * 100.0 / F.col("pv")).alias("percent"))  # one row

    def counted(self) -> DataFrame:
        """What dashboard.counted() tells of the rows, from each rollup table and the cut hours' rows, read once."""
        lay, hour = self.lay, F.col("hour")
        inside, _ = self._inside()
        zero, none = F.lit(0).cast("long"), F.lit(None).cast("string")
        places = [("window", inside, F.lit(0)), ("hour", F.lit(True), F.floor((hour - lay.hour_start) / HOUR)), ("day", F.lit(True), d.day_number(hour, lay.zone))]
        each = F.filter(F.array(*[F.when(cond, F.struct(F.lit(kind).alias("kind"), at.cast("long").alias("at"))) for kind, cond, at in places]), lambda x: x.isNotNull())
        sums = self.whole("hours").select(F.explode(each).alias("x"), "pv", "bytes").select("x.*", none.alias("name"), F.col("pv").alias("n"), "bytes")
        who = self.whole("visitors").select(F.explode(each).alias("x"), "ip").select("x.*", F.col("ip").alias("name"), zero.alias("n"), zero.alias("bytes"))
        named = F.coalesce(*[F.when(F.col("kind") == kind, list_) for list_, kind in _KIND.items()])
        lists = self.whole("terms").where(inside).select(named.alias("kind"), zero.alias("at"), F.col("term").alias("name"), "n", zero.alias("bytes"))
        minutes = self.minutes().select(F.lit("minute").alias("kind"), F.col("minute").cast("long").alias("at"), none.alias("name"), F.col("pv").alias("n"), zero.alias("bytes"))
        return d.summed(reduce(DataFrame.unionByName, [sums, who, lists, minutes, d.told(self.edges, lay, minutes=False)]))

    def dashboard(self) -> dict[str, DataFrame]:
        return d.response(*d.from_counts(self.counted(), self.lay), self.lay)
