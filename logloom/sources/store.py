"""The store: tables of log rows and rollups in generations.

A commit writes new Parquet folders, a segment, and then one manifest that names the live segments of each group, file
states and marks. A manifest is written aside and renamed to the next number, which must be free; readers
take the highest number, so they see the old or the new generation whole. A failed commit leaves only folders
that nothing names. Files are reached through Spark's file systems alone.

Folders are never changed. Content that is deleted is named in its segment, as ranges of offsets of a fingerprint, and left out on
reading; the hours it lay in are rolled up again, on their own. The manifest has the rows and times of each segment, so that
what a group holds is told without a job. Segments of one size are merged when there are FAN of them.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from logloom.functions.geo import folded, range_lookup
from logloom.functions.ip import ip_hex
from logloom.functions.parse import access_rows, error_rows
from logloom.functions.tokens import count_packed, pack_atoms, pack_full, pack_tokens, unpacked
from logloom.functions.useragent import clients
from logloom.operators.dashboard import HOUR
from logloom.operators.postings import PAGE, POSTINGS, STORED, index, told
from logloom.operators.rollup import HOURS, Rollup, build, merge, sums
from logloom.shared import look_up, materialise
from logloom.sources.loglines import FileState
from logloom.sources.places import Places

#: Another number means another schema: the store is then empty and logs are read again.
FORMAT = 5
#: Columns of tokens, which are stored packed.
TOKENED = ["raw_tok", "path_tok", "ua_tok", "ref_tok"]
ROLLUPS = ("hours", "minutes", "visitors", "terms")
TABLES = ("rows", *ROLLUPS, POSTINGS)
#: So many segments of a size class, powers of this, are merged; and a segment of whose rows more than this share is deleted is written anew.
FAN, MOST_DELETED = 8, 0.3
#: A group whose rollups have over so many entries, and over half as many as it has rows, is answered from its rows.
ROLLUP_FLOOR = 1 << 20
#: So many manifests stay, for readers that have just looked.
KEPT = 8
GEO = ["region_code", "province", "city", "sub1", "sub2", "city_point", "c1", "c2", "c3", "c4"]
#: Content of a fingerprint from an offset up to another, or to its end.
Range = tuple[str, int, int | None]


@dataclass
class Segment:
    """Folders that one commit or merge wrote: ``id`` names that of the rows, and each of ``rollups`` those of a rollup and the hours of it that no longer count.

    ``rows``, ``first`` and ``last`` are of the rows that ``gone`` leaves; ``dropped`` are those that it takes. ``fps`` and ``offs``
    are the least and greatest of all rows. ``tokens``: of the raw lines of ``rows``, if they have any. ``indexed``: whether it has postings.
    """

    id: str
    rows: int = 0
    dropped: int = 0
    first: int | None = None
    last: int | None = None
    fps: list[str] = field(default_factory=list)
    offs: list[int] = field(default_factory=list)
    gone: list[list] = field(default_factory=list)
    rollups: list[dict] = field(default_factory=list)
    entries: int = 0
    tokens: int | None = None
    indexed: bool = False

    def touched(self, ranges: list[Range]) -> list[Range]:
        """The ranges that may hold rows of this segment."""
        if not self.fps:
            return []
        return [r for r in ranges if self.fps[0] <= r[0] <= self.fps[1] and r[1] <= self.offs[1] and (r[2] is None or r[2] > self.offs[0])]

    def seen(self, rows: DataFrame) -> DataFrame:
        """Of all its rows those that aren't deleted."""
        return rows.where(~within(self.gone)) if self.gone else rows


@dataclass
class Manifest:
    """``parts``: group -> segments. ``states``: group -> file states. ``dirty``: groups with an unfinished import. ``marks``: the last streamed batch of a group."""

    format: int = FORMAT
    generation: int = 0
    parts: dict[str, list[dict]] = field(default_factory=dict)
    states: dict[str, list[dict]] = field(default_factory=dict)
    dirty: list[str] = field(default_factory=list)
    marks: dict[str, str] = field(default_factory=dict)

    def segments(self, groups: list[str] | None = None) -> list[Segment]:
        return [Segment(**s) for g, held in self.parts.items() if groups is None or g in groups for s in held]


def within(ranges: list) -> Column:
    """Whether a row's content lies in one of the ranges."""
    hits = [(F.col("fp") == fp) & (F.col("off") >= a) & (F.lit(True) if b is None else F.col("off") < b) for fp, a, b in ranges]
    return reduce(Column.__or__, hits, F.lit(False))


def tier(segments: list[Segment]) -> list[Segment]:
    """The segments to merge next: all of the smallest size class that has FAN of them, or one with too many deleted rows.

    A row is written again when its segment grows into the next class, so over n appends about log n times.
    """
    classes: dict[int, list[Segment]] = {}
    for s in segments:
        size = 0
        while FAN ** (size + 1) <= s.rows:
            size += 1
        classes.setdefault(size, []).append(s)
    for size in sorted(classes):
        if len(classes[size]) >= FAN:
            return classes[size]
    return next(([s] for s in segments if s.dropped > MOST_DELETED * (s.rows + s.dropped)), [])


def enrich(lines: DataFrame, kind: str, now: int, zone: str = "UTC", locations: DataFrame | Places | None = None) -> DataFrame:
    """Log rows of ``raw, off, fp, main_log_path`` lines, with packed tokens, names of clients and locations.

    Lines are read and parsed once, to a table. Names are looked up for each different agent of it, places for each
    different address, and joined without moving rows where there are few of them.
    ``locations``: databases, or a table of some of GEO by ip_hex, one row each, or by lo and hi, blocks of addresses; without it they're null.
    """
    base = lines.select("raw", "off", "fp", "main_log_path")
    rows = materialise((access_rows(base, now) if kind == "access" else error_rows(base, now, zone)).withColumn("ip_hex", ip_hex("ip")))
    named = clients(rows).select("user_agent", *[F.nullif(F.col(c), F.lit("")).alias(c) for c in ("browser", "os", "device_type")])
    rows = look_up(rows, named, "user_agent")
    if isinstance(locations, Places):
        rows = look_up(rows, locations.locate(rows), "ip_hex")
    else:
        held = [c for c in GEO if locations is not None and c in locations.columns]
        if held:
            found = range_lookup(rows, locations.select("lo", "hi", *held)) if "lo" in locations.columns else locations.select("ip_hex", *held)
            rows = look_up(rows, found, "ip_hex")
        rows = rows.withColumns({c: F.lit(None).cast("string") for c in GEO if c not in held})
        country, sub1, sub2 = folded(F.col("region_code"), F.col("sub1"), F.col("sub2"))
        rows = rows.withColumns({"region_code": country, "sub1": sub1, "sub2": sub2}) if held else rows
    # packed, a row's tokens are four texts on their way from Python to the files, instead of some seventy structs
    return rows.withColumns({"raw_tok": pack_full("raw"), "path_tok": pack_atoms("path"), "ua_tok": pack_atoms("user_agent"), "ref_tok": pack_atoms("referer")})



class Store:
    """``indexed``: whether commits write postings, which take about as long as the rows."""

    def __init__(self, spark: SparkSession, path: str, rollup_floor: int = ROLLUP_FLOOR, indexed: bool = False) -> None:
        self.spark, self.path, self.rollup_floor, self.indexed = spark, path.rstrip("/"), rollup_floor, indexed
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.commons.io.IOUtils

    def _at(self, name: str):
        return self._path(f"{self.path}/{name}")

    def _manifests(self) -> list[tuple[int, str]]:
        """Numbers and names of the manifests that are there, the newest first."""
        if not self._fs.exists(self._at("")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(""))]
        return sorted(((int(n.removeprefix("manifest-")), n) for n in names if re.fullmatch(r"manifest-\d+", n)), reverse=True)

    def manifest(self) -> Manifest:
        for number, name in self._manifests():
            try:
                stream = self._fs.open(self._at(name))
            except Py4JJavaError:  # deleted as an old one meanwhile: a newer one stands
                return self.manifest()
            try:
                got = json.loads(self._io.toString(stream, "UTF-8"))
            finally:
                stream.close()
            return Manifest(**got) if got.get("format") == FORMAT else Manifest(generation=number)
        return Manifest()

    def _publish(self, m: Manifest) -> bool:
        """Whether ``m`` is now the next generation; no, if another one with its number is there already."""
        aside, target = self._at(f".manifest-{uuid.uuid4().hex}"), self._at(f"manifest-{m.generation + 1:012d}")
        out = self._fs.create(aside, True)
        out.write(bytearray(json.dumps(asdict(m) | {"generation": m.generation + 1}).encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._fs.makeQualified(aside), self._fs.makeQualified(target), none)
        except Py4JJavaError as e:
            self._fs.delete(aside, False)
            if "FileAlreadyExistsException" in str(e.java_exception):
                return False
            raise
        m.generation += 1
        for _, name in self._manifests()[KEPT:]:
            self._fs.delete(self._at(name), False)
        return True

    # reading

    def _load(self, table: str, names: list[str], packed: bool = False) -> DataFrame:
        """``packed``: tokens of rows are left as they are stored."""
        if table == POSTINGS:  # one table with a folder for each segment, of which only those asked for are listed
            base = f"{self.path}/{table}"
            return told(self.spark.read.schema(STORED).option("basePath", base).parquet(*[f"{base}/seg={n}" for n in names]))
        held = self.spark.read.parquet(*[f"{self.path}/{table}/{n}" for n in names])
        return held if packed else held.withColumns({c: unpacked(F.col(c)) for c in TOKENED if c in held.columns})

    def _seen(self, segments: list[Segment], table: str = "rows", packed: bool = False) -> DataFrame | None:
        """Rows, or postings, of segments: those without deleted content are one scan."""
        whole = [s.id for s in segments if not s.gone]
        frames = [self._load(table, whole, packed)] if whole else []
        frames += [s.seen(self._load(table, [s.id], packed)) for s in segments if s.gone]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None

    def _rolled(self, segments: list[Segment], table: str) -> DataFrame | None:
        time = F.col("minute" if table == "minutes" else "hour")
        parts = [r for s in segments for r in s.rollups]
        whole = [r["id"] for r in parts if not r["without"]]
        frames = [self._load(table, whole)] if whole else []
        for r in parts:
            if r["without"]:
                stale = reduce(Column.__or__, [time.between(a, b + HOUR - 1) for a, b in r["without"]])
                frames.append(self._load(table, [r["id"]]).where(~stale))
        return reduce(DataFrame.unionByName, frames) if frames else None

    def rows(self, groups: list[str] | None = None, start: int | None = None, end: int | None = None) -> DataFrame | None:
        """Log rows of the live generation, None if there are none; folders of other groups, and those without rows in [start, end), aren't even listed."""
        segments = self.manifest().segments(groups)
        timely = [s for s in segments if s.rows and (start is None or s.last >= start) and (end is None or s.first < end)]
        return self._seen(timely or segments[-1:])

    def postings(self, groups: list[str] | None = None, start: int | None = None, end: int | None = None) -> DataFrame | None:
        """Tokens of the live rows, by term; None if there are no rows, or some were committed without postings."""
        segments = self.manifest().segments(groups)
        timely = [s for s in segments if s.rows and (start is None or s.last >= start) and (end is None or s.first < end)]
        return None if any(not s.indexed for s in segments) else self._seen(timely or segments[-1:], POSTINGS)

    def rollup(self, groups: list[str] | None = None) -> Rollup | None:
        """None if there is nothing, or if a rollup is as good as no smaller than its rows."""
        segments = self.manifest().segments(groups)
        entries = sum(s.entries for s in segments)
        if entries > self.rollup_floor and 2 * entries > sum(s.rows for s in segments):
            return None
        frames = [self._rolled(segments, t) for t in ROLLUPS]
        return None if any(f is None for f in frames) else merge(Rollup(*frames))

    def hours(self, groups: list[str] | None = None) -> DataFrame | None:
        """The hours of rollup(), which are few however large its other tables are; None if there is nothing."""
        held = self._rolled(self.manifest().segments(groups), "hours")
        return None if held is None else sums(held, HOURS)

    def figures(self, groups: list[str] | None = None) -> dict[str, dict]:
        """docs, first and last, and tokens, of each group that has rows: from the manifest, without a job."""
        out = {}
        for group, held in self.manifest().parts.items():
            some = [s for s in map(lambda x: Segment(**x), held) if s.rows]
            if some and (groups is None or group in groups):
                out[group] = {"docs": sum(s.rows for s in some), "first": min(s.first for s in some), "last": max(s.last for s in some), "tokens": sum(s.tokens or 0 for s in some)}
        return out

    def states(self, group: str) -> dict[str, FileState]:
        return {s["path"]: FileState(**s) for s in self.manifest().states.get(group, [])}

    def mark(self, group: str) -> str | None:
        return self.manifest().marks.get(group)

    # writing

    def _write(self, df: DataFrame, table: str, name: str) -> None:
        df.write.option("compression", "zstd").parquet(f"{self.path}/{table}/{name}")

    def _roll(self, rolled: Rollup) -> tuple[str, int]:
        """A new rollup's name and how many entries it has."""
        name = uuid.uuid4().hex
        for table, frame in rolled.frames().items():
            self._write(frame, table, name)
        counts = [self._load(t, [name]).select(F.lit(t)) for t in ROLLUPS]
        return name, reduce(DataFrame.unionAll, counts).count()

    def _segment(self, rows: DataFrame, rolled: Rollup | None = None) -> Segment:
        """Writes rows and their rollup, which is made from what was written if it isn't given, and tells of them."""
        s = Segment(uuid.uuid4().hex)
        rows = rows.withColumns({c: pack_tokens(F.col(c)) for c in TOKENED if c in rows.columns and not isinstance(rows.schema[c].dataType, StringType)})
        self._write(rows.sortWithinPartitions("ts"), "rows", s.id)
        written = self._load("rows", [s.id], packed=True)
        tokens = (F.sum(count_packed(F.col("raw_tok"))) if "raw_tok" in written.columns else F.max(F.lit(None))).cast("long")
        one = written.agg(F.count("*").alias("n"), *[f(c).alias(f"{k}_{c}") for c in ("ts", "fp", "off") for k, f in (("min", F.min), ("max", F.max))], tokens.alias("tokens")).first()
        s.rows, s.first, s.last = one["n"], one["min_ts"], one["max_ts"]
        if one["n"]:
            s.fps, s.offs = [one["min_fp"], one["max_fp"]], [one["min_off"], one["max_off"]]
        s.tokens = one["tokens"]
        if self.indexed and "raw_tok" in written.columns:
            index(written).write.option("compression", "zstd").option("parquet.page.row.count.limit", PAGE).partitionBy("bucket").parquet(f"{self.path}/{POSTINGS}/seg={s.id}")
            s.indexed = True
        name, s.entries = self._roll(rolled or build(written))
        s.rollups = [{"id": name, "without": []}]
        return s

    def _without(self, s: Segment, ranges: list[Range], known: dict[str, Segment]) -> Segment:
        """The segment less the content of ``ranges``: its folders stay, and the hours that lost rows get a rollup of their own."""
        ranges = s.touched(ranges)
        key = json.dumps([asdict(s), ranges])
        if not ranges:
            return s
        if key not in known:
            rows = s.seen(self._load("rows", [s.id], packed=True))
            hit, hour = within(ranges), F.col("ts") - F.pmod("ts", F.lit(HOUR))
            lost = lambda f, c: f(F.when(hit, c))
            left = lambda f, c: f(F.when(~hit, c))
            words = (F.sum(F.when(~hit, count_packed(F.col("raw_tok")))) if "raw_tok" in rows.columns else F.max(F.lit(None))).cast("long")
            one = rows.agg(words.alias("tokens"), lost(F.count, F.lit(1)).alias("n"), lost(F.min, hour).alias("a"), lost(F.max, hour).alias("b"), left(F.min, F.col("ts")).alias("first"), left(F.max, F.col("ts")).alias("last")).first()
            known[key] = s
            if one["n"]:
                made = replace(s, rows=s.rows - one["n"], dropped=s.dropped + one["n"], first=one["first"], last=one["last"], tokens=one["tokens"], gone=[*s.gone, *map(list, ranges)])
                stale = [one["a"], one["b"]]
                name, entries = self._roll(build(rows.where(~hit).where(F.col("ts").between(stale[0], stale[1] + HOUR - 1))))
                made.rollups = [{"id": r["id"], "without": [*r["without"], stale]} for r in s.rollups] + [{"id": name, "without": []}]
                made.entries = s.entries + entries
                known[key] = made
        return known[key]

    def commit(
        self, group: str, rows: DataFrame | None, states: list[FileState] = (), delete: list[tuple[str, int]] = (), dirty: bool | None = False, mark: str | None = None,
        reads: list[tuple[str, int, int]] = (), forget: list[str] = (),
    ) -> None:
        """One generation: deletes (fingerprint, from offset), new rows with their rollup, and changed file states.

        Folders are written first. The manifest is then read again, changed, and published as the next number; if another
        writer has taken that, it is read again. So commits that run together all count.
        ``reads``: (fingerprint, from, up to) that the rows come from. What another commit has stored of it meanwhile is left out of them, and a file's
        position never falls but where its content is deleted: no line is stored twice. ``forget``: paths whose states go.
        ``dirty`` of None leaves as it is whether the group's import is unfinished.
        """
        new, known, starts = self._segment(rows) if rows is not None else None, {}, dict(delete)
        while True:
            m = self.manifest()
            held = {s["path"]: FileState(**s) for s in m.states.get(group, [])}
            parts = [self._without(Segment(**s), [(fp[:16], at, None) for fp, at in delete], known) for s in m.parts.get(group, [])]
            if new:
                reached = lambda fp: max((s.position for s in held.values() if s.fingerprint == fp), default=0)  # noqa: E731, B023
                again = [(fp[:16], a, min(b, reached(fp))) for fp, a, b in reads if fp not in starts and reached(fp) > a]
                parts.append(self._without(new, again, known))
            if parts:
                m.parts[group] = [asdict(s) for s in [s for s in parts if s.rows] or parts[-1:]]
            for s in held.values():
                if s.fingerprint in starts and s.position > starts[s.fingerprint]:
                    held[s.path] = replace(s, position=starts[s.fingerprint])
            for s in states:
                old = held.get(s.path)
                if not (old and old.fingerprint == s.fingerprint and old.position > s.position):
                    held[s.path] = s
            m.states[group] = [asdict(s) for path, s in held.items() if path not in forget]
            if mark is not None:
                m.marks[group] = mark
            if dirty is not None:
                m.dirty = sorted({*m.dirty, group} if dirty else {*m.dirty} - {group})
            if self._publish(m):
                return

    def purge(self, group: str | None = None) -> None:
        """Forgets one group or all, with the marks of their streams; old folders stay until vacuum()."""
        while True:
            m = self.manifest()
            for g in [group] if group else list({*m.parts, *m.states, *m.marks}):
                for held in (m.parts, m.states, m.marks):
                    held.pop(g, None)
            m.dirty = [] if group is None else [g for g in m.dirty if g != group]
            if self._publish(m):
                return

    def compact(self, group: str) -> int:
        """Merges segments, a size class at a time, and gives the number of rows written; left to the next time if another commit changes them meanwhile."""
        written = 0
        while some := tier(self.manifest().segments([group])):
            made = self._segment(self._seen(some, packed=True), merge(Rollup(*[self._rolled(some, t) for t in ROLLUPS])))
            written += made.rows
            old = [asdict(s) for s in some]
            while True:
                m = self.manifest()
                now = m.parts.get(group, [])
                if any(s not in now for s in old):
                    return written
                at = now.index(old[0])
                m.parts[group] = [s for s in now[:at] if s not in old] + [asdict(made)] + [s for s in now[at:] if s not in old]
                if self._publish(m):
                    break
        return written

    def vacuum(self) -> None:
        """Deletes folders that the live manifest doesn't name. Not while other readers or writers are at work."""
        segments = self.manifest().segments()
        live = {s.id for s in segments} | {r["id"] for s in segments for r in s.rollups}
        for table in TABLES:
            if self._fs.exists(self._at(table)):
                for s in self._fs.listStatus(self._at(table)):
                    if s.getPath().getName().removeprefix("seg=") not in live:
                        self._fs.delete(s.getPath(), True)
