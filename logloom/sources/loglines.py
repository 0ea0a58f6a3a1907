"""Log files: fingerprints, reading plans and the ``loglines`` data source.

A plan says for each file where reading starts. The driver makes it from file states; executors read,
a task for each file or, for large plain ones, for each slice of it. Files must be reachable by path
from the executors, as log folders mounted on them are.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import os
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from logloom.sources.logs import main_log_path

#: The longest line that is read, and how much of a first line makes the fingerprint.
LONGEST_LINE, FIRST_LINE = 1 << 20, 4096
#: Plain files are read in slices of so many bytes, some 64,000 lines: as many tasks parse them, and take them apart into tokens.
SLICE = 16 << 20
#: ``upto``: the offset after the line.
SCHEMA = "raw string, off long, fp string, path string, main_log_path string, upto long"
_NAMES, _TYPES = ["raw", "off", "fp", "path", "main_log_path", "upto"], [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
#: Rows that are handed on at a time.
BATCH = 4096


def is_gzip(path: str) -> bool:
    if not path.lower().endswith(".gz"):
        return False
    with open(path, "rb") as f:
        return f.read(2) == b"\x1f\x8b"


def gzip_size(path: str) -> int:
    """The last member's size modulo 2^32, as its end says."""
    with open(path, "rb") as f:
        f.seek(0, os.SEEK_END)
        if f.tell() < 18:
            return 0
        f.seek(-4, os.SEEK_END)
        return int.from_bytes(f.read(4), "little")


def fingerprint(path: str) -> str | None:
    """32 hexadecimal digits of the first line; None while a plain file's first line isn't ended."""
    zipped = is_gzip(path)
    with gzip.open(path) if zipped else open(path, "rb") as f:
        data = f.read(FIRST_LINE + 64)
    start = len(data) - len(data.lstrip(b"\r\n"))
    line, newline, _ = data[start : start + FIRST_LINE].partition(b"\n")
    if not line or (not newline and not zipped and len(line) < FIRST_LINE):
        return None
    return hashlib.sha256(line.rstrip(b"\r")).hexdigest()[:32]


@dataclass(frozen=True)
class FileState:
    """How far a file was read: ``position`` in content bytes, ``size`` and time as they were."""

    path: str
    fingerprint: str
    position: int
    size: int
    mtime_ns: int
    indexed_at: int = 0


@dataclass(frozen=True)
class FilePlan:
    """Read ``path`` from ``start`` up to ``size``; ``replace``: content of this fingerprint from there on is deleted first."""

    path: str
    fingerprint: str
    start: int
    size: int
    mtime_ns: int
    replace: bool = False
    skip: bool = False


def plan_file(path: str, states: dict[str, FileState], high_water: Callable[[str], int], force: bool = False, dirty: bool = False) -> FilePlan | None:
    """The plan of a file; None if it can't be told apart yet.

    The same path and first line continue; a shorter one was rewritten and starts again. Otherwise
    the file takes the place of the furthest other path with its first line, as renamed or copied
    files do. Reading that starts below what the content has already been read to replaces it.
    """
    stat = os.stat(path)
    own = states.get(path)
    if own and not force and not dirty and own.size == stat.st_size and own.mtime_ns == stat.st_mtime_ns:
        return FilePlan(path, own.fingerprint, own.position, stat.st_size, stat.st_mtime_ns, skip=True)
    fp = fingerprint(path)
    if fp is None:
        return None
    zipped = is_gzip(path)
    size = gzip_size(path) if zipped else stat.st_size
    rewritten = False
    if force:
        start = 0
    elif own and own.fingerprint == fp:
        rewritten = not zipped and stat.st_size < own.position
        start = 0 if rewritten else own.position
    else:
        others = [s.position for s in states.values() if s.fingerprint == fp and s.path != path]
        start = max(others, default=0)
        start = start if zipped else min(start, size)
    if zipped and not force and 0 < start < 1 << 32 and start == size:
        return FilePlan(path, fp, start, stat.st_size, stat.st_mtime_ns, skip=True)
    return FilePlan(path, fp, start, stat.st_size, stat.st_mtime_ns, replace=rewritten or dirty or start < high_water(fp))


def read_lines(path: str, start: int, size: int, stop: int | None = None) -> Iterator[tuple[int, bytes, int]]:
    """(offset, line without its end, offset after it) from ``start`` up to ``size`` bytes of the file.

    Empty lines and those over LONGEST_LINE are skipped but count. A last line without an end waits in
    a plain file and counts in a gzip one, which is decoded up to ``start``. ``stop``: lines that start there or later aren't read.
    """
    zipped = is_gzip(path)
    with gzip.open(path) if zipped else open(path, "rb") as f:
        if zipped:
            left = start
            while left and (got := f.read(min(left, 1 << 20))):
                left -= len(got)
        else:
            f.seek(start)
        at = start
        while (stop is None or at < stop) and (zipped or at < size):
            most = LONGEST_LINE + 1 if zipped else min(LONGEST_LINE + 1, size - at)
            line = f.readline(most)
            if not line:
                return
            end = at + len(line)
            if not line.endswith(b"\n") and len(line) > LONGEST_LINE:
                while not line.endswith(b"\n") and (zipped or end < size) and (line := f.readline(1 << 16 if zipped else min(1 << 16, size - end))):
                    end += len(line)
                if not line.endswith(b"\n") and not zipped:
                    return
                at = end
                continue
            if not line.endswith(b"\n") and not zipped:
                return
            body = line.strip(b"\r\n")
            if body:
                yield at, body, end
            at = end


def gzip_length(path: str) -> int:
    """Bytes of content, all members; the file is decoded."""
    n = 0
    with gzip.open(path) as f:
        while got := f.read(1 << 20):
            n += len(got)
    return n


def gzip_lengths(spark: SparkSession, paths: list[str]) -> dict[str, int]:
    """gzip_length() of files, on the executors, a task for each; one row a file comes back."""
    if not paths:
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([gzip_length(p) for p in batch.column(0).to_pylist()], pa.int64())], ["path", "n"])

    asked = spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths), "path")
    return {r["path"]: r["n"] for r in asked.mapInArrow(run, "path string, n long").collect()}


def end_of(plan: FilePlan, lengths: dict[str, int]) -> int:
    """Where reading a plan ends: after the last ended line. Only the tail of a plain file is looked at; of gzip files ``lengths`` tells."""
    if is_gzip(plan.path):
        return max(lengths[plan.path], plan.start)
    with open(plan.path, "rb") as f:
        at = plan.size
        while at > plan.start:
            begin = max(plan.start, at - (1 << 16))
            f.seek(begin)
            k = f.read(at - begin).rfind(b"\n")
            if k >= 0:
                return begin + k + 1
            at = begin
    return plan.start


@dataclass
class Slice(InputPartition):
    """Lines of a file that start in [start, stop); ``aligned``: the first byte starts a line."""

    path: str
    fp: str
    start: int
    stop: int | None
    size: int
    aligned: bool = True


def slices(path: str, fp: str, start: int, size: int) -> list[Slice]:
    if is_gzip(path):
        return [Slice(path, fp, start, None, size)]
    return [Slice(path, fp, a, min(a + SLICE, size), size, a == start) for a in range(start, size, SLICE)]


def read_slice(part: Slice) -> Iterator[tuple]:
    """Rows of SCHEMA; they carry half of the fingerprint. A line that starts before a slice belongs to the one before."""
    start = part.start
    if not part.aligned:
        with open(part.path, "rb") as f:
            f.seek(start - 1)
            while start < part.size and (got := f.readline(1 << 20)):
                start = f.tell()
                if got.endswith(b"\n"):
                    break
    main = main_log_path(part.path)
    for at, line, end in read_lines(part.path, start, part.size, part.stop):
        yield line.decode("utf-8", "replace"), at, part.fp[:16], part.path, main, end


class _Reader(DataSourceReader):
    def __init__(self, plans: list[dict]) -> None:
        self.plans = plans

    def partitions(self) -> list[InputPartition]:
        return [x for p in self.plans for x in slices(p["path"], p["fingerprint"], p["start"], p["size"])] or [Slice("", "", 0, 0, 0)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        rows = read_slice(partition) if partition.path else iter(())
        while some := list(islice(rows, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), _TYPES, strict=True)], _NAMES)


class LogLines(DataSource):
    """``spark.read.format("loglines").option("plans", json)``: raw, off, fp, path, main_log_path of planned files."""

    @classmethod
    def name(cls) -> str:
        return "loglines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(json.loads(self.options["plans"]))


def read_plans(spark, plans: list[FilePlan]):
    """The lines of plans that aren't skipped."""
    spark.dataSource.register(LogLines)
    return spark.read.format("loglines").option("plans", json.dumps([asdict(p) for p in plans if not p.skip])).load()


def after(plan: FilePlan, now: int, lengths: dict[str, int]) -> FileState:
    """The file's state once its plan is read."""
    position = plan.start if plan.skip else end_of(plan, lengths)
    return FileState(plan.path, plan.fingerprint, position, plan.size, plan.mtime_ns, now)
