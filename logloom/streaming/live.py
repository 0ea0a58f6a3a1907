"""Live logs as a stream: ``spark.readStream.format("livelogs")``.

A stream offset is the position in each file of a group, by fingerprint, so that a renamed file goes on where it
was. A batch reads from one offset to the next, large files in slices; the query's checkpoint keeps the offsets, so a
restarted query reads each line once. A new query starts where the store's file states are, and its batches move them on, so
that a round over the same log reads on from there; lines that a round stores while a batch reads them are left out of it.
Files that were rewritten are read again from their start; replacing their old rows is the work of rounds.py.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from logloom.shared import collected, materialise, release
from logloom.sources.loglines import SCHEMA, FilePlan, FileState, Slice, end_of, fingerprint, gzip_length, is_gzip, read_slice, slices
from logloom.sources.logs import main_log_path
from logloom.sources.store import Store, enrich


class _Stream(DataSourceStreamReader):
    def __init__(self, base: str, start: dict[str, int]) -> None:
        self.base, self.start = base, start
        self.lengths: dict[tuple, int] = {}

    def _files(self) -> dict[str, str]:
        """Path by fingerprint, the live file before its copies."""
        folder, name = os.path.split(self.base)
        paths = sorted(os.path.join(folder, f) for f in os.listdir(folder) if f.startswith(name)) if os.path.isdir(folder) else []
        out: dict[str, str] = {}
        for p in paths:
            if main_log_path(p) == main_log_path(self.base) and os.path.isfile(p) and (fp := fingerprint(p)):
                out.setdefault(fp, p)
        return out

    def initialOffset(self) -> dict:
        return self.start

    def latestOffset(self) -> dict:
        """After the last ended line of each file."""
        return {fp: end_of(FilePlan(path, fp, 0, os.path.getsize(path), 0), self._length(path)) for fp, path in self._files().items()}

    def _length(self, path: str) -> dict[str, int]:
        """The content's length of a gzip copy, decoded once for each size and time it has."""
        if not is_gzip(path):
            return {}
        stat = os.stat(path)
        key = path, stat.st_size, stat.st_mtime_ns
        if key not in self.lengths:
            self.lengths[key] = gzip_length(path)
        return {path: self.lengths[key]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        files = self._files()
        out: list[InputPartition] = []
        for fp, stop in end.items():
            begin = start.get(fp, 0) if start.get(fp, 0) <= stop else 0
            if fp in files and begin < stop:
                out += slices(files[fp], fp, begin, stop)
        return out

    def read(self, partition: Slice) -> Iterator[tuple]:
        yield from read_slice(partition)

    def commit(self, end: dict) -> None:
        """Nothing is kept outside the query's checkpoint."""


class LiveLogs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "livelogs"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options["base"], json.loads(self.options.get("start", "{}")))


def live_lines(spark: SparkSession, base: str, start: dict[str, int] | None = None) -> DataFrame:
    """The lines of a log and its rotations; ``start``: offsets by fingerprint that a query without a checkpoint begins at."""
    spark.dataSource.register(LiveLogs)
    return spark.readStream.format("livelogs").option("base", base).option("start", json.dumps(start or {})).load()


def reached(states: Iterable[FileState]) -> dict[str, int]:
    """By fingerprint how far its content was read."""
    out: dict[str, int] = {}
    for s in states:
        out[s.fingerprint] = max(out.get(s.fingerprint, 0), s.position)
    return out


def follow(store: Store, base: str, kind: str, now: int, checkpoint: str, zone: str = "UTC", every: str | None = None) -> StreamingQuery:
    """Commits each batch of a log's new lines to the store, with the states of their files; a batch that was committed before a crash isn't committed again.

    ``every``: a time like ``15 minutes`` between batches; without it they follow each other.
    """
    group = main_log_path(base)

    def commit(batch: DataFrame, batch_id: int) -> None:
        mark = json.dumps({"stream": checkpoint, "batch": batch_id})
        if store.mark(group) == mark:
            return
        lines = materialise(batch)
        states, reads = [], []
        # a row for each file of the log
        for path, fp, start, stop in lines.groupBy("path", "fp").agg(F.min("off"), F.max("upto")).collect():
            whole = fingerprint(path) if os.path.exists(path) else None
            if whole and whole.startswith(fp):
                # without size and time, so that a round looks at the file, and reads on from here
                states.append(FileState(path, whole, stop, stop, 0, now))
                reads.append((whole, start, stop))
        with collected() as made:
            store.commit(group, enrich(lines, kind, now, zone), states, dirty=None, mark=mark, reads=reads)
        release(lines, *made)

    stream = live_lines(store.spark, base, reached(store.states(group).values())).writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (stream.trigger(processingTime=every) if every else stream).start()
