"""Indexing rounds: every line of every log is read once, across appends, rotations, rewrites and restarts."""

from __future__ import annotations

import os
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from logloom.shared import collected, release
from logloom.sources.loglines import FilePlan, FileState, after, gzip_lengths, is_gzip, plan_file, read_plans
from logloom.sources.logs import Catalogue
from logloom.sources.places import Places
from logloom.sources.store import Store, enrich

#: At most so many states of files that are gone are kept for a group.
MOST_GONE = 16


class RebuildError(RuntimeError):
    """Why a rebuild can't start: ``busy``, ``group_busy`` or ``not_allowed``."""


@dataclass
class RoundReport:
    groups: list[str] = field(default_factory=list)
    files: int = 0
    removed: list[str] = field(default_factory=list)
    #: Why groups could not be read.
    failed: dict[str, str] = field(default_factory=dict)


@dataclass
class Rounds:
    """Rounds over a catalogue into a store. They never overlap; ``listener`` hears of phases: ``queued`` with a place in the row,
    ``indexing`` with a percentage, ``done``, ``stopped``, and ``failed`` with a message and how often it has failed running. A group that fails doesn't keep others from being read.
    """

    store: Store
    catalogue: Catalogue
    zone: str = "UTC"
    locations: DataFrame | Places | None = None
    listener: Callable[[dict], None] = lambda event: None
    #: Bytes of log files that one commit takes.
    batch: int = 256 << 30
    #: Whether a log's file is there.
    found: Callable[[str], bool] = os.path.exists
    _stop: threading.Event = field(default_factory=threading.Event)
    _lock: threading.Lock = field(default_factory=threading.Lock)
    _stale: set[str] = field(default_factory=set)
    busy: set[str] = field(default_factory=set)
    #: Groups that wait in the round at work, and how often groups have failed since they were last read.
    queue: list[str] = field(default_factory=list)
    failures: dict[str, int] = field(default_factory=dict)

    def cancel(self) -> None:
        """Stops the round after the commit at work. What it has committed stays; the group is dirty, and the next round reads on."""
        self._stop.set()

    def run(self, groups: list[str] | None = None, rebuild: bool = False, now: int | None = None) -> RoundReport | None:
        """One round; None if another is at work."""
        if not self._lock.acquire(blocking=False):
            return None
        now = int(time.time()) if now is None else now
        self._stop.clear()
        try:
            report = RoundReport(removed=self._prune())
            todo = [(g, kind) for g, kind in self.catalogue.groups() if groups is None or g in groups]
            self.queue[:] = [g for g, _ in todo]
            for k, group in enumerate(self.queue):
                self.listener({"group": group, "phase": "queued", "place": k + 1})
            for group, kind in todo:
                if self._stop.is_set():
                    break
                self.queue.remove(group)
                self.busy.add(group)
                self.listener({"group": group, "phase": "indexing"})
                try:
                    n = self._group(group, kind, rebuild, now)
                except Exception as e:
                    self.failures[group] = self.failures.get(group, 0) + 1
                    report.failed[group] = str(e)
                    self.listener({"group": group, "phase": "failed", "message": str(e), "retries": self.failures[group]})
                    continue
                finally:
                    self.busy.discard(group)
                self.failures.pop(group, None)
                if n:
                    report.groups.append(group)
                    report.files += n
                if not self._stop.is_set():
                    self.listener({"group": group, "phase": "done", "files": n})
            return report
        finally:
            self.queue.clear()
            self._lock.release()

    def _group(self, group: str, kind: str, rebuild: bool, now: int) -> int:
        store = self.store
        if rebuild:
            store.purge(group)
        # the states as they were before the round, so that renamed files still find their old place
        states = store.states(group)
        dirty = group in store.manifest().dirty
        reached: dict[str, int] = {}
        for s in states.values():
            reached[s.fingerprint] = max(reached.get(s.fingerprint, 0), s.position)
        plans: list[FilePlan] = []
        for path in self.catalogue.group_files(group):
            plan = plan_file(path, states, lambda fp: reached.get(fp, 0), force=rebuild, dirty=dirty)
            if plan:
                plans.append(plan)
        lengths = gzip_lengths(store.spark, [p.path for p in plans if not p.skip and is_gzip(p.path)])
        done = {p.path: after(p, now, lengths) for p in plans}
        # files of one content: the furthest reads for all
        todo: dict[str, FilePlan] = {}
        for p in plans:
            if not p.skip:
                best = todo.get(p.fingerprint)
                if not best or p.start < best.start or (p.start == best.start and done[p.path].position > done[best.path].position):
                    todo[p.fingerprint] = p
        unchanged = all(p.skip for p in plans) and {p.path for p in plans} == set(states)
        if unchanged and not dirty:
            return 0
        gone = sorted((s for path, s in states.items() if path not in done), key=lambda s: -s.indexed_at)
        forget = [s.path for s in gone[MOST_GONE:]]
        same = {p.path for p in plans if p.skip and p.path in states}
        changed = [s for path, s in done.items() if path not in same]
        batches = self._batches(list(todo.values()), now, lengths)
        whole, read = sum(p.size - p.start for b in batches for p in b), 0
        for k, batch in enumerate(batches):
            delete = [(p.fingerprint, p.start) for p in batch if p.replace]
            ends = [after(p, now, lengths) for p in batch]
            reads = [(p.fingerprint, p.start, s.position) for p, s in zip(batch, ends, strict=True)]
            last = k + 1 == len(batches)
            with collected() as made:
                rows = enrich(read_plans(store.spark, batch), kind, now, self.zone, self.locations)
                store.commit(group, rows, changed if last else ends, delete, dirty=not last, reads=reads, forget=forget if last else ())
            release(*made)
            if not last:
                read += sum(p.size - p.start for p in batch)
                self.listener({"group": group, "phase": "indexing", "percent": 100 * read // max(1, whole)})
                if self._stop.is_set():
                    self.listener({"group": group, "phase": "stopped"})
                    return len(todo)
        if not batches:
            store.commit(group, None, changed, forget=forget)
        store.compact(group)
        return len(todo)

    def _batches(self, plans: list[FilePlan], now: int, lengths: dict[str, int]) -> list[list[FilePlan]]:
        """Plans in batches of about ``batch`` bytes, each committed on its own; large plain files are cut after ended lines."""
        cut: list[FilePlan] = []
        for p in plans:
            upto = p.start + self.batch
            while not is_gzip(p.path) and upto < p.size:
                part = replace(p, size=upto)
                end = after(part, now, lengths).position
                if end > p.start:  # else a line is longer than a batch
                    cut.append(part)
                    p = replace(p, start=end, replace=False)
                upto += self.batch
            cut.append(p)
        out: list[list[FilePlan]] = []
        room = 0
        for p in cut:
            # parts of a file are committed one after the other
            if not out or room < p.size - p.start or any(q.path == p.path for q in out[-1]):
                out.append([])
                room = self.batch
            out[-1].append(p)
            room -= p.size - p.start
        return out

    def _prune(self) -> list[str]:
        """Removes groups that were neither listed nor found in two checks running; an empty catalogue removes nothing."""
        if not self.catalogue.logs:
            return []
        listed = {g for g, _ in self.catalogue.groups()}
        m = self.store.manifest()
        stale = {g for g in {*m.parts, *m.states} if g not in listed and not self.found(g)}
        sure, self._stale = stale & self._stale, stale
        for group in sorted(sure):
            self.store.purge(group)
        return sorted(sure)

    def check_rebuild(self, group: str | None = None) -> list[str] | None:
        """The groups that a rebuild may take, None for all; an error says why it can't."""
        if group is not None and group not in {g for g, _ in self.catalogue.groups()}:
            raise RebuildError("not_allowed")
        if group in self.busy or group in self.queue:
            raise RebuildError("group_busy")
        if self._lock.locked():
            raise RebuildError("busy")
        return [group] if group else None

    def states(self) -> list[FileState]:
        return [s for g, _ in self.catalogue.groups() for s in self.store.states(g).values()]
