"""The engine's face: one method for each thing a client asks."""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import date
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from logloom.operators import dashboard, hits, search, stats
from logloom.operators.dashboard import Layout
from logloom.operators.rollup import Hybrid
from logloom.plans.filters import Filter, compile_filter, filter_of, validate_range
from logloom.shared import collected, release
from logloom.sources.logs import Catalogue, clean_path, decode_path
from logloom.sources.store import Store
from logloom.streaming.rounds import RebuildError, RoundReport, Rounds


class ScopeError(ValueError):
    """A path that isn't listed, or that the question doesn't fit."""


#: Dashboards that can be read at a time.
BOARDS = 64
#: The scope of coded errors, and the numbers and texts that clients translate.
SCOPE = "nginx_log"
NOT_LISTED, NO_ACCESS = (50014, "log path is not under whitelist"), (50015, "cannot access log file")
NO_REBUILD, NO_FILE_REBUILD = (50018, "failed to rebuild index"), (50019, "failed to rebuild file index")


def answer(ask: Callable[[], Any], group: str = "") -> tuple[int, Any]:
    """A status and what ``ask`` gives, or the error that it ends with as clients read errors. ``group``: of the question, for rebuilds."""
    try:
        return 200, ask()
    except RebuildError as e:
        code, text = NOT_LISTED if str(e) == "not_allowed" else NO_FILE_REBUILD if group else NO_REBUILD
        return 500, {"scope": SCOPE, "code": code, "message": text, "params": [str(e)]}
    except ScopeError as e:
        code, text = NO_ACCESS if "no dashboard" in str(e) or "nothing" in str(e) else NOT_LISTED
        return 500, {"scope": SCOPE, "code": code, "message": text, "params": [str(e)]}
    except (ValueError, TypeError, KeyError) as e:
        return 406, {"scope": "validate", "code": 406, "message": "Validation error", "errors": {"body": str(e)}}


def split_comma(value: str) -> list[str]:
    return [x for x in (p.strip() for p in value.split(",")) if x]


@dataclass
class Engine:
    spark: SparkSession
    store: Store
    catalogue: Catalogue
    zone: str = "UTC"
    rounds: Rounds = field(init=False)
    events: list[dict] = field(default_factory=list)
    #: What the newest dashboards read, which are BOARDS at most; older ones' tables are deleted.
    boards: list[list[DataFrame]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.rounds = Rounds(self.store, self.catalogue, self.zone, listener=self._heard)

    def _heard(self, event: dict) -> None:
        """Progress, the newest 64 events."""
        self.events.append(event)
        del self.events[:-64]

    def resolve(self, path: str, default: bool = True) -> str | None:
        """The group of a path parameter; empty: the default log's, or None for all."""
        path = decode_path(path)
        if not path:
            first = self.catalogue.default_access() if default else None
            return self.catalogue.group_of(first) if first else None
        if not self.catalogue.is_valid(clean_path(path)):
            raise ScopeError(f"not a listed log: {path}")
        return self.catalogue.group_of(path)

    def _rows(self, group: str | None, start: int | None = None, end: int | None = None) -> DataFrame:
        """Rows of a group or all; segments without any in [start, end) aren't listed."""
        rows = self.store.rows([group] if group else None, start, end)
        if rows is None:
            raise ScopeError("nothing is indexed")
        return rows

    def index(self, path: str = "", rebuild: bool = False) -> RoundReport | None:
        """Runs a round, of one group or all."""
        group = self.resolve(path, default=False)
        return self.rounds.run(self.rounds.check_rebuild(group) if rebuild else ([group] if group else None), rebuild)

    def search(self, path: str = "", limit: int = 0, offset: int = 0, sort_by: str = "", sort_order: str = "", now: int | None = None, start: int = 0, end: int = 0, **parts) -> search.Answer:
        validate_range(start, end)
        group = self.resolve(path)
        f = filter_of(int(time.time()) if now is None else now, start, end, groups=[group] if group else [], **parts)
        groups = [group] if group else None
        if sort_by == "_score":  # lines are ranked among all of the group's
            known = self.store.figures(groups).values()
            figures = sum(x["docs"] for x in known), sum(x["tokens"] for x in known)
            return search.search(self._rows(group), f, limit, offset, sort_by, sort_order, self.store.postings(groups), figures)
        return search.search(self._rows(group, f.start, f.end), f, limit, offset, sort_by, sort_order, self.store.postings(groups, f.start, f.end))

    def entries(self, path: str = "", limit: int = 0, tail: bool = True) -> DataFrame:
        return search.entries(self._rows(self.resolve(path)), limit, tail)

    def analytics(self, path: str = "", start: int = 0, end: int = 0) -> dict[str, DataFrame]:
        """Statistics of entries; an empty path is the whole index."""
        validate_range(start, end)
        rows = self._rows(self.resolve(path, default=False), start or None, end or None).where(compile_filter(Filter(start=start or None, end=end or None)))
        return stats.entries_overview(rows)

    def dashboard(self, path: str = "", start: date | None = None, end: date | None = None, now: int | None = None) -> dict[str, DataFrame]:
        """From the rollups, with cut hours from the rows; from the rows alone where rollups are no smaller. An error log has no dashboard; without a default log all groups count."""
        group = self.resolve(path)
        if group and dict(self.catalogue.groups()).get(group) == "error":
            raise ScopeError("an error log has no dashboard")
        lay = Layout.of_dates(start, end, int(time.time()) if now is None else now, self.zone)
        rows, roll = self._rows(group), self.store.rollup([group] if group else None)
        with collected() as made:
            out = Hybrid(roll, rows, lay).dashboard() if roll else dashboard.dashboard(rows, lay)
        self.boards.append(made)
        while len(self.boards) > BOARDS:
            release(*self.boards.pop(0))
        return out

    def geo(self, kind: str, path: str = "", start: int = 0, end: int = 0, country: str = "CN", limit: int = 0) -> DataFrame:
        """``world``, ``regions`` or ``points``; ``stats``: the twenty most frequent countries."""
        validate_range(start, end)
        rows = self._rows(self.resolve(path), start or None, end or None).where(compile_filter(Filter(start=start or None, end=end or None)))
        if kind == "regions":
            return stats.regions(rows, country, min(limit or 500, 500))
        if kind == "points":
            return stats.city_points(rows, limit or 500)
        return stats.countries(rows, {"world": 300, "stats": 20}[kind])

    def hits(self, frame: DataFrame, chinese: bool = False) -> DataFrame:
        """Hits as clients see them: without token columns, with their JSON and a label of the place."""
        return hits.entries(frame.drop("raw_tok", "path_tok", "ua_tok", "ref_tok", "ip_hex"), self.zone, chinese)

    def status(self, kind: str = "", name: str = "", state: str = "") -> list[dict]:
        """Groups with what is indexed of them, sorted; narrowed by kind, a part of the path and state. Told by the manifest, without a job."""
        known = self.store.figures()
        out = []
        for group, k in self.catalogue.groups():
            if (kind and k != kind) or (name and name not in group):
                continue
            states = [asdict(s) for s in self.store.states(group).values()]
            out.append(
                {"path": group, "kind": k, "files": len(states), "size": sum(s["size"] for s in states), "modified": max((s["mtime_ns"] // 10**9 for s in states), default=0), "indexed_at": max((s["indexed_at"] for s in states), default=0),
                 "documents": known.get(group, {}).get("docs", 0), "first": known.get(group, {}).get("first"), "last": known.get(group, {}).get("last"),
                 "state": "indexing" if group in self.rounds.busy else "queued" if group in self.rounds.queue else "indexed" if group in known else "failed" if group in self.rounds.failures else "not_indexed",
                 "retries": self.rounds.failures.get(group, 0)}
            )
        return [s for s in out if not state or s["state"] == state]

    def totals(self) -> dict:
        """Files, groups that are indexed and at work, and documents over all groups."""
        found = self.status()
        count = lambda state: sum(s["state"] == state for s in found)
        return {"files": sum(s["files"] for s in found), "indexed": count("indexed"), "indexing": count("indexing"), "documents": sum(s["documents"] for s in found)}

    def preflight(self, path: str = "") -> dict:
        """Whether questions about a log can be answered now: its state, its file, the times it covers, and why not."""
        told = {"available": False, "state": "not_indexed", "message": "", "time_range": None, "file": None, "documents": 0}
        try:
            group = self.resolve(path)
        except ScopeError as e:
            return told | {"state": "error", "message": str(e), "file": {"exists": False, "readable": False, "size": 0, "modified": 0}}
        if group is None:  # all logs
            known = self.store.figures().values()
            return told | {"available": True, "state": "indexed" if known else "not_indexed", "documents": sum(x["docs"] for x in known)}
        asked = clean_path(decode_path(path)) if path else group
        states = self.store.states(group)
        known = self.store.figures([group]).get(group) if any(s.indexed_at for s in states.values()) else None
        if known:
            told |= {"available": True, "state": "indexed", "time_range": (known["first"], known["last"]), "documents": known["docs"]}
        elif any(s.indexed_at for s in states.values()):
            told |= {"available": True, "state": "indexed"}
        elif group in self.rounds.busy:
            told["state"] = "indexing"
        elif group in self.rounds.queue:
            told["state"] = "queued"
        try:
            stat = os.stat(asked)
            readable = os.access(asked, os.R_OK)
        except FileNotFoundError:
            why = "its file is gone, what was indexed of it is available" if told["available"] else "log file does not exist"
            return told | {"message": why, "file": {"exists": False, "readable": False, "size": 0, "modified": 0}}
        except OSError as e:
            return told | {"available": False, "state": "error", "message": f"cannot access log file: {e}", "file": {"exists": True, "readable": False, "size": 0, "modified": 0}}
        told["file"] = {"exists": True, "readable": readable, "size": stat.st_size, "modified": int(stat.st_mtime)}
        if not readable:
            return told | {"available": False, "state": "error", "message": "cannot access log file"}
        return told | {"message": "" if states else "log file not indexed yet"}

    def warm(self) -> int:
        rows = self.store.rows()
        return rows.count() if rows is not None else 0
