"""The log catalogue: listed files, their rotations and groups."""

from __future__ import annotations

import base64
import os
import posixpath
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings of compressed files, each taken off once, and what rotated names look like, in order: what is kept of them, and what comes behind it.
ENDINGS = ("gz", "bz2", "xz", "lz4")
_DATE = r"(?:\d{8}|\d{4}-\d{2}-\d{2}"
ROTATED = [
    (rf"(.+\..+)-{_DATE})", ""), (r"(.+)\.\d{4}\.\d{2}\.\d{2}", ""), (rf"(.*\..*)\.{_DATE}|\d{{6}})", ""), (r"(.+)\.\d{1,3}", ""), (r"(.+)\.\d{1,3}\.log", ".log"),
    (rf"(){_DATE}|\d{{6}}|2\d{{3}}\.\d{{2}}\.\d{{2}})", "access.log"),
]
PREFIX = "b64_"


def clean_path(path: str) -> str:
    """Without empty, ``.`` and ``..`` parts, by the text alone; an empty path is ``.``."""
    out = posixpath.normpath(path) if path else "."
    return out[1:] if out.startswith("//") else out


def main_log_path(path: str) -> str:
    """The live log that a rotated or compressed file belongs to; the path itself if its name tells none."""
    folder, name = posixpath.split(path.rstrip("/"))
    for ending in ENDINGS:
        name = name.removesuffix(f".{ending}")
    found = ((re.fullmatch(pattern, name, re.S | re.A), tail) for pattern, tail in ROTATED)
    return next((clean_path(posixpath.join(folder, m[1] + tail)) for m, tail in found if m and name not in (".", "..")), path)


def main_log_column(path: Column) -> Column:
    """The same over a column, by built-in functions, for absolute paths with a name."""
    folder, name = F.regexp_extract(path, r"(?s)^(.*/)[^/]*$", 1), F.regexp_extract(path, r"(?s)([^/]*)$", 1)
    for ending in ENDINGS:
        name = F.regexp_replace(name, rf"\.{ending}$", "")
    out = path
    for pattern, tail in reversed(ROTATED):
        whole = f"(?s)^{pattern}$"
        out = F.when(name.rlike(whole), F.concat(folder, F.regexp_extract(name, whole, 1), F.lit(tail))).otherwise(out)
    return out


def decode_path(value: str) -> str:
    """A path parameter: ``b64_`` and base64url, padded or not; anything that isn't text then stays as it is."""
    rest = value.removeprefix(PREFIX)
    if rest == value or not rest:
        return value
    if not re.fullmatch(r"[A-Za-z0-9_-]+={0,2}", rest):
        return value
    try:
        out = base64.urlsafe_b64decode(rest.rstrip("=") + "=" * (-len(rest.rstrip("=")) % 4))
        return value if b"\0" in out else out.decode()
    except ValueError:
        return value


def encode_path(path: str) -> str:
    return PREFIX + base64.urlsafe_b64encode(path.encode()).decode().rstrip("=")


@dataclass(frozen=True)
class HostLog:
    path: str
    kind: str = "access"
    source: str = "default"


@dataclass
class Catalogue:
    """The listed logs. Relative paths are dropped, paths are cleaned, the first of equal ones counts."""

    logs: list[HostLog] = field(default_factory=list)

    def __post_init__(self) -> None:
        seen: dict[str, HostLog] = {}
        for log in self.logs:
            if log.path.startswith("/"):
                p = clean_path(log.path)
                seen.setdefault(p, HostLog(p, log.kind, log.source))
        self.logs = list(seen.values())

    def default_access(self) -> str | None:
        return next((x.path for x in self.logs if x.kind == "access" and x.source == "default"), None)

    def groups(self) -> list[tuple[str, str]]:
        """(main path, kind) of each group, sorted; the first listed log says its kind."""
        out: dict[str, str] = {}
        for log in self.logs:
            out.setdefault(main_log_path(log.path), log.kind)
        return sorted(out.items())

    def group_of(self, path: str) -> str:
        return main_log_path(clean_path(path))

    def is_valid(self, path: str) -> bool:
        """Absolute, listed or a rotation of a listed log, and a regular file if it exists; a linked rotation stays in its folder."""
        if not path.startswith("/"):
            return False
        path = clean_path(path)
        listed = {x.path for x in self.logs}
        mains = {main_log_path(x.path) for x in self.logs}
        if path not in listed and main_log_path(path) not in mains:
            return False
        if not os.path.lexists(path):
            return True
        real = os.path.realpath(path)
        if path not in listed and os.path.islink(path):
            bases = {os.path.realpath(os.path.dirname(x.path)) for x in self.logs if main_log_path(x.path) == main_log_path(path)}
            if os.path.dirname(real) not in bases:
                return False
        return os.path.isfile(real)

    def group_files(self, base: str) -> list[str]:
        """A log and its rotations next to it, sorted."""
        folder, name = posixpath.split(base)
        try:
            found = [posixpath.join(folder, f) for f in os.listdir(folder) if f.startswith(name)]
        except OSError:
            found = []
        return sorted(f for f in {base, *found} if main_log_path(f) == main_log_path(base) and self.is_valid(f) and os.path.isfile(f))
