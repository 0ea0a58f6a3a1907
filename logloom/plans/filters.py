"""Filters: a request compiled to one Column over the log table."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.tokens import has_all_terms, has_phrase, tokenize
from logloom.plans.qsyntax import LEVEL_NAMES, Item, Span, parse

#: The column of each keyword of the search box.
COLUMNS = {"method": "method", "browser": "browser", "os": "os", "device": "device_type", "country": "region_code", "region": "province", "city": "city"}
#: The token column of each phrase field.
PHRASES = {"path": "path_tok", "ua": "ua_tok", "referer": "ref_tok"}


@dataclass(frozen=True)
class Filter:
    """All parts narrow; an empty list doesn't. ``end`` is excluded. Lists match exactly, phrases by tokens."""

    text: str = ""
    start: int | None = None
    end: int | None = None
    groups: list[str] = field(default_factory=list)
    ips: list[str] = field(default_factory=list)
    statuses: list[int] = field(default_factory=list)
    methods: list[str] = field(default_factory=list)
    countries: list[str] = field(default_factory=list)
    provinces: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    user_agents: list[str] = field(default_factory=list)
    referers: list[str] = field(default_factory=list)
    browsers: list[str] = field(default_factory=list)
    systems: list[str] = field(default_factory=list)
    devices: list[str] = field(default_factory=list)
    levels: list[str] = field(default_factory=list)


def span(c: Column, s: Span) -> Column:
    """Whether a number lies in an interval; null for null."""
    if s.low is not None and s.low == s.high:
        return c == s.low
    parts = []
    if s.low is not None:
        parts.append(c >= s.low if s.with_low else c > s.low)
    if s.high is not None:
        parts.append(c <= s.high if s.with_high else c < s.high)
    return reduce(Column.__and__, parts, F.lit(True))


def phrase(c: str, text: str, full: bool = False) -> Column:
    return has_phrase(F.col(c), tokenize(text, full, query=True))


def item(i: Item) -> Column:
    """One item of a search box, without its exclusion."""
    if i.kind == "text":
        return has_all_terms(F.col("raw_tok"), [t for _, t in tokenize(i.value, True, query=True)])
    if i.kind == "phrase":
        return phrase("raw_tok", i.value, True)
    if i.kind in PHRASES:
        return phrase(PHRASES[i.kind], i.value)
    if i.kind in COLUMNS:
        return F.lower(COLUMNS[i.kind]) == F.lower(F.lit(i.value))
    if i.kind == "ip":
        return F.col("ip_hex").between(*i.value)
    if i.kind == "level":
        return F.col("level") == i.value
    return span(F.col({"status": "status", "bytes": "bytes_sent", "rt": "request_time"}[i.kind]), i.value)


def excluded(c: Column) -> Column:
    """All rows but those that match, rows without a value among them."""
    return ~F.coalesce(c, F.lit(False))


def time_range(start: int | None, end: int | None) -> list[Column]:
    return [F.col("ts") >= start] * (start is not None) + [F.col("ts") < end] * (end is not None)


def posted(f: Filter) -> tuple[list[tuple[str, list[tuple[int, str]], bool]], list[Item]]:
    """The items of a filter's box that postings answer, as field, tokens and whether they are a phrase; and those that are left."""
    told, rest = [], []
    for i in parse(f.text)[0]:
        if not i.exclude and i.kind in ("text", "phrase"):
            told.append(("raw", tokenize(i.value, True, query=True), i.kind == "phrase"))
        elif not i.exclude and i.kind == "path":
            told.append(("path", tokenize(i.value, False, query=True), True))
        else:
            rest.append(i)
    return told, rest


def compile_filter(f: Filter, items: list[Item] | None = None) -> Column:
    """The conjunction of all parts; everything for an empty filter. ``items`` take the place of the box's.

    Conditions on the partition columns and on ts come first, so that they reach the scan.
    """
    parts = [F.col("main_log_path").isin(f.groups)] if f.groups else []
    parts += time_range(f.start, f.end)
    levels = [x for x in f.levels if x in LEVEL_NAMES]
    exact = {
        "ip": f.ips, "status": f.statuses, "method": f.methods, "region_code": f.countries, "province": f.provinces, "browser": f.browsers,
        "os": f.systems, "device_type": f.devices, "level": levels,
    }
    parts += [F.col(c).isin(values) for c, values in exact.items() if values]
    for c, texts in (("path_tok", f.paths), ("ua_tok", f.user_agents), ("ref_tok", f.referers)):
        if texts:
            parts.append(reduce(Column.__or__, [phrase(c, t) for t in texts]))
    for i in parse(f.text)[0] if items is None else items:
        parts.append(excluded(item(i)) if i.exclude else item(i))
    return reduce(Column.__and__, parts, F.lit(True))


def filter_of(now: int, start: int = 0, end: int = 0, statuses: list[int] | None = None, **rest) -> Filter:
    """A filter of a request: without a range from 0 to now; the end is included; 0 is open; negative statuses don't count."""
    if not start and not end:
        return Filter(start=0, end=now + 1, statuses=[s for s in statuses or [] if s >= 0], **rest)
    return Filter(start=start or None, end=end + 1 if end else None, statuses=[s for s in statuses or [] if s >= 0], **rest)


def validate_range(start: int, end: int) -> None:
    """Negative ends, and a start that isn't before the end, are errors."""
    if start < 0 or end < 0 or (start > 0 and end > 0 and start >= end):
        raise ValueError("invalid time range")
