"""Search: a page of hits, figures of all of them, and their order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.tokens import tokenize
from logloom.operators.postings import bm25, lines_with, ranked
from logloom.plans.filters import Filter, compile_filter, posted
from logloom.plans.qsyntax import Warning, parse

#: The page's default size and its most, and what hits can be sorted by.
DEFAULT_PAGE, MOST_PAGE, DEFAULT_ENTRIES = 50, 10_000, 100
SORT_KEYS = {
    "timestamp": "ts", "ts": "ts", "bytes_sent": "bytes_sent", "status": "status", "request_time": "request_time", "ip": "ip", "method": "method", "browser": "browser",
    "os": "os", "device_type": "device_type", "region_code": "region_code", "province": "province", "city": "city", "level": "level",
}
#: Ties are broken by what identifies a line. This order, and nulls last, are this engine's own choice.
IDENTITY = ["main_log_path", "fp", "off"]


def summary(rows: DataFrame) -> DataFrame:
    """Of all hits: docs, bytes, different addresses and paths. Exact; the distinct counts are partial before the shuffle."""
    return rows.agg(
        F.count("*").alias("docs"), F.coalesce(F.sum("bytes_sent"), F.lit(0)).cast("long").alias("bytes"),
        F.countDistinct("ip").alias("unique_ips"), F.countDistinct("path").alias("unique_paths"),
    )


def order(sort_by: str = "", sort_order: str = "") -> list[Column]:
    """No key: newest first whatever the order says. An unknown key is the time. Descending unless ``asc``."""
    c = F.col(SORT_KEYS.get(sort_by, "ts"))
    up = bool(sort_by) and sort_order == "asc"
    return [c.asc_nulls_last() if up else c.desc_nulls_last(), *[F.col(x) for x in IDENTITY]]


def page(rows: DataFrame, limit: int = 0, offset: int = 0, sort_by: str = "", sort_order: str = "") -> DataFrame:
    """A page of hits: 0 is the default size, a negative limit none. A top-k in every task, merged by one."""
    if limit < 0:
        return rows.limit(0)
    n = min(limit or DEFAULT_PAGE, MOST_PAGE)
    return rows.orderBy(*order(sort_by, sort_order)).offset(max(0, offset)).limit(n)


def late_page(rows: DataFrame, table: DataFrame, **how) -> DataFrame:
    """The page with all columns of ``table``: sorted on narrow rows, wide ones fetched for its hits only."""
    key = SORT_KEYS.get(how.get("sort_by", ""), "ts")
    narrow = rows.select(*dict.fromkeys([*IDENTITY, key]))
    hits = page(narrow, **how).select(*IDENTITY)
    return table.join(F.broadcast(hits), IDENTITY, "left_semi").orderBy(*order(how.get("sort_by", ""), how.get("sort_order", "")))  # at most MOST_PAGE hits


def entries(rows: DataFrame, limit: int = 0, tail: bool = True) -> DataFrame:
    """Newest entries of a log, or its oldest."""
    n = min(max(limit or DEFAULT_ENTRIES, 1), MOST_PAGE)
    return rows.orderBy(F.col("ts").desc() if tail else F.col("ts").asc(), *IDENTITY).limit(n)


def terms_of(text: str) -> list[str]:
    """The terms of a box by which hits are ranked: those of its words and phrases."""
    return list(dict.fromkeys(t for i in parse(text)[0] if i.kind in ("text", "phrase") and not i.exclude for _, t in tokenize(i.value, True, query=True)))


def score(rows: DataFrame, table: DataFrame, text: str) -> DataFrame:
    """``rows`` of ``table`` with their ``score``: BM25 of the box's terms in the raw line, as frequent as they are in the table, told by one scan of its tokens."""
    terms, size = terms_of(text), F.size("raw_tok")
    one = table.agg(F.count("*"), F.sum(size), *[F.count(F.when(F.array_contains(F.col("raw_tok.term"), t), 1)) for t in terms]).first()

    def times(term: str) -> Column:
        return F.size(F.filter("raw_tok", lambda x: x["term"] == term))

    return rows.withColumn("score", bm25([times(t) for t in terms], size, list(one[2:]), one[0], one[1] or 0))


def narrowed(rows: DataFrame, f: Filter, postings: DataFrame | None) -> DataFrame:
    """The rows that a filter leaves; what postings know of the box is asked of them."""
    if postings is None:
        return rows.where(compile_filter(f))
    told, rest = posted(f)
    rows = rows.where(compile_filter(f, rest))
    for field, tokens, phrase in told:
        rows = rows.join(lines_with(postings, field, tokens, phrase), IDENTITY, "left_semi")
    return rows


@dataclass
class Answer:
    """Two frames over one filtered frame, and what the box warns of."""

    hits: DataFrame
    figures: DataFrame
    warnings: list[Warning]


def search(table: DataFrame, f: Filter, limit: int = 0, offset: int = 0, sort_by: str = "", sort_order: str = "", postings: DataFrame | None = None, figures: tuple[int, int] | None = None) -> Answer:
    """``postings``: of the table; ``figures``: how many rows and tokens it has. With them neither words nor ranking read its token columns."""
    rows = narrowed(table, f, postings)
    if sort_by == "_score":
        n = min(limit or DEFAULT_PAGE, MOST_PAGE)
        terms = terms_of(f.text)
        if postings is not None and figures and terms:
            hits = rows.join(ranked(postings, terms, *figures), IDENTITY)
        else:
            hits = score(rows, table, f.text)
        hits = hits.orderBy(F.col("score").desc(), *IDENTITY).offset(max(0, offset)).limit(n if limit >= 0 else 0)
    else:
        hits = page(rows, limit, offset, sort_by, sort_order)
    return Answer(hits, summary(rows), parse(f.text)[1])
