"""Postings: where each token of the log lines and of their paths stands, kept by term.

A posting is one token at one position. A stored row has those of one term in some lines of a file that a task took together, so that no posting is
shuffled and rows are few to sort; their numbers are packed as bytes, so that Spark carries, sorts and writes three values instead of three for each posting. Rows lie in folders by a hash of field and term, sorted by term, so that a question
reads the folders of its terms and there, by the files' own statistics, little but them. Lines that hold all of a text's terms, or a phrase's at their
distances, are told by one aggregate over what is read; they then pick the log rows by a semi join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from logloom.functions.tokens import flat_tokens

POSTINGS = "postings"
#: Folders: each task of a commit writes a file to each of them, and a file costs as much as some thousand lines. What a folder holds
#: of other terms is left out by the pages' statistics, so pages are short.
BUCKETS, PAGE = 8, 256
ROW = "field string, term string, main_log_path string, fp string, off array<bigint>, pos array<int>, size array<int>"
#: ``n`` postings, the first at offset ``first``: how far each stands behind the one before, its position and size, in 2, 4 or 8 bytes each.
PACKED = "field string, term string, main_log_path string, fp string, n int, first long, off binary, pos binary, size binary"
STORED = PACKED + ", seg string, bucket int"
WIDTHS = {w: np.dtype(f"<i{w}") for w in (2, 4, 8)}
IDENTITY = ["main_log_path", "fp", "off"]
#: The token column of each field that is kept.
FIELDS = {"raw": "raw_tok", "path": "path_tok"}
#: A task takes lines of so many tokens together, and hands on so many rows at a time.
TOGETHER, BATCH = 1 << 21, 1 << 14
#: Constants of BM25.
K1, B = 1.2, 0.75


def bucket(field: Column, term: Column) -> Column:
    return F.pmod(F.xxhash64(field, term), F.lit(BUCKETS)).cast("int")


def _order(key: np.ndarray) -> np.ndarray:
    """The stable order of numbers from 0 on, by 16 bits at a time: these numpy sorts by counting."""
    order, done, top = np.argsort(key.astype(np.uint16), kind="stable"), 16, int(key.max(initial=0))
    while top >> done:
        order = order[np.argsort((key[order] >> done).astype(np.uint16), kind="stable")]
        done += 16
    return order


def grouped(lines: pa.Table, field: str) -> pa.Table:
    """Rows of ROW of the tokens of a field, by file and term; those of one term in the order of ``lines``."""
    line, pos, terms = flat_tokens(lines[FIELDS[field]].combine_chunks())
    terms = terms.dictionary_encode()
    paths, fps = (lines[c].combine_chunks().dictionary_encode() for c in ("main_log_path", "fp"))
    path, fp = (c.indices.to_numpy(zero_copy_only=False).astype(np.int64)[line] for c in (paths, fps))
    key = (path * len(fps.dictionary) + fp) * len(terms.dictionary) + terms.indices.to_numpy()
    order = _order(key)
    key = key[order]
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    first, ends = pa.array(order[starts]), pa.array(np.append(starts, len(key)), pa.int32())
    size = np.bincount(line, minlength=len(lines))
    each = {
        "off": pa.array(lines["off"].to_numpy()[line[order]], pa.int64()), "pos": pa.array(pos[order], pa.int32()), "size": pa.array(size[line[order]], pa.int32()),
    }
    return pa.table(
        {
            "field": pa.array([field] * len(starts), pa.string()), "term": terms.dictionary.take(terms.indices.take(first)),
            "main_log_path": paths.dictionary.take(pa.array(path[order[starts]])), "fp": fps.dictionary.take(pa.array(fp[order[starts]])),
            **{c: pa.ListArray.from_arrays(ends, v) for c, v in each.items()},
        }
    )


def _count(tokens: pa.Array) -> int:
    """How many tokens there are, or of packed ones what parts them."""
    return sum(pc.sum(pc.count_substring(tokens, c)).as_py() or 0 for c in " \t") if pa.types.is_string(tokens.type) else len(pc.list_flatten(tokens))


def _group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, tokens = [], 0

    def told() -> Iterator[pa.RecordBatch]:
        lines = pa.Table.from_batches(held)
        for field in FIELDS:
            yield from grouped(lines, field).to_batches(BATCH)

    for batch in batches:
        held.append(batch)
        tokens += sum(_count(batch.column(c)) for c in FIELDS.values())
        if tokens >= TOGETHER:
            yield from told()
            held, tokens = [], 0
    if held:
        yield from told()


def _bytes(numbers: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Numbers as little-endian integers of the least width that all of them keep, those up to each of ``ends`` as one value."""
    low, high = int(numbers.min(initial=0)), int(numbers.max(initial=0))
    width = next(w for w in WIDTHS if -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1)
    data = np.ascontiguousarray(numbers, WIDTHS[width])
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64) * width), pa.py_buffer(data)]).cast(pa.binary())


def packed_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of ROW as those of PACKED."""
    lists = {c: batch.column(c) for c in ("off", "pos", "size")}
    n = pc.list_value_length(lists["off"]).to_numpy()
    ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
    flat = {c: pc.list_flatten(x).to_numpy() for c, x in lists.items()}
    first = flat["off"][ends[:-1]]
    flat["off"] = np.diff(flat["off"], prepend=0)
    flat["off"][ends[:-1]] = 0
    named = ["field", "term", "main_log_path", "fp"]
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in named], pa.array(n, pa.int32()), pa.array(first, pa.int64()), *[_bytes(x, ends) for x in flat.values()]], [*named, "n", "first", *flat])


def _numbers(values: pa.Array, n: np.ndarray) -> np.ndarray:
    """The numbers of _bytes(), of which each value has ``n``."""
    held = values.to_pylist()
    widths = [len(x) // int(k) for x, k in zip(held, n, strict=True)]
    if len(set(widths)) == 1:
        return np.frombuffer(b"".join(held), WIDTHS[widths[0]]).astype(np.int64)
    return np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(x, WIDTHS[w]) for x, w in zip(held, widths, strict=True)]])


@F.arrow_udf(ArrayType(StructType([StructField("off", LongType()), StructField("pos", IntegerType()), StructField("size", IntegerType())])))
def _opened(n: pa.Array, first: pa.Array, off: pa.Array, pos: pa.Array, size: pa.Array) -> pa.Array:
    n = n.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(n)])
    offs = np.cumsum(_numbers(off, n))
    offs += np.repeat(first.to_numpy(zero_copy_only=False) - offs[ends[:-1]], n)
    each = [pa.array(offs, pa.int64()), *[pa.array(_numbers(x, n), pa.int32()) for x in (pos, size)]]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(each, ["off", "pos", "size"]))


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return map(packed_rows, _group(batches))


def index(rows: DataFrame) -> DataFrame:
    """The postings of log rows, with tokens packed or not, as they are stored, each task's sorted by term. ``size``: tokens of the field."""
    out = rows.select(*IDENTITY, *FIELDS.values()).mapInArrow(_stored, PACKED)
    return out.withColumn("bucket", bucket(F.col("field"), F.col("term"))).sortWithinPartitions("bucket", "field", "term")


def told(stored: DataFrame) -> DataFrame:
    """A row for each posting."""
    return stored.select("field", "term", "main_log_path", "fp", F.inline(_opened("n", "first", "off", "pos", "size")), "seg", "bucket")


def _of(postings: DataFrame, field: str, terms: list[str]) -> DataFrame:
    """The postings of some terms. The folders are told by constants, so that others aren't read."""
    spark = postings.sparkSession
    hashes = [bucket(F.lit(field), F.lit(t)) for t in terms]
    folders = sorted(set(spark.range(1).select(F.array(*hashes)).first()[0]))
    return postings.where(F.col("bucket").isin(folders) & (F.col("field") == field) & F.col("term").isin(terms))


def lines_with(postings: DataFrame, field: str, tokens: list[tuple[int, str]], phrase: bool) -> DataFrame:
    """IDENTITY of the lines in whose field all tokens stand, for a phrase at their distances; none for no tokens."""
    if not tokens:
        return postings.select(*IDENTITY).limit(0)
    asked = tokens if phrase else [(0, t) for t in dict.fromkeys(t for _, t in tokens)]
    some = _of(postings, field, list(dict.fromkeys(t for _, t in asked)))
    start = (F.col("pos") - F.lit(0)) if phrase else F.lit(0)
    # a token is one bit; a term that is asked for twice stands for both
    marks = F.array(*[F.when(F.col("term") == t, F.struct((start - F.lit(p - asked[0][0] if phrase else 0)).alias("at"), F.lit(1 << k).cast("long").alias("bit"))) for k, (p, t) in enumerate(asked[:62])])
    told = some.select(*IDENTITY, F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("m"))
    found = told.groupBy(*IDENTITY, "m.at").agg(F.bit_or("m.bit").alias("bits")).where(F.col("bits") == (1 << len(asked[:62])) - 1).select(*IDENTITY)
    found = found.distinct() if phrase else found
    rest = asked[61:] if len(asked) > 62 else []  # the first of the rest ties it to what was found
    return found.join(lines_with(postings, field, rest, phrase), IDENTITY, "left_semi") if rest else found


def ranked(postings: DataFrame, terms: list[str], docs: int, tokens: int) -> DataFrame:
    """IDENTITY and ``score``: BM25 of the lines with any of the terms. Of ``docs`` lines with ``tokens`` in all, the manifest tells."""
    times = [F.count(F.when(F.col("term") == t, 1)) for t in terms]
    some = _of(postings, "raw", terms).groupBy(*IDENTITY).agg(F.first("size").alias("size"), *[n.alias(f"tf{k}") for k, n in enumerate(times)])
    df = some.agg(*[F.count(F.when(F.col(f"tf{k}") > 0, 1)) for k in range(len(terms))]).first()
    return some.select(*IDENTITY, bm25([F.col(f"tf{k}") for k in range(len(terms))], F.col("size"), list(df), docs, tokens).alias("score"))


def bm25(times: list[Column], size: Column, df: list[int], docs: int, tokens: int) -> Column:
    """The score of a line of ``size`` tokens that has terms so many times, where ``df`` of ``docs`` lines have them."""
    mean, total = (tokens / docs if docs and tokens else 1.0), F.lit(0.0)
    for tf, n in zip(times, df, strict=True):
        idf = math.log(1 + (docs - n + 0.5) / (n + 0.5))
        total = total + F.lit(idf) * tf * (K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * size / F.lit(mean)))
    return total
