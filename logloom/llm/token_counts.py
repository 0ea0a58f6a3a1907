"""Token counts: pieces counted once for each distinct pre-token, joined to pre-token frequencies.

Documents are read once, in blocks. For every pre-token in a block there is a list of (document in
block, frequency), so a pre-token that every document has costs one list a block. The lists of a
block are packed by bucket, a hash of the pre-token, and dealt by bucket: the task of a bucket
counts each of its distinct pre-tokens once and joins the counts to all its lists. The products are
summed by document there, dealt by block, and summed again. No ids are kept. A pre-token that
many documents of a block have is dealt to up to SALTS tasks, so that no task gets all lists of a word
that a third of the corpus has; it is counted once in each of them.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm import tokens

#: A block ends after so many documents or characters, so that it fits in a Python worker.
BLOCK_DOCS, BLOCK_CHARS = 8_192, 24_000_000
#: A list of so many documents in a block is long; long lists of a pre-token go to SALTS buckets.
LONG, SALTS = 512, 64
#: Products that a task holds before it sums and sends them, and pre-tokens whose counts it remembers.
HELD, REMEMBERED = 4_000_000, 1_000_000
_LISTS = "bucket int, block long, keys int, body binary"
_SUMS = "block long, keys int, body binary"
_RESULT = "doc_id long, n_bytes long, n_tokens long"
#: In ``keys``, says that the body is a block's list of documents, or of sums.
_DOCS, _PART = -1, -2


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` for each row of ``docs``.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows and null ids each give their own
    row. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # some buckets for each task that reads them, so that tasks are even
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = rows.mapInArrow(lambda b: _blocks(b, buckets, vocabulary), _LISTS).repartition("bucket")
    return lists.mapInArrow(lambda b: _joined(b, vocabulary), _SUMS).groupBy("block").applyInArrow(_total, _RESULT)


def _pack(*parts: bytes) -> bytes:
    """Parts with their lengths, compressed."""
    raw = np.array([len(parts), *map(len, parts)], "<u4").tobytes() + b"".join(parts)
    return len(raw).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(body: bytes) -> list[bytes]:
    raw = pa.decompress(body[4:], int.from_bytes(body[:4], "little"), codec="zstd", asbytes=True)
    n = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4)).tolist()
    at = 4 + 4 * n
    return [raw[at + a : at + b] for a, b in zip([0, *ends], ends, strict=False)]


def _blocks(batches: Iterator[pa.RecordBatch], buckets: int, vocabulary: str | None) -> Iterator[pa.RecordBatch]:
    """A list is records of 3 bytes: the document's place in the block (2) and a frequency up to 255 (1)."""
    tok = tokens.load(vocabulary)
    block = TaskContext.get().partitionId() << 32
    ids: list[int | None] = []
    sizes: list[int] = []
    lists: dict[str, bytearray] = defaultdict(bytearray)
    chars = 0

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal block, chars
        mask = np.array([i is None for i in ids], "u1")
        head = _pack(np.array([i or 0 for i in ids], "<i8").tobytes(), np.array(sizes, "<i8").tobytes(), mask.tobytes())
        out = [(block % buckets, block, _DOCS, head)]
        dealt: dict[int, list[str]] = defaultdict(list)
        for piece, found in lists.items():
            salt = block % SALTS if len(found) >= 3 * LONG else 0
            dealt[(zlib.crc32(piece.encode()) + salt) % buckets].append(piece)
        for bucket, pieces in dealt.items():
            names = [p.encode() for p in pieces]
            found = [lists[p] for p in pieces]
            out.append((bucket, block, len(pieces), _pack(np.array([*map(len, names)], "<u4").tobytes(), b"".join(names), np.array([*map(len, found)], "<u4").tobytes(), b"".join(found))))
        types = (pa.int32(), pa.int64(), pa.int32(), pa.binary())
        for i in range(0, len(out), 256):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 256], strict=True), types, strict=True)], ["bucket", "block", "keys", "body"])
        ids.clear(), sizes.clear(), lists.clear()
        block, chars = block + 1, 0

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py() or ""
            at = len(ids).to_bytes(2, "little")
            for piece, n in Counter(tok.split(text)).items():
                out = lists[piece]
                while n > 255:
                    out += at + b"\xff"
                    n -= 255
                out += at + n.to_bytes(1, "little")
            ids.append(doc_id)
            sizes.append(len(text.encode()))
            chars += len(text)
            if len(ids) == BLOCK_DOCS or chars >= BLOCK_CHARS:
                yield from close()
    if ids:
        yield from close()


def _joined(batches: Iterator[pa.RecordBatch], vocabulary: str | None) -> Iterator[pa.RecordBatch]:
    """Counts each pre-token once and multiplies; sums by block and document before rows go on."""
    tok = tokens.load(vocabulary)
    known: dict[bytes, int] = {}
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
    n_held = 0

    def send() -> Iterator[pa.RecordBatch]:
        nonlocal n_held
        for block, parts in held.items():
            at = np.concatenate([p[0] for p in parts])
            total = np.bincount(at, weights=np.concatenate([p[1] for p in parts]))
            places = np.flatnonzero(total)
            yield _batch([block], [_PART], [_pack(np.diff(places, prepend=0).astype("<u2").tobytes(), total[places].astype("<u4").tobytes())])
        held.clear()
        n_held = 0

    for batch in batches:
        for block, keys, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            if keys == _DOCS:
                yield _batch([block], [_DOCS], [body.as_py()])
                continue
            name_sizes, names, list_sizes, lists = _unpack(body.as_py())
            counts, at = np.empty(keys, "i8"), 0
            if len(known) > REMEMBERED:
                known.clear()
            for k, size in enumerate(np.frombuffer(name_sizes, "<u4").tolist()):
                name = names[at : at + size]
                at += size
                n = known.get(name)
                if n is None:
                    n = known[name] = tok.count(name.decode())
                counts[k] = n
            rec = np.frombuffer(lists, "u1").reshape(-1, 3)
            places = rec[:, 0].astype("u2") | rec[:, 1].astype("u2") << 8
            held[block].append((places, np.repeat(counts, np.frombuffer(list_sizes, "<u4") // 3) * rec[:, 2]))
            n_held += len(rec)
            if n_held > HELD:
                yield from send()
    yield from send()


def _batch(block: list, keys: list, body: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(keys, pa.int32()), pa.array(body, pa.binary())], ["block", "keys", "body"])


def _total(block: pa.Table) -> pa.Table:
    keys, bodies = block.column("keys").to_pylist(), block.column("body")
    ids, sizes, mask = _unpack(bodies[keys.index(_DOCS)].as_py())
    total = np.zeros(len(mask), "i8")
    for k, body in zip(keys, bodies, strict=True):
        if k == _PART:
            steps, sums = _unpack(body.as_py())
            total[np.cumsum(np.frombuffer(steps, "<u2"), dtype="i8")] += np.frombuffer(sums, "<u4")
    return pa.table([pa.array(np.frombuffer(ids, "<i8"), mask=np.frombuffer(mask, "?")), pa.array(np.frombuffer(sizes, "<i8")), pa.array(total)], ["doc_id", "n_bytes", "n_tokens"])
