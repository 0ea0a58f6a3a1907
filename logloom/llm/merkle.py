"""A Merkle manifest of a dataset: a tree of digests for each source, and one over the sources.

A leaf is the SHA-256 of a row's fields. Each run of three consecutive nodes becomes the digest of their
hexadecimal texts; the last run of a level may be shorter and isn't padded. What remains of a source is its subroot, and the
subroots make the root in the same way.

Leaves get their places in the source first. Each task then walks its run of places with a mountain range: a stack of
completed peaks, in which three neighbours of one height carry to the next. Runs start and end anywhere, so the
peaks at both edges wait for neighbours of other tasks: they are merged in blocks of 3^6, 3^12 and so on
leaves by the same walk, until nothing is open. No task takes more than 3^6 nodes of a block, whatever the source's size.
Proofs go the other way, from the root down, six levels at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import in_order, materialise, quoted, release

#: Children of a node, and the levels that one task takes of a block.
BASE, STRIDE = 3, 6
BLOCK = BASE**STRIDE
NODES = "tree string, total long, level int, idx long, digest string, top boolean, made boolean, open boolean"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values: list[Column]) -> Column:
    """The digest of fields: ``-`` for null, else the length in bytes, a colon and the value; so no two lists of fields are written alike."""
    told = []
    for v in values:
        text = v.cast("string")
        told.append(F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*told), 256)


def width(total: int, level: int) -> int:
    """Nodes of a level over ``total`` leaves."""
    return -(-total // BASE**level)


def climb(nodes: Iterator[tuple[str, int, int, int, str]]) -> Iterator[tuple]:
    """Walks (tree, total, level, idx, digest) in order of tree and first leaf; gives rows of NODES.

    ``made``: a node that was completed here. ``open``: one whose parent can't be, as a neighbour isn't here. ``top``: what remains of a tree.
    """
    stack: list[list] = []  # peaks of a run: level, idx, digest, made here
    tree, total, reached = None, 0, 0

    def record(level: int, idx: int, value: str, made: bool, waits: bool) -> tuple:
        top = width(total, level) == 1
        return tree, total, level, idx, value, top, made or (top and level == 0), waits and not top

    for t, n, level, idx, value in nodes:
        span = BASE**level
        if t != tree or idx * span != reached:
            yield from (record(*peak, True) for peak in stack)
            stack, tree, total = [], t, n
        reached = min(n, (idx + 1) * span)
        stack.append([level, idx, value, False])
        while True:
            level, idx, _, _ = stack[-1]
            nodes_here = width(total, level)
            if nodes_here == 1 or not (idx % BASE == BASE - 1 or idx == nodes_here - 1):
                break
            children = idx % BASE + 1
            if len(stack) < children or stack[-children][0] != level or stack[-children][1] != idx - children + 1:
                break
            run = stack[-children:]
            del stack[-children:]
            yield from (record(*child, False) for child in run if child[3])
            stack.append([level + 1, idx // BASE, digest("".join(child[2] for child in run)), True])
    yield from (record(*peak, True) for peak in stack)


def _rows(source: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in source:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, names, types)
            held = []
    if held:
        yield _batch(held, names, types)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], list(names))


_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
_NAMES = [x.split()[0] for x in NODES.split(", ")]
_TYPES = [_ARROW[x.split()[1]] for x in NODES.split(", ")]


def build(leaves: DataFrame) -> DataFrame:
    """The nodes, rows of NODES, over ``tree, total, place, digest`` leaves that lie in runs of places, as in_order() leaves them.

    Leaves aren't repeated, but for those that are all of a tree. ``tree`` isn't null.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(climb((t, n, 0, at, d) for t, n, at, d in _rows(source)), _NAMES, _TYPES)

    def merge(block: pa.Table) -> pa.Table:
        held = sorted(_rows(block.select(["tree", "total", "level", "idx", "digest"]).to_batches()), key=lambda r: r[3] * BASE ** r[2])
        return pa.Table.from_batches([_batch(list(climb(iter(held))), _NAMES, _TYPES)])

    now = materialise(leaves.select("tree", "total", "place", "digest").mapInArrow(run, NODES))
    found, high = now.where("made"), STRIDE
    while (waiting := now.where("open")).head(1):
        block = F.expr(f"idx * CAST(pow({BASE}, level) AS long) div {BASE**high}")
        now = materialise(waiting.withColumn("block", block).groupBy("tree", "block").applyInArrow(merge, NODES))
        found, high = found.unionAll(now.where("made")), high + STRIDE
    return found.select("tree", "total", "level", "idx", "digest", "top")


def _beside(held: list[str], level: int, total: int) -> list[list[tuple[str, str]]]:
    """By level of a block, up to its top: for each node what stands left and right of it in its run."""
    out: list[list[tuple[str, str]]] = []
    while len(out) < STRIDE and width(total, level) > 1:
        beside, above = [], []
        for at in range(0, len(held), BASE):
            run = held[at : at + BASE]
            beside += [("".join(run[:k]), "".join(run[k + 1 :])) for k in range(len(run))]
            above.append(digest("".join(run)))
        out.append(beside)
        held, level = above, level + 1
    return out


def prove(leaves: DataFrame, nodes: DataFrame, tops: DataFrame, keep: list[str], told: Callable[[str, tuple, list[str], list[str], list[str]], tuple], schema: str) -> DataFrame:
    """``told(tree, values of keep, left, right, tail)`` for every leaf: its siblings by level, from the leaf up to what remains of ``tops``.

    ``tops``: ``tree``, the siblings ``before`` and ``after`` of the tree's top in what stands above it, and
    ``tail``, constants of the tree. ``keep``: columns of ``leaves`` that ``told`` gets, ``schema`` what it gives.
    """
    depths = nodes.where("top").select("tree", F.col("level").alias("depth"))
    heads = materialise(tops.join(depths, "tree"))
    deepest = heads.agg(F.max("depth")).first()[0] or 0
    paths = "tree string, block long, before array<string>, after array<string>, tail array<string>"
    upper = heads.where("false").select("tree", F.lit(0).cast("long").alias("block"), "before", "after", "tail")
    for stride in range(max(1, -(-deepest // STRIDE)) - 1, -1, -1):
        low, high = stride * STRIDE, stride * STRIDE + STRIDE
        begin = heads.where((F.col("depth") > low if stride else F.lit(True)) & (F.col("depth") <= high))
        upper = upper.unionAll(begin.select("tree", F.lit(0).cast("long").alias("block"), "before", "after", "tail"))
        own = nodes.where((F.col("level") == low) & ~F.col("top")).select("tree", "total", F.col("idx").alias("place"), "digest") if stride else leaves
        own = own.withColumn("block", F.expr(f"place div {BLOCK}"))
        shape, names = (schema, keep) if stride == 0 else (paths, ["place"])
        run = _block(low, names, shape, told if stride == 0 else _kept)
        upper = own.groupBy("tree", "block").cogroup(upper.groupBy("tree", "block")).applyInArrow(run, shape)
        if stride:
            upper = materialise(upper)
    return upper


def _block(level: int, names: list[str], schema: str, told: Callable) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The work on one block of nodes of a level: ``told`` for each, with its siblings in the block and those above."""
    labels, types = zip(*((x.split()[0], _ARROW[x.split()[1]]) for x in schema.split(", ")), strict=True)

    def run(members: pa.Table, above: pa.Table) -> pa.Table:
        if not members.num_rows:
            return pa.Table.from_batches([_batch([], labels, types)])
        before, after, tail = (above.column(c)[0].as_py() for c in ("before", "after", "tail"))
        tree, total = members.column("tree")[0].as_py(), members.column("total")[0].as_py()
        held = sorted(zip(members.column("place").to_pylist(), members.column("digest").to_pylist(), _values(members, names), strict=True), key=lambda r: r[0])
        beside = _beside([d for _, d, _ in held], level, total)
        out = []
        for k, (_, _, values) in enumerate(held):
            sides = [pairs[k // BASE**j] for j, pairs in enumerate(beside)]
            out.append(told(tree, values, [a for a, _ in sides] + before, [b for _, b in sides] + after, tail))
        return pa.Table.from_batches([_batch(out, labels, types)])

    return run


def _kept(tree: str, values: tuple, left: list[str], right: list[str], tail: list[str]) -> tuple:
    return tree, values[0], left, right, tail


def _values(table: pa.Table, names: list[str]) -> list[tuple]:
    return list(zip(*(table.column(c).to_pylist() for c in names), strict=True))


def fold(value: str, left: list[str], right: list[str]) -> str:
    """The root above a leaf, from its siblings by level."""
    for a, b in zip(left, right, strict=True):
        value = digest(a + value + b)
    return value


def manifest(docs: DataFrame, fields: list[str] = FIELDS, id_col: str = "doc_id", source_col: str = "source", other: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Leaves, nodes of the sources' trees, subroots as leaves, and nodes of the tree above them.

    Leaves stand in order of ``id_col``, null first, then of their digests, so repeated rows are leaves side by side and
    no field needs to be unique. Null sources are a tree of their own, the first; the others follow bytewise. A
    tree's name is ``s`` and the source, or nothing for null. ``other``: a column told beside each leaf. An empty table has no
    leaves, nodes or root. Columns besides ``fields`` play no part, whatever their names.
    """
    col = lambda c: F.col(quoted(c))
    tree = F.coalesce(F.concat(F.lit("s"), col(source_col).cast("string")), F.lit(""))
    told = materialise(docs.select(col(id_col).cast("long").alias("id"), tree.alias("tree"), leaf([col(c) for c in fields]).alias("digest"), (F.lit(None).cast("string") if other is None else other).alias("other")))
    leaves = in_order(told.withColumn("tie", F.monotonically_increasing_id()), ["tree"], ["id", "digest", "tie"]).drop("tie")
    nodes = build(leaves)
    tops = nodes.where("top").select(F.lit("sources").alias("all"), "tree", "digest")
    sources = in_order(materialise(tops), ["all"], ["tree"]).select(F.col("all").alias("tree"), "total", "place", "digest", F.col("tree").alias("source"))
    above = build(sources)
    release(told)
    return leaves, nodes, sources, above


def proofs(docs: DataFrame) -> DataFrame:
    """Per document: leaf, subroot, root, digest of its siblings up to the root, and whether the document as it may have been tampered with still leads there.

    Documents whose id has an even CRC-32 lose their line feeds; those without an id, text or line feed stay as they are.
    Repeated rows have a proof each, of their own place. Other columns are ignored. An empty table gives an empty result.
    """
    hit = (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0) & F.contains("text", F.lit("\n"))
    changed = leaf([F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in FIELDS])
    leaves, nodes, sources, above = manifest(docs, other=F.when(hit, changed))

    def source_path(tree: str, values: tuple, left: list[str], right: list[str], tail: list[str]) -> tuple:
        source, subroot = values
        return source, left, right, [subroot, *tail]

    root = above.where("top").select("tree", F.array().cast("array<string>").alias("before"), F.array().cast("array<string>").alias("after"), F.array("digest").alias("tail"))
    tops = prove(sources, above, root, ["source", "digest"], source_path, "tree string, before array<string>, after array<string>, tail array<string>")

    def told(tree: str, values: tuple, left: list[str], right: list[str], tail: list[str]) -> tuple:
        doc_id, own, other = values
        subroot, top = tail
        folded = fold(other or own, left, right)
        return doc_id, own, subroot, top, digest("".join(a + b for a, b in zip(left, right, strict=True))), folded, folded == top

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return prove(leaves, nodes, tops, ["id", "digest", "other"], told, schema)
