"""Approximate nearest neighbours by a forest of random-projection trees.

Largest inner product becomes smallest distance by one more component, sqrt(M^2 - |x|^2) with M the
largest norm. The forest is fitted on at most SAMPLE different vectors (lowest hashes): a node
splits at the median of the projection on the difference of two of its vectors. Every row is
indexed into a leaf of each tree. A query goes through all trees with one priority queue of nodes,
by the squared margins that it would cross on the way, until the leaves it has taken hold enough
of the sample; leaf members are scored exactly in double precision.

Equal vectors are indexed once, with their K + 1 smallest ids: no result needs more of them. A
leaf's members are dealt into parts of bounded size, and so are its queries; each part of the one meets each of the other.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.common import materialise, quoted

SAMPLE, TREES = 32_768, 12
#: A leaf holds so many vectors of the sample, or more if there were over LEAVES leaves.
LEAF, LEAVES = 48, 128
#: Share of the sample whose leaves a query takes, and the least number of sample vectors in them. The given embeddings
#: are close to random directions in 64 dimensions, the hardest case for any tree: half of the rows give a recall of 0.9.
SEARCH, SEARCH_LEAST = 0.6, 1_500
#: Members of a leaf, and queries that have taken it, that meet in one task.
PART, QUERIES = 20_000, 20_000


@dataclass
class Tree:
    """Inner nodes in order: a normal, an offset and two children; a child below 0 is leaf -1 - child."""

    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    leaves: list[np.ndarray]


def grow(x: np.ndarray, seed: int, leaf: int) -> Tree:
    rng = np.random.default_rng(seed)
    normals, offsets, children, leaves = [], [], [], []
    todo: list[tuple[np.ndarray, int, int]] = [(np.arange(len(x)), -1, 0)]
    while todo:
        rows, parent, side = todo.pop()
        where = None
        if len(rows) > leaf:
            a, b = rng.choice(rows, 2, replace=False)
            normal = x[a] - x[b]
            p = x[rows] @ normal
            cut = float(np.median(p))
            left = p < cut
            if left.any() and not left.all():
                where = len(normals)
                normals.append(normal / (np.linalg.norm(normal) or 1.0))
                offsets.append(cut / (np.linalg.norm(normal) or 1.0))
                children.append([0, 0])
                todo += [(rows[left], where, 0), (rows[~left], where, 1)]
        if where is None:
            where = -1 - len(leaves)
            leaves.append(rows)
        if parent >= 0:
            children[parent][side] = where
    return Tree(np.array(normals).reshape(-1, x.shape[1]), np.array(offsets), np.array(children, "i8").reshape(-1, 2), leaves)


def leaf_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    at = np.zeros(len(x), "i8") if len(tree.children) else np.full(len(x), -1)
    while (inner := np.flatnonzero(at >= 0)).size:
        node = at[inner]
        right = np.einsum("ij,ij->i", x[inner], tree.normals[node]) >= tree.offsets[node]
        at[inner] = tree.children[node, right.astype("i8")]
    return -1 - at


def search(forest: list[Tree], q: np.ndarray, want: int) -> list[tuple[int, int]]:
    """(tree, leaf) pairs, best margin first over all trees, until their leaves hold ``want`` different sample vectors."""
    queue: list[tuple[float, int, int]] = [(0.0, t, 0 if len(tree.children) else -1) for t, tree in enumerate(forest)]
    heapq.heapify(queue)
    margins = [tree.normals @ q - tree.offsets for tree in forest]
    taken: list[tuple[int, int]] = []
    seen: set[int] = set()
    while queue and len(seen) < want:
        crossed, t, node = heapq.heappop(queue)
        while node >= 0:
            m = float(margins[t][node])
            near, far = (forest[t].children[node][1], forest[t].children[node][0]) if m >= 0 else (forest[t].children[node][0], forest[t].children[node][1])
            heapq.heappush(queue, (crossed + m * m, t, int(far)))
            node = int(near)
        taken.append((t, -1 - node))
        seen.update(forest[t].leaves[-1 - node].tolist())
    return taken


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, one component after the other, so that equal vectors score equally."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), "f8").reshape(-1, dim)


def _lifted(x: np.ndarray, top: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0.0))[:, None]])


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows whose id is divisible by ``every``, against all other rows.

    Rows with a null id or vector, a null or non-finite component or all zeros take no part, nor do
    rows of another length than most have (of equally frequent lengths, the longer one). A query never finds rows of its own id.
    Equal scores rank by the smaller id; repeated rows of an id count once. Other columns are
    ignored. An empty table gives an empty result. Trees see vectors divided by the largest component of all, so that
    squares of large components don't overflow; scores are of the vectors as they are.
    """
    v = F.col("v")
    rows = vectors.select(F.col(quoted(id_col)).cast("long").alias("id"), F.transform(F.col(quoted(vec_col)), lambda x: x.cast("double")).alias("v"))
    sound = rows.where("id is not null and v is not null").where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists(v, lambda x: x != 0))
    ordered = Window.partitionBy("v").orderBy("id")
    # a limit that Spark applies before and after the shuffle, so equal vectors never gather
    few = sound.distinct().withColumn("r", F.row_number().over(ordered)).where(F.col("r") <= k + 1)
    index = materialise(few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("rep", F.get("ids", F.lit(0))))
    spark = vectors.sparkSession
    lengths = sound.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("dim").desc()).first()
    if not lengths:
        return spark.range(0).selectExpr("id query_id", "cast(id as int) rank", "id vec_id", "cast(id as double) score")
    dim = lengths["dim"]
    index = index.where(F.size("v") == dim)
    x = np.array([r["v"] for r in index.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect()])
    unit = index.agg(F.max(F.array_max(F.transform("v", lambda c: F.abs(c))))).first()[0]
    n, top = index.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda s, c: s + (c / unit) * (c / unit)))).first()
    lifted = _lifted(x / unit, top)
    leaf = max(LEAF, len(x) // LEAVES)
    forest = spark.sparkContext.broadcast([grow(lifted, t, leaf) for t in range(TREES)])
    longest = math.sqrt(top)
    parts = max(1, math.ceil(n * leaf / len(x) / PART))
    queries = sound.where(F.col("id") % every == 0).where(F.size("v") == dim).select("id", "v").distinct()
    different = materialise(queries.groupBy("v").agg(F.min("id").alias("q")))
    want = max(SEARCH_LEAST, math.ceil(SEARCH * len(x)), 2 * k)

    asking = max(1, math.ceil(different.count() * min(1.0, want / len(x)) / QUERIES))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _lifted(_matrix(batch.column(1), dim) / unit, top)
            rep = batch.column(0).to_numpy()
            for t, tree in enumerate(forest.value):
                leaves = pa.array(leaf_of(tree, m))
                for k in range(asking):
                    part = pa.array(rep % parts * asking + k)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), t, "i4")), leaves, part, batch.column(0), batch.column(1)], ["tree", "leaf", "part", "rep", "v"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = _matrix(batch.column(1), dim)
            # a query's own length doesn't change its order of nearness; the added component is 0
            near = raw / np.abs(raw).max(axis=1, keepdims=True)
            m = np.hstack([near * math.sqrt(top) / np.linalg.norm(near, axis=1, keepdims=True), np.zeros((len(raw), 1))])
            own = batch.column(0).to_numpy() % asking
            for at in range(0, len(m), 256):
                found = [(i, t, leaf, p * asking + own[i]) for i in range(at, min(at + 256, len(m))) for t, leaf in search(forest.value, m[i], want) for p in range(parts)]
                i, t, leaf, p = map(np.array, zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(t.astype("i4")), pa.array(leaf.astype("i8")), pa.array(p.astype("i8")), batch.column(0).take(pa.array(i)), batch.column(1).take(pa.array(i))], ["tree", "leaf", "part", "q", "qv"])

    def scored(members: pa.Table, queries: pa.Table) -> pa.Table:
        if not members.num_rows or not queries.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], ["q", "rep", "score"])
        m, q = (_matrix(t.column(c).combine_chunks(), dim) for t, c in ((members, "v"), (queries, "qv")))
        reps, qs = members.column("rep").to_numpy(), queries.column("q").to_numpy()
        scaled, kth, out = m / unit, min(k + 1, len(m)) - 1, []
        for at in range(0, len(q), 256):
            asker = q[at : at + 256] / np.abs(q[at : at + 256]).max(axis=1, keepdims=True)
            rough = asker @ scaled.T
            # all that may be among the k + 1 best once scored exactly, however many are equal
            least = -np.partition(-rough, kth, axis=1)[:, kth]
            margin = 1e-12 * dim * np.abs(rough).max(axis=1) + 1e-12 * dim * np.linalg.norm(asker, axis=1) * longest
            i, j = np.nonzero(rough >= (least - margin)[:, None])
            score = inner_products(q[at + i], m[j])
            order = np.lexsort((reps[j], -score, i))
            i, j, score = i[order], j[order], score[order]
            first = np.searchsorted(i, np.arange(len(rough)))
            best = np.arange(len(i)) - first[i] <= kth
            out.append(pa.table([pa.array(qs[at + i[best]]), pa.array(reps[j[best]]), pa.array(score[best])], ["q", "rep", "score"]))
        return pa.concat_tables(out)

    members = index.select("rep", "v").mapInArrow(placed, "tree int, leaf long, part long, rep long, v array<double>")
    # few bytes and much work: as many tasks as shuffles have, whatever their size
    dealt = different.select("q", "v").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "q")
    told = dealt.mapInArrow(asked, "tree int, leaf long, part long, q long, qv array<double>")
    pairs = members.groupBy("tree", "leaf", "part").cogroup(told.groupBy("tree", "leaf", "part")).applyInArrow(scored, "q long, rep long, score double")
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), "rep")
    close = pairs.distinct().withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    spread = close.join(index.select("rep", "ids"), "rep").select("q", "score", F.explode("ids").alias("vec_id"))
    again = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    # equal queries share their neighbours; each then leaves itself out
    shared = spread.withColumn("r", F.row_number().over(again)).where(F.col("r") <= k + 1)
    lists = shared.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found"))
    named = queries.join(different, "v").select(F.col("id").alias("query_id"), "q")
    own = F.slice(F.filter("found", lambda f: f.vec_id != F.col("query_id")), 1, k)
    return (
        named.join(lists, "q").select("query_id", F.posexplode(own).alias("p", "f"))
        .select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "f.vec_id", "f.score")
    )
