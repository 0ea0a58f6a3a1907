"""Near-duplicates by Order MinHash, verified by banded alignment.

A text is the sequence of its five-word shingles, each labelled with its occurrence in the text. A
sketch picks the ELEMENTS labelled shingles with the smallest hashes of a random order and keeps
them in the order of the text; two texts share a sketch with about the probability that they agree
on shingles and on their order. There are SKETCHES of them: at a similarity of 0.8 a pair shares none
with a probability below 10^-6.

Similarity is L / (n + m - L) for texts of n and m shingles that have L in common in the same
order. Equal texts are one class before anything else. Of different texts, every member of a sketch's
bucket is first compared with two of them, the smallest id and one by hash, and components are joined;
nearly all members of a family are one component then. Buckets that
still hold several components compare their members across components, in blocks of BLOCK: a pair in
the first bucket it shares, by two true bounds, what their lengths and their shingles by bin allow, then by the
shingles in common. Only pairs that may be links leave the block, to be verified. The largest
component of a bucket isn't compared with itself, so a family and few others cost one row for each member.

A bucket where more than SPLIT members stand outside its largest component is common text in
different documents. Its members are compared where they share rare shingles instead: of n
shingles in a global order, rare ones first, two similar texts share one of the first n - ceil(0.8 n) + 1.
The order comes from a table of counts with ORDER rows, whatever the input. No link between different texts is lost
but by sketches, and what remains quadratic is the number of texts below the similarity that share
one of their rarest shingles.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.bloom import Bloom
from logloom.llm.common import join_split, materialise, quoted, release, renamed
from logloom.llm.components import components

WORDS, SIMILARITY = 5, 0.8
SKETCHES, ELEMENTS = 20, 3
#: Members of a bucket, and bytes of their shingles, that meet in one task for the comparison of all with all.
BLOCK, BLOCK_BYTES, BINS = 512, 16 << 20, 1024
SPLIT, ORDER = 2048, 1 << 20
_MUL = np.uint64(0x9E3779B97F4A7C15)
_CACHE: dict[str, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _word_hash(word: str) -> int:
    h = _CACHE.get(word)
    if h is None:
        if len(_CACHE) > 500_000:
            _CACHE.clear()
        raw = word.encode()
        h = _CACHE[word] = zlib.crc32(raw) << 32 | zlib.crc32(raw[::-1], 0x5BD1E995)
    return h


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the labelled shingles of a text, in order; a text of fewer than five words is one shingle, one without words has none."""
    words = (text or "").split()
    if not words:
        return np.empty(0, "u8")
    w = np.array([_word_hash(x) for x in words], "u8")
    n = max(1, len(w) - WORDS + 1)
    s = np.full(n, len(w) if len(w) < WORDS else WORDS, "u8")
    for k in range(min(WORDS, len(w))):
        s = _mix((s + w[k : k + n]) * _MUL)
    order = np.argsort(s, kind="stable")
    t = s[order]
    first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
    label = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))
    s[order] = np.where(label > 0, _mix(t + label.astype("u8") * _MUL), t)
    return s


_SEEDS = _mix(np.arange(1, SKETCHES + 1, dtype="u8") * _MUL)


def sketches(s: np.ndarray) -> np.ndarray:
    """One 64-bit key for each sketch of at least one shingle."""
    keys = np.full(SKETCHES, len(s) if len(s) < ELEMENTS else ELEMENTS, "u8")
    if len(s) <= ELEMENTS:
        picked = np.broadcast_to(np.arange(len(s)), (SKETCHES, len(s)))
    else:
        picked = np.empty((SKETCHES, ELEMENTS), "i8")
        for k, seed in enumerate(_SEEDS):
            picked[k] = np.sort(np.argpartition(_mix((s ^ seed) * _MUL), ELEMENTS - 1)[:ELEMENTS])
    for j in range(picked.shape[1]):
        keys = _mix((keys + s[picked[:, j]]) * _MUL)
    return _mix(keys + _SEEDS)


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """L / (n + m - L), or 0 if that is below ``least``.

    Labelled shingles occur once in a text, so a common subsequence is an increasing run of the
    places in b of what a and b share. A pair that reaches ``least`` has at most so many unmatched
    shingles, and no match of its alignment lies farther off the diagonal than that: the band.
    """
    n, m = len(a), len(b)
    need = least / (1 + least) * (n + m) - 1e-9
    if not n or not m or min(n, m) < need:
        return 0.0
    _, ia, ib = np.intersect1d(a, b, assume_unique=False, return_indices=True)
    band = n + m - 2 * need
    near = np.abs(ia - ib) <= band
    if near.sum() < need:
        return 0.0
    places = ib[near][np.argsort(ia[near], kind="stable")]
    if np.all(places[1:] > places[:-1]):
        length = len(places)
    else:
        tails: list[int] = []
        for p in places.tolist():
            k = bisect_left(tails, p)
            tails[k : k + 1] = [p]
        length = len(tails)
    return length / (n + m - length) if length >= need else 0.0


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            out = []
            for text in part.column(2):
                s = shingles(text.as_py())
                out.append(sketches(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.binary())], ["id", "digest", "sketch"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy()
        keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, SKETCHES)), pa.array(keys)], ["id", "key"])


def _verified(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, s = None, np.empty(0, "u8")
        for batch in batches:
            keep = []
            for a, ta, tb in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != last:
                    last, s = a, shingles(ta.as_py())
                keep.append(similarity(s, shingles(tb.as_py()), least) > 0)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verify(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of ids whose ``texts`` (id, text) are similar. An end with many pairs is dealt out."""
    ends = F.explode(F.array(F.struct(F.lit("a").alias("end"), F.col("a").alias("id")), F.struct(F.lit("b").alias("end"), F.col("b").alias("id"))))
    counts = materialise(pairs.select(ends.alias("e")).groupBy("e.end", "e.id").agg(F.count("*").alias("n")))
    joined = pairs
    for end, text in (("b", "tb"), ("a", "ta")):
        own = counts.where(F.col("end") == end).select(F.col("id").alias(end), "n")
        joined = join_split(joined, texts.select(F.col("id").alias(end), F.col("text").alias(text)), [end], "inner", own, narrow=False)
    return joined.select("a", "b", "ta", "tb").sortWithinPartitions("a").mapInArrow(_verified(least), "a long, b long")


def bins(s: np.ndarray) -> np.ndarray:
    """How many shingles fall into each of BINS bins."""
    return np.bincount((s >> np.uint64(20)).astype("i8") & (BINS - 1), minlength=BINS).astype("i4")


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [np.sort(shingles(t.as_py())).tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["id", "shingles"])


def _place(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(13)).astype("i8") & (ORDER - 1)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the places of all shingles of a partition."""
    n = np.zeros(ORDER, "i8")
    for batch in batches:
        n += np.bincount(_place(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u8")), minlength=ORDER)
    some = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["place", "n"])


def rare_first(s: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """So many of the rarest shingles that two texts that reach ``least`` share one of them."""
    return s[np.lexsort((s, counts[_place(s)]))][: len(s) - math.ceil(least * len(s) - 1e-9) + 1]


def _by_rare(members: DataFrame, made: DataFrame, least: float) -> DataFrame:
    """``key, id, label`` of members (id, label): one row for each rare shingle that members of several components have."""
    own = materialise(members.join(made, "id"))
    counts = np.zeros(ORDER, "i8")
    found = own.select("shingles").mapInArrow(_counted, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    counts[found.column("place").to_numpy()] = found.column("n").to_numpy()
    shared = members.sparkSession.sparkContext.broadcast(counts)  # ORDER numbers

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [rare_first(np.frombuffer(x, "<u8"), shared.value, least) for x in batch.column(2).to_pylist()]
            n = [len(x) for x in told]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.empty(0, "u8"), *told]).view("i8")), *[pa.array(np.repeat(batch.column(k).to_numpy(), n)) for k in (0, 1)]], ["key", "id", "label"]
            )

    return _several(materialise(own.select("id", "label", "shingles").mapInArrow(keys, "key long, id long, label long")))


def _several(placed: DataFrame) -> DataFrame:
    """The rows (key, id, label) of keys with several labels."""
    some = materialise(placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", "n"))
    return join_split(placed, some.select("key"), ["key"], "inner", some)


def _sizes(rest: DataFrame, shingled: DataFrame) -> DataFrame:
    """Of each key of ``rest`` (key, id, label): its rows, its largest label, the rows outside that, and the blocks of both."""
    by_label = rest.join(shingled.select("id", F.length("shingles").alias("size")), "id").groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    by_key = by_label.groupBy("key").agg(F.max(F.struct("n", "label", "bytes")).alias("top"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    blocks = lambda n, size: F.ceil(F.greatest(n / BLOCK, size / BLOCK_BYTES)).cast("long")
    few, rest_bytes = F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes")
    return materialise(by_key.select("key", "n", F.col("top.label").alias("largest"), few.alias("few"), blocks(F.col("top.n"), F.col("top.bytes")).alias("tops"), blocks(few, rest_bytes).alias("others")))


def _meetings(rest: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows of ``rest`` (key, id, label) once for each meeting of their block; ``sizes`` tells a key's largest label, and blocks of that and of the others."""
    told = join_split(rest, sizes.select("key", "largest", "tops", "others"), ["key"], "inner", sizes.select("key", "n")).withColumn("top", F.col("label") == F.col("largest"))
    told = told.withColumn("mine", F.pmod(F.xxhash64("id"), F.when(F.col("top"), F.col("tops")).otherwise(F.col("others"))))
    # blocks of the others are numbered from 0, those of the largest label below it; two of the latter never meet
    light = F.sequence(F.lit(0).cast("long"), F.col("others") - 1)
    heavy = F.transform(F.sequence(F.lit(1).cast("long"), F.col("tops")), lambda x: -x)
    spread = told.withColumn("mine", F.when(F.col("top"), -1 - F.col("mine")).otherwise(F.col("mine"))).withColumn("with", F.explode(F.when(F.col("top"), light).otherwise(F.concat(light, heavy))))
    return spread.select("key", F.least("mine", "with").alias("i"), F.greatest("mine", "with").alias("j"), F.when(F.col("mine") <= F.col("with"), 0).otherwise(1).alias("side"), "id", "label")


def _across(least: float):
    def run(block: pa.Table) -> pa.Table:
        """Pairs of members of two blocks of a bucket, in different components, that may reach ``least``."""
        key = block.column("key")[0].as_py()
        side, ids, labels = (block.column(c).to_numpy() for c in ("side", "id", "label"))
        told = block.column("keys").to_pylist()
        width = max(len(x) for x in told)
        # what is missing is filled up with numbers that differ
        keys = np.array([x + [-1 - i * width - j for j in range(width - len(x))] for i, x in enumerate(told)], "i8").reshape(len(told), width)
        keys.sort(axis=1)
        own = [np.frombuffer(x, "<u8") for x in block.column("shingles").to_pylist()]
        n = np.array([len(x) for x in own])
        filled = np.array([bins(x) for x in own])
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        alone = not len(right)
        a, b = [], []
        for k, i in enumerate(left):
            some = left[k + 1 :] if alone else right
            some = some[(labels[some] != labels[i]) & (np.minimum(n[some], n[i]) >= least * np.maximum(n[some], n[i]))]
            if len(some):
                common = np.minimum(filled[some], filled[i]).sum(axis=1)
                some = some[common >= least / (1 + least) * (n[some] + n[i]) - 1e-9]
            for j in some:
                both = np.intersect1d(keys[i], keys[j], assume_unique=True)
                if both[0] != key:  # they meet in another bucket
                    continue
                if len(np.intersect1d(own[i], own[j], assume_unique=True)) >= least / (1 + least) * (n[i] + n[j]) - 1e-9:
                    a.append(ids[i])
                    b.append(ids[j])
        lo, hi = np.minimum(a, b).astype("i8"), np.maximum(a, b).astype("i8")
        return pa.table([pa.array(hi), pa.array(lo)], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """``doc_id, class_id`` for each row of ``docs``; class_id is the smallest doc_id of its class.

    A class is a component of equal texts and of texts with a similarity of ``least`` or more. A
    null text counts as empty, and empty texts are equal; texts of white space alone are similar
    to none. A text of fewer than five words is similar only to those with the same words.
    Repeated rows of an id are in each of its texts' classes. A row with a null id can't be
    named by another and is a class of its own, with a null class_id. Other columns are ignored.
    """
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256))).select("id", "digest", "text")
    named = rows.where("id is not null")
    made = materialise(named.mapInArrow(_sketched, "id long, digest binary, sketch binary"))
    different = materialise(made.groupBy("digest").agg(F.min("id").alias("rep"), F.min("sketch").alias("sketch"), F.count("*").alias("n")))
    # copies take the id of their text; an id that comes with several texts joins them
    twice = different.where("n > 1")
    copies = join_split(made.select("id", "digest"), twice.select("digest", "rep"), ["digest"], "inner", twice.select("digest", "n"))
    linked = materialise(copies.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")))
    owners = different.where("sketch is not null").select(F.col("rep").alias("id"), "sketch", "digest")

    keys = materialise(owners.select("id", "sketch").mapInArrow(_keys, "id long, key long"))
    # every member of a bucket is compared with the smallest id and with another one by hash
    first, second = F.min("id").alias("f0"), F.min_by("id", F.xxhash64("id", "key")).alias("f1")
    shared = materialise(keys.groupBy("key").agg(first, second, F.max("id").alias("hi"), F.count("*").alias("n")).where("f0 < hi").select("key", "f0", "f1", "n"))
    buckets = materialise(join_split(keys, shared.select("key", "f0", "f1"), ["key"], "inner", shared.select("key", "n")))
    may = Bloom(buckets, "id", buckets.agg(F.approx_count_distinct("id", 0.02)).first()[0])
    own = may.passed(owners.select("id", "digest"), "id").join(buckets.select("id"), "id", "left_semi")
    texts = materialise(may.passed(named, "id").join(own, ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"]).select("id", "text"))
    release(made, keys)

    met = buckets.select("id", F.explode(F.array_distinct(F.array("f0", "f1"))).alias("first")).where("id <> first")
    told = materialise(met.select(F.greatest("id", "first").alias("a"), F.least("id", "first").alias("b")).distinct())
    found = components(linked.unionAll(_verify(told, texts, least)))
    placed = materialise(buckets.select("key", "id").join(found, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label")))
    open_ = materialise(_several(placed))
    release(shared, buckets, placed)

    # what is left of a bucket: its largest label and the others
    shingled = materialise(texts.join(open_.select("id"), "id", "left_semi").mapInArrow(_shingled, "id long, shingles binary"))
    sizes = _sizes(open_, shingled)
    if sizes.where(F.col("few") > SPLIT).head(1):
        big, small = (join_split(open_, sizes.where(c).select("key"), ["key"], "inner", sizes.select("key", "n")) for c in (F.col("few") > SPLIT, F.col("few") <= SPLIT))
        rare = _by_rare(big.select("id", "label").distinct(), shingled, least)
        open_ = materialise(small.select("key", "id", "label").unionAll(rare.select("key", "id", "label")).distinct())
        sizes = _sizes(open_, shingled)
    own = shingled.join(open_.groupBy("id").agg(F.sort_array(F.collect_set("key")).alias("keys")), "id")
    meets = _meetings(open_, sizes).join(own, "id")
    across = meets.groupBy("key", "i", "j").applyInArrow(_across(least), "a long, b long").distinct()
    untold = materialise(across.join(told, ["a", "b"], "left_anti"))
    if untold.head(1):
        stars = found.select(F.col("id").alias("a"), F.col("label").alias("b"))
        found = components(stars.unionAll(_verify(untold, texts, least)))
    release(different, linked, told, texts, open_, shingled, sizes, untold)
    classes = rows.where("id is not null").select("id").join(found, "id", "left").select(F.col("id").alias("doc_id"), F.coalesce("label", "id").alias("class_id"))
    return classes.unionAll(rows.where("id is null").select(F.col("id").alias("doc_id"), F.col("id").alias("class_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each class, the one with the smallest id; of rows with that id, the one with the lowest hash.

    Rows with a null id all stay. Columns may have any names.
    """
    own, at = renamed(docs)
    i = at[id_col]
    classes = near_duplicates(own, i, at[text_col], least)
    gone = materialise(classes.where("class_id <> doc_id").select(F.col("doc_id").alias("id")).distinct())
    again = own.groupBy(F.col(i).cast("long").alias("id")).agg(F.count("*").alias("n")).where("n > 1 and id is not null").select("id")
    # texts of documents that certainly stay, most of them, aren't shuffled
    touched = materialise(gone.unionAll(again))
    keyed = own.withColumn("id", F.col(i).cast("long"))
    marked = Bloom(touched, "id", touched.count()).marked(keyed, "id", "may")
    told = F.xxhash64(*[c for c, t in own.dtypes if "map<" not in t])
    rest = marked.where("may").join(gone, "id", "left_anti").groupBy("id").agg(F.min_by(F.struct(*own.columns), told).alias("row")).select("row.*")
    kept = marked.where("not may").select(*own.columns).unionAll(rest)
    return kept.select(*[F.col(b).alias(c) for c, b in at.items()])
