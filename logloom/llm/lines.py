"""Line dedup by content-defined chunks of lines.

A hash rolls over the hashes of two neighbouring lines. A window begins at each line and takes 1, 2, 4 or MOST
lines, the most that begin any passage of MIN_WORDS words starting there (a blank line counts as one word); where
the hash is least in a window, a chunk ends. So what ends a chunk is told by the lines of a window alone:
boundaries follow the content, survive shifts, and every passage of MIN_WORDS words has in all its
copies a boundary at the same line. A line of MIN_WORDS words is a window, and so ends a chunk.

Boundaries that repeat anywhere are found by the hash of their two lines (of the line, if it has MIN_WORDS words).
From a repeated boundary a chunk grows line by line to both sides, also past the boundaries next to it, as far
as a window may reach: less than MIN_WORDS words and MOST lines. What it grows to are units: two lines or more, or one
line of MIN_WORDS words. Units are compared by hash, then by their bytes, and of equal ones all but the first
(lowest id, lowest line) are marked. Runs of marked lines with at least MIN_WORDS words go. A run
never takes the last copy of its lines: what marks a unit is a copy that stands before it.

Why no passage is lost, whatever the lengths of its lines: say it has the lines a to b. The window at a lies in it, so
its boundary c is one in each copy, and growing from c to the left reaches a. The window at the next line either lies in the
passage too, and its boundary grows to the left as far as c, or it reaches past b, and growing from c to the right reaches b.

Line hashes, words and boundaries are written once, a few bytes a line. Texts shuffle only of documents that
hold a unit repeated by hash, units are combined before they shuffle, and hot passages are dealt out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.bloom import Bloom
from logloom.llm.common import WORD, columns, join_split, materialise, renamed

MIN_WORDS = 50
#: Lines of the widest window.
MOST = 8
_OWN = ("n_removed", "removed_words", "removed")


def with_boundaries(docs: DataFrame, min_words: int) -> DataFrame:
    """Adds to ``_text`` its lines' hashes ``_hash`` and words ``_w`` (1 at least), and ``_cuts``, the lines that end chunks.

    The least hash of a window and its place are one number: 32 bits of the hash, then the line. Of equal ones the first
    counts. Sums and minima of 2 and 4 neighbours make those of all windows.
    """
    hashed = docs.withColumn("_lines", F.split("_text", "\n")).withColumns({
        "_hash": F.transform("_lines", lambda x: F.xxhash64(x)), "_w": F.transform("_lines", lambda x: F.greatest(F.lit(1), F.regexp_count(x, F.lit(WORD)))),
    })
    rolled = hashed.withColumn("_roll", F.expr("transform(_hash, (h, i) -> shiftleft(shiftright(xxhash64(get(_hash, i - 1), h), 32), 31) + i)"))
    sums = rolled.withColumn("_w2", F.expr("transform(_w, (w, i) -> w + coalesce(get(_w, i + 1), 0))")).withColumn("_w4", F.expr("transform(_w2, (w, i) -> w + coalesce(get(_w2, i + 2), 0))"))
    least = sums.withColumn("_r2", F.expr("transform(_roll, (r, i) -> least(r, get(_roll, i + 1)))")).withColumn("_r4", F.expr("transform(_r2, (r, i) -> least(r, get(_r2, i + 2)))"))
    three = "w + coalesce(get(_w2, i + 1), 0)"
    at = f"""transform(_w, (w, i) -> CASE WHEN w >= {min_words} THEN i WHEN {three} >= {min_words} THEN get(_roll, i + 1)
      WHEN {three} + coalesce(get(_w4, i + 3), 0) >= {min_words} THEN least(get(_r2, i + 1), get(_r2, i + 2)) ELSE least(get(_r4, i + 1), get(_r4, i + 4)) END)"""
    cuts = F.expr(f"array_distinct(transform(filter({at}, r -> r is not null), r -> cast(r & 2147483647 as int)))")
    return least.withColumn("_cuts", cuts).drop("_lines", "_roll", "_w2", "_w4", "_r2", "_r4")


def _seed(j: str, min_words: int) -> str:
    """A boundary's lines by their hash."""
    return f"if(_w[{j}] >= {min_words}, _hash[{j}], xxhash64(get(_hash, {j} - 1), _hash[{j}]))"


def around(told: DataFrame, min_words: int) -> DataFrame:
    """``k, h, c``: each boundary with the hashes and words of its line and of those that a chunk may grow by."""
    low, high = f"greatest(0, j - {MOST - 1})", f"least(size(_hash), j + {MOST})"
    each = f"transform(_cuts, j -> named_struct('h', {_seed('j', min_words)}, 'a', j, 'low', {low}, 'hashes', slice(_hash, {low} + 1, {high} - {low}), 'w', slice(_w, {low} + 1, {high} - {low})))"
    return told.withColumn("c", F.explode_outer(F.expr(each))).where("c is not null").select("k", F.col("c.h").alias("h"), "c")


def grown(seeds: DataFrame, min_words: int) -> DataFrame:
    """``k, start, n, h, side``: the units that chunks grow to from the boundaries of around(). What grows from one boundary to the left another may grow to the right."""
    unit = "named_struct('start', {a}, 'n', {n}, 'h', xxhash64({n}, slice(c.hashes, {a} - c.low + 1, {n})), 'side', {side})"
    fewer = "aggregate(slice(c.w, {a} - c.low + 1, d), 0, (s, w) -> s + w) < " + str(min_words)
    left, right = "c.a - c.low", "c.low + size(c.hashes) - c.a - 1"
    none = "cast(array() as array<struct<start:int,n:int,h:bigint,side:int>>)"
    sides = [
        f"if({reach} > 0, transform(filter(sequence(1, {reach}), d -> {fewer.format(a=inner)}), d -> {unit.format(a=a, n='(d + 1)', side=side)}), {none})"
        for side, reach, inner, a in ((0, left, "c.a - d", "(c.a - d)"), (1, right, "c.a + 1", "c.a"))
    ]
    own = f"if(c.w[c.a - c.low] >= {min_words}, array({unit.format(a='c.a', n=1, side=2)}), {none})"
    units = seeds.withColumn("u", F.explode_outer(F.expr(f"concat({own}, {', '.join(sides)})"))).where("u is not null")
    return units.select("k", "u.*")


def _repeated(rows: DataFrame) -> Bloom:
    """A filter of the values of ``h`` that several rows have."""
    found = materialise(rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    return Bloom(found, "h", found.count())


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without repeated passages, plus ``n_removed`` (lines), ``removed_words`` and ``removed`` (ranges of lines, first and last).

    Every row stays; a text that has nothing of its own becomes empty. A null text stays null. A
    null id stands for the text's hash. Rows with equal id and text are one document and are
    treated alike. Columns of ``docs`` called like the new ones are replaced. An empty table gives
    an empty result. Jobs run while the result is built.
    """
    own, at = renamed(docs.select(*columns(c for c in docs.columns if c.lower() not in _OWN)))
    th = F.xxhash64(at[text_col])
    keyed = own.withColumn("k", F.struct(F.coalesce(F.col(at[id_col]).cast("long"), th).alias("id"), F.col(at[id_col]).isNull().alias("unnamed"), th.alias("th")))
    keyed = keyed.withColumn("kh", F.xxhash64("k"))
    texts = keyed.where(F.col(at[text_col]).isNotNull()).select("k", "kh", F.col(at[text_col]).alias("_text"))

    told = materialise(with_boundaries(texts.drop("kh"), min_words).drop("_text"))
    seeds = _repeated(told.select(F.explode(F.expr(f"transform(_cuts, j -> {_seed('j', min_words)})")).alias("h")))
    # copies of a passage grow alike, so a unit repeats on one side; what grew on both is one unit from here on
    units = materialise(grown(seeds.passed(around(told, min_words), "h"), min_words).withColumn("grew", F.xxhash64("h", "side")).drop("side"))
    listed = materialise(_repeated(units.select(F.col("grew").alias("h"))).passed(units, "grew").groupBy("k").agg(F.collect_set(F.struct("start", "n", "h")).alias("units")).withColumn("kh", F.xxhash64("k")))

    # of rows with equal id and text one is enough; a unit is its lines, joined as they stood
    some = Bloom(listed, "kh", listed.count()).passed(texts, "kh").join(listed.select("k", "units"), "k").dropDuplicates(["k"])
    one = some.withColumn("_lines", F.split("_text", "\n")).select("k", "_lines", F.explode_outer("units").alias("u")).where("u is not null")
    one = one.select("k", "u.*", F.slice("_lines", F.col("u.start") + 1, F.col("u.n")).alias("own")).withColumn("bytes", F.array_join("own", "\n"))
    # where a unit stands among all: one number, so that the first is found by a hash aggregate; null ids come last
    shift = F.when(F.col("k.unnamed"), F.expr("1000000000000000000000000000000")).otherwise(F.expr("0"))
    place = ((F.col("k.id").cast("decimal(38,0)") * F.lit(1 << 31).cast("decimal(10,0)") + shift).cast("decimal(38,0)") + F.col("start")).cast("decimal(38,0)")
    one = one.withColumn("place", place)
    digest = F.unhex(F.sha2("bytes", 256)).alias("digest")
    same = materialise(one.groupBy("h", "n", "bytes").agg(F.min("place").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("h", digest, "first", "copies"))
    words = F.transform("own", lambda x: F.regexp_count(x, F.lit(WORD))).alias("words")
    marked = join_split(one.select("k", "place", "start", "h", "n", digest, words), same.select("h", "digest", "first"), ["h", "digest"], "inner", same.select("h", "digest", F.col("copies").alias("n")))
    marked = marked.where((F.col("place") > F.col("first")) & ((F.col("n") > 1) | (F.col("words")[0] >= min_words)))
    stood = marked.select("k", "start", F.posexplode_outer("words").alias("j", "w")).select("k", (F.col("start") + F.col("j")).alias("line"), "w").distinct()
    by_line = Window.partitionBy("k").orderBy("line")
    runs = stood.withColumn("run", F.col("line") - F.row_number().over(by_line)).groupBy("k", "run").agg(F.min("line").alias("a"), F.max("line").alias("b"), F.sum("w").alias("w"))
    gone = runs.where(F.col("w") >= min_words).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("removed"), F.sum("w").alias("removed_words"))
    gone = materialise(gone.withColumn("kh", F.xxhash64("k")))

    touched = Bloom(gone, "kh", gone.count()).marked(keyed, "kh", "may")
    changed = touched.where("may").join(gone.drop("kh"), "k", "left").withColumn("_lines", F.split(at[text_col], "\n"))
    part = "slice(_lines, coalesce(get(removed, j - 1).b + 2, 1), coalesce(get(removed, j).a, size(_lines)) - coalesce(get(removed, j - 1).b + 1, 0))"
    kept = F.expr(f"array_join(flatten(transform(sequence(0, size(removed)), j -> {part})), '\n')")
    out = changed.withColumn("_kept", F.when(F.col("removed").isNull(), F.col(at[text_col])).otherwise(kept))
    none = F.expr("cast(array() as array<struct<a:int,b:int>>)")
    out = out.select(
        *[F.col("_kept" if c == text_col else b).alias(c) for c, b in at.items()],
        F.expr("cast(coalesce(aggregate(removed, 0, (s, r) -> s + r.b - r.a + 1), 0) as long)").alias("n_removed"),
        F.coalesce("removed_words", F.lit(0).cast("long")).alias("removed_words"), F.coalesce("removed", none).alias("removed"),
    )
    rest = touched.where("not may").select(*[F.col(b).alias(c) for c, b in at.items()], F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("removed_words"), none.alias("removed"))
    return out.unionAll(rest)
