"""Shards of even sizes that keep linked documents together, by balanced label propagation.

Links are memberships: rows of one key are each other's neighbours, so that copies aren't expanded into pairs. Rows
start in shards of their hash, and all are unsettled. In each round the shards of a row's neighbours are counted, and an unsettled row asks for
the one with most of them whose quota has room for the unsettled rows of its group. Requests are granted by group size, largest first,
up to the quotas; such rows move there and are settled. A sweep ends when nothing is granted any more. Where rows
have several keys another sweep starts from the labels of the last one.

The driver sees sums over shards, size classes and hash buckets, never rows. Groups above the quota can't be in one
shard; they are cut into pieces, which keep the group's key beside their own and so follow each other.

Last, rows without neighbours, or whose group found no room, fill the shards up. Rows are ranked by shard and key, as in_order() does;
those without a shard go by their rank to what shards lack. So counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import columns, free_name, in_order, join_split, materialise, quoted, release

SHARDS, SWEEPS, ROUNDS = 16, 3, 24
#: Pieces of a group above the quota have about an 8th of it.
PIECES = 8
#: Requests are granted by classes of sizes (powers of two), and in these by buckets of hashes.
BUCKETS = 256


def propagate(links: DataFrame, shards: int, quota: int, sweeps: int = SWEEPS) -> DataFrame:
    """``row, at`` for the rows of ``links`` (row, key: long, each pair once) that got a shard by label propagation.

    ``quota``: rows that a shard takes at most. Rows without an answer found no room with their neighbours.
    """
    sizes = materialise(links.groupBy("key").agg(F.count("*").alias("n")))
    # as many groups as there are shards, at most
    over = sizes.where(F.col("n") > quota).select("key", F.ceil(F.col("n") * PIECES / max(1, quota)).cast("int").alias("pieces"))
    piece = F.xxhash64("key", F.pmod(F.xxhash64("row"), F.col("pieces")))
    cut = links.join(F.broadcast(over), "key", "left").select("row", F.explode(F.when(F.col("pieces").isNull(), F.array("key")).otherwise(F.array("key", piece))).alias("key"))
    now = materialise(cut.select("row", "key", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("at")))
    while True:
        got, moved = _sweep(now, shards, quota)
        sweeps -= 1
        if not moved or not sweeps:
            return got
        old = F.col("at").alias("old")
        now = materialise(join_split(now.select("row", "key", old), got, ["row"], "left").select("row", "key", F.coalesce("at", "old").alias("at")))


def _sweep(now: DataFrame, shards: int, quota: int) -> tuple[DataFrame, int]:
    """The new shard of each row of ``row, key, at`` that got one, and how many rows moved."""
    rooms, moved, settled = [quota] * shards, 0, now.where("false").select("row", "at")
    state = now.withColumn("free", F.lit(True))
    for k in range(ROUNDS):
        counts = F.array(*[F.sum(F.when(F.col("at") == s, 1).otherwise(0)) for s in range(shards)])
        groups = materialise(state.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("free").cast("int")).alias("free_n"), counts.alias("c")).where("free_n > 0"))
        met = join_split(state, groups.drop("n"), ["key"], "inner", groups.select("key", "n"))
        # the smallest of a row's groups tells what must find room; ties have one order, so that its rows agree
        own = F.max(F.struct(-F.col("free_n"), "key", F.col("free_n").alias("n")))
        score = F.array(*[F.sum(F.get("c", F.lit(s))) for s in range(shards)])
        rows = met.groupBy("row").agg(F.first("at").alias("at"), F.first("free").alias("free"), F.collect_list("key").alias("keys"), own.alias("own"), score.alias("score"))
        asking = materialise(rows.select("row", "at", "keys", "free", F.when(F.col("free"), _wanted(rooms)).alias("to"), _turn()))
        asked = asking.where("to is not null").groupBy("to", "turn").agg(F.count("*").alias("n"), F.sum((F.col("to") != F.col("at")).cast("int"))).collect()
        last, rooms = grant([tuple(r)[:3] for r in asked], rooms)
        if k:
            release(state)
        release(groups)
        moved += sum(n for to, turn, _, n in asked if turn <= last[to])
        granted = F.col("to").isNotNull() & (F.col("turn") <= F.get(F.array(*[F.lit(x) for x in last]), F.col("to")))
        granted = F.coalesce(granted, F.lit(False))
        settled = settled.unionAll(asking.where(granted).select("row", F.col("to").alias("at")))
        if all(turn <= last[to] for to, turn, _, _ in asked) or all(x < 0 for x in last):
            break  # room only shrinks, so who couldn't ask now never can
        state = materialise(asking.select("row", F.explode("keys").alias("key"), F.when(granted, F.col("to")).otherwise(F.col("at")).alias("at"), (F.col("free") & ~granted).alias("free")))
    return materialise(settled), moved


def _turn() -> Column:
    """When a row's request is granted: larger groups first, the rows of a group together."""
    size = F.least(F.floor(F.log2(F.col("own.n").cast("double"))), F.lit(40))
    return ((40 - size) * BUCKETS + F.pmod(F.xxhash64("own.key"), F.lit(BUCKETS))).cast("int").alias("turn")


def _wanted(rooms: list[int]) -> Column:
    """The shard with most neighbours of those with room for the group; ties by the group's hash."""
    choices = []
    for s, room in enumerate(rooms):
        tie = F.pmod(F.xxhash64("own.key", F.lit(s)), F.lit(1 << 20))
        choices.append(F.when(F.col("own.n") <= room, F.struct(F.get("score", F.lit(s)).alias("n"), tie.alias("tie"), F.lit(s).alias("s"))))
    return F.greatest(*choices).getField("s") if len(choices) > 1 else choices[0].getField("s")


def grant(asked: list[tuple[int, int, int]], rooms: list[int]) -> tuple[list[int], list[int]]:
    """For each shard the last turn that it has room for, -1 if it has for none, and the room it has after that.

    ``asked``: (shard, turn, rows).
    """
    last, left, full = [-1] * len(rooms), list(rooms), [False] * len(rooms)
    for to, turn, n in sorted(asked, key=lambda r: r[1]):
        full[to] = full[to] or n > left[to]
        if not full[to]:
            last[to] = turn
            left[to] -= n
    return last, left


def spread(rows: DataFrame, at: str, order: list[str], shards: int) -> DataFrame:
    """``rows``, a table of materialise(), with ``shard`` and ``slot``: places from 0 without gaps in shards whose counts differ by one at most.

    ``at``: the shard that a row should be in, null if it may be in any. ``order`` tells rows apart; what is beyond a
    shard's share is last in it.
    """
    spot = F.coalesce(F.col(at), F.lit(shards)).cast("int")
    placed = in_order(materialise(rows.withColumn("_spot", spot)), ["_spot"], order, "_place", "_total")
    loads = dict.fromkeys(range(shards), 0) | {r["_spot"]: r["n"] for r in rows.groupBy(spot.alias("_spot")).agg(F.count("*").alias("n")).collect()}
    total = sum(loads.values())
    share = [total // shards + (s < total % shards) for s in range(shards)]
    held = [min(loads[s], share[s]) for s in range(shards)]
    beyond = [sum(loads[x] - held[x] for x in range(s)) for s in range(shards + 1)]
    lacking = [sum(share[x] - held[x] for x in range(s)) for s in range(shards + 1)]

    def of(values: list[int], key: Column) -> Column:
        return F.get(F.array(*[F.lit(v).cast("long") for v in values]), key)

    here = F.col("_place") < of([*held, 0], F.col("_spot"))
    rank = of(beyond, F.col("_spot")) + F.col("_place") - of([*held, 0], F.col("_spot"))
    shard = F.coalesce(*[F.when(F.col("_rank") < lacking[s + 1], s) for s in range(shards)])
    out = placed.withColumn("_rank", rank).withColumn("shard", F.when(here, F.col("_spot")).otherwise(shard).cast("int"))
    slot = F.when(here, F.col("_place")).otherwise(of(held, F.col("shard")) + F.col("_rank") - of(lacking, F.col("shard")))
    return out.withColumn("slot", slot).drop("_spot", "_place", "_total", "_rank")


def shard_documents(docs: DataFrame, shards: int = SHARDS, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns, if none are named), ``size``, ``text_crc32``, ``shard`` and ``slot`` of each row of ``docs``.

    Rows of equal texts are linked; null texts are one group, empty ones another. ``size`` is the text's bytes, 0 for null, and 1;
    the checksum of a null text is 0. Repeated rows are rows of their own. New names that clash with a kept column get an underscore. An empty table gives an empty result.
    """
    keep = docs.columns if keep is None else keep
    text = F.col(quoted(text_col))
    names = {c: free_name(c, keep) for c in ("size", "text_crc32", "shard", "slot")}
    own = [c.alias(f"c{k}") for k, c in enumerate(columns(keep))]
    told = materialise(docs.select(*own, (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"), F.xxhash64(text.isNull(), text).alias("key"), F.monotonically_increasing_id().alias("row")))
    copies = materialise(told.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    links = join_split(told.select("row", "key"), copies.select("key"), ["key"], "inner", copies)
    n = told.count()
    at = propagate(materialise(links), shards, n // shards, sweeps=1)  # a row has one group
    rows = materialise(join_split(told, at, ["row"], "left"))
    out = spread(rows, "at", ["key", "row"], shards)
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(keep)], *[F.col(c).alias(name) for c, name in names.items()])


def cut_links(placed: DataFrame, key: str, shard: str) -> tuple[int, int]:
    """Pairs of rows with equal keys: how many lie in different shards, and all."""
    groups = placed.groupBy(key, shard).agg(F.count("*").alias("n")).groupBy(key).agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1)).alias("kept"))
    every, kept = groups.agg(F.sum(F.col("n") * (F.col("n") - 1)), F.sum("kept")).first()
    return ((every or 0) - (kept or 0)) // 2, (every or 0) // 2
