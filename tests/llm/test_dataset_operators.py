"""Merkle manifests, filter audits and shards: brute force and odd inputs."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from logloom.llm import audit, merkle, sharding
from logloom.llm import queries as q
from logloom.llm.common import in_order, materialise

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def told(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def above(digests):
    """Levels of a tree, the leaves first."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, k):
    out = []
    for level in levels[:-1]:
        first = k - k % 3
        out.append((level[first:k], level[k + 1 : first + 3]))
        k //= 3
    return out


def brute_manifest(docs):
    by = defaultdict(list)
    for d in docs:
        fields = lambda text, d=d: H(*(told(v) for v in (d["doc_id"], d["source"], d["lang"], d["n_chars"], text)))
        hit = d["doc_id"] is not None and d["text"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 2 == 0
        by[d["source"]].append((d["doc_id"] is not None, d["doc_id"] or 0, fields(d["text"]), fields(d["text"].replace("\n", "")) if hit else None))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: above([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in order}
    tops = above([trees[s][-1][0] for s in order])
    out = []
    for at, s in enumerate(order):
        for k, (known, doc_id, own, other) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            path = siblings(trees[s], k) + siblings(tops, at)
            folded = other or own
            for left, right in path:
                folded = H(*left, folded, *right)
            out.append((doc_id if known else None, own, trees[s][-1][0], tops[-1][0], H(*(x for a, b in path for x in a + b)), folded, folded == tops[-1][0]))
    return Counter(out)


def test_manifest_of_the_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    got = q.op11_merkle_manifest(spark, small).collect()
    assert Counter(map(tuple, got)) == brute_manifest(docs)
    assert {r["verified"] for r in got} == {True, False}


@pytest.mark.parametrize("sizes", [[1], [1, 1], [3, 4, 730], [2200, 1, 9, 27, 28, 5]])
def test_manifest_of_sizes(spark, sizes):
    rng = random.Random(len(sizes))
    rows = [(rng.randrange(10**9), "a\nb" if k % 3 else None, None, None if s == 1 else f"s{s}" if s else "\U0001f600", k) for s, n in enumerate(sizes) for k in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert Counter(map(tuple, merkle.proofs(df).collect())) == brute_manifest(df.collect())


def test_manifest_of_odd_rows(spark):
    rows = [(None, "a\n", None, None, None)] * 3 + [(4, "x\ny", "en", "s", 3)] * 40 + [(5, "", "", "", 0), (6, None, "de", "", None), (7, "é\n" * 50_000, "fr", "Z", 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"tree": F.lit("x"), "place": F.lit(1), "a.b": F.lit(2)})
    assert Counter(map(tuple, merkle.proofs(df).collect())) == brute_manifest(df.collect())
    assert merkle.proofs(df.limit(0)).count() == 0


def test_nodes_are_a_tree(spark):
    df = spark.createDataFrame([(k, str(k), None, "a" if k % 4 else "b", None) for k in range(1000)], SCHEMA).repartition(5)
    leaves, nodes, sources, tops = merkle.manifest(df)
    for tree, n in (("sa", 750), ("sb", 250)):
        held = {(r["level"], r["idx"]): r for r in nodes.where(F.col("tree") == tree).collect()}
        digests = [r["digest"] for r in leaves.where(F.col("tree") == tree).orderBy("place").collect()]
        want = {(level, k): d for level, row in enumerate(above(digests)) for k, d in enumerate(row) if level}
        assert {at: r["digest"] for at, r in held.items()} == want and len(digests) == n
        assert [at for at, r in held.items() if r["top"]] == [max(want)]
    assert tops.where("top").count() == 1 and sources.count() == 2


def test_merging_of_edges():
    """Any cut of the leaves into runs gives the tree of the whole."""
    rng = random.Random(5)
    for n in (1, 2, 3, 10, 81, 100, 244):
        digests = [H(str(k)) for k in range(n)]
        want = {(level, k): d for level, row in enumerate(above(digests)) for k, d in enumerate(row)}
        cuts = sorted({0, n, *(rng.randrange(n + 1) for _ in range(6))})
        held, made = [], {}
        for a, b in zip(cuts, cuts[1:], strict=False):
            held += merkle.climb(iter([("t", n, 0, k, digests[k]) for k in range(a, b)]))
        for _ in range(2):
            made |= {(r[2], r[3]): r[4] for r in held if r[6]}
            held = list(merkle.climb(iter(sorted((r[:5] for r in held if r[7]), key=lambda r: r[3] * 3 ** r[2]))))
        assert not held
        assert made == {at: d for at, d in want.items() if at[0] or n == 1}


def test_places(spark):
    df = materialise(spark.range(5000).select((F.col("id") % 7 % 3).alias("g"), F.col("id").alias("x")).repartition(6))
    rows = in_order(df, ["g"], ["x"]).collect()
    for g in range(3):
        mine = sorted((r["place"], r["x"]) for r in rows if r["g"] == g)
        assert [p for p, _ in mine] == list(range(len(mine))) and [x for _, x in mine] == sorted(x for _, x in mine)
        assert {r["total"] for r in rows if r["g"] == g} == {len(mine)}


# audit

ASCII_SPACE = b" \t\n\x0b\x0c\r"


def brute_audit(docs, labels):
    good, toxic = ({r["doc_id"] for r in labels if r[c] == 1 and r["doc_id"] is not None} for c in ("quality", "toxic"))
    first = {}
    for d in docs:
        if d["doc_id"] is not None:
            t = d["text"] or ""
            first[t] = min(first.get(t, d["doc_id"]), d["doc_id"])
    by = defaultdict(list)
    for d in docs:
        t = d["text"] or ""
        w = t.encode().split()
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": d["doc_id"] is not None and d["doc_id"] > first[t],
        }
        by[d["lang"] or ""].append((d["doc_id"], {f for f, x in fails.items() if x}))
    out = {}
    for part, held in by.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            gone = set()
            for k, f in enumerate(order):
                removed = [i for i, (_, x) in enumerate(held) if f in x and i not in gone]
                shapley[f] += len(removed)
                redundant = sum(f in x for i, (_, x) in enumerate(held) if i in gone)
                gone |= set(removed)
                alone = sum(x == {f} for _, x in held)
                lost = [sum(held[i][0] in known for i in removed) for known in (good, toxic)]
                out[part, "".join(order), k + 1] = [len(held) - len(gone), len(removed), redundant, alone, *lost]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def audited(frame):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in audit.MEASURES] for r in frame.collect()}


def test_audit_of_the_table(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet").collect() for t in ("documents", "labels"))
    frame = q.op12_filter_audit(spark, small)
    assert {c: t for c, t in frame.dtypes if c in audit.MEASURES} == dict.fromkeys(audit.MEASURES, "bigint")
    got = audited(frame)
    assert len(got) == frame.count() == 600 * len({d["lang"] for d in docs})
    assert got == brute_audit(docs, labels)


def test_audit_of_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(300))
    rows = [(None, None, None, "s", 0), (1, None, "", "s", 0), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, long, "en", "s", 0), (3, long, "de", "s", 0), (None, long, "en", "s", 0), (4, long, "en", "s", 0)]
    rows += [(5, "A" * 9 + "\u00a0" * 300, "en", "s", 0), (6, "a b " * 200_000, "en", "s", 0), (7, "x\x0by\x85z #", "fr", "s", 0)] + [(k, "same", "en", "s", 0) for k in range(20, 60)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"part": F.lit("x"), "mask": F.lit(1), "a.b": F.lit(1)})
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 1), (4, None, 1), (None, 1, 1), (25, 1, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    assert audited(audit.interactions(df, labels)) == brute_audit(df.collect(), labels.collect())
    assert audit.interactions(df.limit(0), labels).count() == 0
    assert all(r[4] == r[5] == 0 for r in audited(audit.interactions(df, labels.limit(0))).values())


def test_parity_sums_invert(spark):
    rng = random.Random(1)
    masks = [(rng.randrange(2), rng.randrange(8) & rng.randrange(8)) for _ in range(500)]
    df = spark.createDataFrame(masks, "g int, mask int")
    for r in audit.parity_sums(df, ["g"], filters=3).select("g", audit.cells(filters=3).alias("c")).collect():
        assert r["c"] == [masks.count((r["g"], m)) for m in range(8)]


# shards


def checked(frame, docs):
    """Every law of the contract; gives the share of links that are cut."""
    got = frame.collect()
    want = Counter((d["doc_id"], len((d["text"] or "").encode()) + 1, zlib.crc32((d["text"] or "").encode())) for d in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert set(slots) <= set(range(16))
    counts = [len(slots[s]) for s in range(16)]
    assert max(counts) - min(counts) <= 1
    groups = defaultdict(Counter)
    for r in got:
        groups[r["text_crc32"], r["size"]][r["shard"]] += 1
    pairs = lambda n: n * (n - 1) // 2
    every = sum(pairs(sum(g.values())) for g in groups.values())
    return 1 - sum(pairs(n) for g in groups.values() for n in g.values()) / every if every else 0.0, groups


def test_shards_of_the_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    frame = q.op13_sharding(spark, small)
    cut, groups = checked(frame, docs)
    assert cut == 0 and any(sum(g.values()) > 1 for g in groups.values())
    assert {(r["law"], r["grown_shard"]) for r in frame.collect()} == {("rows", None)}


def test_shards_of_hot_groups(spark):
    """A third of all rows is one group, which needs six shards; a half is pairs and threes; the rest is alone."""
    rows = [(k, "hot" if k % 3 == 0 else f"t{k // 6}" if k % 2 else f"own {k}", "en", "s", 0) for k in range(4800)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    cut, groups = checked(sharding.shard_documents(df, keep=["doc_id"]), df.collect())
    small = [g for g in groups.values() if 1 < sum(g.values()) < 10]
    assert sum(len(g) > 1 for g in small) <= len(small) / 20
    hot = max(groups.values(), key=lambda g: sum(g.values()))
    assert len(hot) <= 10


def test_shards_where_everything_is_linked(spark):
    rows = [(k, f"t{k % 400}", "en", "s", 0) for k in range(1600)]
    df = spark.createDataFrame(rows, SCHEMA)
    cut, groups = checked(sharding.shard_documents(df), df.collect())
    assert cut < 0.1


def test_shards_of_odd_rows(spark):
    rows = [(None, None, None, None, None)] * 5 + [(1, "", "en", "s", 0)] * 3 + [(2, "é" * 300_000, "en", "s", 0), (3, "x", "en", "s", 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"size": F.lit("mine"), "row": F.lit(1), "Shard": F.lit(2), "a.b": F.lit(3)})
    frame = sharding.shard_documents(df)
    assert frame.columns == [*df.columns, "size_", "text_crc32", "shard_", "slot"]
    assert {r["size"] for r in frame.collect()} == {"mine"}
    checked(frame.select("doc_id", F.col("size_").alias("size"), "text_crc32", F.col("shard_").alias("shard"), "slot"), df.collect())
    assert sharding.shard_documents(df.limit(0)).count() == 0


def test_cut_links(spark):
    df = spark.createDataFrame([("a", 0), ("a", 0), ("a", 1), ("b", 2), ("c", 3), ("c", 4)], "key string, shard int")
    assert sharding.cut_links(df, "key", "shard") == (3, 4) and sharding.cut_links(df.limit(0), "key", "shard") == (0, 0)


def test_links_of_several_keys(spark):
    """Rows in chains of keys: neighbours' shards win against the hash."""
    links = spark.createDataFrame([(r, r // 4 * 2 + k) for r in range(400) for k in (0, 1)], "row long, key long")
    at = dict(map(tuple, sharding.propagate(materialise(links), 4, 110).collect()))
    assert len(at) == 400 and max(Counter(at.values()).values()) <= 110
    assert sum(len({at[4 * g + k] for k in range(4)}) == 1 for g in range(100)) >= 95


def test_grants_keep_quotas():
    rng = random.Random(3)
    for _ in range(50):
        rooms = [rng.randrange(60) for _ in range(5)]
        asked = list({(to, turn): (to, turn, rng.randrange(1, 30)) for to, turn in ((rng.randrange(5), rng.randrange(9)) for _ in range(30))}.values())
        last, left = sharding.grant(asked, rooms)
        for s in range(5):
            taken = [(t, n) for to, t, n in sorted(asked) if to == s and t <= last[s]]
            assert left[s] == rooms[s] - sum(n for _, n in taken) >= 0
            later = [n for to, t, n in sorted(asked) if to == s and t > last[s]]
            assert not later or later[0] > left[s]
