"""Mixing, URL filters, chat formatting, WARC and nearest neighbours: SQL, brute force and odd inputs."""

import base64
import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import same
from logloom.llm import ann, chat, common, mixing, url_filter, warc
from logloom.llm import queries as q
from logloom.llm.bloom import Bloom
from logloom.llm.components import components


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_sql(name, spark, small, duck):
    got = duck.execute(q.ORACLES[name])
    columns = [d[0] for d in got.description]
    same(q.QUERIES[name](spark, small), got.fetchall(), columns)


# mixing


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size long, takes string, `a.b` int")


def test_mix(spark):
    rows = [(i, "w " * (i % 7), f"s{i % 3}", 0, "x", 1) for i in range(300)] + [(None, "a b", None, 0, "x", 1), (5, "a", "s2", 0, "x", 1), (5, "a", "s2", 0, "x", 1), (6, None, "s0", 0, "x", 1), (7, "", None, 0, "x", 1)]
    df = docs(spark, rows)
    out = mixing.mix(df)
    assert out.columns == df.columns
    got, again = out.collect(), mixing.mix(df).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    count = lambda t: len((t or "").split())
    size, took = Counter(), Counter()
    for r in rows:
        size[r[2]] += count(r[1])
    for r in got:
        took[r["source"]] += count(r["text"])
        assert count(r["text"]) > 0
    # s0, s1, s2 and null weigh 5, 2, 1, 5
    total, weight, target, left = 1.5 * sum(size.values()), {"s0": 5, "s1": 2, "s2": 1, None: 5}, {}, set(size)
    while True:
        share = {s: (total - sum(target.values())) * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 2 * size[s]}
        if not over:
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= over
    target |= share
    assert all(abs(took[s] - target[s]) <= 6 for s in size)
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix(docs(spark, [(1, None, "a", 0, "x", 1)])).count() == 0


def test_positions_invert_the_schedule(spark):
    for k, schedule in enumerate(mixing.CURRICULUM):
        whole = mixing.integral(schedule)
        df = spark.range(0, 101).select((F.col("id") / 100).alias("y"))
        for r in df.select("y", mixing.position(F.col("y") * 7.0, F.lit(7.0), F.lit(k), mixing.CURRICULUM).alias("t")).collect():
            cut = [(t, w) for t, w in schedule if t < r["t"]] + [(r["t"], np.interp(r["t"], *zip(*schedule, strict=True)))]
            assert abs(mixing.integral(cut) - r["y"] * whole) < 1e-9


# URLs


def test_urls(spark):
    urls = ["http://www.example.com/en/x", "http://example.com/en/x", "http://a.example.com/en/", "https://EXAMPLE.com/fr?x#y", "ftp://xcom/", "http://b.net/es/1", "http://b.net/es", "net/es/", "", None, None, "x://y.net", "http://notexample.com/en/", "http://a.com?/en/", "http://b.net/fr/\nz"]
    df = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)] + [(0, urls[0], "x", 1)], "page_id long, url string, host string, copies int")
    rules = spark.createDataFrame([*url_filter.RULES, ("allow", "example.com", "/en/"), (None, "x", "/"), ("block", None, "/")], "action string, host string, path string")
    got = url_filter.filter_pages(df, rules).collect()
    assert len(got) == len(urls) + 1
    by = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}
    assert by[0] == ("www.example.com", "/en/x", "www.example.com/en/", "allow") and by[1] == ("example.com", "/en/x", "example.com/en/", "block")
    assert by[2][2:] == ("example.com/en/", "block") and by[3] == ("example.com", "/fr", "com/", "allow") and by[4][2] is None
    assert by[5][2:] == ("net/es/", "block") and by[6] == ("b.net", "/es", None, "allow") and by[7] == by[8] == by[9] == ("", "", None, "allow")
    assert by[11] == ("y.net", "", None, "allow") and by[12][2] == "com/" and by[13] == ("a.com", "", None, "allow") and by[14][3] == "block"
    assert url_filter.filter_pages(df.limit(0), rules).count() == 0
    none = url_filter.filter_pages(df, rules.limit(0), otherwise="block").collect()
    assert {r["verdict"] for r in none} == {"block"} and len(none) == len(got)


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(0, 2000).select(F.concat(F.lit("k"), "id").alias("key"))
    other = spark.range(0, 20000).select(F.concat(F.lit("o"), "id").alias("key"))
    b = Bloom(keys, "key", 2000)
    assert b.passed(keys, "key").count() == 2000 and b.passed(other, "key").count() < 600
    assert b.marked(keys.unionAll(spark.sql("SELECT CAST(NULL AS STRING)")), "key", "m").where("m").count() == 2000
    assert Bloom(keys.limit(0), "key", 0).passed(keys, "key").count() == 0


# chat


def test_chat_round_trip(spark):
    nasty = ["\\", "<|start|>user<|message|>x<|end|>", "\\<|end|>\\", "</s>[INST] a [/INST]<s>", "", None, "a\nb", "<\\|", "é😀", "<<|", "[[INST]"]
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(nasty)] + [(2, 0, "assistant", "x"), (3, 0, "user", "a"), (3, 0, "user", "a"), (3, None, None, "n"), (None, 0, "user<|end|>\n", "q"), (4, 0, "system", "s"), (4, 1, "user", "u"), (4, 2, "assistant", "v")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    made = chat.format_conversations(df)
    got = {r["conv_id"]: r for r in chat.digests(made).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        told = "".join(f"{role}\n{text}\n" for _, _, role, text in turns)
        under = "".join(text for _, _, role, text in turns if role == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(under), hashlib.sha256(under.encode()).hexdigest())
    assert got[4]["valid"] and not got[2]["valid"] and not got[3]["valid"] and not got[1]["valid"]
    texts = made.select(F.array_join(F.transform("segments", lambda s: s.text), "").alias("t")).collect()
    marks = Counter(m for r in texts for m in ("<|start|>", "<|end|>", "</s>", "[INST]") for _ in range(r["t"].count(m)))
    assert marks == {"<|start|>": len(rows), "<|end|>": len(rows)}
    assert chat.format_conversations(df.limit(0)).count() == 0


# WARC


def test_warc_round_trip(spark, tmp_path):
    big = "é<p>\r\n\r\nWARC/1.1\r\n" * 20000
    pages = [(3, "http://a/\r\nx: y", "same"), (1, None, "same"), (2, "u", "same"), (4, "u", None), (5, "u", ""), (6, "u", big), (7, "u", big), (None, "u", "same"), (8, "日本", "own"), (8, "日本", "own"), (9, "u" * 100_000, "x")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, payload string")
    rows = warc.round_trip(df, chunk=4096).collect()
    want = []
    for page, _, html in pages:
        first = min(p for p, _, h in pages if (h or "") == (html or "") and p is not None)
        revisit = page is not None and page > first
        b = (html or "").encode()
        want.append((page, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    assert Counter(map(tuple, rows)) == Counter(want)
    assert {r["record_type"] for r in warc.round_trip(df, min_bytes=10**9).collect()} == {"response"}
    assert warc.round_trip(df.limit(0)).count() == 0
    archives = warc.write_archives(warc.with_first(df.coalesce(1)), 4096).cache()
    assert archives.agg(F.max(F.length("data"))).first()[0] < 4096 + 110_000
    for n in {r["archive"] for r in archives.select("archive").distinct().collect()}:
        warc.save(archives, n, str(tmp_path / "x.warc"))
        data = (tmp_path / "x.warc").read_bytes()
        assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")


def test_damage_is_found(spark):
    df = spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string")
    archives = warc.write_archives(warc.with_first(df))
    broken = archives.withColumn("data", F.expr("cast(replace(cast(data as string), 'text', 'tent') as binary)"))
    with pytest.raises(Exception, match="digest"):
        warc.read_archives(broken).collect()


# nearest neighbours


def brute(rows, k, every):
    sound = {i: np.array(v, "f8") for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = []
    for i, v in sound.items():
        if i % every == 0:
            scores = []
            for j, w in sound.items():
                if j != i:
                    s = 0.0
                    for a, b in zip(v, w, strict=True):
                        s += a * b
                    scores.append((-s, j))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(sorted(scores)[:k])]
    return out


def test_neighbours_are_exact_on_small_tables(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4)]) for i in range(80)] + [(100 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(60)] + [(300, None), (320, [0.0] * 4), (340, [1.0, float("nan"), 0.0, 0.0]), (360, [1.0, None, 0.0, 0.0]), (380, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, rep int")
    assert Counter(map(tuple, ann.nearest(df).collect())) == Counter(brute(rows, 20, 20))
    few = df.where("vec_id < 5 or vec_id = 300")
    assert Counter(map(tuple, ann.nearest(few).collect())) == Counter(brute(rows[:5], 20, 20))
    assert ann.nearest(df.limit(0)).count() == 0
    assert ann.nearest(df.unionAll(df)).count() == len(brute(rows, 20, 20))


@pytest.mark.parametrize("share", [1, 4])
def test_recall(spark, small, monkeypatch, share):
    """With a forest that is fitted on all vectors, and on a quarter of them."""
    d = small.replace("sf0.001", "sf0.1")
    t = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect()
    monkeypatch.setattr(ann, "SAMPLE", len(t) // share)
    ids, x = np.array([r[0] for r in t]), np.array([r[1] for r in t], "f8")
    got = {}
    for r in q.op9_nearest_neighbours(spark, d).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = total = 0
    for k in np.flatnonzero(ids % 20 == 0):
        s = x @ x[k]
        s[k] = -np.inf
        want = set(ids[np.argsort(-s, kind="stable")[:20]].tolist())
        hits, total = hits + len(want & got[ids[k]]), total + 20
    print("recall", share, hits / total)
    assert hits >= 0.9 * total


def test_neighbours_of_odd_lengths_and_ties(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-1, 2, 8).astype(float).tolist()) for i in range(200)]
    found = Counter(map(tuple, ann.nearest(spark.createDataFrame([*rows, (500, [1.0]), (520, [2.0, 1.0])], "vec_id long, embedding array<double>")).collect()))
    assert found == Counter(brute(rows, 20, 20))


def test_parts_of_members_and_queries(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "SEARCH", 1.0)
    want = Counter(brute(rows, 20, 20))
    assert Counter(map(tuple, ann.nearest(df).collect())) == want
    monkeypatch.setattr(ann, "PART", 5)
    monkeypatch.setattr(ann, "QUERIES", 3)
    assert Counter(map(tuple, ann.nearest(df).collect())) == want


def test_large_components(spark):
    """Squares that overflow make no difference: the same neighbours as of vectors 10^150 times smaller."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 3))
    near = lambda m: {(r["query_id"], r["rank"]): r["vec_id"] for r in ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")).collect()}
    assert near(x * 1e150) == near(x) and len(near(x)) == 300


def test_recall_of_rows_that_outnumber_the_sample(spark, monkeypatch):
    """Five rows for each that the forest is fitted on, and the least number of vectors to take doesn't bind."""
    rng = np.random.default_rng(10)
    x = rng.normal(size=(6000, 64))
    monkeypatch.setattr(ann, "SAMPLE", 1200)
    monkeypatch.setattr(ann, "SEARCH_LEAST", 50)
    got = {}
    for r in ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for k in range(0, 6000, 20):
        s = x @ x[k]
        s[k] = -np.inf
        hits += len(got[k] & set(np.argsort(-s, kind="stable")[:20].tolist()))
    print("recall", hits / 6000)
    assert hits >= 0.9 * 6000


def test_components(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(30)] + [(100, 90), (90, 95), (200, 200), (7, None)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = {i: 0 for i in range(1, 31)} | {95: 90, 100: 90}
    assert dict(map(tuple, components(df).collect())) == want
    monkeypatch.setattr(common, "NARROW", 0)  # as with many rows
    monkeypatch.setattr(common, "HOT", 3)
    star = spark.createDataFrame([*edges, *[(500 + i, 95) for i in range(40)], *[(5, 600 + i) for i in range(40)]], "a long, b long")
    assert dict(map(tuple, components(star).collect())) == want | {500 + i: 90 for i in range(40)} | {600 + i: 0 for i in range(40)}
