"""The store: deletes, merges, figures, postings, and writers that meet."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logloom.engine import Engine
from logloom.functions import tokens
from logloom.functions.tokens import stored_full, token_array, tokenize
from logloom.operators import postings, search
from logloom.plans.filters import Filter, compile_filter
from logloom.sources import store as st
from logloom.shared import materialise
from logloom.sources.loglines import FileState
from logloom.sources.logs import Catalogue, HostLog
from logloom.sources.store import Segment, Store, tier
from logloom.streaming.live import follow
from test_rounds import BASE, NOW, lines, paths

G = "/l/access.log"


def rows(spark, fp, a, b, ip="1.1.1.1"):
    """Rows a to b of one content, one every ten minutes."""
    data = [(BASE + 600 * n, f"{ip}", f"/p/{n}", 200, n, "B", "O", "D", G, fp, n) for n in range(a, b)]
    return spark.createDataFrame(data, "ts long, ip string, path string, status int, bytes_sent long, browser string, os string, device_type string, main_log_path string, fp string, off long")


def rolled(store):
    r = store.rollup()
    return {t: Counter(map(tuple, f.select(sorted(f.columns)).collect())) for t, f in r.frames().items()}


def direct(store):
    r = st.build(store.rows())
    return {t: Counter(map(tuple, f.select(sorted(f.columns)).collect())) for t, f in r.frames().items()}


def test_deletes_rewrite_no_folder(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.commit(G, rows(spark, "a" * 16, 0, 30))
    store.commit(G, rows(spark, "b" * 16, 0, 30, "2.2.2.2"))
    before = {s.id: s for s in store.manifest().segments()}
    store.commit(G, rows(spark, "a" * 16, 20, 22, "3.3.3.3"), delete=[("a" * 32, 20)])
    after = {s.id: s for s in store.manifest().segments()}
    assert set(before) < set(after) and len(after) == 3
    one, other = (next(s for s in after.values() if s.id in before and s.fps == [x * 16] * 2) for x in "ab")
    assert other == before[other.id]
    assert (one.rows, one.dropped, one.gone) == (20, 10, [["a" * 16, 20, None]])
    # ten rows lay in two hours, which alone are rolled up again
    assert [len(r["without"]) for r in one.rollups] == [1, 0] and one.rollups[0]["without"][0][1] - one.rollups[0]["without"][0][0] == 3600
    got = Counter((r["fp"][0], r["off"], r["ip"]) for r in store.rows().collect())
    assert got == Counter([("a", n, "1.1.1.1") for n in range(20)] + [("b", n, "2.2.2.2") for n in range(30)] + [("a", n, "3.3.3.3") for n in (20, 21)])
    assert rolled(store) == direct(store)
    assert store.figures() == {G: {"docs": 52, "first": BASE, "last": BASE + 600 * 29, "tokens": 0}}
    store.commit(G, None, delete=[("a" * 32, 5), ("c" * 32, 0)])
    assert store.rows().count() == 35 and rolled(store) == direct(store)
    store.compact(G)  # over three tenths of a segment are deleted: it is written anew
    assert all(not s.gone for s in store.manifest().segments() if s.fps == ["a" * 16] * 2)
    store.vacuum()
    assert store.rows().count() == 35 and rolled(store) == direct(store)
    store.commit(G, None, delete=[("a" * 32, 0), ("b" * 32, 0)])
    assert store.figures() == {} and store.rows().count() == 0


def test_hours_that_nothing_touched_keep_their_rollup(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.commit(G, rows(spark, "a" * 16, 0, 60))
    store.commit(G, None, delete=[("a" * 32, 59)])
    (s,) = store.manifest().segments()
    hour = BASE + 59 * 600 - (BASE + 59 * 600) % 3600
    assert s.rollups[0]["without"] == [[hour, hour]] and rolled(store) == direct(store)


def test_segments_are_merged_by_size(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    for k in range(9):
        store.commit(G, rows(spark, "a" * 16, 10 * k, 10 * k + 10))
    store.commit(G, rows(spark, "b" * 16, 0, 200), delete=[("a" * 32, 85)])
    large = store.manifest().segments()[-1]
    want, figures = direct(store), store.figures()
    assert store.compact(G) == 80 + 5  # eight of one size, and the one that lost half
    now = store.manifest().segments()
    assert [s.rows for s in now] == [80, 5, 200] and now[2] == large and not any(s.gone for s in now)
    assert rolled(store) == direct(store) == want and store.figures() == figures


def test_rows_are_written_again_a_logarithm_of_times():
    for n in (100, 1000, 5000):
        held, written = [], 0
        for k in range(n):
            held.append(Segment(str(k), rows=1))
            while some := tier(held):
                held = [s for s in held if s not in some] + [Segment(f"m{written}-{k}", rows=sum(s.rows for s in some))]
                written += held[-1].rows
        assert sum(s.rows for s in held) == n
        times = next(t for t in range(20) if 8**t > n)
        assert written <= n * times and len(held) <= 7 * times + 7


def test_large_rollups_give_way_to_rows(spark, tmp_path):
    from datetime import date

    log = tmp_path / "access.log"
    log.write_text(lines(0, 40))
    boards = []
    for floor in (1 << 20, 0):
        engine = Engine(spark, Store(spark, f"file://{tmp_path}/s{floor}", rollup_floor=floor), Catalogue([HostLog(str(log))]))
        engine.rounds.run(now=NOW)
        assert (engine.store.rollup() is None) == (floor == 0)
        boards.append({k: Counter(map(tuple, f.collect())) for k, f in engine.dashboard(start=date(2026, 9, 7), end=date(2026, 9, 7), now=NOW).items()})
    assert boards[0] == boards[1]


def test_hours_are_told_however_large_rollups_are(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", rollup_floor=0)
    assert store.hours() is None
    store.commit(G, rows(spark, "a" * 16, 0, 30))
    store.commit(G, rows(spark, "b" * 16, 15, 40))
    assert store.rollup() is None
    told = lambda f: sorted(map(tuple, f.select(sorted(f.columns)).collect()))
    assert told(store.hours()) == told(st.build(store.rows()).hours)


def test_status_runs_no_job(spark, tmp_path):
    log = tmp_path / "access.log"
    log.write_text(lines(0, 7))
    engine = Engine(spark, Store(spark, f"file://{tmp_path}/s"), Catalogue([HostLog(str(log))]))
    engine.rounds.run(now=NOW)
    spark.sparkContext.setJobGroup("status", "x")
    try:
        assert engine.status()[0]["documents"] == 7 and engine.preflight()["documents"] == 7 and engine.totals()["documents"] == 7
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("status")) == []
    finally:
        spark.sparkContext._jsc.clearJobGroup()


@pytest.fixture
def site(spark, tmp_path):
    log = tmp_path / "logs" / "access.log"
    log.parent.mkdir()
    engine = Engine(spark, Store(spark, f"file://{tmp_path}/store"), Catalogue([HostLog(str(log))]))

    def streamed():
        query = follow(engine.store, str(log), "access", NOW, f"file://{tmp_path}/check")
        query.processAllAvailable()
        query.stop()

    return log, engine, streamed, lambda: sorted(r["path"] for r in engine.store.rows().select("path").collect())


def test_stream_and_rounds_share_positions(site):
    log, engine, streamed, got = site
    log.write_text(lines(0, 5))
    streamed()
    engine.rounds.run(now=NOW)
    assert got() == paths(0, 5)
    with open(log, "a") as f:
        f.write(lines(5, 8))
    engine.rounds.run(now=NOW)
    assert got() == paths(0, 8)
    with open(log, "a") as f:
        f.write(lines(8, 10))
    streamed()  # its checkpoint stands at five lines, so it reads three of a round again
    assert got() == paths(0, 10)
    engine.rounds.run(now=NOW)
    streamed()
    assert got() == paths(0, 10)
    assert engine.store.figures()[str(log)]["docs"] == 10 and rolled(engine.store) == direct(engine.store)


def test_a_stream_starts_where_rounds_are(site):
    log, engine, streamed, got = site
    log.write_text(lines(0, 5))
    engine.rounds.run(now=NOW)
    streamed()
    with open(log, "a") as f:
        f.write(lines(5, 7))
    streamed()
    assert got() == paths(0, 7)
    assert all(not s.gone for s in engine.store.manifest().segments())  # nothing was read twice


def test_a_round_between_read_and_commit(site, monkeypatch):
    """Another writer stores some of the lines while a commit with them is on its way."""
    log, engine, _, got = site
    log.write_text(lines(0, 5))
    engine.rounds.run(now=NOW)
    with open(log, "a") as f:
        f.write(lines(5, 9))
    again = Engine(engine.spark, Store(engine.spark, engine.store.path), engine.catalogue)
    real, first = Store._segment, [True]

    def slow(self, rows, rolled=None):
        made = real(self, rows, rolled)
        if first and self is engine.store:
            first.clear()
            with open(log, "a") as f:
                f.write(lines(9, 11))
            again.rounds.run(now=NOW)
        return made

    monkeypatch.setattr(Store, "_segment", slow)
    engine.rounds.run(now=NOW)
    assert got() == paths(0, 11)
    position = engine.store.states(str(log))[str(log)].position
    assert position == log.stat().st_size  # the earlier position doesn't come back
    engine.rounds.run(now=NOW)
    assert got() == paths(0, 11) and rolled(engine.store) == direct(engine.store)


def test_states_are_merged(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    state = lambda path, n, fp="f" * 32: FileState(path, fp, n, n, 1)
    store.commit(G, None, [state("a", 10), state("b", 5)])
    store.commit(G, None, [state("a", 7), state("c", 1, "e" * 32)])
    assert {p: s.position for p, s in store.states(G).items()} == {"a": 10, "b": 5, "c": 1}
    store.commit(G, None, [state("a", 8)], delete=[("f" * 32, 3)], forget=["c"])
    assert {p: s.position for p, s in store.states(G).items()} == {"a": 8, "b": 3}
    store.commit(G, None, mark="m")
    store.purge(G)
    assert store.mark(G) is None and not store.states(G)


def test_commit_reads_lines_once(spark, tmp_path, monkeypatch):
    """One scan of the log in all plans of a round, and no exchange that carries lines."""
    log = tmp_path / "access.log"
    log.write_text(lines(0, 50))
    engine = Engine(spark, Store(spark, f"file://{tmp_path}/s"), Catalogue([HostLog(str(log))]))
    engine.rounds.locations = spark.createDataFrame([("0" * 20 + "ffff" + "0" * 8, "0" * 20 + "ffff" + "f" * 8, "US")], "lo string, hi string, region_code string")
    plans = []
    real = type(spark.range(1).write).parquet

    def written(self, path, *a, **k):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return real(self, path, *a, **k)

    monkeypatch.setattr(type(spark.range(1).write), "parquet", written)
    engine.rounds.run(now=NOW)
    scans = [p for p in plans if "BatchScan loglines" in p or "loglines" in p.lower()]
    assert len(scans) == 1
    assert not any("Exchange" in line and "hashpartitioning" in line and "raw" in line for p in plans for line in p.split("\n"))
    assert {r["region_code"] for r in engine.store.rows().select("region_code").collect()} == {"US"}


def test_look_up(spark, monkeypatch):
    from logloom import shared

    df = shared.materialise(spark.range(3000).select((F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id"))).alias("k"), F.col("id").alias("x")))
    names = spark.range(0, 3000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v")).unionAll(spark.range(1, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v")))
    want = Counter(map(tuple, df.join(names, "k", "left").collect()))
    assert Counter(map(tuple, shared.look_up(df, names, "k").collect())) == want
    monkeypatch.setattr(shared, "BROADCAST", 10)
    assert Counter(map(tuple, shared.look_up(df, names, "k").collect())) == want


# tokens and postings


def test_stored_tokens_are_the_tokenizer(spark):
    rng = random.Random(4)
    pieces = ["a", "Z", "9", "12", ".", "_", " ", "-", "/", "1.2", "::", ":", "..", "ff", "3_4", "é", "中", "%20", "\\x41", "../", "😀", "http", "\n", "a" * 300]
    texts = [None, "", *["".join(rng.choice(pieces) for _ in range(rng.randrange(14))) for _ in range(5000)]]
    for r in spark.createDataFrame([(t,) for t in texts], "x string").select("x", stored_full(F.col("x")).alias("t")).collect():
        assert (r["t"] is None) == (r["x"] is None)
        assert [(t["pos"], t["term"]) for t in r["t"] or []] == tokenize(r["x"], True)


def test_indexed_tokens_are_the_tokenizer():
    """Texts that one pattern takes apart and all others; repeated ones and null too."""
    rng = random.Random(5)
    pieces = ["a", "Z", "9", "12", ".", "_", " ", "-", "/", "1.2", "::", ":", "..", "ff:", "3_4", "é", "中", "%20", "\\x41", "../", "..\\", "😀", "http", "\n", "a" * 300, "1." * 150, "\u0130", "\u212a"]
    texts = [None, "", *["".join(rng.choice(pieces) for _ in range(rng.randrange(14))) for _ in range(20000)]]
    for full in (True, False):
        for some in (texts, [*texts[:50], *texts[:50], *texts[:50]]):
            got = token_array(pa.array(some, pa.string()), full).to_pylist()
            assert got == [None if t is None else [{"pos": p, "term": x} for p, x in tokenize(t, full)] for t in some]


def test_lines_are_taken_apart_by_one_pattern(monkeypatch):
    """The tokenizer's own way is for odd texts only: it takes several times as long."""
    monkeypatch.setattr(tokens, "tokenize", None)
    error = '2024/01/10 12:13:14 [warn] 12#34: *5 it broke, client: 10.0.3.1, server: x, request: "GET /error/7 HTTP/1.1", host: "h"'
    assert [x["term"] for x in token_array(pa.array([lines(0, 1).strip(), error]), True).to_pylist()[1]][-3:] == ["1.1", "host", "h"]


def test_packed_tokens_are_the_tokenizer(spark):
    """In Spark and in Arrow, packed from texts and from arrays; long terms leave positions without any."""
    rng = random.Random(6)
    pieces = ["a", "Z", "9", "12", ".", "_", " ", "-", "/", "1.2", "::", "ff:", "3_4", "é", "中文", "%20", "\\x41", "../", "😀", "http", "\t", "\n", "a" * 254, "9" * 255, "1." * 150, "\u0130"]
    texts = [None, "", "a" * 255, *["".join(rng.choice(pieces) for _ in range(rng.randrange(14))) for _ in range(3000)]]
    for full, pack in ((True, tokens.pack_full), (False, tokens.pack_atoms)):
        want = [None if t is None else tokenize(t, full) for t in texts]
        frame = materialise(spark.createDataFrame(list(enumerate(texts)), "n int, x string").withColumn("p", pack("x"))).withColumn("again", tokens.pack_tokens(tokens.unpacked(F.col("p"))))
        for r in frame.select("n", "p", "again", tokens.unpacked(F.col("p")).alias("t"), tokens.count_packed(F.col("p")).alias("k")).collect():
            assert (r["t"] and [tuple(t) for t in r["t"]]) == want[r["n"]] and r["again"] == r["p"]
            assert r["p"] is None or r["k"] == len(want[r["n"]])
        line, pos, terms = tokens.flat_tokens(tokens.packed_array(pa.array(texts, pa.string()), full))
        assert list(zip(line.tolist(), pos.tolist(), terms.to_pylist(), strict=True)) == [(n, *t) for n, some in enumerate(want) for t in some or []]


def test_tokens_are_stored_packed(lines_store):
    """As one text, while readers see arrays; the manifest's count is theirs."""
    (segment, *_) = lines_store.manifest().segments()
    held = lines_store.spark.read.parquet(f"{lines_store.path}/rows/{segment.id}")
    assert {dict(held.dtypes)[c] for c in ("raw_tok", "path_tok", "ua_tok", "ref_tok")} == {"string"}
    for r in lines_store.rows().select("raw", "raw_tok", "path", "path_tok", "user_agent", "ua_tok").collect():
        for c, t, full in (("raw", "raw_tok", True), ("path", "path_tok", False), ("user_agent", "ua_tok", False)):
            assert (r[t] and [tuple(x) for x in r[t]]) == (None if r[c] is None else tokenize(r[c], full))


def test_postings_are_sorted_as_few_rows(spark, monkeypatch):
    """Those of a term in a file are one row, in lines' order; no posting is shuffled, wherever a task cuts its lines."""
    monkeypatch.setattr(postings, "TOGETHER", 40)
    texts = ["a b a", None, "", "b 1.2", "c"] * 9
    table = pa.table({
        "main_log_path": [G] * 45, "fp": ["f" if n < 20 else "g" for n in range(45)], "off": list(range(45)),
        "raw_tok": token_array(pa.array(texts), True), "path_tok": token_array(pa.array(texts), False),
    })
    want = Counter((f, x["term"], r["fp"], r["off"], x["pos"], len(r[c])) for r in table.to_pylist() for f, c in postings.FIELDS.items() for x in r[c] or [])
    for batch in (7, 45):
        rows = [r for b in postings._group(iter(table.to_batches(batch))) for r in b.to_pylist()]
        got = Counter((r["field"], r["term"], r["fp"], *x) for r in rows for x in zip(r["off"], r["pos"], r["size"], strict=True))
        assert got == want and all(r["off"] == sorted(r["off"]) for r in rows)
        assert batch == 7 or len(rows) == len({k[:3] for k in want})
    plan = postings.index(spark.createDataFrame(table.slice(0, 5).to_pylist(), "main_log_path string, fp string, off long, raw_tok array<struct<pos: int, term: string>>, path_tok array<struct<pos: int, term: string>>"))
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def lines_store(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("p")
    log = top / "access.log"
    store = Store(spark, f"file://{top}/store", indexed=True)
    engine = Engine(spark, store, Catalogue([HostLog(str(log))]))
    log.write_text(lines(0, 120))
    engine.rounds.run(now=NOW)
    (top / "access.log.1").write_text(lines(300, 330))
    engine.rounds.run(now=NOW)
    log.write_text(lines(0, 1) + lines(200, 220))  # the first file is written anew
    engine.rounds.run(now=NOW)
    return store


BOXES = ["get", "get 200", '"GET /p"', '"p get"', "203.0.113", '"GET /p/7 HTTP/1.1"', "path:/p/21", "path:p -get", "/p/205 curl", "nothere", '"curl/8.0"', "-curl", "!!", '"0.01 0.01"', '"01 0.01"', "status:200 path:/p/301"]


@pytest.mark.parametrize("box", BOXES)
def test_postings_answer_as_a_scan(box, lines_store):
    rows, f = lines_store.rows(), Filter(text=box)
    want = Counter(r["path"] for r in rows.where(compile_filter(f)).collect())
    assert Counter(r["path"] for r in search.narrowed(rows, f, lines_store.postings()).collect()) == want


def test_long_boxes(lines_store):
    words = [f"w{k}" for k in range(70)]
    tokens = [(k, w) for k, w in enumerate(words)]
    data = [("raw", w, G, "f", n, k, 70) for n in range(3) for k, w in enumerate(words) if not (n == 1 and k == 65)] + [("raw", "w3", G, "f", 2, 90, 70)]
    df = lines_store.spark.createDataFrame(data, "field string, term string, main_log_path string, fp string, off long, pos int, size int").withColumn("bucket", postings.bucket(F.col("field"), F.col("term")))
    for phrase in (True, False):
        assert sorted(r["off"] for r in postings.lines_with(df, "raw", tokens, phrase).collect()) == [0, 2]


def test_ranks_from_postings(lines_store):
    rows, f = lines_store.rows(), Filter(text="get 21")
    (known,) = lines_store.figures().values()
    assert known["docs"] == rows.count() and known["tokens"] == rows.agg(F.sum(F.size("raw_tok"))).first()[0]
    told = lambda a: [(r["path"], round(r["score"], 9)) for r in a.hits.collect()]
    one = told(search.search(rows, f, 30, 0, "_score", postings=lines_store.postings(), figures=(known["docs"], known["tokens"])))
    assert one == told(search.search(rows, f, 30, 0, "_score")) and one


def test_questions_read_few_folders(lines_store):
    plan = lines_store.postings().where("1 = 1").transform(lambda p: postings.lines_with(p, "raw", [(0, "get"), (1, "p")], True))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("\n")[0]
    assert "term" in plan.split("PushedFilters")[1].split("\n")[0]


def test_rounds_and_dashboards_leave_no_tables(site, monkeypatch):
    from logloom import engine as e
    from logloom import shared

    log, engine, streamed, got = site
    made, gone = [], []
    real, drop = shared.shared_path, shared._delete
    monkeypatch.setattr(shared, "shared_path", lambda spark, kind: made.append(real(spark, kind)) or made[-1])
    monkeypatch.setattr(shared, "_delete", lambda spark, path: gone.append(path.split("/")[-1]) or drop(spark, path))
    log.write_text(lines(0, 5))
    engine.rounds.run(now=NOW)
    with open(log, "a") as f:
        f.write(lines(5, 7))
    streamed()
    assert made and {p.split("/")[-1] for p in made} == set(gone) and got() == paths(0, 7)
    monkeypatch.setattr(e, "BOARDS", 1)
    made.clear()
    gone.clear()
    first, second = (engine.dashboard(now=BASE + 90_000) for _ in range(2))
    assert 0 < len(gone) < len(made) and second["overview"].first()["pv"] == 7


def test_postings_are_packed_as_few_values(spark):
    """Spark sees bytes, as narrow as the numbers allow, and the same postings come out, where widths differ too."""
    rng = random.Random(7)
    rows = []
    for k in range(300):
        n = rng.choice([1, 2, 40])
        offs = sorted(rng.randrange(rng.choice([300, 1 << 20, 1 << 40])) for _ in range(n))
        rows.append(("raw", f"t{k}", G, "f", offs, [rng.randrange(rng.choice([9, 1 << 20])) for _ in offs], [9] * n))
    names = ["field", "term", "main_log_path", "fp", "off", "pos", "size"]
    types = [pa.string()] * 4 + [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
    small = postings.packed_rows(batch.slice(0, 1))
    assert len(small["size"][0].as_py()) == 2 * small["n"][0].as_py()
    table = pa.Table.from_batches([small, *[postings.packed_rows(batch.slice(a, 50)) for a in range(1, 300, 50)]])
    stored = spark.createDataFrame(table.to_pylist(), postings.PACKED).select("*", F.lit("s").alias("seg"), F.lit(0).alias("bucket")).coalesce(1)
    got = Counter(tuple(r) for r in postings.told(stored).select(*names).collect())
    assert got == Counter((*r[:4], *x) for r in rows for x in zip(*r[4:], strict=True))
    assert [tuple(x) for x in postings._order(np.array([7, 1 << 40, 7, 65536, 0, 1 << 20])).reshape(1, -1).tolist()] == [(4, 0, 2, 3, 5, 1)]
    assert "array" not in postings.index(spark.createDataFrame([(G, "f", 1, "a b", "a")], "main_log_path string, fp string, off long, raw_tok string, path_tok string")).schema.simpleString()


def test_texts_are_packed_at_once():
    """Of plain texts each different run with a dot is looked at once in a batch, and no text on its own; slices, blanks and nulls count too."""
    tokens._pack_dotted.cache_clear()
    texts = [f"GET /p/{k} 10.0.0.{k % 3} 1.2" for k in range(900)]
    got = tokens.packed_array(pa.array([*texts, None, "", " .", ". 中"], pa.string()).slice(5), True).to_pylist()
    assert got == [*[tokens.joined(tokenize(t, True)) for t in texts[5:]], None, "", "", "中"]
    assert tokens._pack_dotted.cache_info().hits == 0
