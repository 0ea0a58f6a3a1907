"""Files over rounds: every line is read once."""

import gzip
import os
import shutil

import pytest
from pyspark.sql import functions as F

from logloom import indexed
from logloom.engine import Engine, ScopeError
from logloom.operators.dashboard import Layout
from logloom.operators.rollup import Hybrid, build
from logloom.sources.loglines import fingerprint, read_lines, slices
from logloom.sources.logs import Catalogue, HostLog
from logloom.sources.store import Store

BASE = 1788739200
NOW = BASE + 10 * 86400


def lines(a, b):
    from datetime import UTC, datetime

    out = ""
    for n in range(a, b):
        t = datetime.fromtimestamp(BASE + 37 * n, UTC).strftime("%d/%b/%Y:%H:%M:%S +0000")
        out += f'203.0.113.{n % 250} - - [{t}] "GET /p/{n} HTTP/1.1" 200 {100 + n} "-" "curl/8.0" 0.01 0.01\n'
    return out


@pytest.fixture
def site(spark, tmp_path):
    log = tmp_path / "logs" / "access.log"
    log.parent.mkdir()
    engine = Engine(spark, Store(spark, f"file://{tmp_path}/store"), Catalogue([HostLog(str(log))]))

    def indexed():
        engine.rounds.run(now=NOW)
        rows = engine.store.rows()
        return sorted(r["path"] for r in rows.select("path").collect()) if rows is not None else []

    return log, engine, indexed


def paths(a, b):
    return sorted(f"/p/{n}" for n in range(a, b))


def test_append_and_partial_line(site):
    log, _, indexed = site
    whole = lines(0, 6)
    log.write_text(whole[:-20])
    assert indexed() == paths(0, 5)
    log.write_text(whole + lines(6, 8))
    assert indexed() == paths(0, 8)
    assert indexed() == paths(0, 8)


def test_rotation_with_tail_and_gzip_copy(site):
    log, _, indexed = site
    log.write_text(lines(0, 5))
    assert indexed() == paths(0, 5)
    log.rename(f"{log}.1")
    with open(f"{log}.1", "a") as f:
        f.write(lines(5, 7))
    log.write_text(lines(100, 103))
    assert indexed() == sorted(paths(0, 7) + paths(100, 103))
    with open(f"{log}.1", "rb") as src, gzip.open(f"{log}.2.gz", "wb") as out:
        out.write(src.read())
    os.remove(f"{log}.1")
    assert indexed() == sorted(paths(0, 7) + paths(100, 103))


def test_gzip_with_unread_tail(site):
    log, _, indexed = site
    log.write_text(lines(0, 3))
    assert indexed() == paths(0, 3)
    os.remove(log)
    with gzip.open(f"{log}.1.gz", "wb") as out:
        out.write(lines(0, 6).encode())
    assert indexed() == paths(0, 6)


def test_copytruncate_and_rewrite(site):
    log, _, indexed = site
    log.write_text(lines(0, 6))
    assert indexed() == paths(0, 6)
    shutil.copy(log, f"{log}.1")
    log.write_text("")
    assert indexed() == paths(0, 6)
    log.write_text(lines(50, 52))
    assert indexed() == sorted(paths(0, 6) + paths(50, 52))


def test_rewrite_with_the_same_first_line(site):
    log, _, indexed = site
    log.write_text(lines(0, 6))
    assert indexed() == paths(0, 6)
    log.write_text(lines(0, 1) + lines(20, 22))
    assert indexed() == sorted(paths(0, 1) + paths(20, 22))


def test_restart_and_rebuild(site, spark):
    log, engine, indexed = site
    log.write_text(lines(0, 4))
    indexed()
    again = Engine(spark, Store(spark, engine.store.path), engine.catalogue)
    assert again.rounds.run(now=NOW).files == 0
    assert again.index(str(log), rebuild=True).files == 1
    assert indexed() == paths(0, 4)
    again.store.vacuum()
    assert indexed() == paths(0, 4)


def test_stopped_import_is_read_again(site):
    log, engine, indexed = site
    log.write_text(lines(0, 4))
    indexed()
    states = list(engine.store.states(str(log)).values())
    engine.store.commit(str(log), None, states, dirty=True)
    log.write_text(lines(0, 5))
    assert indexed() == paths(0, 5)


def test_import_in_batches_stopped_and_resumed(site, spark):
    log, engine, indexed = site
    log.write_text(lines(0, 60))
    with gzip.open(f"{log}.2.gz", "wb") as out:
        out.write(lines(500, 505).encode())
    rounds = engine.rounds
    rounds.batch, heard = 2000, []

    def stop(event):
        heard.append(event)
        if event.get("percent"):
            rounds.cancel()

    rounds.listener = stop
    rounds.run(now=NOW)
    assert heard[-1]["phase"] == "stopped" and str(log) in engine.store.manifest().dirty
    some = engine.store.rows().count()
    assert 0 < some < 65
    again = Engine(spark, Store(spark, engine.store.path), engine.catalogue)
    again.rounds.batch = 2000
    again.rounds.run(now=NOW)
    assert sorted(r["path"] for r in again.store.rows().select("path").collect()) == sorted(paths(0, 60) + paths(500, 505))
    assert not again.store.manifest().dirty and again.rounds.run(now=NOW).files == 0


def test_commits_that_run_together_all_count(site, spark):
    from concurrent.futures import ThreadPoolExecutor

    log, engine, indexed = site
    log.write_text(lines(0, 3))
    indexed()
    rows = engine.store.rows().cache()
    with ThreadPoolExecutor(4) as pool:
        for f in [pool.submit(Store(spark, engine.store.path).commit, f"/g{k}", rows, []) for k in range(4)]:
            f.result()
    assert engine.store.rows().count() == 15 and len(engine.store.manifest().parts) == 5


def test_stale_groups_go_after_two_checks(site):
    log, engine, indexed = site
    log.write_text(lines(0, 2))
    indexed()
    engine.catalogue.logs = [HostLog(str(log.parent / "other.log"))]
    assert engine.rounds.run(now=NOW).removed == []
    os.remove(log)
    assert engine.rounds.run(now=NOW).removed == []
    assert engine.rounds.run(now=NOW).removed == [str(log)]
    engine.catalogue.logs = []
    assert engine.rounds.run(now=NOW).removed == []


def test_questions(site):
    from datetime import date

    log, engine, indexed = site
    log.write_text(lines(0, 40))
    indexed()
    answer = engine.search(now=NOW, text="/p/7")
    assert [r["path"] for r in answer.hits.collect()] == ["/p/7"] and answer.figures.first()["docs"] == 1
    assert [r["path"] for r in engine.entries(limit=2).collect()] == ["/p/39", "/p/38"]
    board = engine.dashboard(start=date(2026, 9, 7), end=date(2026, 9, 7), now=NOW)
    assert board["overview"].first()["pv"] == 40 and board["urls"].count() == 40
    assert engine.analytics()["figures"].first()["docs"] == 40 and engine.warm() == 40
    assert engine.status()[0]["documents"] == 40 and engine.preflight()["available"]
    assert engine.totals() == {"files": 1, "indexed": 1, "indexing": 0, "documents": 40} and engine.status(state="indexing") == []
    with pytest.raises(ScopeError):
        engine.entries("/etc/passwd")


def test_error_log(spark, tmp_path):
    log = tmp_path / "error.log"
    log.write_text('2026/09/07 15:32:29 [error] 1#2: *3 a, client: 1.2.3.4, request: "GET /x HTTP/1.1"\n  more of it\n2026/09/07 15:32:30 [warn] b\n')
    engine = Engine(spark, Store(spark, f"file://{tmp_path}/store"), Catalogue([HostLog(str(log), "error")]))
    engine.rounds.run(now=NOW)
    assert [(r["level"], r["path"]) for r in engine.entries(str(log), tail=False).collect()] == [("error", "/x"), ("warn", None)]
    assert engine.search(str(log), now=NOW, text="level:warning").figures.first()["docs"] == 1
    with pytest.raises(ScopeError):
        engine.dashboard(str(log))


def test_long_logs_are_read_by_many_tasks(tmp_path):
    """Tasks take the lines apart that they read, so one has some 64,000 of them at most."""
    parts = slices(str(tmp_path / "access.log"), "f", 5, 256 << 20)
    assert len(parts) == 16 and [p.start for p in parts[1:]] == [p.stop for p in parts[:-1]] and parts[-1].stop == 256 << 20
    assert parts[0].aligned and not parts[1].aligned


def test_events_are_written_as_files_with_lines_of_their_own(spark, tmp_path, monkeypatch):
    """Also where copies of the same lines follow each other, as each file of a log is told by its first line."""
    monkeypatch.setattr(indexed, "LINES", 100)
    lines = spark.range(400).select(F.col("id").alias("off"), F.concat(F.lit("line "), F.col("id") % 100).alias("raw"))
    files = indexed._write(lines, str(tmp_path / "a"))
    assert len(files) >= 4 and len({fingerprint(f) for f in files}) == len(files)
    got = [x for f in files for x in open(f).read().splitlines()]
    assert sorted(got) == sorted(f"line {k % 100}" for k in range(400))
    more = indexed._write(lines, str(tmp_path / "b"), beside=files)
    assert not {fingerprint(f) for f in more} & {fingerprint(f) for f in files}


def test_files_of_a_log_are_cut_without_samples(spark, tmp_path, monkeypatch):
    """Copies of lines at equal distances are written once: no cut falls on the same line of two copies."""
    monkeypatch.setattr(indexed, "LINES", 100)
    lines = spark.range(400).select(F.col("id").alias("off"), F.concat(F.lit("line "), F.col("id") % 100).alias("raw"))
    files = indexed._write(lines, str(tmp_path / "a"))
    assert len(files) == 4 and len(list(tmp_path.iterdir())) == 1
    assert [x for f in files for x in open(f).read().splitlines()] == [f"line {k % 100}" for k in range(400)]


def test_line_reader(tmp_path):
    f = tmp_path / "x.log"
    f.write_bytes(b"\r\n\nfirst\r\n" + b"y" * ((1 << 20) + 5) + b"\nlast\nopen")
    size = f.stat().st_size
    assert [x[1] for x in read_lines(str(f), 0, size)] == [b"first", b"last"]
    assert len(fingerprint(str(f))) == 32
    (tmp_path / "open.log").write_bytes(b"no end yet")
    assert fingerprint(str(tmp_path / "open.log")) is None


@pytest.mark.parametrize(("start", "length", "zone"), [(BASE + 1800, 30000, "Asia/Kolkata"), (BASE + 61, 90001, "UTC"), (BASE, 86400, "America/New_York")])
def test_rollups_agree_with_a_scan(spark, start, length, zone):
    import random

    from logloom.operators import dashboard as d

    rng = random.Random(start)
    data = [(BASE + rng.randrange(0, 150000), rng.choice(["1.1.1.1", "2.2.2.2", "::1", None]), rng.choice(["/a", "/b", ""]), 200, rng.randrange(1000), "B", "O", "D", "/l/a.log") for _ in range(800)]
    rows = spark.createDataFrame(data, "ts long, ip string, path string, status int, bytes_sent long, browser string, os string, device_type string, main_log_path string").cache()
    lay = Layout(start, start + length, zone)
    hybrid, direct = Hybrid(build(rows), rows, lay), d.dashboard(rows, lay)
    mine = hybrid.dashboard()
    for name in ("overview", "hourly", "daily", "browsers"):
        assert sorted(map(tuple, mine[name].collect()), key=str) == sorted(map(tuple, direct[name].collect()), key=str), name
    assert sorted(map(tuple, hybrid.minutes().collect())) == sorted(map(tuple, d.minutes(rows, lay).collect()))


@pytest.mark.parametrize("zone", ["UTC", "Asia/Kolkata", "America/New_York"])
def test_one_pass_counts_what_single_scans_do(spark, zone, monkeypatch):
    import random

    from logloom.operators import dashboard as d

    rng = random.Random(7)
    data = [(BASE + rng.randrange(-90000, 200000), rng.choice(["1.1.1.1", "2.2.2.2", "::1", None]), rng.choice(["/a", "/b", "", None]), rng.choice([None, 1, 70]), rng.choice(["B", "", None]), "O", None, "/l/a.log") for _ in range(900)]
    rows = spark.createDataFrame(data, "ts long, ip string, path string, bytes_sent long, browser string, os string, device_type string, main_log_path string")
    for lay in (Layout(BASE + 1234, BASE + 95_000, zone), Layout(BASE + 9_000_000, BASE + 9_009_000, zone)):
        scans = []
        real = d.in_scan
        monkeypatch.setattr(d, "in_scan", lambda *a: scans.append(1) or real(*a))
        window, hours, days, minute, lists = d.from_counts(d.counted(rows, lay), lay)
        assert len(scans) == 1
        monkeypatch.setattr(d, "in_scan", real)
        told = lambda f: sorted(map(tuple, f.select(sorted(f.columns)).collect()), key=str)
        assert told(window) == told(d.window_figures(rows, lay)) and told(hours) == told(d.hourly(rows, lay)) and told(days) == told(d.daily(rows, lay)) and told(minute) == told(d.minutes(rows, lay))
        clear = rows.replace("", None)
        assert all(told(lists[k]) == told(d.facet(clear, lay, k)) for k in lists)
