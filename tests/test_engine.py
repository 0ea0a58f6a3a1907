"""What the engine tells of logs, and how questions fail."""

import json
import os
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from logloom.engine import Engine, ScopeError, answer
from logloom.functions.parse import error_time
from logloom.sources.logs import Catalogue, HostLog, main_log_column, main_log_path
from logloom.sources.store import Store
from logloom.streaming.rounds import RebuildError
from test_rounds import NOW, lines


@pytest.fixture
def site(spark, tmp_path):
    log, other = tmp_path / "access.log", tmp_path / "other.log"
    return log, other, Engine(spark, Store(spark, f"file://{tmp_path}/store"), Catalogue([HostLog(str(log)), HostLog(str(other), source="site")]))


def test_preflight(site):
    log, other, engine = site
    missing = engine.preflight()
    assert not missing["available"] and missing["file"]["exists"] is False and missing["message"] == "log file does not exist"
    log.write_text(lines(0, 4))
    other.write_text(lines(10, 12))
    fresh = engine.preflight(str(log))
    assert not fresh["available"] and fresh["state"] == "not_indexed" and fresh["message"] == "log file not indexed yet" and fresh["file"]["size"] == log.stat().st_size
    heard = []
    engine.rounds.listener = lambda e: heard.append((os.path.basename(e["group"]), e["phase"], engine.preflight(e["group"])["state"]))
    engine.rounds.run(now=NOW)
    # the first answer to a group's question comes while it waits, then while it is read
    assert heard[:3] == [("access.log", "queued", "queued"), ("other.log", "queued", "queued"), ("access.log", "indexing", "indexing")] and heard[-1] == ("other.log", "done", "indexed")
    ready = engine.preflight(str(log))
    assert ready["available"] and ready["documents"] == 4 and ready["time_range"][1] - ready["time_range"][0] == 3 * 37 and ready["message"] == ""
    os.remove(log)
    gone = engine.preflight(str(log))
    assert gone["available"] and gone["state"] == "indexed" and not gone["file"]["exists"] and "available" in gone["message"]
    assert engine.preflight("/etc/passwd")["state"] == "error"


def test_a_group_that_fails_is_counted(site, monkeypatch):
    log, other, engine = site
    log.write_text(lines(0, 4))
    other.write_text(lines(10, 12))
    real, broken = type(engine.rounds)._group, [True]

    def group(self, name, *a):
        if broken and name == str(log):
            raise OSError("no such disk")
        return real(self, name, *a)

    monkeypatch.setattr(type(engine.rounds), "_group", group)
    for k in (1, 2):
        report = engine.rounds.run(now=NOW)
        assert report.failed == {str(log): "no such disk"}
        assert engine.events[-1]["group"] != str(log) or engine.events[-1]["retries"] == k
        assert {s["path"]: (s["state"], s["retries"]) for s in engine.status()} == {str(log): ("failed", k), str(other): ("indexed", 0)}
    broken.clear()
    assert engine.rounds.run(now=NOW).groups == [str(log)] and engine.status(name="access")[0]["retries"] == 0


def test_answers(site):
    log, other, engine = site
    log.write_text(lines(0, 4))
    engine.rounds.run(now=NOW)
    assert answer(lambda: engine.totals()["documents"]) == (200, 4)
    status, body = answer(lambda: engine.entries("/etc/passwd"))
    assert (status, body["code"], body["scope"]) == (500, 50014, "nginx_log")
    assert answer(lambda: engine.search(start=5, end=2))[0] == 406 and answer(lambda: engine.search(start=-5))[1]["scope"] == "validate"

    def refused():
        raise RebuildError("group_busy")

    assert answer(refused, str(log))[1]["code"] == 50019 and answer(refused)[1]["code"] == 50018
    with pytest.raises(ScopeError):
        engine.resolve("relative.log")


def test_rebuilds_wait_for_rounds(site):
    log, other, engine = site
    log.write_text(lines(0, 2))
    other.write_text(lines(10, 12))
    seen = {}

    def heard(event):
        if event["phase"] == "indexing" and event["group"] == str(log):
            for group in (None, str(log), str(other)):
                try:
                    engine.rounds.check_rebuild(group)
                except RebuildError as e:
                    seen[group] = str(e)

    engine.rounds.listener = heard
    engine.rounds.run(now=NOW)
    assert seen == {None: "busy", str(log): "group_busy", str(other): "group_busy"}
    assert engine.rounds.check_rebuild(str(log)) == [str(log)]


def test_hits(site):
    log, other, engine = site
    log.write_text(lines(0, 1) + lines(1, 2).replace(" 0.01 0.01", " 0 -"))
    engine.rounds.run(now=NOW)
    first, second = (json.loads(r["entry"]) for r in engine.hits(engine.entries(tail=False)).collect())
    assert first["protocol"] == "HTTP/1.1" and first["request_time"] == 0.01 and first["browser"] == "" and first["device_type"] == "Desktop" and first["city_id"] == 0
    assert "request_time" not in second and "upstream_time" not in second and not {"c1", "c2", "c3", "c4"} & set(first) and first["province"] == ""


def test_hits_take_a_line_apart_once(site):
    """Patterns of lines stand in the plan once, however many fields an entry has; names of clients are those of the rows."""
    log, other, engine = site
    log.write_text(lines(0, 4))
    engine.rounds.run(now=NOW)
    rows = engine.store.rows([str(log)])
    plan = engine.hits(rows)._jdf.queryExecution().optimizedPlan().toJSON()
    assert 1 <= plan.count("(?s)^([^ ]*) +") <= 2  # the plan tells an expression's origin with it
    entry = lambda frame: [r["entry"] for r in engine.hits(frame).orderBy("off").collect()]
    assert entry(rows) == entry(rows.drop("browser", "os", "device_type"))


@pytest.mark.parametrize(("zone", "day"), [("Australia/Lord_Howe", "2024/10/06"), ("America/New_York", "2024/03/10"), ("Australia/Lord_Howe", "2024/04/07"), ("Europe/London", "2024/10/27")])
def test_times_around_gaps(spark, zone, day):
    """A time that doesn't exist is told an hour later, however long the gap; of two the first."""
    z, start = ZoneInfo(zone), datetime.strptime(day, "%Y/%m/%d")
    texts = {(start + timedelta(minutes=7 * k)) for k in range(60)}

    def at(naive):
        t = int(naive.replace(tzinfo=z, fold=0).timestamp())
        return t if datetime.fromtimestamp(t, UTC).astimezone(z).replace(tzinfo=None) == naive else at(naive + timedelta(hours=1))

    df = spark.createDataFrame([(t.strftime("%Y/%m/%d %H:%M:%S"), at(t)) for t in texts], "t string, want long")
    assert df.select(error_time(df["t"], zone).alias("got"), "want").where("got is distinct from want").count() == 0


NAMES = ["/l/.x.20240101", "/l/a..20240101", "/l/access.log.1.gz.xz", "/l/a.log-20240101.gz", "/l/a-20240101", "/l/2024-01-01.gz", "/l/202401", "/l/x.202401", "/l/a.x.202401", "/l/2.1", "/l/a.1.log", "/l/a.1234", "/l/..", "/l/a.2024.01.01.lz4", "/l/a.log.gz.gz", "/l/1999.01.01"]


def test_rotated_names_by_one_table(spark):
    got = {r["p"]: r["m"] for r in spark.createDataFrame([(n,) for n in NAMES if n != "/l/.."], "p string").select("p", main_log_column(F.col("p")).alias("m")).collect()}
    assert got == {n: main_log_path(n) for n in got}
    assert main_log_path("/l/..") == "/l/.." and main_log_path("/l/access.log.1.gz.xz") == "/l/access.log.1.gz.xz" and main_log_path("/l/a.log.gz.gz") == "/l/a.log.gz.gz"
