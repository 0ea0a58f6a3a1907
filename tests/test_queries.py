"""Every registered query against the same SQL in DuckDB."""

import pytest

from conftest import same
from logloom import indexed as indexed  # adds its queries to those of the engine
from logloom import queries as q
from logloom.sources.store import Store
from logloom.views import error_rows, log_rows


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query(name, spark, small, duck):
    frame = q.QUERIES[name](spark, small)
    got = duck.execute(q.ORACLES[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(frame.columns)
    same(frame, got.fetchall(), columns)


def test_score_order(spark, small):
    hits = q.QUERIES["search_score_order"](spark, small).collect()
    assert [h["score"] for h in hits] == sorted((h["score"] for h in hits), reverse=True)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 96
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize(("name", "share"), [("incremental_append", None), ("incremental_replace", None), ("incremental_replace_tail", 1)])
def test_the_store_takes_the_whole_table(name, share, spark, small, monkeypatch):
    commits = []

    class Seen(Store):
        def commit(self, group, rows, states, delete=(), **more):
            super().commit(group, rows, states, delete, **more)
            commits.append((self.rows().count(), list(delete)))

    monkeypatch.setattr(q, "Store", Seen)
    n = spark.read.parquet(f"{small}/events.parquet").count()
    got = q.QUERIES[name](spark, small).count()
    assert 0 < commits[0][0] < n == commits[1][0]
    assert [bool(d) for _, d in commits] == [False, False] + [True] * (name != "incremental_append")
    assert share is None or got == n


def test_purging_reads_all_lines_twice_and_no_more(spark, small, monkeypatch):
    written = []

    class Seen(Store):
        def _segment(self, rows, rolled=None):
            written.append(super()._segment(rows, rolled))
            return written[-1]

    monkeypatch.setattr(indexed, "Store", Seen)
    monkeypatch.setattr(indexed, "_ENGINES", {})
    monkeypatch.setattr(indexed, "_LOGS", {}, raising=False)
    n, errors = log_rows(spark, small).count(), error_rows(spark, small).count()
    assert q.QUERIES["index_purged"](spark, small).count() == n
    assert sorted((s.rows, s.indexed) for s in written) == sorted([(n, False), (errors, False)] * 2)
