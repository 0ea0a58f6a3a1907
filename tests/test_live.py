"""A log followed as a stream."""

from logloom.sources.store import Store
from logloom.streaming.live import follow
from test_rounds import NOW, lines, paths


def test_follow(spark, tmp_path):
    log = tmp_path / "access.log"
    store = Store(spark, f"file://{tmp_path}/store")
    got = lambda: sorted(r["path"] for r in store.rows().select("path").collect())
    log.write_text(lines(0, 5) + "open")
    for want, change in ((paths(0, 5), None), (paths(0, 7), lambda: log.write_text(lines(0, 7)))):
        if change:
            change()
        query = follow(store, str(log), "access", NOW, f"file://{tmp_path}/check")
        query.processAllAvailable()
        query.stop()
        assert got() == want
    log.rename(f"{log}.1")
    with open(f"{log}.1", "a") as f:
        f.write(lines(7, 9))
    log.write_text(lines(50, 52))
    query = follow(store, str(log), "access", NOW, f"file://{tmp_path}/check")
    query.processAllAvailable()
    query.stop()
    assert got() == sorted(paths(0, 9) + paths(50, 52))
