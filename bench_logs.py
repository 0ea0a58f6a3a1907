"""Times the four shapes of a log site: bulk import, dashboards of 30 and 7 days, and a search over all with the newest 50.

The log has COPIES lines for each event of $BENCH_SF_DIR (1.4 million at sf0.1), spread over the same 30 days, in files of about
40 MB. One JSON line is printed; dashboards and searches run once to warm up, the median of three counts.
"""

import json
import os
import sys
import tempfile
import time
from datetime import date
from statistics import median

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
COPIES = 14


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from logloom.engine import Engine
    from logloom.operators import dashboard
    from logloom.operators.dashboard import Layout
    from logloom.queries import NOW, access_lines
    from logloom.sources.logs import Catalogue, HostLog
    from logloom.sources.store import Store
    from logloom.views import log_rows

    top = tempfile.mkdtemp(prefix="bench-logs-")
    rows = log_rows(spark, sf).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)))).withColumn("ts", F.col("ts") + F.col("copy") * 37 % 3600)
    access_lines(rows).select("raw").coalesce(8).write.text(f"file://{top}/lines")
    os.makedirs(f"{top}/logs")
    parts = sorted(f for f in os.listdir(f"{top}/lines") if f.startswith("part-"))
    for k, name in enumerate(parts):
        os.rename(f"{top}/lines/{name}", f"{top}/logs/access.log.{k}" if k else f"{top}/logs/access.log")
    out: dict[str, float] = {}
    for indexed in (False, True):
        engine = Engine(spark, Store(spark, f"file://{top}/store-{indexed}", indexed=indexed), Catalogue([HostLog(f"{top}/logs/access.log")]))
        began = time.time()
        engine.rounds.run(now=NOW)
        out["import_with_postings" if indexed else "import"] = round(time.time() - began, 2)
    month, week = (date(2024, 1, 1), date(2024, 1, 30)), (date(2024, 1, 24), date(2024, 1, 30))

    def shown(frames: dict) -> None:
        for f in frames.values():
            f.write.format("noop").mode("overwrite").save()

    def timed(name: str, ask) -> None:
        runs = []
        for k in range(4):
            began = time.time()
            ask()
            if k:
                runs.append(time.time() - began)
        out[name] = round(median(runs), 2)

    timed("dashboard_30_days", lambda: shown(engine.dashboard(start=month[0], end=month[1], now=NOW)))
    timed("dashboard_30_days_from_rows", lambda: shown(dashboard.dashboard(engine.store.rows(), Layout.of_dates(*month, NOW))))
    timed("dashboard_7_days", lambda: shown(engine.dashboard(start=week[0], end=week[1], now=NOW)))
    timed("search_newest_50", lambda: [engine.search(now=NOW).hits.collect(), engine.search(now=NOW).figures.collect()])
    timed("search_words", lambda: engine.search(now=NOW, text='"POST /purchase/13"').hits.collect())
    timed("search_words_by_score", lambda: engine.search(now=NOW, text="error 13", sort_by="_score").hits.collect())
    timed("status", lambda: engine.status())
    print(json.dumps({"metric": "seconds", "lines": engine.store.figures()[f"{top}/logs/access.log"]["docs"], "shapes": out, "sf": sf}))


if __name__ == "__main__":
    main()
