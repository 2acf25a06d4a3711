"""Time the headline queries, each from cold caches; prints one JSON line.

The cohort's views, which stand for the tables that a user has, are written as Parquet first; ``fixture`` is the time that
takes.  A query is run up to three times (once where a run takes over 3 s) and its median counts; what queries hold is
released before each run.  ``duckdb`` gives the time of the query's SQL in DuckDB on the same files and cores.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

#: The flagship scan, pooling, agreement of kits, facets, scores, the frequency chain, rules, snapshot diff, shared segments, and
#: text work.
HEADLINE = ("pl1_scan", "ag01_pool_calls", "ag05_concordance", "ag11_facets", "ag24_score_prs", "jn07_genotype_frequency", "ru3_rule_coverage", "jn23_diff_snapshots", "wn03_ibd_segments", "fl6_banned_phrase_scan")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
RUNS, LONG = 3, 3.0


def median_of(run) -> float:
    seconds = []
    while len(seconds) < RUNS and (not seconds or seconds[0] < LONG):
        began = time.perf_counter()
        run()
        seconds.append(time.perf_counter() - began)
    return round(statistics.median(seconds), 3)


def duckdb_seconds(sf_dir: str, cpus: str, sql: dict[str, str], views: dict[str, str]) -> dict[str, float]:
    import duckdb

    db = duckdb.connect(config={"threads": cpus})
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, path in views.items():
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}/*.parquet'")
    return {name: median_of(lambda text=text: db.sql(text).to_arrow_table()) for name, text in sql.items()}


def main() -> None:
    from pyspark.sql import SparkSession

    from genocohort.plans import fixtures, registry
    from genocohort.plans.queries import BARE, release
    from genocohort.plans.views import oracle

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="spark-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", scratch).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = registry.queries()
    began = time.perf_counter()
    views = fixtures.store_views(spark, sf_dir, f"{scratch}/cohort")
    fixture = round(time.perf_counter() - began, 3)

    def run(name: str) -> None:
        release()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    run("ag01_pool_calls")  # starts the workers and compiles
    seconds = {name: median_of(lambda name=name: run(name)) for name in HEADLINE}
    spark.stop()
    beside = duckdb_seconds(sf_dir, cpus, {n: oracle(BARE[n], fixtures=False) for n in HEADLINE}, views)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "fixture": fixture, "duckdb": beside}))


if __name__ == "__main__":
    main()
