"""Time the headline queries; prints one line of JSON.

Settings come from the environment: BENCH_SF_DIR, BENCH_CPUS, BENCH_WARMUP and
BENCH_RUNS (for each query and client), BENCH_CLIENTS (threads that ask at the same
time, each all queries), BENCH_QUERIES (names, comma-separated), and BENCH_COMPARE
(any value: the same queries by an embedded single-node engine, for comparison).
"""

import json
import os
import statistics
import time
from concurrent.futures import ThreadPoolExecutor

from tarnwater.operators import aggregates, joins
from tarnwater.plans import suite
from tarnwater.session import TABLES, build

SF_DIR, CPUS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
WARMUP, RUNS = int(os.environ.get("BENCH_WARMUP", "1")), int(os.environ.get("BENCH_RUNS", "3"))
CLIENTS = int(os.environ.get("BENCH_CLIENTS", "1"))
EVENTS = ("events_group_count", "events_partial_agg", "events_avg")


def chosen() -> dict:
    every = suite.QUERIES | {n: aggregates.QUERIES[n] for n in EVENTS} | {"events_top_k": joins.QUERIES["events_top_k"]}
    names = os.environ.get("BENCH_QUERIES")
    return {n: every[n] for n in names.split(",")} if names else every


def timed(run) -> float:
    began = time.perf_counter()
    run()
    return time.perf_counter() - began


def measure(queries: dict) -> tuple[dict[str, list[float]], float]:
    """Seconds of each run by query, and the wall-clock seconds of all."""

    def client(_) -> dict[str, list[float]]:
        return {name: [timed(run) for _ in range(RUNS)] for name, run in queries.items()}

    for run in queries.values():
        for _ in range(WARMUP):
            run()
    began = time.perf_counter()
    with ThreadPoolExecutor(CLIENTS) as pool:
        parts = list(pool.map(client, range(CLIENTS)))
    return {name: [t for part in parts for t in part[name]] for name in queries}, time.perf_counter() - began


def compared(names: list[str]) -> dict[str, float]:
    """Median seconds of the queries' SQL by the embedded engine."""
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    sql = suite.ORACLES | aggregates.ORACLES | joins.ORACLES
    return {n: round(statistics.median([timed(lambda q=sql[n]: con.execute(q).fetchall()) for _ in range(RUNS)]), 4) for n in names}


def main() -> None:
    settings = {"spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"}
    spark = build(f"local[{CPUS}]", **settings)
    spark.sparkContext.setLogLevel("ERROR")
    runs = {n: (lambda q=q: q(spark, SF_DIR).write.format("noop").mode("overwrite").save()) for n, q in chosen().items()}
    times, wall = measure(runs)
    seconds = {name: round(statistics.median(x), 4) for name, x in times.items()}
    every = [t for x in times.values() for t in x]
    points = statistics.quantiles(every, n=100, method="inclusive") if len(every) > 1 else every * 99
    latency = {f"p{p}": round(points[p - 1], 4) for p in (50, 95, 99)} | {"qps": round(len(every) / wall, 3)}
    out = {"metric": "suite_sum_p50", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "latency": latency}
    if CLIENTS > 1:
        out["clients"] = CLIENTS
    if os.environ.get("BENCH_COMPARE"):
        out["compared"] = compared(list(runs))
    print(json.dumps(out | {"sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
