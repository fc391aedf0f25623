"""Headline queries at one scale; prints one JSON line.

Reads ``BENCH_SF_DIR`` and ``BENCH_CPUS``. Each query has one warm-up run, then
the median of ``BENCH_RUNS`` runs written to the no-op sink. With
``BENCH_ENGINE=duckdb`` the SQL twins are timed in DuckDB instead.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from tenderlake import catalog
from tenderlake.session import build_session

HEADLINE = (
    "dash_overview", "dash_rank_winner", "bidder_leaderboard", "buyer_concentration", "company_summary", "company_rivals",
    "purchaser_context", "risk_pairs", "risk_hotspots", "search_category", "activity_stats", "v_full", "v_org_activity", "estimated_value_lots",
    "merge_results", "record_compare", "msg_language", "heuristic_class", "components", "similar_names",
    "suspect_groups", "group_pairs", "stream_results",
)


def duckdb_times(root: str, runs: int) -> dict[str, float]:
    from tests.compare import oracle_connection

    con, oracles, times = oracle_connection(root), catalog.oracles(), {}
    for name in HEADLINE:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            con.execute(oracles[name]).to_arrow_table()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
    return times


def report(root: str, times: dict[str, float]) -> None:
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(root.rstrip("/"))}))


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    if os.environ.get("BENCH_ENGINE") == "duckdb":
        report(root, duckdb_times(root, runs))
        return
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = catalog.queries(), {}
    for name in HEADLINE:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            queries[name](spark, root).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
    report(root, times)
    spark.stop()


if __name__ == "__main__":
    main()
