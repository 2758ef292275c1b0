"""Time the headline queries and print one JSON line.

BENCH_SF_DIR: folder of the Parquet tables; BENCH_CPUS: local cores; BENCH_RUNS: timed runs each
(the median counts); BENCH_QUERIES: comma-separated names, or 'all'.
"""
from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["artists", "kpi", "totals", "by_week", "genre_distribution", "mood_trend", "new_tracks", "tracks_query",
            "track_profile", "sessions", "cooccur", "next_tracks", "for_now", "mixable", "ingest_listens", "classify",
            "topics", "tfidf", "detect_language", "similar_tracks", "similar_for_seeds", "similar_by_tags", "similar_artists"]


def main() -> None:
    from earlog.plans.registry import load
    from earlog.session import build_session
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    pick = os.environ.get("BENCH_QUERIES", "")
    spark = build_session("earlog-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    table = load()
    names = list(table) if pick == "all" else pick.split(",") if pick else HEADLINE
    table["by_month"][0](spark, sf).write.format("noop").mode("overwrite").save()      # start the workers
    times = {}
    for name in names:
        taken = []
        for _ in range(runs):
            t0 = time.perf_counter()
            table[name][0](spark, sf).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(taken), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
