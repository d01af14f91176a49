"""

Builds the memory graph from the test tables at ``$BENCH_SF_DIR`` once and
stores it as a snapshot (nodes in label buckets, clustered by date; adjacency sorted by
node id) in a scratch folder, then times each query against the snapshot
as the median of ``$BENCH_RUNS`` (default 3) warm runs. Prints one JSON
line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
NOW = "2026-01-01T00:00:00.000Z"


def main() -> None:
    from pyspark.sql import functions as F

    from mnemo.operators import mutate, stats
    from mnemo.plans.bulk import bulk_search
    from mnemo.plans.change_queries import _bulk_requests, _log_lines
    from mnemo.plans.search import search_memories
    from mnemo.session import get_session
    from mnemo.sources.requests import parse_log_lines
    from mnemo.sources.snapshot import materialize, read_graph, release_run, scratch_path, write_graph
    from mnemo.sources.testgraph import K, build_graph, read_table
    from mnemo.operators.delta import write_delta
    from mnemo.streaming.replay import replay_log_delta

    spark = get_session(master=f"local[{CPUS}]", shuffle_partitions=int(CPUS) * 2, app_name="mnemo-bench")
    spark.sparkContext.setLogLevel("ERROR")
    # all bench data lives under the session's shared checkpoint folder
    scratch = scratch_path(spark, "bench")

    t0 = time.perf_counter()
    snap = write_graph(build_graph(spark, SF_DIR), f"{scratch}/graph")
    build_sec = time.perf_counter() - t0
    graph = read_graph(spark, snap)

    flag = dict(query="urgent high", label="order", since_date="1998-01-01", limit=10)
    # those of the earlier rounds, and with one more per supplier (over 1,000 distinct words at sf0.1)
    many = materialize(spark, _bulk_requests(spark, SF_DIR), "bench-requests")
    requests = materialize(spark, many.where(~F.col("req_key").startswith("supplier:")), "bench-few-requests")
    deletes = materialize(spark, read_table(spark, SF_DIR, "customer").where(F.col("c_acctbal") > 9890).select(
        F.col("c_custkey").alias("req_id"), (F.lit(3 * K) + F.col("c_custkey")).alias("memory_id")),
        "bench-deletes")
    # the log as its producer would store it: JSON lines in evenly sized files
    log = materialize(spark, _log_lines(spark, SF_DIR).repartition(int(CPUS) * 2), "bench-log")

    def write_snapshot(change, name):
        write_graph(change.graph, scratch_path(spark, name))
        change.result.write.parquet(scratch_path(spark, name + "-result"))

    def write_change(change, name):
        write_delta(change.delta, scratch_path(spark, name), results=change.result)

    def replay():
        delta, results, _ = replay_log_delta(graph, parse_log_lines(log), NOW)
        write_delta(delta, scratch_path(spark, "bench-replay"), results=results)

    queries = {
        "search_memories": lambda: search_memories(graph, depth=1, **flag).collect(),
        "expand_depth2": lambda: search_memories(graph, depth=2, **flag).collect(),
        "search_match_all": lambda: search_memories(graph, limit=200, depth=0).collect(),
        "bulk_search": lambda: bulk_search(graph.nodes, requests).collect(),
        "bulk_search_many": lambda: bulk_search(graph.nodes, many).collect(),
        "label_summary": lambda: stats.label_summary(graph.nodes).collect(),
        # the whole new snapshot, adjacency included
        "delete_memories": lambda: write_snapshot(mutate.delete_memories(graph, deletes), "bench-delete"),
        # what changed (rows and deleted ids); merging it into a full
        # snapshot is a separate, periodic job
        "delete_delta": lambda: write_change(mutate.delete_memories(graph, deletes), "bench-delete-delta"),
        "replay_log": replay,
    }
    times: dict[str, float] = {}
    for name, fn in queries.items():
        fn()  # warm-up (JIT, file listing caches)
        runs = []
        for _ in range(RUNS):
            t = time.perf_counter()
            fn()
            runs.append(time.perf_counter() - t)
        times[name] = round(statistics.median(runs), 3)
    out = {
        "metric": "total_median_query_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "build_graph_sec": round(build_sec, 3),
        "sf": os.path.basename(SF_DIR.rstrip("/")).replace("sf", ""),
        "spark": spark.version,
        "cpus": int(CPUS),
        "runs": RUNS,
    }
    print(json.dumps(out))
    release_run(spark)
    spark.stop()


if __name__ == "__main__":
    main()
