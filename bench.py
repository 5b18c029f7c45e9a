"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores. Each
query is planned and fully executed (no result is collected) after one untimed
warm-up query, and its best of two runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sparktrail.plans import registry  # noqa: E402
from sparktrail.session import local_session  # noqa: E402

HEADLINE = (
    "detect_chain", "detect_request", "pii_all", "mask_secrets", "fingerprint_reuse",
    "trail_scan", "hook_trail", "assemble_trail", "page_rows", "page_counts", "facets",
    "session_blocks", "paired_source", "auth_alerts", "rpc_latency", "latency_stats",
    "manifest_drift", "compact_idempotent", "export_csv", "stream_counts",
)
RUNS = 2


def run_once(fn, spark, folder) -> float:
    start = time.perf_counter()
    fn(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    run_once(queries["tray_counts_24h"], spark, folder)
    seconds = {name: round(min(run_once(queries[name], spark, folder) for _ in range(RUNS)), 3) for name in names}
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline queries, total seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
