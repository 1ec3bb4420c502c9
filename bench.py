"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Two short queries run untimed first, so that JVM start-up is not charged to whichever query comes first.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from matchlake.catalog import load_all  # noqa: E402
from matchlake.session import get_spark  # noqa: E402

HEADLINES = [
    "physical_report",
    "burst_intervals",
    "registry_aggregate",
    "fragment_merge",
    "tag_insights",
    "next_match_effect",
    "rolling_workload",
    "risk_scores",
    "roster_report",
    "csv_upload_quality",
    "combined_heatmap_cells",
    "state_segments",
    "gap_interpolation",
    "box_overlap_match",
    "stitched_players",
    "team_clusters",
    "weighted_jersey",
    "ingested_statistics",
    "live_workload_windows",
    "top_five_per_team",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:] or HEADLINES
    spark = get_spark("bench", cpus, shuffle_partitions=max(8, int(cpus) if cpus.isdigit() else 8))
    queries = load_all()
    for name in ("state_segments", "top_five_per_team"):
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.catalog.clearCache()
    times: dict[str, float] = {}
    for name in only:
        started = time.time()
        df = queries[name](spark, sf_dir)
        # the noop sink runs the whole plan without moving rows to the driver
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 3)
        spark.catalog.clearCache()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
