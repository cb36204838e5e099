"""Wall time of the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Each query runs once to warm up and then ``$BENCH_RUNS`` times (default 2); the median
counts. Results go to the no-op sink, so every row is computed and none is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kinolake import registry  # noqa: E402
from kinolake.session import build_session  # noqa: E402

HEADLINE = (
    "wn01_savgol", "wn10_change_points_l2", "pl01_segment_videos", "ag05_movement_stats", "ag03_scene_averages",
    "jn06_frames_to_intervals", "jn01_combined_view", "tk01_retrieve_candidates", "jn15_resolve_contested",
    "jn05_bucket_edges", "tk03_find_chains", "wn19_global_offsets",
    "sc31_export_items", "ag02_camera_motion_residual",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINE
    spark = build_session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else None)
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = registry.load()
    times = {}
    for name in names:
        samples = []
        for _ in range(runs + 1):
            started = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - started)
        times[name] = round(statistics.median(samples[1:]), 3)
    print(json.dumps({"metric": "sum of median query times", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
