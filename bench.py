"""Times the headline queries at $BENCH_SF_DIR and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyfield.plans import load_all  # noqa: E402
from tallyfield.session import build_session  # noqa: E402

HEADLINE = (
    "summary_by_dataset",
    "error_by_distance_bins",
    "pa_mpjpe_by_record",
    "average_precision",
    "pairwise_overlap",
    "predictions_attached",
    "gate_reasons",
    "points_capped",
    "points_in_boxes",
    "relabelled",
    "nearest_in_frame",
    "nearest_anywhere",
    "k_nearest",
    "mask_overlap",
    "mask_assignment",
    "smooth_pairs",
    "acceptance_summary",
    "error_by_band",
    "depth_reprojected",
    "pillars",
    "column_ranks",
    "early_stops",
    "mixture_batches",
    "clouds_resampled",
    "clouds_thinned",
    "tracks_packed",
    "camera_statistics",
    "stream_early_stop",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries = load_all()[0]
    # one scan and one shuffle first, so that the first query does not pay for the start
    spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_suppkey").count().count()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
