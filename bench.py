"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from trailweave import build_session  # noqa: E402
from trailweave.catalog import all_queries  # noqa: E402

HEADLINE = [
    "log_info", "stages", "funnel", "type_counts", "subject_tree", "directly_follows", "edges", "variants", "nodes",
    "split_runs", "walk_order_chrono", "dotted_points", "subject_bands", "density", "drill", "variant_bands",
    "template_check", "check_sequence", "model_fit", "validate_payload", "stream_verdict", "reference_edges",
    "payload_references", "resolve_references",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
           "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
           "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-")},
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = all_queries()
    names = sys.argv[1:] or HEADLINE
    known["log_info"](spark, folder).collect()  # start the engine before timing
    timings = {}
    for name in names:
        began = time.perf_counter()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": Path(folder).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
