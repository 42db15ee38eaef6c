"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Every query runs over its whole tables into a no-op sink, once cold and then warm; `queries` holds the best warm time and
`value` their sum.
"""

from __future__ import annotations

import json
import os
import sys
import time

from foliomill.plans.catalog import QUERIES
from foliomill.session import local_session

HEADLINE = (
    "quality_features",
    "quality_score",
    "quality_report",
    "html_to_markdown",
    "html_to_text",
    "select_best",
    "select_best_long",
    "document_results",
    "batch_stats",
    "web_stats",
    "scan_filter",
    "route_plan",
    "target_collisions_flat",
    "skip_existing",
    "table_to_markdown",
    "assemble_pages",
    "assembled_scores",
    "ocr_lines_new",
    "isolated_faults",
    "convert_tables",
    "incremental_convert",
    "export_and_scan",
)
WARM_RUNS = 2


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    cold, warm = {}, {}
    for name in sys.argv[1:] or HEADLINE:
        times = [_seconds(spark, name, sf_dir) for _ in range(1 + WARM_RUNS)]
        cold[name], warm[name] = times[0], min(times[1:])
    n_docs, n_pages = (spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("documents", "pages"))
    rates = {}
    if "quality_score" in warm:
        rates["documents_scored_per_sec"] = round(n_docs / warm["quality_score"], 1)
    if "select_best" in warm:
        rates["pages_converted_and_selected_per_sec"] = round(n_pages / warm["select_best"], 1)
    print(
        json.dumps(
            {
                "metric": "sum of best warm query times",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                **rates,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
                "spark": spark.version,
            }
        )
    )
    spark.stop()


def _seconds(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


if __name__ == "__main__":
    main()
