"""Time the headline queries (after one warm-up query) and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tidyledger.plans.queries import QUERIES  # noqa: E402
from tidyledger.session import local_session  # noqa: E402

HEADLINE = (
    "by_category",
    "by_product",
    "kpi_overall",
    "kpi_grouping_sets",
    "trend",
    "top_products",
    "period_comparison",
    "valid_rows",
    "dedup_keep_first",
    "findings",
    "rejected_records",
    "quality_metrics",
    "cleaning_actions",
    "normalise_text",
    "extract_numbers",
    "redact_documents",
    "chunk_documents",
    "classify_function",
    "narrate_regions",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's compiler and the table readers before the clock runs.
    QUERIES[HEADLINE[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        # The no-op sink runs the whole query without bringing rows to the driver.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    total = round(sum(seconds.values()), 3)
    scale = Path(sf_dir).name.removeprefix("sf")
    print(json.dumps({"metric": "headline queries, total time", "value": total, "unit": "sec",
                      "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
