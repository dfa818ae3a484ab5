"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (table folder), BENCH_CPUS (local cores). Every query
runs to completion into a sink that keeps nothing; the first run of the flagship
warms the session and is not counted.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tabulith.queries import QUERIES  # noqa: E402
from tabulith.session import local_session  # noqa: E402

HEADLINE = (
    "month_region_totals", "region_rollup", "scoped_sums", "period_change", "contribution_margin", "trend_four_months",
    "quantiles_type7", "outlier_scan", "row_spans", "evidence_page", "type_vote", "quality_ledger", "normalize_apply",
    "csv_cells", "delimiter_vote", "findings_ranked", "scenario_sweep", "proof_recompute", "referential_checks",
    "largest_remainder",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, "tabulith-bench", os.environ.get("BENCH_MEMORY", "8g"))
    QUERIES["month_region_totals"](spark, folder).write.format("noop").mode("overwrite").save()
    timings: dict[str, float] = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": cores,
            }
        )
    )


if __name__ == "__main__":
    main()
