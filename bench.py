"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR  test tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_RUNS    warm runs per query, of which the median counts (default 3)
BENCH_QUERIES comma-separated query names (default the headline queries)
"""

from __future__ import annotations

import json
import os
import statistics
import time
from pathlib import Path

from verification.compare import local_session
from verification.queries import QUERIES

HEADLINE = (
    "group_quality,monthly_quality_share,monthly_quality_area_by_lot,alert_preforza_list,"
    "alert_postforza,alert_new_blocks,group_applications,weekly_program,weight_distribution,"
    "model_base,forcing_candidates,forcing_scenarios"
)


def seconds(spark, name: str, sf_dir: str) -> float:
    begin = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", HEADLINE).split(",")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    timed = {}
    for name in names:
        seconds(spark, name, sf_dir)  # warm-up
        timed[name] = round(statistics.median(seconds(spark, name, sf_dir) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "total of median warm query times",
                "value": round(sum(timed.values()), 3),
                "unit": "sec",
                "queries": timed,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
