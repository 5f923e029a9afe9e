"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from headwater.plans import QUERIES  # noqa: E402
from headwater.session import build_session  # noqa: E402

HEADLINES = (
    "scan_script_lines",
    "prepare_scripts",
    "tokenize_statements",
    "nest_blocks",
    "source_relations",
    "lineage_ctas",
    "catalog_vertices",
    "table_lineage",
    "expand_stars",
    "triplets",
    "upstream_closure",
    "search_with_upstream",
    "inner_join_chain",
    "dimension_roles_join",
    "full_outer_multiway",
    "group_sum_avg",
    "union_then_aggregate",
    "latest_row_join_back",
    "max_then_min_tiebreak",
    "span_rate",
    "event_pivot_dates",
    "stage_delays",
    "global_row_number",
    "staged_tables",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    width = str(os.cpu_count() or 8) if cpus == "*" else cpus
    spark = build_session(
        "headwater-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": width,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # The first job pays for starting the engine, not for the query it happens to be.
    QUERIES["group_sum_avg"](spark, folder).write.format("noop").mode("overwrite").save()
    wanted = sys.argv[1:] or HEADLINES
    took = {}
    for name in wanted:
        begin = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - begin, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rstrip("/").rsplit("sf", 1)[-1], "cpus": width}))
    spark.stop()


if __name__ == "__main__":
    main()
