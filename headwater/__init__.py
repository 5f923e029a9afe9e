"""Column lineage and catalog analytics over large corpora of SQL scripts, as Spark jobs."""

from headwater.api import (
    LineageResult,
    LineageState,
    lineage_from_files,
    lineage_from_sql,
    lineage_from_statements,
    lineage_result,
    load_state,
    read_lineage,
    run_folder,
    save_state,
)

__all__ = [
    "LineageResult",
    "LineageState",
    "lineage_from_files",
    "lineage_from_sql",
    "lineage_from_statements",
    "lineage_result",
    "load_state",
    "read_lineage",
    "run_folder",
    "save_state",
]
