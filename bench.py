"""Wall-clock seconds per query: warm, best of BENCH_RUNS, local mode.

Prints one JSON line. BENCH_SF_DIR, BENCH_CPUS, BENCH_RUNS and BENCH_ONLY
(comma-separated query names) change the run.
"""

from __future__ import annotations

import functools
import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from formloom.plans.queries import registry  # noqa: E402
from formloom.sources import tables  # noqa: E402

HEADLINE = (
    "q_match_cascade", "q_match_exact", "q_match_prefix", "q_match_email", "q_review_list", "q_top_candidates",
    "q_dob_candidates", "q_content_hash_dups", "q_email_extract", "q_doc_kind", "q_field_precedence",
    "q_next_line_label", "q_enriched", "q_discrepancies", "q_latest_by_hash", "q_resubmit_action",
    "q_session_unique_people", "q_completed_list", "q_progress", "q_audit_trail", "q_current_ledger", "q_sheet",
    "q_safe_log", "q_grid_marked", "q_completeness", "q_widget_rows", "q_option_winner", "q_lines",
    "q_label_right_neighbour", "q_column_clusters", "q_signature_verdict", "q_final_status", "q_audit_events",
    "q_stream_intake", "q_batch_decisions",
)


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("formloom-bench")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    todo = registry()
    # each checking table is one file of one row group, so without this one core would do the work before the first shuffle
    tables.read = functools.partial(tables.read, spread=True)
    only = os.environ.get("BENCH_ONLY")
    names = only.split(",") if only else (todo if os.environ.get("BENCH_ALL") else HEADLINE)
    seconds: dict[str, float] = {}
    for name in names:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            todo[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
