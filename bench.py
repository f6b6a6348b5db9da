"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Every query runs from
the event table to its collected rows; nothing is shared between queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

import catalog
from driftwarden.session import build_session

HEADLINE = (
    "agg_1_email_features",
    "agg_2_logon_features",
    "agg_3_file_features",
    "agg_4_device_features",
    "sch_4_build_every_kind",
    "jon_1_merge_features",
    "scr_12_forward_signals",
    "scr_13_analyze_threats",
    "rpt_2_executive_summary",
    "pil_g_all_features",
    "trn_1_training_layout",
    "scr_4_risk_buckets",
    "profile_risk_without_model",
    "agg_9_quantiles_narrowed",
    "evl_2_classification_metrics",
    "mdl_2_decision_score",
    "log_risk_with_model",
    "profile_risk_with_model",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/events.parquet").count()
    registered = catalog.queries()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        registered[name](spark, folder).collect()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
