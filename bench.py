"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line. The headline is the first run of each query, start-up
and code generation included; `second` has the seconds of a second run of the same code."""

from __future__ import annotations

import json
import os
import time

from tracemill.plans import registry
from tracemill.session import session

HEADLINE = [
    "scan_record_rules", "prioritised_topn", "locate_innermost", "claim_groups_representative", "funnel_steps", "total_budget_drop", "intervals_inclusive", "unread_ranges",
    "coverage_full_partial_never", "method_index", "agent_rows_fold", "latest_by_arrival", "topk_new_per_scope", "model_call_totals", "closure_rule", "traffic_by_path", "token_estimate",
    "grep_lines", "workspace_digest", "diff_only_left_right", "caller_walk", "flow_components",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", **{"spark.master": f"local[{cpus}]", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).selectExpr("sum(id)").collect()
    first, second = {}, {}
    for times in (first, second):
        for name in HEADLINE:
            began = time.time()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(first.values()), 3), "unit": "sec", "queries": first, "second": second, "second_total": round(sum(second.values()), 3), "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
