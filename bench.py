"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line. Each query runs to the end of its result."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from ledgerline.plans import registry  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["match_topk", "trigram_block", "match_decide", "threshold_simulate", "score_histogram", "weight_sweep", "impact_by_threshold", "impact_by_json_form", "ledger_dedupe_import", "settle_band_join", "settle_claim", "audit_verify", "reg_status"]
#: A pass over small tables compiles code first.
WARM_DIR = os.path.join(os.path.dirname(SF_DIR.rstrip("/")), "sf0.001")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    seconds: dict[str, float] = {}
    for folder in [WARM_DIR] * os.path.isdir(WARM_DIR) + [SF_DIR]:
        for name in HEADLINE:
            began = time.perf_counter()
            registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    sf = float(os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf") or 0)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
