"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pricelark.plans import all_queries  # noqa: E402
from pricelark.session import build_session  # noqa: E402

HEADLINE = [
    "alert_target_price",
    "alert_threshold_drop",
    "alert_back_in_stock",
    "alert_offer_changes",
    "alert_auto_paused",
    "alerts_all",
    "product_state",
    "stock_bands",
    "catalogue_page",
    "chart_points",
    "chart_stats",
    "proxy_usage",
    "pair_series",
    "cooldown",
    "outbox",
    "import_review",
    "offer_normalise",
    "digest",
    "daily_sweep",
    "stream_alerts",
    "stream_controlled_alerts",
    "stream_quiet_hold",
    "product_state_stored",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("OFF")
    queries, _ = all_queries()
    queries["table_scan"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
