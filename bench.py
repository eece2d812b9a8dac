"""Times the headline queries and prints one JSON line.

The daily tables are written once before timing starts, as they are stored tables
for the operators.  Each query runs once to warm up and then BENCH_RUNS times into a
sink that discards the rows; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from dayplan.operators import edits as ed
from dayplan.operators import forecast as fc
from dayplan.operators import inventory as inv
from dayplan.operators import summary
from dayplan.plans.queries import KEYS, START, streamed_messages
from dayplan.session import build_session
from dayplan.sources import views
from dayplan.sources.staging import release
from dayplan.streaming.events import debug_messages

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
MEMORY = os.environ.get("BENCH_MEMORY", "8g")


def headline(spark):
    part = views.daily(spark, SF_DIR, "part")
    stale = views.daily_stale(spark, SF_DIR, "part")
    brand = views.daily_stale(spark, SF_DIR, "brand")
    single = views.daily_stale(spark, SF_DIR, None)
    edits = views.edits(spark, SF_DIR)
    changes = views.daily_changes(spark, SF_DIR)
    events = views.agent_events(spark, SF_DIR)

    def four_scans():
        summary.production_summary(part, KEYS).write.format("noop").mode("overwrite").save()
        summary.demand_summary(part, KEYS).write.format("noop").mode("overwrite").save()
        summary.inventory_summary(part, KEYS).write.format("noop").mode("overwrite").save()
        return summary.latest_inventory(part, KEYS)

    return {
        "recalc_inventory": lambda: inv.recalc_inventory(stale, START, KEYS),
        "recalc_inventory_by_series": lambda: inv.recalc_inventory(
            stale, START, KEYS, by_series=True
        ),
        "recalc_inventory_single": lambda: inv.recalc_inventory(single, START),
        "recalc_inventory_single_direct": lambda: inv.recalc_inventory(
            single, START, by_series=True
        ),
        "set_demand": lambda: ed.apply_edits(brand, edits, KEYS),
        "upsert_daily": lambda: ed.upsert_daily(brand, changes, KEYS),
        "kpi_cards": lambda: summary.kpi_cards(part, KEYS),
        "kpi_cards_four_scans": four_scans,
        "stockouts": lambda: inv.stockouts(part, KEYS),
        "ses_forecast": lambda: fc.ses_forecast(part, keys=KEYS),
        "moving_average_forecast": lambda: fc.moving_average_forecast(part, keys=KEYS),
        "moving_average_series": lambda: fc.moving_average_series(part, keys=KEYS),
        "debug_messages": lambda: debug_messages(events),
        "stream_debug_messages": lambda: streamed_messages(spark, SF_DIR),
    }


def timed(run) -> float:
    begin = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        int(CPUS),
        spark__driver__memory=MEMORY,
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = os.environ.get("BENCH_ONLY")
    times = {}
    for name, run in headline(spark).items():
        if chosen and name not in chosen.split(","):
            continue
        timed(run)
        times[name] = round(statistics.median(timed(run) for _ in range(RUNS)), 4)
    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": round(sum(times.values()), 4),
                "unit": "sec",
                "queries": times,
                "sf": SF_DIR.rsplit("sf", 1)[-1],
                "cpus": int(CPUS),
                "memory": MEMORY,
                "runs": RUNS,
            }
        )
    )
    release(spark)
    spark.stop()


if __name__ == "__main__":
    main()
