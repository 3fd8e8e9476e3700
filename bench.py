"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR picks the tables (default sf0.1), BENCH_CPUS the local cores.
Every query runs once to warm up and is then timed; results go to the noop sink, so all
rows and columns are computed and none is collected.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from aisleframe.operators import features, leadership, marts, warehouse  # noqa: E402
from aisleframe.panel import price_panel  # noqa: E402
from aisleframe.plans.catalogue import QUERIES  # noqa: E402
from aisleframe.plans.q_tables import essentials_of  # noqa: E402
from aisleframe.session import build_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
CATALOGUE = [
    "clean_listings",
    "dispersion",
    "seasonal_decompose",
    "asof_lookup",
    "canonical_clusters",
    "cluster_bootstrap",
    "listing_day",
    "legacy_rolling_inclusive",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(make, repeats: int = 2) -> float:
    best = float("inf")
    for _ in range(repeats):
        start = time.perf_counter()
        run(make())
        best = min(best, time.perf_counter() - start)
    return round(best, 3)


def main() -> None:
    work = tempfile.mkdtemp(prefix="aisleframe-bench-")
    spark = build_session(
        "aisleframe-bench",
        f"local[{CPUS}]",
        {
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": "16g",
            "spark.checkpoint.dir": f"{work}/checkpoints",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    # The stages hand tables over as Parquet, so the operators are timed on that.
    price_panel(spark, SF_DIR).write.parquet(f"{work}/panel")
    panel = spark.read.parquet(f"{work}/panel")
    times: dict[str, float] = {}
    start = time.perf_counter()
    marts.fact_price_daily(panel).write.parquet(f"{work}/fact")
    marts.dim_product(panel).write.parquet(f"{work}/dim")
    times["build_marts"] = round(time.perf_counter() - start, 3)
    fact, dim = spark.read.parquet(f"{work}/fact"), spark.read.parquet(f"{work}/dim")
    daily = features.listing_day(panel)
    daily.write.parquet(f"{work}/daily")
    daily = spark.read.parquet(f"{work}/daily")
    items = essentials_of(spark, SF_DIR)
    base_rows = panel.groupBy("canonical_name", "supermarket", "date").agg(F.avg("prices").alias("avg_price"))

    times["temporal_features"] = timed(lambda: features.temporal_features(daily))
    times["feature_frame"] = timed(lambda: features.feature_frame(panel))
    times["price_leadership_daily"] = timed(lambda: leadership.price_leadership(panel, max_lag=7))
    times["market_overview_on_mart"] = timed(lambda: warehouse.market_overview(fact, dim))
    times["market_overview_on_base"] = timed(
        lambda: warehouse.market_overview(marts.fact_price_daily(panel), marts.dim_product(panel))
    )
    times["basket_cost_on_mart"] = timed(lambda: warehouse.basket_cost(fact, items))
    times["basket_cost_on_base"] = timed(lambda: warehouse.basket_cost(base_rows, items))
    for name in CATALOGUE:
        times[name] = timed(lambda name=name: QUERIES[name](spark, SF_DIR))
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
