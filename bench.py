"""Times the headline queries; prints one JSON line."""

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from quaylark.plans import catalog  # noqa: E402,F401
from quaylark.plans.registry import QUERIES  # noqa: E402

HEADLINE = ("tower_split", "tower_one_at_100", "loss_report", "loss_report_one_at_100", "group_sum", "aep", "oep", "tvar_batch", "hill_plot", "combine", "gram_matrix", "vector_reductions", "cosine_to_label", "nd_broadcast_add", "windowed_losses")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            t = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - t)
        # warm: the first run compiles
        times[name] = round(median(runs[1:]), 4)
    print(json.dumps({"metric": "total warm seconds, median of 3", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
