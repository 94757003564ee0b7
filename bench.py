"""Headline queries on one machine; prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

import json
import os
import time

from pyspark.sql import SparkSession

from panelkiln import queries as Q
from panelkiln.operators import queries as O
from panelkiln.plans import library
from panelkiln.plans.compile import evaluate
from panelkiln.sources.panel import bars_from_lines
from panelkiln.sources.scratch import scope


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.codegen.maxFields": "400"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    runs = {
        "flagship_alpha_003": Q.flagship,
        "classic_features": lambda s, d: evaluate(bars_from_lines(s, d), library.classic_features()),
        "baseline_features": lambda s, d: evaluate(bars_from_lines(s, d), library.baseline_features()),
        "alphas_first_15": lambda s, d: evaluate(bars_from_lines(s, d), library.alpha_features(list(library.ALPHAS)[:15])),
        "alphas_all_90_by_kernels": lambda s, d: evaluate(bars_from_lines(s, d), library.alpha_features(), kernels=True),
        "pool_105_by_kernels": lambda s, d: evaluate(bars_from_lines(s, d), library.pool(), kernels=True),
        **{k: O.QUERIES[k][0] for k in ("daily_ic", "decile_portfolio", "mean_daily_spearman", "walk_forward_elastic_net", "return_identity")},
    }
    Q.flagship(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warms the JVM up
    seconds = {}
    for name, f in runs.items():
        start = time.time()
        with scope(spark):
            f(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 2)
    print(json.dumps({"metric": "panel_suite_seconds", "value": round(sum(seconds.values()), 2), "unit": "sec", "queries": seconds, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
