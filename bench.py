"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
import json
import os
import time

from checks import load
from checks.registry import QUERIES
from tabulario.session import build_session

HEADLINE = [
    "kpi-09", "kpi-12", "kpi-15", "agg-02", "agg-04", "agg-10", "agg-13", "agg-14", "agg-17", "agg-18", "top-01",
    "prf-01", "prf-04", "qlt-12", "qlt-14", "qlt-17", "qlt-20", "qlt-29", "prp-03", "prp-04", "prp-08", "prp-11",
    "ins-02", "ins-05", "ins-09", "ins-12", "exp-02", "exp-06", "win-04", "win-06", "vis-02", "geo-02", "mod-05",
    "mod-12", "mod-13", "mod-16", "mod-17", "mod-18", "src-01",
]
#: Run once before the clock starts: the first query pays for starting Spark, compiling and opening the tables.
WARM_UP = "kpi-01"


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", spark_sql_shuffle_partitions=cpus, spark_ui_enabled="false",
                          spark_driver_memory=os.environ.get("BENCH_MEMORY", "12g"))
    spark.sparkContext.setLogLevel("OFF")
    load()
    QUERIES[WARM_UP](spark, sf_dir).collect()
    seconds: dict[str, float] = {}
    for key in HEADLINE:
        start = time.perf_counter()
        # every row is computed; none is kept
        QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[key] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
