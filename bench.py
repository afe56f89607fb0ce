"""Times the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Every query is run
once to warm up and then timed, writing all its rows to a sink that drops them. If there
is a folder ``sf0.01`` beside the tables, the queries are timed on it as well, so that
what a query costs at least can be told from what a row costs.
"""

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from duskwatch.operators import iforest
from duskwatch.operators.detect import Detector
from duskwatch.operators.features import extract_features
from duskwatch.scratch import materialize
from verification import lines as L
from verification.registry import QUERIES


SMALL = "sf0.01"


def timed(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    """Seconds of the second run of each query."""
    events = materialize(L.all_events(spark, sf_dir, L.MEDIUM))
    features = materialize(extract_features(events))
    forest = iforest.fit(features)

    def run(df: DataFrame) -> None:
        df.write.format("noop").mode("overwrite").save()

    work = {
        # text to rows: 100,000 lines per kind at sf0.1
        "parse_syslog": lambda: QUERIES["parse_syslog"](spark, sf_dir),
        "parse_access": lambda: QUERIES["parse_access"](spark, sf_dir),
        # lines made, parsed and judged in one plan
        "rule_brute_force": lambda: QUERIES["rule_brute_force"](spark, sf_dir),
        "rule_user_probing": lambda: QUERIES["rule_user_probing"](spark, sf_dir),
        # text to alerts: parsed once, stored, then all rules
        "detect_alerts": lambda: QUERIES["detect_alerts"](spark, sf_dir),
        # from stored events
        "detect_stored": lambda: Detector().run(events),
        "features_all": lambda: extract_features(events),
        "iforest_fit": lambda: iforest.fit_nodes(features),
        "iforest_score": lambda: iforest.score(features, forest),
    }
    seconds = {}
    for name, make in work.items():
        run(make())
        started = time.perf_counter()
        run(make())
        seconds[name] = round(time.perf_counter() - started, 3)
    return seconds


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("duskwatch-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        # tables this small would otherwise be read by one or two tasks
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "100000")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    seconds = timed(spark, sf_dir)
    small_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), SMALL)
    others = {}
    if os.path.isdir(small_dir) and not os.path.samefile(small_dir, sf_dir):
        others[f"queries_{SMALL}"] = timed(spark, small_dir)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                **others,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
