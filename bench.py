"""Times the headline queries once warm: prints one JSON line.

Beside the tables' queries it times aggregates and ingest over a million generated
rows of 30 days, which is the size of published figures.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmill.operators import aggregate
from logmill.operators.logs import page
from logmill.plans.queries import QUERIES
from logmill.session import session
from logmill.sources import generate, ingest

HEADLINE = ("agg_1m", "agg_1h_by_service", "agg_1d_by_service", "agg_1d_by_level", "aggregate_request", "filter_time_range", "filter_q", "filter_attr", "page_first", "page_next", "page_filtered", "dictionary_lookup", "latency_percentiles", "retention_survivors", "validate_rejects")
ROWS, FIRST = 1_000_000, datetime(2024, 1, 1, tzinfo=UTC)


def warm(run: Callable[[], object]) -> float:
    """Seconds of the second of two runs."""
    for _ in range(2):
        began = time.perf_counter()
        run()
        took = time.perf_counter() - began
    return round(took, 4)


def whole(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    cpus, sf = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    times = {name: warm(lambda name=name: whole(QUERIES[name](spark, sf))) for name in HEADLINE}
    folder = tempfile.mkdtemp(prefix="logmill-bench-")
    try:
        table = f"{folder}/logs"
        ingest.append(generate.generate(spark, ROWS, FIRST, 30).withColumn("day", F.to_date("ts")).select(*ingest.LOGS.names), table)
        logs = ingest.read_logs(spark, table)
        bodies = generate.bodies(generate.generate(spark, 100_000, FIRST, 30), 500).withColumn("path", F.sha2("value", 256))
        bodies.write.parquet(f"{folder}/bodies")
        bodies, batch = spark.read.parquet(f"{folder}/bodies"), iter(range(9))
        million = {
            "agg_30d_1m": warm(lambda: whole(aggregate.counts(logs, "1m"))),
            "agg_30d_1d_by_service": warm(lambda: whole(aggregate.counts(logs, "1d", "service"))),
            "agg_24h_1h_by_level": warm(lambda: whole(aggregate.aggregate(logs, {"since": "2024-01-10T00:00:00Z", "until": "2024-01-11T00:00:00Z", "bucket": "1h", "group_by": "level"}))),
            "page_of_a_day": warm(lambda: page(logs, {"since": "2024-01-10T00:00:00Z", "until": "2024-01-11T00:00:00Z"})),
            "ingest_100k_entries": warm(lambda: ingest.write(spark, bodies, f"{folder}/in", f"{folder}/bad", f"b{next(batch)}", datetime(2024, 3, 1, tzinfo=UTC))),
        }
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/")), "million_rows": million}))


if __name__ == "__main__":
    main()
