"""Seconds per headline query; prints one JSON line.

The raw logs are written to files first, outside the timing: 600k records of every
source at sf0.1, made of ``lineitem``.  A timed query reads files or the stored table,
does its whole work and drops the result.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from logweave import configure  # noqa: E402
from logweave.functions import ids  # noqa: E402
from logweave.operators import dispatch, flat, search, store  # noqa: E402
from logweave.plans import rawlogs  # noqa: E402
from logweave.sources import cef, records, sysmon, syslog, wazuh, wel  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
LINE_SOURCES = {
    "syslog": rawlogs.SYSLOG_SQL,
    "cef": rawlogs.CEF_SQL,
    "json": rawlogs.JSON_SQL,
    "wazuh": rawlogs.WAZUH_SQL,
    "sysmon": rawlogs.SYSMON_SQL,
}


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("logweave-bench")
        .config("spark.sql.shuffle.partitions", str(CPUS))
        .config("spark.sql.files.maxPartitionBytes", str(16 << 20))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # The folder that the cluster shares; on one machine, one of its own.
        .config("spark.checkpoint.dir", os.environ.get("BENCH_SHARED_DIR", "/tmp/logweave-bench"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession, root: str) -> None:
    events = rawlogs.as_events(spark.read.parquet(f"{SF_DIR}/lineitem.parquet"))
    base = rawlogs.base(events).repartition(CPUS).persist()
    for name, sql in LINE_SOURCES.items():
        base.selectExpr(f"{sql} AS value").write.text(f"{root}/{name}")
    base.selectExpr(*[f"{sql} AS {name}" for name, sql in rawlogs.WEL_COLUMNS]).write.csv(
        f"{root}/wel", header=True
    )
    base.selectExpr(
        f"{rawlogs.SYSLOG_SQL} AS raw", "eid AS event_uid",
        f"{rawlogs.SESSION_SQL} AS session_id", "iso",
    ).write.parquet(f"{root}/raw_table")
    base.unpersist()
    load = syslog.normalize_syslog(spark.read.parquet(f"{root}/raw_table"))
    store.write_events(store.stored_rows(load, F.col("iso")), f"{root}/events")


def queries(spark: SparkSession, root: str) -> dict:
    def lines(name: str) -> DataFrame:
        return records.read_lines(spark, f"{root}/{name}")

    def stored() -> DataFrame:
        return store.read_events(spark, f"{root}/events")

    def loaded() -> DataFrame:
        return spark.read.parquet(f"{root}/raw_table")

    return {
        "normalize_syslog": lambda: syslog.normalize_syslog(lines("syslog")),
        "normalize_cef": lambda: cef.normalize_cef(lines("cef")),
        "normalize_json": lambda: cef.normalize_json(lines("json")),
        "normalize_wazuh": lambda: wazuh.normalize_wazuh(lines("wazuh")),
        "normalize_sysmon": lambda: sysmon.normalize_sysmon(
            records.read_sysmon(spark, f"{root}/sysmon")
        ),
        "normalize_wel": lambda: wel.normalize_wel(
            records.read_wel(spark, f"{root}/wel")
        ),
        "normalize_wel_lines": lambda: wel.normalize_wel(
            records.read_wel(spark, f"{root}/wel", multi_line=False)
        ),
        "syslog_by_action": lambda: syslog.normalize_syslog(lines("syslog"))
        .groupBy("event.action", "event.outcome").count(),
        "session_rollup": lambda: store.session_rollup(syslog.normalize_syslog(loaded())),
        "stable_ids": lambda: ids.with_event_ids(lines("syslog")),
        "insert_if_absent": lambda: store.insert_if_absent(
            stored().filter(F.col("severity") > 0), stored()
        ),
        "outcome_counts": lambda: dispatch.outcome_counts(
            wazuh.normalize_wazuh(lines("wazuh")), records.SOURCE_FILE
        ),
        "search_events": lambda: search.listing(
            search.find_events(stored(), source_type="syslog", search="u1%2")
        ),
        "search_count": lambda: search.page_count(search.find_events(stored(), search="root")),
        "events_page": lambda: search.events_page(stored(), page=3),
        "events_deep_page": lambda: search.events_page(stored(), page=5000),
        "export_rows": lambda: flat.export_rows(stored()),
        "export_json": lambda: store.export_json(stored()),
    }


def run(frame: DataFrame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = session()
    configure(spark)
    root = store.scratch_path(spark, "bench")
    prepare(spark, root)
    seconds = {}
    for name, build in queries(spark, root).items():
        times = []
        for _ in range(2):
            start = time.perf_counter()
            run(build())
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    rows = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()
    rate = {
        name: round(rows / s) for name, s in seconds.items() if name.startswith("normalize_")
    }
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "records": rows,
        "records_per_sec": rate,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
