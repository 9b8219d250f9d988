"""Events and sessions as Parquet tables: loading, clearing, exporting."""

from __future__ import annotations

import logging
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.storagelevel import StorageLevel

from logweave.functions.shape import now_text, scratch_path
from logweave.operators import flat
from logweave.schema import EVENT_COLUMNS, event_schema

_log = logging.getLogger(__name__)

SESSION_DDL = """
session_id STRING, source_type STRING, filename STRING, created_at STRING,
total_events BIGINT, failed_count BIGINT
"""

# Rows of one file; keeps files near the size of a Parquet row group.
_ROWS_PER_FILE = 2_000_000


def stored_schema() -> StructType:
    """Flat columns for listing and searching, then the nested event."""
    flat_part = StructType.fromDDL(
        "event_id STRING, session_id STRING, created_at STRING, category STRING, "
        "event_action STRING, severity BIGINT, host_name STRING, process_name STRING, "
        "user_name STRING, src_ip STRING, dst_ip STRING, indexed_at STRING"
    )
    return StructType(
        flat_part.fields + event_schema().fields + StructType.fromDDL("source_type STRING").fields
    )


# Rows of a load that one task of a bucketed insert sorts; a larger load has several tasks to a bucket.
_ROWS_PER_TASK = 250_000

# The partition column of a staged table.
SOURCE_KEY = "_source_key"

# What the table is partitioned by: the source, and the day of the load.
_PARTITIONS = ("source_type", "load_date")
# Point lookups skip files by these filters; ids are sorted within files besides.
_ID_FILTER = {
    "parquet.bloom.filter.enabled#event_id": "true",
    "parquet.bloom.filter.expected.ndv#event_id": str(_ROWS_PER_FILE),
}


def stored_rows(
    events: DataFrame, indexed_at: Column | None = None, session_id: str = "session_id"
) -> DataFrame:
    """Good events in the layout of the stored table."""
    ready = events.filter(F.col("_status") == "ok").select(
        *flat.flat_columns(),
        F.col(session_id).alias("session_id"),
        (now_text() if indexed_at is None else indexed_at).alias("indexed_at"),
        *EVENT_COLUMNS,
        F.col("event.source_type").alias("source_type"),
    )
    return ready.select(*stored_schema().names)


# ---- sessions -----------------------------------------------------------------


def session_rollup(
    events: DataFrame,
    session_id: str = "session_id",
    source_type: Column | None = None,
    filename: Column | None = None,
    created_at: Column | None = None,
) -> DataFrame:
    """One row per load with its totals; a load without any event leaves no row."""
    source = F.col("event.source_type") if source_type is None else source_type
    file = F.lit("") if filename is None else filename
    return (
        events.groupBy(F.col(session_id).alias("session_id"))
        .agg(
            F.min(source).alias("source_type"),
            F.min(file).alias("filename"),
            F.min(now_text() if created_at is None else created_at).alias("created_at"),
            F.count_if(F.col("_status") == "ok").alias("total_events"),
            F.count_if(F.col("_status") == "failed").alias("failed_count"),
        )
        .filter(F.col("total_events") > 0)
    )


def session_totals(sessions: DataFrame) -> DataFrame:
    """Success, failed and total of every session."""
    return sessions.select(
        "session_id",
        F.col("total_events").alias("success"),
        F.col("failed_count").alias("failed"),
        (F.col("total_events") + F.col("failed_count")).alias("total"),
    )


def upsert_sessions(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Sessions after an upsert: a known session takes over the two totals only."""
    both = existing.withColumn("_round", F.lit(0)).unionByName(
        incoming.withColumn("_round", F.lit(1))
    )
    return _resolved(both, "_round")


def _resolved(rows: DataFrame, round_col: str) -> DataFrame:
    """One row per session: its totals from the last round, the rest from the first."""
    first = F.struct("source_type", "filename", "created_at")
    last = F.struct("total_events", "failed_count")
    return (
        rows.groupBy("session_id")
        .agg(
            F.min_by(first, round_col).alias("_first"), F.max_by(last, round_col).alias("_last")
        )
        .select("session_id", "_first.*", "_last.*")
    )


# ---- writing ------------------------------------------------------------------


def stage_by_source(raw: DataFrame, path: str, source_col: str = "source_type") -> DataFrame:
    """Write a mixed raw table partitioned by source and read it back, with ``SOURCE_KEY``.

    One pass over the input; afterwards every branch of ``normalize_mixed``
    reads its own partition and no other.
    """
    keyed = raw.withColumn(SOURCE_KEY, F.lower(source_col))
    keyed.write.mode("overwrite").option(
        "maxRecordsPerFile", _ROWS_PER_FILE
    ).partitionBy(SOURCE_KEY).parquet(path)
    return raw.sparkSession.read.schema(keyed.schema).parquet(path)


def read_events(spark: SparkSession, *paths: str, base: str | None = None) -> DataFrame:
    """The stored events with ``load_date``; an empty table reads as one without rows.

    ``paths`` may be some files of the table at ``base``.
    """
    schema = StructType(stored_schema().fields + StructType.fromDDL("load_date STRING").fields)
    reader = spark.read.schema(schema)
    return (reader if base is None else reader.option("basePath", base)).parquet(*paths)


def write_events(
    rows: DataFrame, path: str, mode: str = "append", by_time: bool = False, **options
) -> None:
    """Append stored rows, partitioned by source and day of the load.

    Tasks write what they hold, sorted by id, so a source with most of the rows needs no
    shuffle and lands in no single task.  ``by_time`` deals the rows out by ranges of the event's own time, whose bounds
    Spark samples, and sorts by it: a search of some hours then skips what lies outside of them
    (``search.find_events`` with ``since`` and ``until``).
    """
    dated = rows.withColumn("load_date", F.substring("indexed_at", 1, 10))
    order = [*_PARTITIONS, F.col("event.created_ts" if by_time else "event_id")]
    dealt = dated.repartitionByRange(*order) if by_time else dated
    dealt.sortWithinPartitions(*order).write.mode(mode).partitionBy(
        *_PARTITIONS
    ).options(maxRecordsPerFile=_ROWS_PER_FILE, **_ID_FILTER, **options).parquet(path)


def insert_if_absent(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows, one per new id.

    Equal ids mean equal events.  Copies collapse before the shuffle, so an id
    that fills much of the load stays small, and the anti join then reuses the
    partitioning by id.  Of the stored events only the ids are read; a filter on
    ``load_date`` of ``existing`` prunes them to the days on which the load can have been stored before.
    """
    return incoming.dropDuplicates(["event_id"]).join(
        existing.select("event_id"), "event_id", "left_anti"
    )


def insert_bucketed(rows: DataFrame, name: str, buckets: int = 64, path: str | None = None) -> DataFrame:
    """Append stored rows whose id is new to a catalog table bucketed by id, and return the rows' plan before the write.

    The table's files are dealt by a hash of the id already, so finding the new rows shuffles the load alone, once, and
    nothing of what is stored; each load adds a file to a bucket and partition at most.  Ids sort within files, so the join merges.

    The load is written to the shared folder first.  One of more than ``_ROWS_PER_TASK`` rows a bucket is dealt to several tasks a
    bucket, each of which adds a file: what a task sorts stays bounded.  The hash modulo a multiple of the buckets tells the bucket
    too, so a task holds rows of one.  Of what is stored, the column of ids is then shuffled as well.
    """
    spark = rows.sparkSession
    folder = scratch_path(spark, "load")
    load = rows.withColumn("load_date", F.substring("indexed_at", 1, 10))
    load.write.parquet(folder)
    dated = spark.read.schema(load.schema).parquet(folder)
    tasks = buckets * max(1, -(-dated.count() // (buckets * _ROWS_PER_TASK)))
    new = dated.repartition(tasks, "event_id").dropDuplicates(["event_id"])
    if spark.catalog.tableExists(name):
        new = new.join(spark.table(name).select("event_id").hint("merge"), "event_id", "left_anti").select(dated.columns)
    writer = new.write.mode("append").format("parquet").partitionBy(*_PARTITIONS).bucketBy(
        buckets, "event_id").sortBy("event_id").options(
            **_ID_FILTER | {"parquet.bloom.filter.expected.ndv#event_id": str(_ROWS_PER_TASK)})
    (writer if path is None else writer.option("path", path)).saveAsTable(name)
    return new


def save_events(
    events: DataFrame,
    path: str,
    session_id: str = "session_id",
    save: bool = True,
    auto_save: bool = True,
    fallback_path: str | None = None,
    indexed_at: Column | None = None,
    load_dates: list[str] | None = None,
) -> bool:
    """Insert good events whose id is not stored yet; True when they were stored.

    ``load_dates`` names the days of earlier loads that may hold the same events (a retried
    load: today and yesterday); None compares with all days.

    The load is computed once, before anything is written, so an error in it is raised.  When
    the table cannot be written, the load goes to ``fallback_path`` as JSON.
    """
    if not (save and auto_save):
        return False
    spark = events.sparkSession
    held = events.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        held.count()
        rows = stored_rows(held, indexed_at, session_id)
        try:
            stored = _stored_before(spark, path)
            if stored is None:
                rows = rows.dropDuplicates(["event_id"])
            else:
                if load_dates is not None:
                    stored = stored.filter(F.col("load_date").isin(load_dates))
                rows = insert_if_absent(stored, rows).select(*stored_schema().names)
            write_events(rows, path)
            return True
        except (PySparkException, Py4JError):
            if fallback_path is None:
                raise
            _log.warning("storing failed, the load goes to %s", fallback_path, exc_info=True)
            fallback(held, fallback_path, session_id)
            return False
    finally:
        held.unpersist()


def _stored_before(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored events, None before the first load."""
    return if_there(lambda: read_events(spark, path))


def if_there(read: Callable[[], DataFrame]) -> DataFrame | None:
    try:
        found = read()
        found.schema  # noqa: B018  a path is looked up no later than here
        return found
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def fallback(events: DataFrame, path: str, session_id: str = "session_id") -> None:
    """Whole load as JSON lines: session, source, time, event, and failed records too."""
    events.select(
        F.col(session_id).alias("session_id"),
        F.col("event.source_type").alias("source_type"),
        now_text().alias("saved_at"),
        F.when(F.col("_status") == "ok", flat.event_json()).alias("event"),
        "_status",
        "_error",
    ).write.mode("append").json(path)


def dead_letters(events: DataFrame, *carried: str) -> DataFrame:
    """Records that gave no event, with the reason."""
    return events.filter(F.col("_status") != "ok").select(*carried, "_status", "_error")


def write_dead_letters(events: DataFrame, path: str, *carried: str) -> None:
    dead_letters(events, *carried).write.mode("append").json(path)


_SAVED_DDL = SESSION_DDL + ", saved_at STRING, save_number BIGINT"


def save_sessions(incoming: DataFrame, path: str) -> None:
    """Append sessions; :func:`current_sessions` resolves those saved again, by the number of the save."""
    spark = incoming.sparkSession
    saved = if_there(lambda: spark.read.schema(_SAVED_DDL).parquet(path))
    last = 0 if saved is None else saved.agg(F.max("save_number")).first()[0] or 0
    incoming.withColumn("saved_at", now_text()).withColumn(
        "save_number", F.lit(last + 1).cast("bigint")
    ).write.mode("append").parquet(path)


def current_sessions(spark: SparkSession, path: str) -> DataFrame:
    """The sessions after every upsert so far."""
    saved = if_there(lambda: spark.read.schema(_SAVED_DDL).parquet(path))
    if saved is None:
        return spark.createDataFrame([], SESSION_DDL)
    order = F.struct("save_number", "saved_at", "total_events", "failed_count")
    return _resolved(saved.withColumn("_order", order), "_order")


def clear_session(spark: SparkSession, path: str, session_id: str) -> int:
    """Remove the events of one session and return how many there were.

    Only files that hold the session are rewritten; files of other loads stay, even of the same source and day.  The
    rows that such files keep are appended before the files go, so a failure in between loses nothing, but leaves rows twice.
    """
    table = read_events(spark, path)
    mine = F.coalesce(F.col("session_id") == session_id, F.lit(False))
    file = F.col("_metadata.file_path")
    # A row per file that holds the session, with what its partition (a source's loads of a day) keeps.
    counts = (
        table.groupBy(*_PARTITIONS, file.alias("file"))
        .agg(F.count_if(mine).alias("mine"), F.count_if(~mine).alias("others"))
        .withColumn("kept", F.sum("others").over(Window.partitionBy(*_PARTITIONS)))
        .filter("mine > 0")
        .collect()
    )
    mixed = [r["file"] for r in counts if r["others"]]
    if mixed:
        write_events(table.filter(file.isin(mixed) & ~mine), path)
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files = [(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(r["file"])), r["kept"]) for r in counts]
    for name, kept in files:
        if kept:
            name.getFileSystem(conf).delete(name, False)
    # A partition without rows keeps a file, so that the table stays one.
    columns = StructType([f for f in stored_schema().fields if f.name != "source_type"])
    for folder in {name.getParent().toString() for name, kept in files if not kept}:
        spark.createDataFrame([], columns).write.mode("overwrite").parquet(folder)
    spark.catalog.refreshByPath(path)
    return sum(r["mine"] for r in counts)


def clear_all(spark: SparkSession, path: str, sessions_path: str | None = None) -> int:
    """Empty the events and sessions; the number of events there were."""
    count = read_events(spark, path).count()
    spark.createDataFrame([], stored_schema()).write.mode("overwrite").parquet(path)
    if sessions_path is not None:
        no_sessions = spark.createDataFrame([], _SAVED_DDL)
        no_sessions.write.mode("overwrite").parquet(sessions_path)
    return count


# ---- exports ------------------------------------------------------------------


def export_json(events: DataFrame, pretty: bool = False) -> DataFrame:
    """One JSON text per event without empty keys; ``pretty`` breaks it into lines."""
    options = {"pretty": "true"} if pretty else {}
    return events.select(flat.event_json(options).alias("value"))


def write_json(events: DataFrame, path: str, pretty: bool = False) -> None:
    export_json(events, pretty).write.mode("overwrite").text(path)


def write_csv(events: DataFrame, path: str) -> None:
    """The export rows as CSV with a header, quotes doubled."""
    flat.export_rows(events).write.mode("overwrite").csv(
        path, header=True, escape='"', emptyValue="", nullValue=""
    )
