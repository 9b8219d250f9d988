"""Reading logs as streams and storing their events batch by batch.

The jobs are stateless, so they run on a stream as they are, with content ids.
Storing numbers equal records inside a micro-batch: a file arrives whole in one
batch, so its ids are those a batch load would give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logweave.functions.shape import now_text
from logweave.functions.text import strip
from logweave.operators import dispatch, store
from logweave.sources.records import SOURCE_FILE, fragments


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the files that arrive in a folder."""
    lines = spark.readStream.text(path).select(
        F.make_valid_utf8("value").alias("raw"),
        F.col("_metadata.file_path").alias(SOURCE_FILE),
    )
    return lines.filter(strip(F.col("raw")) != "")


def stream_sysmon(spark: SparkSession, path: str) -> DataFrame:
    """``<Event>`` elements of the XML files that arrive in a folder."""
    pieces = spark.readStream.option("lineSep", "</Event>").text(path)
    return fragments(
        pieces.select(
            F.make_valid_utf8("value").alias("raw"),
            F.col("_metadata.file_path").alias(SOURCE_FILE),
        )
    )


def normalize_stream(
    lines: DataFrame, source_type: str, documents: bool = False, **options
) -> DataFrame:
    """Events of a stream of records."""
    return dispatch.normalize(
        lines, source_type, documents=documents, id_mode="content", **options
    )


def without_repeats(events: DataFrame, horizon: str = "1 hour") -> DataFrame:
    """Drop events whose id was loaded within the horizon, from the same file and session.

    Equal lines of different files or sessions are events of their own.  The watermark is on the load time, since the event's own time may be missing
    or lack its year.
    """
    origin = [c for c in (SOURCE_FILE, "session_id") if c in events.columns]
    return (
        events.withColumn("event_id", F.col("event.id"))
        .withColumn("loaded_at", F.current_timestamp())
        .withWatermark("loaded_at", horizon)
        .dropDuplicatesWithinWatermark(["event_id", *origin])
        .drop("event_id")
    )


def store_sessions(
    lines: DataFrame,
    source_type: str,
    sessions_path: str,
    checkpoint: str,
    session_id: str = SOURCE_FILE,
    available_now: bool = True,
    **options,
) -> StreamingQuery:
    """Running totals of every session, saved with each micro-batch that changes them.

    Spark's state store holds a row per session, so a session that arrives in many batches, or before and after a
    restart, has the totals of all its records.  A repeated batch saves the same totals again.
    """
    events = normalize_stream(lines, source_type, **options)
    # The time of a batch is no constant to a stream, so it is a column before it is aggregated.
    timed = events.withColumn("_saved", now_text())
    writer = (
        store.session_rollup(timed, session_id, created_at=F.col("_saved")).writeStream.outputMode("update")
        .foreachBatch(lambda totals, number: store.save_sessions(totals, sessions_path))
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


class StoredStream:
    """The queries of :func:`store_stream`: one stores events, one the sessions' totals."""

    def __init__(self, events: StreamingQuery, sessions: StreamingQuery):
        self.events, self.sessions = events, sessions

    def awaitTermination(self) -> None:  # noqa: N802  named like that of one query
        for query in (self.events, self.sessions):
            query.awaitTermination()

    def processAllAvailable(self) -> None:  # noqa: N802
        for query in (self.events, self.sessions):
            query.processAllAvailable()

    def stop(self) -> None:
        for query in (self.events, self.sessions):
            query.stop()


def store_stream(
    lines: DataFrame,
    source_type: str,
    events_path: str,
    sessions_path: str,
    checkpoint: str,
    session_id: str = SOURCE_FILE,
    dead_letter_path: str | None = None,
    available_now: bool = True,
    load_dates: list[str] | None = None,
    **options,
) -> StoredStream:
    """Normalize and store every micro-batch of records, and the sessions' totals; a session is a file by default.

    A repeated batch inserts nothing twice, as its ids are stored already.  ``load_dates`` is that
    of ``store.save_events``: the days whose stored ids a batch is compared with.
    """

    def save(batch: DataFrame, number: int) -> None:
        held = dispatch.normalize(batch, source_type, documents=False, **options).persist()
        try:
            store.save_events(held, events_path, session_id, load_dates=load_dates)
            if dead_letter_path is not None:
                bad = store.dead_letters(held, "raw", session_id)
                bad.write.mode("overwrite").json(f"{dead_letter_path}/batch={number}")
        finally:
            held.unpersist()

    writer = lines.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return StoredStream(writer.start(), store_sessions(
        lines, source_type, sessions_path, f"{checkpoint.rstrip('/')}-sessions", session_id, available_now, **options))
