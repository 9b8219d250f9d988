"""Exact deduplication as a stateful stream.

A streaming aggregation keeps, for each digest of a normalised text, how many rows had it, the
smallest ``doc_id`` and where that row's content lies (file and row).  The state is keyed, lives on disk
(RocksDB, snapshots in the shared folder) and has no watermark, so it never expires: a later run over
new files with the same state folder finds the copies of all earlier ones.  Rows that hit a
digest that is there already are then compared with the kept row byte by byte.

Everything is built-in expressions; no Python runs on the executors.

* Texts are equal when identical after each ``[\\x20\\x09-\\x0D]+`` became one space; null is the empty text.
* Of equal texts the row with the smallest ``doc_id`` stays; a null id counts as larger than all others.
* Repeated rows (same id, same text) are rows of their own: ``group_size`` counts them, and each is
  returned; ``kept`` is true for all rows that carry the kept id and text.
* If two texts share a digest but not their bytes, the rows unlike the kept one form groups of their own.
* An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import common

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "400",
    # Hundreds of stores may share an executor's disk: none reserves space ahead, and each is closed after its commit.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
#: Stands for a null id, so that it loses against every other one.
NO_ID = (1 << 63) - 1


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), common.GAP, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _id(doc_id: Column) -> Column:
    return F.coalesce(doc_id, F.lit(NO_ID))


def update_state(
    stream: DataFrame, state: str, changes: str, digest: Callable[[Column], Column] = sha256
) -> None:
    """Runs the stream over all files not seen before.

    ``state`` is the checkpoint with the keyed state, ``changes`` gets the changed keys of every
    micro-batch as Parquet; a batch that is run again overwrites its own folder.
    """
    spark = stream.sparkSession
    kept = F.struct(
        _id(F.col("doc_id")).alias("doc_id"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )
    keyed = (
        stream.select(digest(normalised(F.col("text"))).alias("digest"), kept.alias("at"))
        .groupBy("digest")
        .agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("group_size"))
    )
    before = {key: spark.conf.get(key, None) for key in STATE_STORE}
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)
    try:
        query = (
            keyed.writeStream.outputMode("update")
            .option("checkpointLocation", state)
            .trigger(availableNow=True)
            .foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{changes}/batch={n}"))
            .start()
        )
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


CHANGES = ("digest string, at struct<doc_id: bigint, file: string, row: bigint>, "
           "group_size bigint, batch bigint")


def read_state(spark: SparkSession, changes: str) -> DataFrame:
    """digest, keep_id, file, row, group_size: the newest change of each key.

    Counts only grow and the kept id only falls, so the newest values are the extremes.
    """
    return (
        spark.read.schema(CHANGES).parquet(changes)
        .groupBy("digest")
        .agg(F.min("at").alias("at"), F.max("group_size").alias("group_size"))
        .select("digest", F.col("at.doc_id").alias("keep_id"), F.col("at.file").alias("file"),
                F.col("at.row").alias("row"), "group_size")
    )


def decisions(
    documents: DataFrame, state: DataFrame, digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest of every row, after the check of bytes.

    Only ids and digests are joined with the state.  Texts move only for the check: rows of
    groups of two or more, each beside its group's kept text; a group with a third of all rows is a
    skewed join that Spark splits.
    """
    text = normalised(F.col("text"))
    rows = common.written(
        documents.select(_id(F.col("doc_id")).alias("doc_id"), digest(text).alias("digest"))
        .join(state.select("digest", "keep_id", "group_size"), "digest"),
        "dedup-rows",
    )
    hits = rows.filter("group_size > 1").select("doc_id", "digest", "keep_id")
    texts = documents.select(
        _id(F.col("doc_id")).alias("doc_id"), text.alias("content"), digest(text).alias("digest")
    )
    wanted = common.written(hits.select("doc_id").distinct(), "dedup-hits")
    of_hits = common.written_matches(texts, wanted, ["doc_id"], "dedup-texts")
    # Where an id stands on several texts of one digest, the smallest text is the kept one.
    keepers = common.written(
        of_hits.join(hits.filter("doc_id = keep_id").distinct(), ["doc_id", "digest"])
        .groupBy("digest").agg(F.min("content").alias("keep_content")),
        "dedup-kept",
    )
    unlike = common.written(
        of_hits.join(keepers, "digest").filter("content <> keep_content")
        .select("doc_id", "digest", "content"),
        "dedup-unlike",
    )
    own = unlike.groupBy("digest", "content").agg(
        F.min("doc_id").alias("own_keep"), F.count(F.lit(1)).alias("own_size")
    )
    moved = unlike.join(own, ["digest", "content"]).groupBy("doc_id", "digest", "own_keep", "own_size").agg(
        F.count(F.lit(1)).alias("own_rows")
    )
    lost = unlike.groupBy("digest").agg(F.count(F.lit(1)).alias("lost"))
    if unlike.isEmpty():
        judged = rows
    else:
        judged = _split(rows, moved, lost)
    shown = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return judged.select(
        shown("doc_id"), shown("keep_id"), "group_size",
        (F.col("doc_id") == F.col("keep_id")).alias("kept"), "digest",
    )


def _split(rows: DataFrame, moved: DataFrame, lost: DataFrame) -> DataFrame:
    """Rows whose bytes differ from the kept text's go to groups of their own.

    Equal pairs of id and digest are told apart by count: so many of them move as have differing texts.
    """
    counted = rows.groupBy("doc_id", "digest", "keep_id", "group_size").agg(F.count(F.lit(1)).alias("n"))
    gone = moved.groupBy("doc_id", "digest").agg(F.sum("own_rows").alias("gone"))
    stay = (
        counted.join(lost, "digest", "left").join(gone, ["doc_id", "digest"], "left")
        .select(
            "doc_id", "digest", "keep_id",
            (F.col("group_size") - F.coalesce("lost", F.lit(0))).alias("group_size"),
            (F.col("n") - F.coalesce("gone", F.lit(0))).alias("n"),
        )
    )
    leave = moved.select(
        "doc_id", "digest", F.col("own_keep").alias("keep_id"),
        F.col("own_size").alias("group_size"), F.col("own_rows").alias("n"),
    )
    return (
        stay.unionByName(leave).filter("n > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
        .drop("n", "copy")
    )


def exact_dedup(
    spark: SparkSession, path: str, state: str | None = None, digest: Callable[[Column], Column] = sha256,
    files_per_batch: int | None = None,
) -> DataFrame:
    """Decisions on all rows of the Parquet table at ``path``, whose new files update ``state``."""
    documents = spark.read.parquet(path)
    stream = spark.readStream.schema(documents.schema)
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    state = state or common.shared_folder(spark, "dedup-state")
    # A pattern of its last character: the stream then takes a single file as well as a folder.
    update_state(stream.parquet(f"{path[:-1]}[{path[-1]}]"), f"{state}/checkpoint", f"{state}/changes", digest)
    return decisions(documents, read_state(spark, f"{state}/changes"), digest)
