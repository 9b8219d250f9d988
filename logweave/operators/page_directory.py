"""Pages of stored events by a directory of counts.

A page in the order "newest load first, then by id" needs to know how many rows stand before it.  The directory holds, for
every stored file, its rows by minute of the load and by the first two characters of their ids, written with each load.
A page is looked for in it by day, by minute and, in minutes that hold a single load time, by range of ids; of
the stored table only the files of the blocks found are read, and in them, as files are sorted by id, the row groups of the range.

The rows are those of ``search.events_page``.  Files that the directory doesn't know yet are counted for the page, and
entries of files that are gone are ignored, as are entries that an update written twice left behind.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from logweave.operators import search, search_index, store

DIRECTORY_DDL = (
    "file STRING, source_type STRING, minute STRING, ids STRING, first STRING, last STRING, rows BIGINT"
)
_KEYS = ["file", "source_type", "minute", "ids"]
_DAY, _MINUTE, _IDS = 10, 16, 2


def _counts(table: DataFrame) -> DataFrame:
    """Entries of stored rows; only two columns are read."""
    return (
        table.select(
            search_index.plain_path(F.col("_metadata.file_path")).alias("file"), "source_type", "indexed_at",
            F.substring("indexed_at", 1, _MINUTE).alias("minute"), F.substring("event_id", 1, _IDS).alias("ids"),
        )
        .groupBy(*_KEYS)
        .agg(F.min("indexed_at").alias("first"), F.max("indexed_at").alias("last"), F.count(F.lit(1)).alias("rows"))
    )


def _known(spark: SparkSession, directory_path: str) -> DataFrame:
    saved = store.if_there(lambda: spark.read.schema(DIRECTORY_DDL).parquet(directory_path))
    return spark.createDataFrame([], DIRECTORY_DDL) if saved is None else saved.dropDuplicates(_KEYS)


def _parts(spark: SparkSession, path: str, directory_path: str) -> tuple[DataFrame, DataFrame | None, dict[str, str]]:
    """Entries of the stored files, the counts of files without entries, and all files by their plain name."""
    files = search_index.current_files(store.read_events(spark, path))
    held, known = spark.createDataFrame([(f,) for f in files], "file STRING"), _known(spark, directory_path)
    new = [files[r["file"]] for r in held.join(known.select("file"), "file", "left_anti").toLocalIterator()]
    counted = _counts(store.read_events(spark, *new, base=path)) if new else None
    return known.join(held, "file", "left_semi"), counted, files


def update_directory(spark: SparkSession, path: str, directory_path: str) -> None:
    """Count the stored files that the directory doesn't know yet; to be called after a load."""
    _, counted, _ = _parts(spark, path, directory_path)
    if counted is not None:
        counted.write.mode("append").parquet(directory_path)


def _entries(
    spark: SparkSession, path: str, directory_path: str, source_type: str
) -> tuple[DataFrame, dict[str, str]]:
    known, counted, files = _parts(spark, path, directory_path)
    entries = known if counted is None else known.unionByName(counted)
    return (entries.filter(F.col("source_type") == source_type) if source_type else entries), files


def _touched(
    entries: DataFrame, blocks: dict[str, Column], order: list[Column], offset: int, rows: int
) -> tuple[list[Row], int]:
    """Blocks that hold rows ``[offset, offset + rows)``, and the offset in them."""
    counts = entries.groupBy(*[c.alias(n) for n, c in blocks.items()]).agg(
        F.sum("rows").alias("_rows"), F.min("first").alias("_first"), F.max("last").alias("_last")
    )
    found = search.touched_blocks(counts, order, offset, rows)
    return found, offset - min((r["_start"] for r in found), default=0)


def events_page(
    spark: SparkSession,
    path: str,
    directory_path: str,
    page: int = 1,
    per_page: int = search.DEFAULT_PAGE_ROWS,
    source_type: str = "",
) -> DataFrame:
    """``search.events_page`` of the table at ``path``, or of one source of it, by its directory."""
    offset, rows = search.page_limits(page, per_page)
    entries, files = _entries(spark, path, directory_path, source_type)
    day = F.substring("minute", 1, _DAY)
    days, offset = _touched(entries, {"_day": day}, [F.desc("_day")], offset, rows)
    entries = entries.filter(day.isin([r["_day"] for r in days]))
    minutes, offset = _touched(entries, {"_minute": F.col("minute")}, [F.desc("_minute")], offset, rows)
    entries = entries.filter(F.col("minute").isin([r["_minute"] for r in minutes]))
    # Ranges of ids follow each other only where all rows have one load time.
    single = F.col("minute").isin([r["_minute"] for r in minutes if r["_first"] == r["_last"]])
    ids = F.when(single, F.col("ids"))
    blocks, offset = _touched(
        entries, {"_minute": F.col("minute"), "_ids": ids}, [F.desc("_minute"), F.asc("_ids")], offset, rows
    )
    if not blocks:
        return search.listing(store.read_events(spark, path).limit(0))
    within = [
        (F.col("minute") == r["_minute"]) & (F.lit(True) if r["_ids"] is None else F.col("ids") == r["_ids"])
        for r in blocks
    ]
    held = entries.filter(reduce(lambda a, b: a | b, within)).select("file").distinct()
    names = sorted(files[r["file"]] for r in held.toLocalIterator())
    table = store.read_events(spark, *names, base=path).filter(reduce(lambda a, b: a | b, map(_rows_of, blocks)))
    if source_type:
        table = table.filter(F.col("source_type") == source_type)
    return search.page_at(table, offset, rows)


def _rows_of(block: Row) -> Column:
    """Stored rows of a block; the prefixes are what Parquet's statistics are compared with."""
    minute = F.col("indexed_at").startswith(block["_minute"]) & (
        F.substring("indexed_at", 1, _MINUTE) == block["_minute"]
    )
    if block["_ids"] is None:
        return minute
    return minute & F.col("event_id").startswith(block["_ids"]) & (
        F.substring("event_id", 1, _IDS) == block["_ids"]
    )


def page_count(
    spark: SparkSession,
    path: str,
    directory_path: str,
    per_page: int = search.DEFAULT_PAGE_ROWS,
    source_type: str = "",
) -> DataFrame:
    """``search.page_count`` without a look at the stored rows."""
    entries, _ = _entries(spark, path, directory_path, source_type)
    total = entries.agg(F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("total"))
    return search.pages_of(total, per_page)
