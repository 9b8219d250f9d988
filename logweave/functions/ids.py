"""Event ids that survive task retries and repeated runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COPIES_PER_TASK_ROW = 100_000


def uuid_layout(digest: Column) -> Column:
    """The first 128 bits of a hex digest, laid out as a version 4 UUID."""
    # One replacement names the digest once, so that it is computed once.
    return F.regexp_replace(
        digest,
        F.lit("^(.{8})(.{4}).(.{3}).(.{3})(.{12}).*$"),
        F.lit("$1-$2-4$3-8$4-$5"),
    )


def content_id(source_type: str, raw: Column) -> Column:
    """Id of a record by its text alone; equal texts share it."""
    return uuid_layout(F.sha2(F.concat_ws("\u0000", F.lit(source_type), raw), 256))


def with_event_ids(records: DataFrame, id_col: str = "event_uid") -> DataFrame:
    """Give every record an id made of its columns and the number of its copy.

    All columns together make the record, so equal rows are interchangeable
    copies.  They are counted with map-side combining and unfolded again, so a
    record that fills a third of the table is never gathered in one task: up to
    ``_COPIES_PER_TASK_ROW`` copies unfold in place, larger counts are first cut
    into blocks that are spread over the cluster.  No row order is involved, so
    a retried task gives the same ids.
    """
    columns = records.columns
    counted = records.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
    block = F.lit(_COPIES_PER_TASK_ROW)
    few = counted.filter(F.col("_copies") <= block).withColumn("_from", F.lit(0).cast("bigint"))
    many = (
        counted.filter(F.col("_copies") > block)
        .withColumn(
            "_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1, block))
        )
        .repartition("_from", *columns)
    )
    numbered = few.unionByName(many).withColumn(
        "_copy",
        F.explode(
            F.sequence(
                F.col("_from"), F.least(F.col("_from") + block, F.col("_copies")) - F.lit(1)
            )
        ),
    )
    # to_json keeps column borders and NULLs apart, so different rows hash differently.
    identity = F.to_json(F.struct(*columns, "_copy"), {"ignoreNullFields": "false"})
    return numbered.select(*columns, uuid_layout(F.sha2(identity, 256)).alias(id_col))


def with_random_ids(records: DataFrame, id_col: str = "event_uid") -> DataFrame:
    """Random ids.  Cheap, but a retried task draws new ones."""
    return records.withColumn(id_col, F.uuid())
