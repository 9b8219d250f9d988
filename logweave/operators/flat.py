"""Flat views of events: table row, export row, listing, display rules, long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.fixed_values import SEVERITY_BAND_DEFAULT, SEVERITY_BANDS
from logweave.functions.text import empty_strings, null_to_blank
from logweave.schema import EVENT_COLUMNS, FIELD_CATALOG, field_catalog, source_catalog

# Columns of the flat event row, as stored and listed.
LISTING_COLUMNS = [
    "event_id", "source_type", "created_at", "category", "event_action", "severity",
    "host_name", "process_name", "user_name", "src_ip", "dst_ip", "session_id", "indexed_at",
]
SEARCHED_COLUMNS = [
    "event_action", "host_name", "process_name", "user_name", "src_ip", "dst_ip",
]


def event_json(options: dict | None = None) -> Column:
    """The event as JSON without empty keys; our parsed time is not part of it."""
    parts = [
        F.col("event").dropFields("created_ts").alias("event") if c == "event" else F.col(c)
        for c in EVENT_COLUMNS
    ]
    return F.to_json(F.struct(*parts), options or {})


def flat_columns() -> list[Column]:
    """The flat copies of event fields that are listed and searched."""
    return [
        F.col("event.id").alias("event_id"),
        null_to_blank(F.col("event.created")).alias("created_at"),
        F.to_json(F.coalesce("event.category", empty_strings())).alias("category"),
        null_to_blank(F.col("event.action")).alias("event_action"),
        F.coalesce("event.severity", F.lit(0)).cast("bigint").alias("severity"),
        null_to_blank(F.col("host.name")).alias("host_name"),
        null_to_blank(F.col("process.name")).alias("process_name"),
        null_to_blank(F.col("user.name")).alias("user_name"),
        null_to_blank(F.col("network.source.ip")).alias("src_ip"),
        null_to_blank(F.col("network.destination.ip")).alias("dst_ip"),
    ]


def flat_events(
    events: DataFrame, session_id: Column, indexed_at: Column, source_type: Column | None = None
) -> DataFrame:
    """The 14-column row of every event, the event itself as JSON among them."""
    source = F.col("event.source_type") if source_type is None else source_type
    return events.select(
        *flat_columns(),
        session_id.alias("session_id"),
        source.alias("source_type"),
        event_json().alias("ecs_json"),
        indexed_at.alias("indexed_at"),
    )


def export_rows(events: DataFrame) -> DataFrame:
    """The 15 columns of a CSV export; lists joined by ``|``, no port left blank."""
    return events.select(
        F.col("event.id").alias("event_id"),
        null_to_blank(F.col("event.created")).alias("created"),
        F.col("event.source_type").alias("source_type"),
        F.array_join(F.coalesce("event.category", empty_strings()), "|").alias("category"),
        null_to_blank(F.col("event.action")).alias("action"),
        null_to_blank(F.col("event.outcome")).alias("outcome"),
        F.coalesce("event.severity", F.lit(0)).cast("bigint").alias("severity"),
        null_to_blank(F.col("host.name")).alias("host_name"),
        null_to_blank(F.col("user.name")).alias("user_name"),
        null_to_blank(F.col("process.name")).alias("process_name"),
        null_to_blank(F.col("process.command_line")).alias("process_cmdline"),
        null_to_blank(F.col("network.source.ip")).alias("src_ip"),
        null_to_blank(F.col("network.destination.ip")).alias("dst_ip"),
        null_to_blank(F.col("network.destination.port").cast("string")).alias("dst_port"),
        F.array_join("tags", "|").alias("tags"),
    )


def severity_band(severity: Column) -> Column:
    result = None
    for floor, name in SEVERITY_BANDS:
        test = severity >= floor
        result = F.when(test, name) if result is None else result.when(test, name)
    return result.otherwise(SEVERITY_BAND_DEFAULT)


def principal(process_name: Column, user_name: Column, src_ip: Column) -> Column:
    """Who acted: the process, else the account, else the source address."""
    first = [F.when(c != "", c) for c in (process_name, user_name, src_ip)]
    return F.coalesce(*first, F.lit(""))


def display_time(created: Column) -> Column:
    """The time with its first ``T`` made a blank and its first ``Z`` removed."""
    spaced = F.regexp_replace(created, F.lit("(?s)^([^T]*)T"), F.lit("$1 "))
    return F.regexp_replace(spaced, F.lit("(?s)^([^Z]*)Z"), F.lit("$1"))


# Section | shown name | field path
DETAIL_FIELDS = [
    tuple(cell.strip() for cell in line.split("|"))
    for line in """
Event    | event.id             | event.id
Event    | event.created        | event.created
Event    | event.source_type    | event.source_type
Event    | event.category       | event.category
Event    | event.type           | event.type
Event    | event.action         | event.action
Event    | event.outcome        | event.outcome
Event    | event.severity       | event.severity
Event    | event.original_id    | event.original_event_id
Host     | host.name            | host.name
Host     | host.ip              | host.ip
Host     | host.os.type         | host.os.type
Host     | host.os.name         | host.os.name
Process  | process.pid          | process.pid
Process  | process.ppid         | process.ppid
Process  | process.name         | process.name
Process  | process.executable   | process.executable
Process  | process.command_line | process.command_line
Process  | process.hash.md5     | process.hash.md5
Process  | process.hash.sha256  | process.hash.sha256
Process  | parent.pid           | process.parent.pid
Process  | parent.name          | process.parent.name
Process  | parent.executable    | process.parent.executable
Process  | parent.command_line  | process.parent.command_line
Network  | network.direction    | network.direction
Network  | network.transport    | network.transport
Network  | network.src.ip       | network.source.ip
Network  | network.src.port     | network.source.port
Network  | network.dst.ip       | network.destination.ip
Network  | network.dst.port     | network.destination.port
Network  | network.dst.domain   | network.destination.domain
File     | file.path            | file.path
File     | file.name            | file.name
File     | file.extension       | file.extension
File     | file.hash.md5        | file.hash.md5
File     | file.hash.sha256     | file.hash.sha256
File     | file.size            | file.size
Registry | registry.path        | registry.path
Registry | registry.key         | registry.key
Registry | registry.value.name  | registry.value.name
Registry | registry.value.type  | registry.value.type
Registry | registry.value.data  | registry.value.data
User     | user.name            | user.name
User     | user.domain          | user.domain
User     | user.id              | user.id
Tags     | tags                 | tags
""".strip().splitlines()
]
_LIST_FIELDS = ("event.category", "event.type", "host.ip")


def event_long(events: DataFrame, *keys: str) -> DataFrame:
    """One row per filled field: section, field and value as text, empties left out."""

    def shown(path: str) -> Column:
        if path == "tags":
            return F.when(F.size("tags") > 0, F.array_join("tags", "  "))
        if path in _LIST_FIELDS:
            return F.array_join(F.col(path), ", ")
        return F.col(path).cast("string")

    pairs = [
        F.struct(
            F.lit(section).alias("section"), F.lit(name).alias("field"), shown(path).alias("value")
        )
        for section, name, path in DETAIL_FIELDS
    ]
    return (
        events.select(*keys, F.inline(F.array(*pairs)))
        .filter(F.col("value") != "")
    )


def fields_in_use(events: DataFrame) -> DataFrame:
    """The field catalog with the number of events that fill each field."""
    paths = [path for path, *_ in FIELD_CATALOG]
    counts = events.agg(*[F.count(F.col(path)).alias(path) for path in paths])
    pairs = [
        F.struct(F.lit(path).alias("path"), F.col(f"`{path}`").alias("events")) for path in paths
    ]
    used = counts.select(F.inline(F.array(*pairs)))
    # Both sides have one row per documented field.
    return F.broadcast(field_catalog(events.sparkSession)).join(used, "path")


def sources_in_use(events: DataFrame) -> DataFrame:
    """The source catalog with the number of events of each source, 0 without any."""
    counts = events.groupBy(F.col("event.source_type").alias("source_type")).agg(
        F.count(F.lit(1)).alias("records")
    )
    return (
        source_catalog(events.sparkSession)
        .join(counts, "source_type", "left")
        .withColumn("records", F.coalesce("records", F.lit(0).cast("bigint")))
    )
