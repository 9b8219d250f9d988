"""Shaping: flat fields to the nested event, and the options on original_log."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from logweave.functions.fixed_values import SCHEMA_VERSION
from logweave.functions.ids import content_id
from logweave.schema import EVENT_COLUMNS, event_schema

EVENT_ID = "event_uid"

# Fixed value: layout of a default creation time.
_NOW_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def now_text() -> Column:
    """The current time in UTC, in milliseconds, whatever the session time zone."""
    utc = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    return F.date_format(utc, _NOW_FORMAT)


def parsed_time(created: Column, time_zone: str = "UTC") -> Column:
    """Best-effort TIMESTAMP of a source time; NULL when it cannot be read.

    Times without a zone are those of ``time_zone``, whatever the session's zone.  The cheap shape tests keep unreadable text away from the formatters, which
    would raise and catch an exception per row.
    """
    def local(read: Column) -> Column:
        # Spark reads in the session's zone: back to the clock's time, then out of the given zone.
        clock = F.from_utc_timestamp(read, F.current_timezone())
        return clock if time_zone == "UTC" else F.to_utc_timestamp(clock, time_zone)

    zoned = created.rlike(r":\d{2}.*(Z|[+-]\d{2}:?\d{2})$")
    return (
        F.when(created.like("____-__-__%") & zoned, created.try_cast("timestamp"))
        .when(created.like("____-__-__%"), local(created.try_cast("timestamp")))
        .when(
            created.rlike(r"^\d{4} [A-Z][a-z]{2} \d{2} \d{2}:\d{2}:\d{2}$"),
            local(F.try_to_timestamp(created, F.lit("yyyy MMM dd HH:mm:ss"))),
        )
        .when(
            created.rlike(r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2} [AP]M$"),
            local(F.try_to_timestamp(created, F.lit("M/d/yyyy h:mm:ss a"))),
        )
        .when(created.rlike(r"^\d{10}$"), F.timestamp_seconds(created.try_cast("bigint")))
        .when(created.rlike(r"^\d{13}$"), F.timestamp_millis(created.try_cast("bigint")))
    )


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path in the folder that all of the cluster reaches, ``spark.checkpoint.dir``."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        raise ValueError("set spark.checkpoint.dir to a folder that every executor reaches")
    return f"{shared.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


_METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
_REPEATED_KEYS = "spark.sql.variant.allowDuplicateKeys"


def configure(spark: SparkSession) -> None:
    """Settings of a session that the jobs run better with; call it once, they never change any.

    JSON objects that repeat a key are read with the last of them (without the setting,
    Wazuh alerts that do so are ``failed``).

    Spark splits generated code that the JVM would only interpret.  HotSpot never compiles a method over 8000 bytes of byte code.  A wide projection
    fused into one stage easily exceeds that and then runs many times slower; over
    this limit Spark runs its operators one by one, with their code split into
    small methods.  A limit set by the user stays.
    """
    default = "65535"
    if spark.conf.get(_METHOD_LIMIT, default) == default:
        spark.conf.set(_METHOD_LIMIT, "8000")
    spark.conf.set(_REPEATED_KEYS, "true")


def computed_once(df: DataFrame, keep: list[str], columns: list[str]) -> DataFrame:
    """Fix columns that are to be computed once per row, however they are used later.

    Spark moves a filter below the projections that make its columns and repeats
    their expressions there, over and over for layered ones.  It never moves a
    filter on the output of a generator, so parsed fields pass through one: a
    single struct per row, unfolded into columns.
    """
    kept = [f"`{c}`" for c in keep]
    # The struct is made in a projection, which is compiled; a generator interprets.
    made = df.selectExpr(*kept, f"array(struct({', '.join(columns)})) AS _computed")
    return made.selectExpr(*kept, "inline_outer(_computed)")


def _struct(kind: StructType, prefix: str, leaves: dict[str, str]) -> tuple[str, list[str]]:
    """SQL of a struct by field path, NULL when none of its leaves has a value."""
    parts, below = [], []
    for field in kind.fields:
        path = prefix + field.name
        if isinstance(field.dataType, StructType):
            part, inner = _struct(field.dataType, path + ".", leaves)
            below += inner
        elif path in leaves:
            part = leaves[path]
            below.append(part)
        else:
            part = _null(field.dataType)
        parts.append(f"'{field.name}', {part}")
    if not below:
        return _null(kind), []
    present = " OR ".join(f"{leaf} IS NOT NULL" for leaf in below)
    return f"CASE WHEN {present} THEN named_struct({', '.join(parts)}) END", below


def _null(kind: DataType) -> str:
    return f"CAST(NULL AS {kind.simpleString()})"


def shape_event(
    df: DataFrame,
    source_type: str,
    values: dict[str, Column],
    status: Column,
    error: Column,
    keep: list[str],
    raw: Column,
) -> DataFrame:
    """Nest mapped fields into the event columns and add ``_status`` and ``_error``.

    ``values`` maps field paths such as ``process.parent.pid`` to columns of
    ``df``.  ``keep`` columns are carried along.  ``raw`` feeds the content id
    that stands in when ``df`` has no ``event_uid`` column.
    """
    schema = event_schema()
    values = dict(values)
    if "host.name" in values:
        values["host.hostname"] = values["host.name"]
    if "network.transport" in values:
        values["network.protocol"] = values["network.transport"]
    for path in [p for p in values if p.endswith((".md5", ".sha256"))]:
        values[path] = F.lower(values[path])

    written = values["event.created"]
    values["event.created"] = F.when(written != "", written).otherwise(now_text())
    values["event.created_ts"] = F.when(written != "", parsed_time(written)).otherwise(
        F.current_timestamp()
    )
    values["event.id"] = F.col(EVENT_ID) if EVENT_ID in df.columns else content_id(source_type, raw)
    values["event.source_type"] = F.lit(source_type)
    values["log.source_type"] = F.lit(source_type)
    tool = values.get("log.source_tool", F.lit(""))
    values["log.source_tool"] = F.when(tool != "", tool).otherwise(source_type)
    values.setdefault("event.outcome", F.lit("unknown"))
    values.setdefault("event.severity", F.lit(0))
    values["event.severity"] = values["event.severity"].cast("bigint")
    if "event.original_event_id" in values:
        values["log.original_event_id"] = values["event.original_event_id"]

    kinds = dict(_leaf_types(schema))
    unknown = set(values) - set(kinds)
    if unknown:
        raise ValueError(f"unknown event fields: {sorted(unknown)}")

    # Leaves are columns of their own first, so that the structs only refer to them.
    leaves = {path: f"`_leaf_{path}`" for path in values}
    kept = [f"`{c}`" for c in keep]
    mapped = df.select(
        *kept,
        *[value.alias(f"_leaf_{path}") for path, value in values.items()],
        status.alias("_status"),
        error.alias("_error"),
    )
    filled = mapped.selectExpr(
        *kept,
        *[
            f"nullif({leaf}, '') AS {leaf}" if kinds[path].typeName() == "string" else leaf
            for path, leaf in leaves.items()
        ],
        "_status",
        "_error",
    )
    columns = [f"'{SCHEMA_VERSION}' AS schema_version"]
    for name in EVENT_COLUMNS[1:-1]:
        kind = schema[name].dataType
        if name in ("event", "log"):
            # Always present, hence plain structs that Catalyst can see through.
            parts = [
                f"'{f.name}', {leaves.get(f'{name}.{f.name}', _null(f.dataType))}"
                for f in kind.fields
            ]
            columns.append(f"named_struct({', '.join(parts)}) AS {name}")
        else:
            columns.append(f"{_struct(kind, name + '.', leaves)[0]} AS {name}")
    no_tags = "CAST(array() AS array<string>)"
    columns.append(f"coalesce({leaves.get('tags', no_tags)}, {no_tags}) AS tags")
    return filled.selectExpr(*kept, *columns, "_status", "_error")


def _leaf_types(kind: StructType, prefix: str = ""):
    for field in kind.fields:
        if isinstance(field.dataType, StructType):
            yield from _leaf_types(field.dataType, prefix + field.name + ".")
        else:
            yield prefix + field.name, field.dataType


def kept_columns(df: DataFrame, *dropped: str) -> list[str]:
    """Input columns a job carries along; they must not hide event columns."""
    clash = [c for c in df.columns if c in EVENT_COLUMNS + ["_status", "_error"]]
    if clash:
        raise ValueError(f"input columns would hide event columns: {clash}")
    return [c for c in df.columns if c not in dropped]


def truncated_map(original_log: Column, max_chars: int) -> Column:
    return F.transform_values(
        original_log,
        lambda _, v: F.when(
            F.length(v) > max_chars, F.concat(F.substring(v, 1, max_chars), F.lit("…"))
        ).otherwise(v),
    )


def truncate_original_log(
    events: DataFrame, max_chars: int = 0
) -> DataFrame:
    """Cut the values of log.original_log to so many characters; 0 keeps them whole."""
    if max_chars <= 0:
        return events
    return events.withColumn(
        "log",
        F.col("log").withField(
            "original_log", truncated_map(F.col("log.original_log"), max_chars)
        ),
    )


def drop_original_log(events: DataFrame) -> DataFrame:
    """Events without log.original_log."""
    return events.withColumn("log", F.col("log").dropFields("original_log"))
