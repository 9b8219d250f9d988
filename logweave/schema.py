"""The event schema and the catalogs describing its fields and its sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from logweave.functions.fixed_values import SCHEMA_VERSION

__all__ = [
    "EVENT_COLUMNS",
    "EVENT_DDL",
    "FIELD_CATALOG",
    "SCHEMA_VERSION",
    "SOURCE_CATALOG",
    "event_schema",
    "field_catalog",
    "source_catalog",
]

EVENT_DDL = """
schema_version STRING,
event STRUCT<id: STRING, created: STRING, created_ts: TIMESTAMP, outcome: STRING,
             severity: BIGINT, source_type: STRING, category: ARRAY<STRING>,
             type: ARRAY<STRING>, action: STRING, original_event_id: STRING>,
host STRUCT<name: STRING, hostname: STRING, ip: ARRAY<STRING>,
            os: STRUCT<type: STRING, name: STRING>>,
process STRUCT<pid: BIGINT, ppid: BIGINT, name: STRING, executable: STRING,
               command_line: STRING, hash: STRUCT<md5: STRING, sha256: STRING>,
               parent: STRUCT<pid: BIGINT, name: STRING, executable: STRING,
                              command_line: STRING>>,
network STRUCT<direction: STRING, transport: STRING, protocol: STRING,
               destination: STRUCT<ip: STRING, port: BIGINT, domain: STRING>,
               source: STRUCT<ip: STRING, port: BIGINT>>,
file STRUCT<path: STRING, name: STRING, extension: STRING,
            hash: STRUCT<md5: STRING, sha256: STRING>, size: BIGINT>,
registry STRUCT<path: STRING, key: STRING,
                value: STRUCT<name: STRING, type: STRING, data: STRING>>,
user STRUCT<name: STRING, domain: STRING, id: STRING>,
log STRUCT<source_type: STRING, source_tool: STRING, original_event_id: STRING,
           original_log: MAP<STRING, STRING>>,
tags ARRAY<STRING>
"""

# Field path | type | required | what it holds
_FIELDS = """
schema_version              | string  | yes | version of this schema
tags                        | array   | yes | labels such as technique ids
event.id                    | string  | yes | identifier of the event
event.created               | ISO8601 | yes | time of the event as the source wrote it
event.source_type           | string  | yes | kind of log the event came from
event.category              | array   | no  | broad class of the event
event.type                  | array   | no  | what happened within the class
event.action                | string  | no  | readable description of the action
event.outcome               | string  | no  | success, failure or unknown
event.severity              | integer | no  | severity on a scale of 0 to 100
event.original_event_id     | string  | no  | event code used by the source
host.name                   | string  | no  | machine the event was seen on
host.hostname               | string  | no  | copy of host.name
host.ip                     | array   | no  | addresses of the machine
host.os.type                | string  | no  | operating system family
host.os.name                | string  | no  | operating system in full
process.pid                 | integer | no  | process number
process.ppid                | integer | no  | number of the parent process
process.name                | string  | no  | image name without directory
process.executable          | string  | no  | image with directory
process.command_line        | string  | no  | command with its arguments
process.hash.md5            | string  | no  | MD5 of the image in lower case
process.hash.sha256         | string  | no  | SHA-256 of the image in lower case
process.parent.pid          | integer | no  | number of the parent process
process.parent.name         | string  | no  | parent image name without directory
process.parent.executable   | string  | no  | parent image with directory
process.parent.command_line | string  | no  | parent command with its arguments
network.direction           | string  | no  | ingress, egress or internal
network.transport           | string  | no  | transport protocol
network.protocol            | string  | no  | copy of the transport when nothing else is known
network.destination.ip      | string  | no  | address connected to
network.destination.port    | integer | no  | port connected to
network.destination.domain  | string  | no  | name connected to
network.source.ip           | string  | no  | address connecting
network.source.port         | integer | no  | port connecting
file.path                   | string  | no  | file with directory
file.name                   | string  | no  | file without directory
file.extension              | string  | no  | extension without its dot
file.hash.md5               | string  | no  | MD5 of the file in lower case
file.hash.sha256            | string  | no  | SHA-256 of the file in lower case
file.size                   | integer | no  | size in bytes
registry.path               | string  | no  | registry object in full
registry.key                | string  | no  | registry key
registry.value.name         | string  | no  | name of the registry value
registry.value.type         | string  | no  | type of the registry value
registry.value.data         | string  | no  | data of the registry value
user.name                   | string  | no  | account without domain
user.domain                 | string  | no  | domain of the account
user.id                     | string  | no  | number or SID of the account
log.source_type             | string  | yes | kind of log the record came from
log.source_tool             | string  | no  | tool that wrote the record
log.original_event_id       | string  | no  | event code before normalization
log.original_log            | object  | no  | parts of the source record as they were
"""

FIELD_CATALOG = [
    tuple(cell.strip() for cell in line.split("|")) for line in _FIELDS.strip().splitlines()
]

# Source key | label | covers | icon | color
_SOURCES = """
sysmon | Sysmon XML              | event codes 1 to 29                              | W | blue
wel    | Windows Event Log CSV   | logons, processes, tasks, accounts, services     | W | blue
wazuh  | Wazuh Alerts JSON       | rule alerts with agent, rule and data blocks     | W | orange
syslog | Linux auth.log / syslog | SSH, sudo, PAM, cron, accounts, su, systemd      | L | green
cef    | CEF / Generic JSON      | any vendor, by the names of its fields           | C | purple
"""

SOURCE_CATALOG = [
    tuple(cell.strip() for cell in line.split("|")) for line in _SOURCES.strip().splitlines()
]

_DESCRIPTIONS = {path: (required == "yes", text) for path, _, required, text in FIELD_CATALOG}


def _described(struct: StructType, prefix: str = "") -> StructType:
    fields = []
    for field in struct.fields:
        path = prefix + field.name
        kind = field.dataType
        if isinstance(kind, StructType):
            kind = _described(kind, path + ".")
        required, text = _DESCRIPTIONS.get(path, (False, ""))
        metadata = {"comment": text, "required": required} if text else {}
        fields.append(StructField(field.name, kind, True, metadata))
    return StructType(fields)


def event_schema() -> StructType:
    """The schema of a normalized event; documented fields carry a comment."""
    return _described(StructType.fromDDL(EVENT_DDL))


EVENT_COLUMNS = [
    "schema_version", "event", "host", "process", "network", "file", "registry", "user", "log",
    "tags",
]


def inline_table(
    spark: SparkSession, rows: list[tuple], columns: list[tuple[str, str]]
) -> DataFrame:
    """A small fixed table as a local relation, planned without any job."""
    structs = [
        F.struct(*[_constant(v).cast(kind).alias(name) for v, (name, kind) in zip(row, columns)])
        for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))


def _constant(value):
    return F.array(*[F.lit(v) for v in value]) if isinstance(value, list) else F.lit(value)


def field_catalog(spark: SparkSession) -> DataFrame:
    """The 53 documented fields: path, section, type, required, description."""
    table = inline_table(
        spark,
        FIELD_CATALOG,
        [("path", "string"), ("type", "string"), ("required", "string"), ("description", "string")],
    )
    return table.select(
        "path",
        F.split_part("path", F.lit("."), F.lit(1)).alias("section"),
        "type",
        (F.col("required") == "yes").alias("required"),
        "description",
    )


def source_catalog(spark: SparkSession) -> DataFrame:
    """The five kinds of source: key, label, what is covered, icon, color."""
    return inline_table(
        spark,
        SOURCE_CATALOG,
        [(c, "string") for c in ("source_type", "label", "events", "icon", "color")],
    )
