"""Sysmon XML: one record per ``<Event>`` element."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.functions import fixed_values as fixed
from logweave.functions.shape import computed_once, kept_columns, shape_event
from logweave.functions.text import (
    account_domain,
    account_name,
    base_name,
    empty_strings,
    extension,
    md5_of,
    sha256_of,
    sql_strip,
    sql_text,
    technique_tags,
    whole_number,
)
from logweave.schema import inline_table

_BROKEN = "_broken"
_EVENT_XML = f"""
System STRUCT<EventID: STRING, TimeCreated: STRUCT<_SystemTime: STRING>, Computer: STRING>,
EventData STRUCT<Data: ARRAY<STRUCT<_Name: STRING, _VALUE: STRING>>>,
{_BROKEN} STRING
"""


def event_table(spark) -> DataFrame:
    """The 29 Sysmon event codes with category, types, action, severity and hints."""
    return inline_table(
        spark,
        fixed.SYSMON_EVENTS,
        [
            ("_code", "bigint"), ("_category", "string"), ("_types", "array<string>"),
            ("_action", "string"), ("_severity", "bigint"), ("_hints", "array<string>"),
        ],
    )


def with_event_meaning(df: DataFrame, code: str) -> DataFrame:
    """Left join the event table (29 rows, fixed) on the event code column."""
    table = F.broadcast(event_table(df.sparkSession))
    return (
        df.join(table, df[code] == table["_code"], "left")
        .withColumn("_category", F.coalesce("_category", F.lit("process")))
        .withColumn("_types", F.coalesce("_types", F.array(F.lit("info"))))
        .withColumn(
            "_action",
            F.coalesce("_action", F.concat(F.lit("Sysmon event "), df[code].cast("string"))),
        )
        .withColumn("_severity", F.least(F.coalesce("_severity", F.lit(0)), F.lit(100)))
        .withColumn("_hints", F.coalesce("_hints", empty_strings()))
        .drop("_code")
    )


def parse_events(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Parse ``<Event>`` text into ``_xml`` and the parallel ``_names, _data``."""
    return (
        df.withColumn(
            "_xml", F.from_xml(F.col(raw), _EVENT_XML, {"columnNameOfCorruptRecord": _BROKEN})
        )
        .withColumn("_names", F.col("_xml.EventData.Data._Name"))
        .withColumn("_data", F.col("_xml.EventData.Data._VALUE"))
    )


def event_data(name: str) -> str:
    """SQL of the trimmed value of the first ``<Data Name=…>``, blank without one."""
    place = f"CAST(array_position(_names, {sql_text(name)}) AS INT) - 1"
    return sql_strip(f"coalesce(get(_data, {place}), '')")


def normalize_sysmon(df: DataFrame, raw: str = "raw", path_style: str = "any") -> DataFrame:
    """Events of Sysmon ``<Event>`` texts.

    Broken XML is ``dropped``, an event without System block ``failed``.
    """
    keep = kept_columns(df)
    fields = [
        "_xml.System IS NOT NULL AS _has_system",
        f"_xml.{_BROKEN} IS NOT NULL AS _is_broken",
        "coalesce(_xml.System.EventID, '') AS _event_id",
        "coalesce(_xml.System.TimeCreated._SystemTime, '') AS _time",
        "coalesce(_xml.System.Computer, '') AS _computer",
        # Numbered, since two names differ in case only.
        *[f"{event_data(name)} AS _d{i}" for i, name in enumerate(fixed.SYSMON_DATA_NAMES)],
    ]
    wide = computed_once(parse_events(df, raw), keep, fields)
    d = {name: F.col(f"_d{i}") for i, name in enumerate(fixed.SYSMON_DATA_NAMES)}
    coded = (
        wide.withColumn("_event_code", F.coalesce(whole_number(F.col("_event_id")), F.lit(0)))
        .withColumn(
            "_file", F.when(d["TargetFilename"] != "", d["TargetFilename"])
            .otherwise(d["TargetFileName"]),
        )
        .withColumn("_file_name", base_name(F.col("_file"), path_style))
    )
    known = with_event_meaning(coded, "_event_code")
    code = F.col("_event_code")
    ok, broken = F.col("_has_system"), F.col("_is_broken")
    return shape_event(
        known,
        "sysmon",
        {
            "event.created": F.col("_time"),
            "event.category": F.array("_category"),
            "event.type": F.col("_types"),
            "event.action": F.col("_action"),
            "event.severity": F.col("_severity"),
            "event.original_event_id": code.cast("string"),
            "host.name": F.col("_computer"),
            "host.os.type": F.lit("windows"),
            "process.pid": whole_number(d["ProcessId"]),
            "process.ppid": whole_number(d["ParentProcessId"]),
            "process.name": base_name(d["Image"], path_style),
            "process.executable": d["Image"],
            "process.command_line": d["CommandLine"],
            "process.hash.md5": md5_of(d["Hashes"]),
            "process.hash.sha256": sha256_of(d["Hashes"]),
            "process.parent.pid": whole_number(d["ParentProcessId"]),
            "process.parent.name": base_name(d["ParentImage"], path_style),
            "process.parent.executable": d["ParentImage"],
            "process.parent.command_line": d["ParentCommandLine"],
            "network.direction": F.when(F.lower(d["Initiated"]) == "true", "egress"),
            "network.transport": F.lower(d["Protocol"]),
            "network.destination.ip": d["DestinationIp"],
            "network.destination.port": whole_number(d["DestinationPort"]),
            "network.destination.domain": F.when(
                (code == 22) & (d["QueryName"] != ""), d["QueryName"]
            ).otherwise(d["DestinationHostname"]),
            "network.source.ip": d["SourceIp"],
            "network.source.port": whole_number(d["SourcePort"]),
            "file.path": F.col("_file"),
            "file.name": F.col("_file_name"),
            "file.extension": extension(F.col("_file_name")),
            "registry.path": d["TargetObject"],
            "registry.value.data": d["Details"],
            "user.name": account_name(d["User"]),
            "user.domain": account_domain(d["User"]),
            "log.source_tool": F.lit("sysmon"),
            "log.original_log": F.create_map(
                F.lit("EventID"), F.col("_event_id"),
                F.lit("RuleName"), d["RuleName"],
                F.lit("Computer"), F.col("_computer"),
                F.lit("TimeCreated"), F.col("_time"),
            ),
            "tags": F.concat(technique_tags(d["RuleName"]), F.col("_hints")),
        },
        status=F.when(ok, "ok").when(broken, "dropped").otherwise("failed"),
        error=F.when(~ok & broken, "broken XML").when(~ok, "no System block"),
        keep=keep,
        raw=F.col(raw),
    )
