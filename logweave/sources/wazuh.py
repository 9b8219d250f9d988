"""Wazuh alerts: one record per JSON object."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions import fixed_values as fixed
from logweave.functions.shape import computed_once, kept_columns, shape_event
from logweave.functions.text import (
    account_domain,
    account_name,
    base_name,
    empty_strings,
    extension,
    string_array,
    strip,
    whole_number,
)


def level_severity(level: Column) -> Column:
    """Severity of a rule level: a table up to its top level, five times if negative."""
    table = F.create_map(
        *[F.lit(cell).cast("bigint") for row in fixed.WAZUH_LEVELS for cell in row]
    )
    top = F.lit(fixed.WAZUH_LEVELS[-1][0])
    return F.coalesce(F.try_element_at(table, F.least(level, top)), level * 5)


def tag_union(techniques: Column, groups: Column) -> Column:
    """Techniques, then the groups that are not blank and not among the techniques."""
    fresh = F.filter(groups, lambda g: (g != "") & ~F.array_contains(techniques, g))
    return F.concat(techniques, fresh)


def alert_category(groups: Column, event_code: Column, description: Column) -> Column:
    """Category, type and action by the first rule whose group or event code fits."""
    lowered = F.transform(groups, F.lower)
    result = None
    for names, codes, category, kind, action in fixed.WAZUH_CATEGORIES:
        default = F.lit(action)
        if codes and not names:
            default = F.concat(F.lit(action + " "), event_code)
        meaning = F.struct(
            F.lit(category).alias("category"),
            F.lit(kind).alias("kind"),
            F.when(description != "", description).otherwise(default).alias("action"),
        )
        tests = []
        if names:
            tests.append(F.arrays_overlap(lowered, string_array(names)))
        if codes:
            tests.append(event_code.isin(codes))
        if not tests:
            return meaning if result is None else result.otherwise(meaning)
        hit = reduce(lambda a, b: a | b, tests)
        result = F.when(hit, meaning) if result is None else result.when(hit, meaning)
    return result


def parse_alerts(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Parse each text into ``_doc``, a VARIANT array holding the one alert.

    The text is parsed inside brackets: that way anything after the object makes
    it unreadable instead of being ignored.  A ``_source`` wrapper is taken off.
    """
    lines = df.withColumn("_line", strip(F.col(raw))).withColumn(
        "_outer",
        F.expr("CASE WHEN startswith(_line, '{') THEN try_parse_json(concat('[', _line, ']')) END"),
    )
    return lines.selectExpr(
        *[f"`{c}`" for c in df.columns],
        "_line",
        "_outer",
        "_outer IS NOT NULL AND try_variant_get(_outer, '$[1]', 'variant') IS NULL AS _single",
        # Only texts that mention the wrapper are looked into for it.
        "CASE WHEN contains(_line, '\"_source\"') "
        "THEN to_json(try_variant_get(_outer, '$[0]._source', 'variant')) END AS _inner",
    ).selectExpr(
        *[f"`{c}`" for c in df.columns],
        "_line",
        "_single",
        "_inner IS NULL OR startswith(_inner, '{') AS _is_object",
        "CASE WHEN _single THEN CASE WHEN _inner IS NULL THEN _outer "
        "ELSE try_parse_json(concat('[', _inner, ']')) END END AS _doc",
    )


# The blocks of an alert that are read.  Each becomes a map once; looking up its
# fields is then cheap, where every path into the VARIANT starts at its root.
_BLOCKS = {
    "_rule": "rule",
    "_agent": "agent",
    "_system": "data.win.system",
    "_windows": "data.win.eventdata",
    "_audit": "data.audit",
    "_syscheck": "syscheck",
}
# Column and where its text is, in order of preference.
_TEXTS = {
    "_agent_name": ["_agent.name"],
    "_agent_ip": ["_agent.ip"],
    "_rule_id": ["_rule.id"],
    "_description": ["_rule.description"],
    "_level_text": ["_rule.level"],
    "_groups_text": ["_rule.groups"],
    "_time": ["_timestamp", "_system.systemTime"],
    "_event_code": ["_system.eventID", "_system.eventId"],
    "_computer": ["_system.computer"],
    "_account": [
        "_windows.targetUserName", "_windows.subjectUserName", "_audit.auid", "_audit.uid",
    ],
    "_ip": ["_windows.ipAddress"],
    "_image": ["_windows.newProcessName", "_windows.processName"],
    "_pid": ["_windows.newProcessId", "_windows.processId"],
    "_command": ["_windows.commandLine", "_audit.command", "_execve"],
    "_file": ["_syscheck.path"],
    "_file_event": ["_syscheck.event"],
    "_md5": ["_syscheck.md5_before", "_syscheck.md5_after"],
    "_sha256": ["_syscheck.sha256_before", "_syscheck.sha256_after"],
}
# JSON text of a list that holds texts only.
_TEXT_LIST = r'^\[(?:"(?:[^"\\]++|\\.)*+"(?:,(?=")|(?=\])))*+\]$'


def _text(*places: str) -> str:
    """SQL of the first of several texts that is not blank."""
    found = []
    for place in places:
        block, _, name = place.partition(".")
        found.append(f"nullif({block}['{name}'], '')" if name else f"nullif({block}, '')")
    return f"coalesce({', '.join(found)}, '')"


def _object_or_missing(path: str) -> str:
    value = f"try_variant_get(_doc, '$[0].{path}', 'variant')"
    return f"({value} IS NULL OR startswith(schema_of_variant({value}), 'OBJECT'))"


def normalize_wazuh(df: DataFrame, raw: str = "raw", path_style: str = "any") -> DataFrame:
    """Events of Wazuh alerts given as one JSON text each.

    Text that is not one JSON value is ``dropped``; a value that is no object, or
    whose rule, data or groups have the wrong kind, is ``failed``.
    """
    keep = kept_columns(df)
    kept = [f"`{c}`" for c in keep]
    blocks = parse_alerts(df, raw).selectExpr(
        *kept,
        "_line",
        "_single",
        "_is_object",
        "_doc",
        *[
            f"try_variant_get(_doc, '$[0].{path}', 'map<string,string>') AS {name}"
            for name, path in _BLOCKS.items()
        ],
        "try_variant_get(_doc, '$[0].timestamp', 'string') AS _timestamp",
        "try_variant_get(_doc, '$[0].location', 'string') AS _location",
    )
    # A block that gave a map is an object; only the others need a closer look.
    wide = blocks.selectExpr(
        *kept,
        "_line",
        "_single",
        "_is_object",
        f"_rule IS NOT NULL OR {_object_or_missing('rule')} AS _rule_ok",
        "_windows IS NOT NULL OR _system IS NOT NULL OR _audit IS NOT NULL OR "
        f"{_object_or_missing('data')} AS _data_ok",
        "_windows IS NOT NULL OR _system IS NOT NULL OR "
        f"{_object_or_missing('data.win')} AS _win_ok",
        "coalesce(_location, '') AS _location",
        "_syscheck['event'] IS NULL OR schema_of_variant("
        "try_variant_get(_doc, '$[0].syscheck.event', 'variant')) = 'STRING' AS _event_ok",
        "CASE WHEN _rule['mitre'] IS NOT NULL THEN "
        "try_variant_get(_doc, '$[0].rule.mitre.id', 'array<string>') END AS _mitre",
        "CASE WHEN _rule['mitre'] IS NOT NULL THEN "
        "try_variant_get(_doc, '$[0].rule.mitre.id', 'string') END AS _mitre_text",
        "CASE WHEN startswith(_rule['groups'], '[') THEN "
        "try_variant_get(_doc, '$[0].rule.groups', 'array<string>') END AS _group_texts",
        "CASE WHEN _audit['execve'] IS NOT NULL THEN "
        "try_variant_get(_doc, '$[0].data.audit.execve.a0', 'string') END AS _execve",
        *_BLOCKS,
        "_timestamp",
    ).selectExpr(
        *kept,
        "_line", "_single", "_is_object", "_rule_ok", "_data_ok", "_win_ok", "_event_ok",
        "_location", "_mitre", "_mitre_text", "_group_texts",
        *[f"{_text(*places)} AS {name}" for name, places in _TEXTS.items()],
    )
    wide = wide.withColumn(
        "_techniques",
        F.coalesce(
            F.filter("_mitre", lambda t: t.isNotNull()),
            F.when(F.col("_mitre_text") != "", F.array(F.col("_mitre_text"))),
            empty_strings(),
        ),
    ).withColumn("_level", F.coalesce(whole_number(F.col("_level_text")), F.lit(0)))
    # Groups: nothing, a plain text and an object count as no groups; a list must be
    # all text; any other value that is not zero makes the record fail.
    listed = F.col("_group_texts").isNotNull()
    groups_ok = F.when(
        listed, F.col("_groups_text").rlike(_TEXT_LIST)
    ).otherwise(~F.col("_groups_text").rlike(r"^(?:true|-?(?!0$)[0-9][0-9.eE+-]*)$"))
    staged = (
        wide.withColumn("_groups_ok", groups_ok)
        .withColumn(
            "_groups", F.when(listed, F.col("_group_texts")).otherwise(empty_strings())
        )
        .withColumn(
            "_class", alert_category(F.col("_groups"), F.col("_event_code"), F.col("_description"))
        )
        .withColumn("_file_name", base_name(F.col("_file"), path_style))
    )
    made = [c for c in staged.columns if c not in keep]
    staged = computed_once(staged, keep, made)
    file_event, code, account = F.col("_file_event"), F.col("_event_code"), F.col("_account")
    watched = file_event != ""
    file_type = F.lit(fixed.FILE_INTEGRITY_DEFAULT)
    for word, kind_name in reversed(fixed.FILE_INTEGRITY_TYPES):
        file_type = F.when(F.lower(file_event) == word, kind_name).otherwise(file_type)
    outcomes = F.create_map(*[F.lit(cell) for row in fixed.WAZUH_OUTCOMES for cell in row])

    sound = reduce(
        lambda a, b: a & b,
        [F.col(c) for c in
         ("_is_object", "_rule_ok", "_data_ok", "_win_ok", "_groups_ok", "_event_ok")],
    )
    failed = ~sound
    # A text the VARIANT parser refuses may still be an object that repeats a key;
    # a reader taking the last of them sees a record, so it counts as failed.
    boxed = F.concat(F.lit("["), F.col("_line"), F.lit("]"))
    repeated = F.coalesce(F.size(F.from_json(boxed, "array<string>")) == 1, F.lit(False))
    is_object_text = F.startswith(F.col("_line"), F.lit("{"))
    # Elements of a JSON array that are no objects reach this job as JSON text.
    return shape_event(
        staged,
        "wazuh",
        {
            "event.created": F.col("_time"),
            "event.category": F.when(watched, string_array(["file"])).otherwise(
                F.array("_class.category")
            ),
            "event.type": F.when(watched, F.array(file_type)).otherwise(F.array("_class.kind")),
            "event.action": F.when(
                watched, F.concat(F.lit("File "), file_event)
            ).otherwise(F.col("_class.action")),
            "event.outcome": F.coalesce(F.try_element_at(outcomes, code), F.lit("unknown")),
            "event.severity": level_severity(F.col("_level")),
            "event.original_event_id": F.col("_rule_id"),
            "host.name": F.when(F.col("_agent_name") != "", F.col("_agent_name")).otherwise(
                F.col("_computer")
            ),
            "host.ip": F.when(F.col("_agent_ip") != "", F.array("_agent_ip")),
            "host.os.type": F.when(code != "", "windows"),
            "process.pid": whole_number(F.col("_pid")),
            "process.name": base_name(F.col("_image"), path_style),
            "process.executable": F.col("_image"),
            "process.command_line": F.col("_command"),
            "network.source.ip": F.col("_ip"),
            "file.path": F.col("_file"),
            "file.name": F.col("_file_name"),
            "file.extension": extension(F.col("_file_name")),
            "file.hash.md5": F.col("_md5"),
            "file.hash.sha256": F.col("_sha256"),
            "user.name": account_name(account),
            "user.domain": account_domain(account),
            "log.source_tool": F.lit("wazuh"),
            "log.original_log": F.create_map(
                F.lit("rule_id"), F.col("_rule_id"),
                F.lit("rule_level"), F.col("_level").cast("string"),
                F.lit("description"), F.col("_description"),
                F.lit("agent"), F.col("_agent_name"),
                F.lit("location"), F.col("_location"),
            ),
            "tags": tag_union(F.col("_techniques"), F.col("_groups")),
        },
        status=F.when(F.col("_single"), F.when(failed, "failed").otherwise("ok"))
        .when(is_object_text & ~repeated, "dropped")
        .when(is_object_text, "failed")
        .otherwise("dropped"),
        error=F.when(
            F.col("_single"), F.when(failed, "rule, data, groups or event of the wrong kind")
        )
        .when(is_object_text & ~repeated, "broken JSON")
        .when(is_object_text, "repeated key")
        .otherwise("no JSON object"),
        keep=keep,
        raw=F.col(raw),
    )
