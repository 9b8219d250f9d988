"""Linux syslog, auth.log and journald text: one record per line."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions import fixed_values as fixed
from logweave.functions.shape import computed_once, kept_columns, shape_event
from logweave.functions.text import one_line_groups, sql_text, strip

_LINE = "(?Ud)^(?:" + "|".join(
    (fixed.JOURNALD_LINE, fixed.RFC5424_LINE, fixed.RFC3164_LINE)
) + ")$"
# time | month | day | clock | host | process | pid | message, one per line; each
# takes the groups of whichever layout matched.
_LINE_PARTS = "$1$6\n$11\n$12\n$13\n$2$7$14\n$3$8$15\n$4$9$16\n$5$10$17"

# Patterns of each program family in the order tried, with their number of groups.
_CRON = [(fixed.CRON_COMMAND, 2)]
_SYSTEMD = [(fixed.SYSTEMD_UNIT, 2)]
_PATTERNS = {
    "sshd": [
        (fixed.SSH_ACCEPTED, 4), (fixed.SSH_FAILED, 4), (fixed.SSH_INVALID, 2),
        (fixed.SSH_DISCONNECTED, 3),
    ],
    "sudo": [(fixed.SUDO_COMMAND, 3)],
    "pam": [(fixed.PAM_OPENED, 2), (fixed.PAM_FAILED, 1)],
    "su": [(fixed.SU_DONE, 2), (fixed.SU_FAILED, 1)],
    "cron": _CRON,
    "cron+systemd": _CRON + _SYSTEMD,
    "systemd": _SYSTEMD,
}


def parse_lines(df: DataFrame, raw: str = "raw", default_year: int | None = None) -> DataFrame:
    """Split lines into ``_time, _host, _program, _pid, _message`` (NULL: no layout)."""
    year = F.lit(default_year) if default_year is not None else F.year(
        F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    )
    parts = df.withColumn(
        "_parts",
        F.split(F.regexp_replace(strip(F.col(raw)), F.lit(_LINE), F.lit(_LINE_PARTS)), "\n", 8),
    )
    part = lambda i: F.get("_parts", F.lit(i))
    stamp = F.concat_ws(" ", year.cast("string"), part(1), F.lpad(part(2), 2, "0"), part(3))
    return parts.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.when(part(0) == "", stamp).when(part(7).isNotNull(), part(0)).alias("_time"),
        part(4).alias("_host"),
        part(5).alias("_program"),
        part(6).alias("_pid"),
        part(7).alias("_message"),
    )


def _families(program: Column, message: Column) -> Column:
    name = F.lower(program)
    return (
        F.when(F.contains(name, F.lit("sshd")), "sshd")
        .when(F.contains(name, F.lit("sudo")), "sudo")
        .when(F.contains(name, F.lit("pam")) | F.startswith(message, F.lit("pam_")), "pam")
        .when(name.isin(fixed.ACCOUNT_PROGRAMS), "account")
        .when(name == "su", "su")
        .when(
            F.contains(name, F.lit("cron")) & F.contains(name, F.lit("systemd")), "cron+systemd"
        )
        .when(F.contains(name, F.lit("cron")), "cron")
        .when(F.contains(name, F.lit("systemd")), "systemd")
        .otherwise("")
    )


# What a message means, first hit wins.  ``{1}`` stands for capture group 1 of the
# family's patterns, a condition ``1`` for "group 1 was found".
# family | condition | category | type | action | severity | outcome | user | ip | port | command | tag
_MEANINGS = [
    [cell.strip() for cell in line.split("|")]
    for line in """
sshd         | 1  | authentication | start | SSH accepted ({1})    | 0  | success | {2}  | {3}  | {4}  |     | T1021.004
sshd         | 5  | authentication | start | SSH failed ({5})      | 30 | failure | {6}  | {7}  | {8}  |     | T1110
sshd         | 9  | authentication | start | SSH invalid user      | 35 | failure | {9}  | {10} |      |     | T1110
sshd         | 11 | authentication | end   | SSH disconnected      | 0  | unknown | {11} | {12} | {13} |     |
sshd         |    | network        | info  | sshd: {message}            | 0  | unknown |      |      |      |     |
sudo         | 1  | process        | start | sudo: {1} ran as {2}  | 20 | success | {1}  |      |      | {3} | T1548.003
sudo         |    | process        | info  | sudo: {message}            | 10 | unknown |      |      |      |     |
pam          | 1  | authentication | start | PAM session opened ({1}) | 0 | success | {2} |     |      |     |
pam          | 3  | authentication | start | PAM authentication failure | 30 | failure | {3} |  |      |     | T1078
pam          |    | authentication | info  | PAM: {message}             | 0  | unknown |      |      |      |     |
account      |    | iam            | {del} | {program}: {message}       | 25 | success | {account} |  |     |     | T1136
su           | 1  | authentication | start | su to {1} by {2}      | 20 | success | {1}  |      |      |     | T1548
su           | 3  | authentication | start | Failed su to {3}      | 35 | failure | {3}  |      |      |     | T1548
cron         | 1  | process        | start | cron: {1}             | 0  | success | {1}  |      |      | {2} |
cron+systemd | 1  | process        | start | cron: {1}             | 0  | success | {1}  |      |      | {2} |
cron+systemd | 3  | process        | info  | systemd: {3} {4}      | {3}? | {3}? |      |      |      |     |
systemd      | 1  | process        | info  | systemd: {1} {2}      | {1}? | {1}? |      |      |      |     |
             |    | process        | info  | {program}: {message}      | 0  | unknown |      |      |      |     |
""".strip("\n").splitlines()
]
_SLOTS = {
    "{message}": "_message",
    "{program}": "_program",
    "{del}": "CASE WHEN contains(lower(_program), 'del') THEN 'deletion' ELSE 'creation' END",
    "{account}": "_account",
}


def _slot(slot: str) -> str:
    return _SLOTS.get(slot) or f"get(_g, {slot.strip('{}')})"


def _template(text: str) -> str:
    """SQL of a text with slots."""
    pieces = [p for p in re.split(r"(\{\w+\})", text) if p]
    sql = [_slot(p) if p.startswith("{") else sql_text(p) for p in pieces]
    return sql[0] if len(sql) == 1 else f"concat({', '.join(sql)})" if sql else "NULL"


def _meaning(cells: list[str]) -> str:
    category, kind, action, severity, outcome, user, ip, port, command, tag = cells
    if severity.endswith("?"):
        failed = f"{_slot(severity[:-1])} = 'Failed'"
        severity = f"CASE WHEN {failed} THEN 10 ELSE 0 END"
        outcome = f"CASE WHEN {failed} THEN 'failure' ELSE 'success' END"
    else:
        outcome = sql_text(outcome)
    tags = f"array({sql_text(tag)})" if tag else "CAST(array() AS array<string>)"
    texts = [_template(x) for x in (category, kind, action)]
    optional = [f"CAST({_template(x)} AS STRING)" for x in (user, ip, port, command)]
    names = "category kind action user ip port command severity outcome tags".split()
    values = [*texts, *optional, severity, outcome, tags]
    return "named_struct(" + ", ".join(f"'{n}', {v}" for n, v in zip(names, values)) + ")"


def _classification() -> str:
    arms = []
    for family, group, *cells in _MEANINGS[:-1]:
        found = f" AND get(_g, {group}) <> ''" if group else ""
        arms.append(f"WHEN _family = '{family}'{found} THEN {_meaning(cells)}")
    return f"CASE {' '.join(arms)} ELSE {_meaning(_MEANINGS[-1][2:])} END"


def classify(df: DataFrame) -> DataFrame:
    """Add ``_class``, the meaning of the message, to parsed lines."""
    message, program, family = F.col("_message"), F.col("_program"), F.col("_family")
    deleted = F.regexp_extract(message, fixed.USER_DELETED, 1)
    added = F.regexp_extract(message, "(?U)" + fixed.USER_ADDED, 1)
    groups = None
    for name, patterns in _PATTERNS.items():
        found = one_line_groups(message, patterns)
        groups = F.when(family == name, found) if groups is None else groups.when(
            family == name, found
        )
    return (
        df.withColumn("_family", _families(program, message))
        .withColumn("_g", groups)
        .withColumn(
            "_account",
            F.when(family == "account", F.when(deleted != "", deleted).otherwise(added)),
        )
        .withColumn("_class", F.expr(_classification()))
    )


def normalize_syslog(
    df: DataFrame, raw: str = "raw", default_year: int | None = None
) -> DataFrame:
    """Events of syslog lines.  A line in none of the three layouts is ``dropped``.

    ``default_year`` completes the year-less time stamps (default: this year).
    """
    keep = kept_columns(df)
    parts = ["_time", "_host", "_program", "_pid", "_message", "_class"]
    lines = computed_once(classify(parse_lines(df, raw, default_year)), keep, parts)
    pid, of = F.col("_pid"), lambda name: F.col(f"_class.{name}")
    matched = F.col("_message").isNotNull()
    return shape_event(
        lines,
        "syslog",
        {
            "event.created": F.col("_time"),
            "event.category": F.array(of("category")),
            "event.type": F.array(of("kind")),
            "event.action": of("action"),
            "event.outcome": of("outcome"),
            "event.severity": of("severity"),
            "host.name": F.col("_host"),
            "host.os.type": F.lit("linux"),
            "process.pid": F.when(pid.rlike("^[0-9]+$"), pid.try_cast("bigint")),
            "process.name": F.col("_program"),
            "process.command_line": of("command"),
            "network.source.ip": of("ip"),
            "network.source.port": of("port").try_cast("bigint"),
            "user.name": of("user"),
            "log.source_tool": F.lit("syslog"),
            "log.original_log": F.create_map(
                F.lit("process"), F.col("_program"),
                F.lit("pid"), F.when(pid != "", pid),
                F.lit("host"), F.col("_host"),
                F.lit("msg"), F.col("_message"),
            ),
            "tags": of("tags"),
        },
        status=F.when(matched, "ok").otherwise("dropped"),
        error=F.when(~matched, "no line layout matches"),
        keep=keep,
        raw=F.col(raw),
    )
