"""SQL counterparts of the registered queries.

Each one derives the expected result from the columns of ``events`` and never
looks at a raw record, so it checks the round trip through text.
"""

from __future__ import annotations

from logweave.functions import fixed_values as fixed
from logweave.plans.rawlogs import BASE_SQL
from logweave.schema import FIELD_CATALOG, SOURCE_CATALOG

_BASE = BASE_SQL.format(events="events")
_BACKSLASH = "chr(92)"
_NUMBER_FIELDS = ("severity", "pid", "ppid", "dst_port", "src_port")
_TEXT_FIELDS = (
    "created", "category", "type", "action", "outcome", "code", "host", "host_ip", "os", "process",
    "executable", "command_line", "md5", "sha256", "direction", "transport", "protocol", "dst_ip",
    "src_ip", "file_path", "file_name", "extension", "file_md5", "file_sha256", "user_name",
    "user_domain", "tool", "tags",
)


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _case(selector: str, *values: str, otherwise: str | None = None) -> str:
    """CASE over 0, 1, 2, … of a selector."""
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    tail = f" ELSE {otherwise}" if otherwise is not None else ""
    return f"CASE {selector} {arms}{tail} END"


def _events(source: str = "base", where: str = "TRUE", key: str = "event_id",
            without: tuple = (), dst_domain: bool = False, **fields: str) -> str:
    """The flat event rows; fields not given are blank, or NULL for numbers."""
    columns = [f"{key} AS row_id"]
    for name in _TEXT_FIELDS:
        if name not in without:
            columns.append(f"CAST({fields.pop(name, _text(''))} AS VARCHAR) AS {name}")
    for name in _NUMBER_FIELDS:
        columns.append(f"CAST({fields.pop(name, 'NULL')} AS BIGINT) AS {name}")
    assert not fields, fields
    return f"WITH base AS ({_BASE}) SELECT {', '.join(columns)} FROM {source} WHERE {where}"


def _values(rows: list, columns: str) -> str:
    body = ", ".join(
        "(" + ", ".join(str(c) if isinstance(c, int) else _text(c) for c in row) + ")"
        for row in rows
    )
    return f"(VALUES {body}) AS {columns}"


_SYSMON = _values(
    [(c, cat, "|".join(t), a, s, "|".join(h)) for c, cat, t, a, s, h in fixed.SYSMON_EVENTS],
    "m(code, category, type, action, severity, hint)",
)
_WINDOWS = _values(
    [(c, cat, "|".join(t), a, s, o) for c, cat, t, a, s, o in fixed.WINDOWS_EVENTS],
    "m(code, category, type, action, severity, outcome)",
)

# ---- syslog -------------------------------------------------------------------

_EIGHT = "event_id % 8"
_SYSLOG = {
    "created": "iso",
    "host": "host",
    "os": "'linux'",
    "tool": "'syslog'",
    "category": _case(_EIGHT, "'authentication'", "'authentication'", "'process'", "'process'",
                      "'iam'", "'process'", "'authentication'", "'process'"),
    "type": _case(_EIGHT, "'start'", "'start'", "'start'", "'start'", "'creation'", "'info'",
                  "'start'", "'info'"),
    "action": _case(_EIGHT, "'SSH accepted (publickey)'", "'SSH failed (password)'",
                    "'sudo: ' || usr || ' ran as root'", "'cron: ' || usr",
                    "'useradd: new user: name=' || usr || ', UID=1'",
                    "'systemd: Started ' || event_type || '.service'", "'Failed su to root'",
                    "'kernel: ' || event_type || ' ' || props"),
    "outcome": _case(_EIGHT, "'success'", "'failure'", "'success'", "'success'", "'success'",
                     "'success'", "'failure'", "'unknown'"),
    "severity": _case(_EIGHT, "0", "30", "20", "0", "25", "0", "35", "0"),
    "pid": f"CASE WHEN {_EIGHT} IN (0, 1, 3, 4) THEN event_id WHEN {_EIGHT} = 5 THEN 1 END",
    "process": _case(_EIGHT, "'sshd'", "'sshd'", "'sudo'", "'CRON'", "'useradd'", "'systemd'",
                     "'su'", "'kernel'"),
    "command_line": f"CASE {_EIGHT} WHEN 2 THEN '/usr/bin/' || event_type "
                    f"WHEN 3 THEN 'run ' || event_type ELSE '' END",
    "src_ip": f"CASE WHEN {_EIGHT} < 2 THEN ip ELSE '' END",
    "src_port": f"CASE WHEN {_EIGHT} < 2 THEN 1024 + event_id % 60000 END",
    "user_name": _case(_EIGHT, "usr", "usr", "usr", "usr", "usr || ','", "''", "'root'", "''"),
    "tags": _case(_EIGHT, "'T1021.004'", "'T1110'", "'T1548.003'", "''", "'T1136'", "''",
                  "'T1548'", "''"),
}
_NINE = "event_id % 9"
_SYSLOG_3164 = {
    "created": "substr(iso, 1, 4) || ' ' || mon || ' ' || lpad(dom, 2, '0') || ' ' || clock",
    "host": "host",
    "os": "'linux'",
    "tool": "'syslog'",
    "category": _case(_NINE, "'authentication'", "'authentication'", "'network'",
                      "'authentication'", "'authentication'", "'iam'", "'authentication'",
                      "'process'", "'process'"),
    "type": _case(_NINE, "'start'", "'end'", "'info'", "'start'", "'start'", "'deletion'",
                  "'start'", "'info'", "'info'"),
    "action": _case(_NINE, "'SSH invalid user'", "'SSH disconnected'",
                    "'sshd: Connection closed by ' || ip", "'PAM session opened (cron)'",
                    "'PAM authentication failure'",
                    "'userdel: delete user ''' || usr || ''''", "'su to root by ' || usr",
                    "'systemd: Failed ' || event_type || '.service'",
                    "'sudo: pam_unix: ' || event_type"),
    "outcome": _case(_NINE, "'failure'", "'unknown'", "'unknown'", "'success'", "'failure'",
                     "'success'", "'success'", "'failure'", "'unknown'"),
    "severity": _case(_NINE, "35", "0", "0", "0", "30", "25", "20", "10", "10"),
    "pid": f"CASE {_NINE} WHEN 7 THEN 1 WHEN 8 THEN NULL ELSE event_id END",
    "process": _case(_NINE, "'sshd'", "'sshd'", "'sshd'", "'CRON'", "'login'", "'userdel'",
                     "'su'", "'systemd'", "'sudo'"),
    "src_ip": f"CASE WHEN {_NINE} < 2 THEN ip ELSE '' END",
    "src_port": f"CASE WHEN {_NINE} = 1 THEN 1024 + event_id % 60000 END",
    "user_name": _case(_NINE, "usr", "usr", "''", "usr", "usr", "usr", "'root'", "''", "''"),
    "tags": _case(_NINE, "'T1110'", "''", "''", "''", "'T1078'", "'T1136'", "'T1548'", "''",
                  "''"),
}
_FIVE = "event_id % 5"
_SYSLOG_5424 = {
    "created": "iso",
    "host": "host",
    "os": "'linux'",
    "tool": "'syslog'",
    "category": _case(_FIVE, "'process'", "'authentication'", "'process'", "'process'"),
    "type": _case(_FIVE, "'info'", "'start'", "'info'", "'start'"),
    "action": _case(_FIVE, "'app: opened ' || event_type", "'SSH accepted (password)'",
                    "'app: - hello ' || usr", "'cron: ' || usr"),
    "outcome": _case(_FIVE, "'unknown'", "'success'", "'unknown'", "'success'"),
    "severity": "0",
    "pid": f"CASE {_FIVE} WHEN 1 THEN NULL ELSE event_id END",
    "process": _case(_FIVE, "'app'", "'sshd'", "'app'", "'cron'"),
    "command_line": f"CASE {_FIVE} WHEN 3 THEN event_type ELSE '' END",
    "src_ip": f"CASE {_FIVE} WHEN 1 THEN ip ELSE '' END",
    "src_port": f"CASE {_FIVE} WHEN 1 THEN 1024 + event_id % 60000 END",
    "user_name": f"CASE WHEN {_FIVE} IN (1, 3) THEN usr ELSE '' END",
    "tags": f"CASE {_FIVE} WHEN 1 THEN 'T1021.004' ELSE '' END",
}

# ---- Sysmon, Windows, Wazuh, CEF, JSON ----------------------------------------

_SYSMON_ROWS = {
    "created": "iso", "host": "host", "os": "'windows'", "tool": "'sysmon'",
    "outcome": "'unknown'",
    "category": "coalesce(m.category, 'process')",
    "type": "coalesce(m.type, 'info')",
    "action": "coalesce(m.action, 'Sysmon event ' || CAST(1 + event_id % 30 AS VARCHAR))",
    "severity": "coalesce(m.severity, 0)",
    "code": "CAST(1 + event_id % 30 AS VARCHAR)",
    "pid": "event_id",
    "process": "event_type || '.exe'",
    "executable": "'/opt/bin/' || event_type || '.exe'",
    "md5": "'ab' || eid", "sha256": "'cd' || eid",
    "direction": "'egress'", "transport": "'tcp'", "protocol": "'tcp'",
    "src_ip": "ip", "src_port": "1024 + event_id % 60000",
    "user_name": "usr", "user_domain": "'CORP'",
    "tags": "'T1059.001' || CASE WHEN coalesce(m.hint, '') <> '' THEN '|' || m.hint ELSE '' END",
}
_SYSMON_FROM = f"base LEFT JOIN {_SYSMON} ON m.code = 1 + event_id % 30"

_SIX = "event_id % 6"
_WEL_CODE = _case(_SIX, "4624", "4625", "4688", "4740", "9999", otherwise="0")
_LOGON = "CASE event_id % 5 " + " ".join(
    f"WHEN {int(kind) - 2} THEN '{name}'" for kind, name in fixed.LOGON_TYPES if int(kind) < 7
) + " ELSE 'type-6' END"
_WEL_ROWS = {
    "created": "iso", "host": "host", "os": "'windows'", "tool": "'windows-event-log'",
    "category": "coalesce(m.category, 'process')",
    "type": "coalesce(m.type, 'info')",
    "action": f"coalesce(m.action, 'WEL event 9999') || CASE WHEN {_SIX} < 2 "
              f"THEN ' (' || {_LOGON} || ')' ELSE '' END",
    "outcome": "coalesce(m.outcome, 'unknown')",
    "severity": "coalesce(m.severity, 0)",
    "code": f"CAST({_WEL_CODE} AS VARCHAR)",
    "pid": "event_id",
    "process": "event_type || '.exe'",
    "executable": "'/opt/bin/' || event_type || '.exe'",
    "src_ip": f"CASE {_SIX} WHEN 2 THEN '' ELSE ip END",
    "user_name": "usr",
}
_WEL_FROM = f"base LEFT JOIN {_WINDOWS} ON m.code = {_WEL_CODE}"

_LEVEL_SEVERITY = (
    "CASE WHEN event_id % 18 <= 12 THEN event_id % 18 * 5 WHEN event_id % 18 = 13 THEN 70 "
    "WHEN event_id % 18 = 14 THEN 80 ELSE 90 END"
)
_LOGON_ALERT = "event_id % 3 = 0 OR event_id % 5 = 0"
_WAZUH_ROWS = {
    "created": "iso", "host": "host", "host_ip": "ip", "tool": "'wazuh'",
    "os": "CASE event_id % 3 WHEN 0 THEN 'windows' ELSE '' END",
    "category": f"CASE WHEN {_LOGON_ALERT} THEN 'authentication' WHEN {_FIVE} IN (1, 4) "
                "THEN 'process' ELSE 'network' END",
    "type": f"CASE WHEN {_LOGON_ALERT} OR {_FIVE} = 1 THEN 'start' WHEN {_FIVE} = 3 "
            "THEN 'access' ELSE 'info' END",
    "action": "event_type || ' alert'",
    "outcome": "CASE event_id % 3 WHEN 0 THEN 'failure' ELSE 'unknown' END",
    "severity": _LEVEL_SEVERITY,
    "code": "CAST(5700 + event_id % 20 AS VARCHAR)",
    "user_name": "usr",
    "tags": "'T1110|' || " + _case(_FIVE, "'authentication_failed'", "'process_creation'",
                                   "'firewall'", "'web'", otherwise="'other'"),
}
_FOUR = "event_id % 4"
_WAZUH_FILE_ROWS = {
    "created": "iso", "host": "host", "tool": "'wazuh'", "category": "'file'",
    "type": _case(_FOUR, "'creation'", "'change'", "'deletion'", "'change'"),
    "action": "'File ' || " + _case(_FOUR, "'added'", "'modified'", "'Deleted'", "'moved'"),
    "outcome": "'unknown'", "severity": "35",
    "code": "CAST(550 + event_id % 3 AS VARCHAR)",
    "file_path": "'/etc/' || event_type || '.conf'",
    "file_name": "event_type || '.conf'",
    "extension": "'conf'",
    "file_md5": "'ab' || eid", "file_sha256": "'cd' || eid",
    "user_name": "usr",
    "tags": "'syscheck|ossec|ossec'",
}
_CEF_ROWS = {
    "tool": "'Acme/FW'", "category": "'network'", "type": "'connection'", "action": "event_type",
    "outcome": "CASE event_id % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'failure' ELSE 'unknown' END",
    "severity": "event_id % 11 * 10",
    "code": "CAST(100 + event_id % 5 AS VARCHAR)",
    "transport": "'tcp'", "protocol": "'tcp'",
    "dst_ip": "'192.168.0.' || CAST(user_id % 256 AS VARCHAR)", "dst_port": "443",
    "src_ip": "ip", "src_port": "1024 + event_id % 60000", "user_name": "usr",
}
# None of the event types holds a category keyword, so the source address decides.
_JSON_ROWS = {
    "created": "iso", "host": "host", "tool": "'generic-json'", "category": "'network'",
    "type": "'info'", "action": "event_type",
    "outcome": _case(_FOUR, "'success'", "'failure'", "'success'", otherwise="'unknown'"),
    "severity": "event_id % 150", "src_ip": "ip", "src_port": "1024 + event_id % 60000",
    "user_name": "usr",
}

# ---- the stored syslog load ---------------------------------------------------

_STORED = f"""
WITH base AS ({_BASE}), stored AS (
  SELECT event_id AS number, eid AS event_id, 'syslog' AS source_type, iso AS created_at,
    '["' || {_SYSLOG['category']} || '"]' AS category, {_SYSLOG['action']} AS event_action,
    CAST({_SYSLOG['severity']} AS BIGINT) AS severity, host AS host_name,
    {_SYSLOG['process']} AS process_name, {_SYSLOG['user_name']} AS user_name,
    {_SYSLOG['src_ip']} AS src_ip, '' AS dst_ip,
    's' || CAST(event_id % 13 AS VARCHAR) AS session_id, iso AS indexed_at,
    {_SYSLOG['outcome']} AS outcome, {_SYSLOG['command_line']} AS command_line,
    {_SYSLOG['tags']} AS tags, CAST({_SYSLOG['pid']} AS BIGINT) AS pid,
    CAST({_SYSLOG['src_port']} AS BIGINT) AS src_port, {_SYSLOG['type']} AS type,
    usr, event_type, props, ip, host
  FROM base)
"""
_LISTED = (
    "event_id, source_type, created_at, category, event_action, severity, host_name, "
    "process_name, user_name, src_ip, dst_ip, session_id, indexed_at"
)

_MESSAGE = _case(
    "number % 8",
    "'Accepted publickey for ' || usr || ' from ' || ip || ' port ' || CAST(src_port AS VARCHAR) || ' ssh2'",
    "'Failed password for invalid user ' || usr || ' from ' || ip || ' port ' || CAST(src_port AS VARCHAR) || ' ssh2'",
    "usr || ' : TTY=pts/0 ; PWD=/home/x ; USER=root ; COMMAND=' || command_line",
    "'(' || usr || ') CMD (' || command_line || ')'",
    "'new user: name=' || usr || ', UID=1'",
    "'Started ' || event_type || '.service.'",
    "'FAILED su for root by ' || usr",
    "event_type || ' ' || props",
)

# ---- the mixed load -----------------------------------------------------------

_MIXED = f"""
WITH base AS ({_BASE}), mixed AS (
  SELECT base.*, 's' || CAST(event_id % 13 AS VARCHAR) AS session_id,
    {_case(_SIX, "'Syslog'", "'cef'", "'WEL'", "'wazuh'", "'sysmon'", otherwise="'netflow'")}
      AS source_type,
    CASE {_SIX} WHEN 5 THEN 'failed' ELSE 'ok' END AS status
  FROM base)
"""
# In the mixed load every row of one kind shares event_id % 6, which fixes its code.
_MIXED_ACTION = _case(
    _SIX, _SYSLOG["action"], "event_type", "'Process created'", "event_type || ' alert'",
    "coalesce(m.action, 'Sysmon event ' || CAST(1 + event_id % 30 AS VARCHAR))", otherwise="''",
)
_MIXED_SEVERITY = _case(
    _SIX, _SYSLOG["severity"], "event_id % 11 * 10", "0", _LEVEL_SEVERITY,
    "coalesce(m.severity, 0)", otherwise="0",
)


def _long(*rows: tuple[str, str, str]) -> str:
    """Section, field and value of every stored event, blanks left out."""
    parts = [
        f"SELECT event_id AS row_id, '{section}' AS section, '{field}' AS field, "
        f"CAST({value} AS VARCHAR) AS value FROM stored"
        for section, field, value in rows
    ]
    return f"{_STORED} SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE value <> ''"


# Fields a syslog event fills, with the condition on the stored row.
_FILLED = {
    "schema_version": "TRUE", "tags": "TRUE", "event.id": "TRUE", "event.created": "TRUE",
    "event.source_type": "TRUE", "event.category": "TRUE", "event.type": "TRUE",
    "event.action": "TRUE", "event.outcome": "TRUE", "event.severity": "TRUE",
    "host.name": "TRUE", "host.hostname": "TRUE", "host.os.type": "TRUE",
    "process.pid": "pid IS NOT NULL", "process.name": "TRUE",
    "process.command_line": "command_line <> ''", "network.source.ip": "src_ip <> ''",
    "network.source.port": "src_port IS NOT NULL", "user.name": "user_name <> ''",
    "log.source_type": "TRUE", "log.source_tool": "TRUE", "log.original_log": "TRUE",
}
_CATALOG_ROWS = " UNION ALL ".join(
    f"SELECT '{path}' AS path, '{path.split('.')[0]}' AS section, '{kind}' AS type, "
    f"{'TRUE' if required == 'yes' else 'FALSE'} AS required, "
    f"count(*) FILTER (WHERE {_FILLED.get(path, 'FALSE')}) AS events FROM stored"
    for path, kind, required, _ in FIELD_CATALOG
)
_SOURCE_ROWS = " UNION ALL ".join(
    f"SELECT '{key}' AS source_type, '{label}' AS label, '{icon}' AS icon, '{color}' AS color, "
    f"count(*) FILTER (WHERE lower(source_type) = '{key}') AS records FROM mixed"
    for key, label, _, icon, color in SOURCE_CATALOG
)

_COUNTS = (
    "count(*) FILTER (WHERE status = 'ok') AS events, "
    "count(*) FILTER (WHERE status = 'failed') AS failed, "
    "count(*) FILTER (WHERE status IN ('ok', 'failed')) AS total, "
    "count(*) FILTER (WHERE status = 'dropped') AS dropped"
)
_SESSION_SUMS = (
    "count(*) AS total_events, CAST(0 AS BIGINT) AS failed_count"
)

ORACLES: dict[str, str] = {
    "syslog_events": _events(**_SYSLOG),
    "syslog_rfc3164": _events(**_SYSLOG_3164),
    "syslog_rfc5424": _events(where=f"{_FIVE} < 4", **_SYSLOG_5424),
    "syslog_by_action": f"""{_STORED} SELECT event_action, outcome, count(*) AS events
        FROM stored GROUP BY 1, 2""",
    "syslog_outcomes": f"""SELECT {_COUNTS} FROM (
        SELECT CASE {_FIVE} WHEN 4 THEN 'dropped' ELSE 'ok' END AS status FROM events)""",
    "syslog_times": """SELECT layout, event_id AS row_id,
        CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS epoch
        FROM events, (VALUES ('journald'), ('rfc3164')) AS l(layout)""",
    "syslog_current_year": """SELECT event_id AS row_id, CAST(epoch(make_timestamp(
        year(get_current_timestamp() AT TIME ZONE 'UTC'), month(ts), day(ts), hour(ts), minute(ts),
        CAST(second(ts) AS DOUBLE))) AS BIGINT) AS epoch FROM events""",
    "sysmon_events": _events(_SYSMON_FROM, **_SYSMON_ROWS),
    "sysmon_by_category": f"""SELECT coalesce(m.category, 'process') AS category,
        coalesce(m.type, 'info') AS type, count(*) AS events,
        CAST(max(coalesce(m.severity, 0)) AS BIGINT) AS max_severity
        FROM events LEFT JOIN {_SYSMON} ON m.code = 1 + event_id % 30 GROUP BY 1, 2""",
    "sysmon_lookup": f"""SELECT event_id AS row_id, event_id % 40 AS event_code,
        coalesce(m.category, 'process') AS category, coalesce(m.type, 'info') AS type,
        coalesce(m.action, 'Sysmon event ' || CAST(event_id % 40 AS VARCHAR)) AS action,
        CAST(coalesce(m.severity, 0) AS BIGINT) AS severity, coalesce(m.hint, '') AS hints
        FROM events LEFT JOIN {_SYSMON} ON m.code = event_id % 40""",
    "sysmon_documents": """SELECT status, count(*) AS records,
        CAST(sum(CASE status WHEN 'ok' THEN event_id END) AS BIGINT) AS pid_sum
        FROM events, (VALUES ('ok'), ('dropped'), ('failed')) AS s(status) GROUP BY 1""",
    "wel_events": _events(_WEL_FROM, where=f"{_SIX} < 5", **_WEL_ROWS),
    "wel_failed_count": f"""SELECT {_COUNTS} FROM (
        SELECT CASE {_SIX} WHEN 5 THEN 'failed' ELSE 'ok' END AS status FROM events)""",
    "wel_lookup": f"""SELECT event_id AS row_id, 4600 + event_id % 200 AS event_code,
        coalesce(m.category, 'process') AS category, coalesce(m.type, 'info') AS type,
        coalesce(m.action, 'WEL event ' || CAST(4600 + event_id % 200 AS VARCHAR)) AS action,
        CAST(coalesce(m.severity, 0) AS BIGINT) AS severity,
        coalesce(m.outcome, 'unknown') AS outcome
        FROM events LEFT JOIN {_WINDOWS} ON m.code = 4600 + event_id % 200""",
    "wel_alias_resolution": _events(
        created="iso", host="host", os="'windows'", tool="'windows-event-log'",
        category="'authentication'", type="'start'", action="'Logon with explicit credentials'",
        outcome="'success'", severity="20", code="'4648'", src_ip="ip", user_name="usr",
        user_domain="'CORP'", command_line="'cmd /c ' || event_type",
    ),
    "wel_documents": f"""WITH base AS ({_BASE})
        SELECT event_id AS row_id, 'ok' AS status, 'User account created' AS action,
          usr AS user_name, 'line 1' || chr(10) || 'says "' || event_type || '", ok' AS message
          FROM base
        UNION ALL SELECT event_id, 'ok', 'User account deleted', '', '' FROM base
        UNION ALL SELECT event_id, 'failed', 'WEL event 1', '4', '3' FROM base
        UNION ALL SELECT event_id, 'failed', 'WEL event 0', '', '' FROM base""",
    "wazuh_events": _events(**_WAZUH_ROWS),
    "wazuh_severity": f"""SELECT CAST({_LEVEL_SEVERITY} AS BIGINT) AS severity,
        count(*) AS events FROM events GROUP BY 1""",
    "wazuh_file_integrity": _events(where="event_id % 7 < 6", **_WAZUH_FILE_ROWS),
    "wazuh_file_failures": f"""SELECT {_COUNTS} FROM (
        SELECT CASE event_id % 7 WHEN 6 THEN 'failed' ELSE 'ok' END AS status FROM events)""",
    "wazuh_category": """
        WITH r AS (SELECT event_id AS row_id, event_type, event_id % 10 AS g,
            CASE event_id % 4 WHEN 0 THEN 'logon' WHEN 1 THEN 'process' ELSE '' END AS w,
            event_id % 3 = 0 AS described FROM events),
        c AS (SELECT *, CASE WHEN g = 0 THEN 1 WHEN w = 'logon' THEN 2
            WHEN g = 1 OR w = 'process' THEN 3 WHEN g = 2 THEN 4 WHEN g = 3 THEN 5 WHEN g = 4 THEN 6
            WHEN g = 5 THEN 7 WHEN g = 6 THEN 8 ELSE 9 END AS rule FROM r)
        SELECT row_id,
          CASE rule WHEN 1 THEN 'authentication' WHEN 2 THEN 'authentication' WHEN 5 THEN 'file'
            WHEN 6 THEN 'network' WHEN 7 THEN 'network' WHEN 8 THEN 'iam' ELSE 'process' END
            AS category,
          CASE WHEN rule <= 3 THEN 'start' WHEN rule IN (5, 8) THEN 'change' WHEN rule = 7
            THEN 'access' ELSE 'info' END AS type,
          CASE WHEN described THEN event_type ELSE CASE rule WHEN 1 THEN 'Authentication event'
            WHEN 2 THEN 'WEL 4634' WHEN 3 THEN 'Process event' WHEN 4 THEN 'Sysmon event'
            WHEN 5 THEN 'File change' WHEN 6 THEN 'Network event' WHEN 7 THEN 'Web event'
            WHEN 8 THEN 'Account change' ELSE 'Wazuh alert' END END AS action
        FROM c""",
    "tag_union": """SELECT event_id AS row_id,
        'T1110|' || event_type || '|x|x|g' || CAST(event_id % 3 AS VARCHAR) AS tags FROM events""",
    "wazuh_documents": """
        SELECT event_id % 3 AS layout, status, count(*) AS records FROM events,
          (VALUES (0, 'ok'), (0, 'ok'), (0, 'failed'), (1, 'ok'), (2, 'ok'), (2, 'dropped'),
                  (2, 'dropped'), (2, 'ok')) AS d(layout_id, status)
        WHERE event_id % 3 = layout_id GROUP BY 1, 2""",
    "cef_events": _events(without=("created",), **_CEF_ROWS),
    "json_events": _events(**_JSON_ROWS),
    "json_documents": """
        SELECT event_id % 3 AS layout, status, count(*) AS records,
          CAST(sum(has_user) AS BIGINT) AS with_user, CAST(sum(has_pid) AS BIGINT) AS with_pid
        FROM events,
          (VALUES (0, 'ok', 1, 0), (1, 'ok', 1, 1), (2, 'ok', 1, 0), (2, 'ok', 1, 0),
                  (2, 'dropped', 0, 0), (2, 'failed', 0, 0)) AS d(layout_id, status, has_user, has_pid)
        WHERE event_id % 3 = layout_id GROUP BY 1, 2""",
    "cef_extensions": f"""WITH base AS ({_BASE})
        SELECT event_id AS row_id, 'src' AS key, ip AS value FROM base
        UNION ALL SELECT event_id, 'request', 'http://x?' FROM base
        UNION ALL SELECT event_id, 'a', '1' FROM base
        UNION ALL SELECT event_id, 'msg', 'two ' || event_type FROM base
        UNION ALL SELECT event_id, 'suser', usr FROM base
        UNION ALL SELECT event_id, 'empty', '' FROM base""",
    "cef_last_alias": f"""WITH base AS ({_BASE})
        SELECT event_id AS row_id,
          CASE event_id % 2 WHEN 0 THEN event_type ELSE usr END AS action,
          CAST(least(event_id % 130, 100) AS BIGINT) AS severity, 'Acme' AS tool FROM base""",
    "cef_severity": """SELECT event_id AS row_id, CAST(CASE WHEN event_id % 5 = 0 THEN 0
        ELSE least(100, event_id % 14 * 10) END AS BIGINT) AS severity FROM events""",
    "cef_category": """SELECT event_id AS row_id,
        CASE event_id % 7 WHEN 0 THEN 'network' WHEN 1 THEN 'authentication' WHEN 2 THEN 'process'
          WHEN 3 THEN 'file' WHEN 4 THEN 'intrusion_detection'
          ELSE CASE event_id % 2 WHEN 0 THEN 'network' ELSE 'process' END END AS category,
        CASE event_id % 7 WHEN 0 THEN CASE event_id % 2 WHEN 0 THEN 'connection' ELSE 'info' END
          WHEN 1 THEN 'start' WHEN 2 THEN 'start' WHEN 3 THEN 'change' ELSE 'info' END AS type
        FROM events""",
    "outcome_words": """SELECT event_id AS row_id, CASE WHEN event_id % 8 < 3 THEN 'success'
        WHEN event_id % 8 < 5 THEN 'failure' WHEN event_id % 8 = 5 THEN 'failure'
        WHEN event_id % 8 = 7 AND event_type = 'error' THEN 'failure'
        ELSE 'unknown' END AS outcome FROM events""",
    "hash_fields": """SELECT event_id AS row_id, 'ab' || CAST(event_id AS VARCHAR) AS md5,
        CASE event_id % 2 WHEN 0 THEN 'cd' || CAST(event_id AS VARCHAR) ELSE 'x' END AS sha256
        FROM events""",
    "split_account": f"""WITH base AS ({_BASE}) SELECT event_id AS row_id,
        CASE event_id % 3 WHEN 0 THEN 'CORP' WHEN 1 THEN '' ELSE 'A' END AS user_domain,
        CASE event_id % 3 WHEN 2 THEN 'B' || {_BACKSLASH} || usr ELSE usr END AS user_name
        FROM base""",
    "path_parts": f"""SELECT event_id AS row_id,
        CASE event_id % 4 WHEN 0 THEN event_type || '.tar.gz' WHEN 1 THEN event_type
          WHEN 2 THEN event_type || '.' ELSE '' END AS file_name,
        CASE event_id % 4 WHEN 0 THEN 'gz' ELSE '' END AS extension,
        CASE event_id % 4 WHEN 0 THEN 'C:' || {_BACKSLASH} || 'Temp' || {_BACKSLASH} || event_type
          || '.tar.gz' WHEN 1 THEN event_type WHEN 2 THEN event_type || '.' ELSE '' END
          AS posix_name
        FROM events""",
    "safe_int": """SELECT event_id AS row_id, CAST(CASE event_id % 6 WHEN 0 THEN event_id
        WHEN 1 THEN event_id WHEN 5 THEN -event_id END AS BIGINT) AS number FROM events""",
    "technique_tags": """SELECT event_id AS row_id, CASE event_id % 4
        WHEN 0 THEN 'T' || CAST(event_id AS VARCHAR) WHEN 1 THEN 'T1|T2=3' ELSE '' END AS tags
        FROM events""",
    "mixed_sources": f"""{_MIXED} SELECT event_id AS row_id, source_type, status,
        {_MIXED_ACTION} AS action,
        {_case(_SIX, _SYSLOG['user_name'], "usr", "usr", "usr", "usr", otherwise="''")}
          AS user_name,
        {_case(_SIX, _SYSLOG['src_ip'], "ip", "''", "''", "ip", otherwise="''")} AS src_ip,
        CAST({_MIXED_SEVERITY} AS BIGINT) AS severity
        FROM mixed LEFT JOIN {_SYSMON} ON m.code = 1 + event_id % 30""",
    "staged_sources": f"{_MIXED} SELECT lower(source_type) AS source_type, {_COUNTS} FROM mixed GROUP BY 1",
    "outcome_counts": f"{_MIXED} SELECT source_type, {_COUNTS} FROM mixed GROUP BY 1",
    "session_rollup": f"""{_MIXED} SELECT session_id, min(lower(source_type)) AS source_type,
        session_id || '.log' AS filename, '2024-02-01T00:00:00.000Z' AS created_at,
        count(*) FILTER (WHERE status = 'ok') AS success,
        count(*) FILTER (WHERE status = 'failed') AS failed, count(*) AS total
        FROM mixed GROUP BY session_id HAVING count(*) FILTER (WHERE status = 'ok') > 0""",
    "stable_ids": f"""WITH base AS ({_BASE}), lines AS (
        SELECT 's' || CAST(event_id % 2 AS VARCHAR) AS session_id,
          CASE WHEN event_id % 3 = 0 THEN 'same line' ELSE usr || ' ' || event_type END AS raw
        FROM base)
        SELECT session_id, raw, count(*) AS ids, count(*) AS records FROM lines GROUP BY 1, 2""",
    "flat_events": f"""{_STORED} SELECT {_LISTED}, event_action AS json_action,
        host_name AS json_host, src_ip AS json_ip, tags AS json_tag FROM stored""",
    "export_rows": f"""{_STORED} SELECT event_id, created_at AS created, source_type,
        substr(category, 3, length(category) - 4) AS category, event_action AS action, outcome,
        severity, host_name, user_name, process_name, command_line AS process_cmdline, src_ip,
        dst_ip, '' AS dst_port, tags FROM stored""",
    "export_json": f"""{_STORED} SELECT event_id,
        'schema_version|event|host|process' || CASE WHEN src_ip <> '' THEN '|network' ELSE '' END
          || CASE WHEN user_name <> '' THEN '|user' ELSE '' END || '|log|tags' AS sections,
        'id|created|outcome|severity|source_type|category|type|action' AS event_keys, pid
        FROM stored""",
    "event_long": _long(
        ("Event", "event.id", "event_id"), ("Event", "event.created", "created_at"),
        ("Event", "event.source_type", "source_type"),
        ("Event", "event.category", "substr(category, 3, length(category) - 4)"),
        ("Event", "event.type", "type"), ("Event", "event.action", "event_action"),
        ("Event", "event.outcome", "outcome"), ("Event", "event.severity", "severity"),
        ("Host", "host.name", "host_name"), ("Host", "host.os.type", "'linux'"),
        ("Process", "process.pid", "pid"), ("Process", "process.name", "process_name"),
        ("Process", "process.command_line", "command_line"),
        ("Network", "network.src.ip", "src_ip"), ("Network", "network.src.port", "src_port"),
        ("User", "user.name", "user_name"), ("Tags", "tags", "tags"),
    ),
    "severity_bands": """SELECT event_id AS row_id, CASE WHEN event_id % 120 >= 80 THEN 'critical'
        WHEN event_id % 120 >= 50 THEN 'high' WHEN event_id % 120 >= 30 THEN 'medium'
        WHEN event_id % 120 > 10 THEN 'low' ELSE 'info' END AS band FROM events""",
    "principal": f"""{_STORED} SELECT event_id, CASE WHEN number % 3 = 0 THEN process_name
        WHEN number % 3 = 1 AND user_name <> '' THEN user_name ELSE src_ip END AS principal
        FROM stored""",
    "display_time": f"""{_STORED} SELECT event_id,
        substr(created_at, 1, 10) || ' ' || substr(created_at, 12, 8) AS shown,
        '  ' || created_at || 'TZ' AS odd FROM stored""",
    "field_catalog": f"{_STORED} {_CATALOG_ROWS}",
    "source_catalog": f"{_MIXED} {_SOURCE_ROWS}",
    "filter_source": f"""{_MIXED} SELECT session_id, event_type AS event_action, ip AS src_ip,
        '192.168.0.' || CAST(user_id % 256 AS VARCHAR) AS dst_ip,
        CAST(event_id % 11 * 10 AS BIGINT) AS severity FROM mixed WHERE source_type = 'cef'""",
    "filter_host": f"{_STORED} SELECT {_LISTED} FROM stored WHERE host_name = 'host3'",
    "filter_session": f"{_STORED} SELECT {_LISTED} FROM stored WHERE session_id = 's5'",
    "search_events": f"""{_STORED} SELECT {_LISTED} FROM stored WHERE event_action LIKE '%u1%2%'
        OR host_name LIKE '%u1%2%' OR process_name LIKE '%u1%2%' OR user_name LIKE '%u1%2%'
        OR src_ip LIKE '%u1%2%'""",
    "insert_bucketed": f"{_STORED} SELECT {_LISTED} FROM stored",
    "search_indexed": f"""{_STORED} SELECT {_LISTED} FROM stored WHERE event_action LIKE '%name=u1%2%'""",
    "events_between": f"""{_STORED} SELECT event_id, created_at, event_action FROM stored
        WHERE created_at >= '2024-01-10T06:00:00' AND created_at < '2024-01-10T09:30:00'""",
    "search_count": f"""{_STORED} SELECT count(*) AS total FROM stored
        WHERE contains(event_action, 'root') OR contains(user_name, 'root')""",
    "page_count": f"""{_STORED} SELECT count(*) AS total,
        CAST(greatest(1, ceil(count(*) / 50.0)) AS BIGINT) AS pages
        FROM stored WHERE host_name = 'host1'""",
    "events_page": f"""{_STORED} SELECT {_LISTED} FROM stored
        ORDER BY indexed_at DESC, event_id LIMIT 50 OFFSET 100""",
    "events_deep_page": f"""{_STORED} SELECT {_LISTED.replace('indexed_at', 'substr(indexed_at, 1, 9) AS indexed_at')}
        FROM stored ORDER BY substr(stored.indexed_at, 1, 9) DESC, event_id LIMIT 70 OFFSET 770""",
    "directory_page": f"""{_STORED} SELECT {_LISTED} FROM stored
        ORDER BY indexed_at DESC, event_id LIMIT 50 OFFSET 100""",
    "directory_deep_page": f"""{_STORED}
        SELECT {_LISTED.replace('indexed_at', "'2024-02-01T00:00:00.000Z' AS indexed_at")}
        FROM stored ORDER BY event_id LIMIT 70 OFFSET 770""",
    "directory_count": f"""{_STORED} SELECT count(*) AS total,
        CAST(greatest(1, ceil(count(*) / 50.0)) AS BIGINT) AS pages FROM stored""",
    "get_event": f"""{_STORED} SELECT event_id, event_action AS action, src_port, tags
        FROM stored WHERE event_id = '17'""",
    "export_newest": f"""{_STORED} SELECT {_LISTED} FROM stored
        ORDER BY indexed_at DESC, event_id LIMIT 300""",
    "export_session": f"{_STORED} SELECT event_id, event_action FROM stored WHERE session_id = 's5'",
    "sessions_latest": f"""{_STORED} SELECT session_id, 'syslog' AS source_type, '' AS filename,
        min(indexed_at) AS created_at, {_SESSION_SUMS} FROM stored GROUP BY session_id
        ORDER BY created_at DESC, session_id LIMIT 5""",
    "first_event": f"""{_STORED} SELECT event_id, event_action FROM stored
        ORDER BY created_at, event_id LIMIT 1""",
    "insert_if_absent": f"""{_STORED} SELECT event_id, event_action, session_id FROM stored
        WHERE number % 2 = 0 AND number % 3 <> 0""",
    "session_upsert": f"""{_STORED},
        old AS (SELECT session_id, count(*) AS n FROM stored WHERE number % 13 < 9 GROUP BY 1),
        new AS (SELECT session_id, count(*) AS n FROM stored
                WHERE number % 13 >= 5 AND number % 2 = 0 GROUP BY 1)
        SELECT coalesce(old.session_id, new.session_id) AS session_id, 'syslog' AS source_type,
          CASE WHEN old.session_id IS NULL THEN 'new' ELSE 'old' END AS filename,
          CASE WHEN old.session_id IS NULL THEN '2024-02-02T00:00:00.000Z'
            ELSE '2024-02-01T00:00:00.000Z' END AS created_at,
          coalesce(new.n, old.n) AS total_events, CAST(0 AS BIGINT) AS failed_count
        FROM old FULL JOIN new ON old.session_id = new.session_id""",
    "truncated_original_log": f"""{_STORED} SELECT event_id AS row_id,
        CASE WHEN length({_MESSAGE}) > 20 THEN substr({_MESSAGE}, 1, 20) || '…'
          ELSE {_MESSAGE} END AS message, process_name AS process FROM stored""",
    "dropped_original_log": f"""{_STORED} SELECT event_id AS row_id,
        'source_type|source_tool' AS keys FROM stored""",
    "write_read_back": f"{_STORED} SELECT {_LISTED} FROM stored",
    "sessions_saved": f"""{_STORED} SELECT session_id, 'syslog' AS source_type, 'f' AS filename,
        'a' AS created_at, {_SESSION_SUMS} FROM stored GROUP BY session_id""",
    "dead_letter": f"""SELECT event_id AS row_id, 'failed' AS status, 'no event code' AS error
        FROM events WHERE {_SIX} = 5""",
    "fallback_load": f"""{_STORED} SELECT session_id, 'syslog' AS source_type, count(*) AS events,
        CAST(0 AS BIGINT) AS failed FROM stored GROUP BY session_id""",
    "clear_session": f"""{_STORED} SELECT session_id, count(*) AS events,
        (SELECT count(*) FROM stored WHERE session_id = 's3') AS removed
        FROM (SELECT session_id FROM stored UNION ALL SELECT NULL FROM stored)
        WHERE session_id IS DISTINCT FROM 's3' GROUP BY session_id""",
    "clear_all": "SELECT CAST(0 AS BIGINT) AS left_over, count(*) AS removed FROM events",
    "syslog_files": f"""{_STORED} SELECT process_name AS process, 'ok' AS status,
        count(*) AS events, CAST(sum(src_port) AS BIGINT) AS port_sum FROM stored GROUP BY 1""",
    "sysmon_files": f"""SELECT
        coalesce(m.action, 'Sysmon event ' || CAST(1 + event_id % 30 AS VARCHAR)) AS event_action,
        'ok' AS status, count(*) AS events, CAST(sum(event_id) AS BIGINT) AS pid_sum
        FROM events LEFT JOIN {_SYSMON} ON m.code = 1 + event_id % 30 GROUP BY 1""",
    "wel_files": f"""WITH base AS ({_BASE}) SELECT CAST({_WEL_CODE} AS VARCHAR) AS code,
        CASE {_SIX} WHEN 5 THEN 'failed' ELSE 'ok' END AS status, count(*) AS events,
        CAST(sum(event_id) AS BIGINT) AS pid_sum,
        'said "' || max(usr) || '",' || chr(10) || 'then left' AS last_message
        FROM base GROUP BY 1, 2""",
    "wel_split_files": f"""WITH base AS ({_BASE}), long AS (SELECT *,
        repeat('said "' || usr || '",' || chr(10) || 'then left' || chr(10), 60) AS m FROM base)
        SELECT CAST({_WEL_CODE} AS VARCHAR) AS code,
        CASE {_SIX} WHEN 5 THEN 'failed' ELSE 'ok' END AS status, count(*) AS events,
        CAST(sum(event_id) AS BIGINT) AS pid_sum, CAST(sum(length(m) - 1) AS BIGINT) AS characters,
        left(max(m), -1) AS last_message
        FROM long GROUP BY 1, 2""",
    "json_array_files": f"""SELECT {_JSON_ROWS['outcome']} AS outcome, count(*) AS events,
        CAST(sum(event_id % 150) AS BIGINT) AS severity_sum, count(*) AS good FROM events GROUP BY 1""",
    "invalid_utf8": """SELECT event_id AS row_id, 'caf' || chr(65533) AS message, 'ok' AS status FROM events""",
    "wel_line_files": f"""WITH base AS ({_BASE}) SELECT mode, CAST({_WEL_CODE} AS VARCHAR) AS code,
        CASE {_SIX} WHEN 5 THEN 'failed' ELSE 'ok' END AS status, count(*) AS events,
        CAST(sum(event_id) AS BIGINT) AS pid_sum
        FROM base, (VALUES ('whole'), ('lines')) AS m(mode) GROUP BY 1, 2, 3""",
    "json_files": f"""SELECT mode, outcome, count(*) AS events,
        CAST(sum(event_id % 150) AS BIGINT) AS severity_sum
        FROM (SELECT event_id, {_JSON_ROWS['outcome']} AS outcome FROM events),
          (VALUES ('lines'), ('documents')) AS m(mode) GROUP BY 1, 2""",
    "file_size_guard": """SELECT CASE WHEN event_id % 10 = 0 THEN 'rejected' ELSE 'kept' END AS part,
        count(*) AS records FROM events GROUP BY 1""",
}
ORACLES["export_csv"] = ORACLES["export_rows"]
