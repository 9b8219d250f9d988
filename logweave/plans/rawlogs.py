"""Raw log records made from the rows of the ``events`` table, one per row.

Every row of the table becomes one record, so the work of a query grows with
the table.  ``BASE_SQL`` names the parts of a record; the SQL counterparts of the
queries start from it too and never look at the raw text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.functions.shape import scratch_path

_TWO = "lpad(CAST({}(ts) AS STRING), 2, '0')"

BASE_SQL = f"""
SELECT event_id, event_type, user_id, props,
  CAST(year(ts) AS STRING) || '-' || {_TWO.format('month')} || '-' || {_TWO.format('day')}
    || 'T' || {_TWO.format('hour')} || ':' || {_TWO.format('minute')}
    || ':' || {_TWO.format('second')} || 'Z' AS iso,
  {_TWO.format('hour')} || ':' || {_TWO.format('minute')} || ':' || {_TWO.format('second')} AS clock,
  CASE month(ts) WHEN 1 THEN 'Jan' WHEN 2 THEN 'Feb' WHEN 3 THEN 'Mar' WHEN 4 THEN 'Apr'
    WHEN 5 THEN 'May' WHEN 6 THEN 'Jun' WHEN 7 THEN 'Jul' WHEN 8 THEN 'Aug'
    WHEN 9 THEN 'Sep' WHEN 10 THEN 'Oct' WHEN 11 THEN 'Nov' ELSE 'Dec' END AS mon,
  CAST(day(ts) AS STRING) AS dom,
  'u' || CAST(user_id AS STRING) AS usr,
  'host' || CAST(event_id % 7 AS STRING) AS host,
  '10.0.' || CAST(user_id % 256 AS STRING) || '.' || CAST(event_id % 256 AS STRING) AS ip,
  CAST(event_id AS STRING) AS eid,
  CAST(1024 + event_id % 60000 AS STRING) AS port
FROM {{events}}
"""

SYSLOG_SQL = """
iso || ' ' || host || ' ' || CASE event_id % 8
 WHEN 0 THEN 'sshd[' || eid || ']: Accepted publickey for ' || usr || ' from ' || ip || ' port ' || port || ' ssh2'
 WHEN 1 THEN 'sshd[' || eid || ']: Failed password for invalid user ' || usr || ' from ' || ip || ' port ' || port || ' ssh2'
 WHEN 2 THEN 'sudo: ' || usr || ' : TTY=pts/0 ; PWD=/home/x ; USER=root ; COMMAND=/usr/bin/' || event_type
 WHEN 3 THEN 'CRON[' || eid || ']: (' || usr || ') CMD (run ' || event_type || ')'
 WHEN 4 THEN 'useradd[' || eid || ']: new user: name=' || usr || ', UID=1'
 WHEN 5 THEN 'systemd[1]: Started ' || event_type || '.service.'
 WHEN 6 THEN 'su: FAILED su for root by ' || usr
 ELSE 'kernel: ' || event_type || ' ' || props END
"""

# Time stamps without a year; the branches SYSLOG_SQL does not reach.
SYSLOG_3164_SQL = """
mon || CASE WHEN length(dom) = 1 THEN '  ' ELSE ' ' END || dom || ' ' || clock || ' ' || host || ' '
 || CASE event_id % 9
 WHEN 0 THEN 'sshd[' || eid || ']: Invalid user ' || usr || ' from ' || ip || ' port ' || port
 WHEN 1 THEN 'sshd[' || eid || ']: Disconnected from authenticating user ' || usr || ' ' || ip || ' port ' || port || ' [preauth]'
 WHEN 2 THEN 'sshd[' || eid || ']: Connection closed by ' || ip
 WHEN 3 THEN 'CRON[' || eid || ']: pam_unix(cron:session): session opened for user ' || usr || ' by (uid=0)'
 WHEN 4 THEN 'login[' || eid || ']: pam_unix(login:auth): authentication failure; logname= uid=0 ruser= user=' || usr
 WHEN 5 THEN 'userdel[' || eid || ']: delete user ''' || usr || ''''
 WHEN 6 THEN 'su[' || eid || ']: Successful su for root by ' || usr
 WHEN 7 THEN 'systemd[1]: Failed ' || event_type || '.service.'
 ELSE 'sudo: pam_unix: ' || event_type END
"""

# Lines with a priority; every fifth line is in no layout at all.
SYSLOG_5424_SQL = """
CASE event_id % 5
 WHEN 0 THEN '<34>1 ' || iso || ' ' || host || ' app ' || eid || ' ID47 [x@1 k="v"] opened ' || event_type
 WHEN 1 THEN '<165>1 ' || iso || ' ' || host || ' sshd - ID47 - Accepted password for ' || usr || ' from ' || ip || ' port ' || port
 WHEN 2 THEN '<34>1 ' || iso || ' ' || host || ' app ' || eid || ' ID47 - hello ' || usr
 WHEN 3 THEN '  <34>1 ' || iso || ' ' || host || ' cron ' || eid || ' - (' || usr || ') CMD (' || event_type || ')  '
 ELSE '-- ' || event_type || ' --' END
"""

CEF_SQL = """
'CEF:0|Acme|FW|1.0|' || CAST(100 + event_id % 5 AS STRING) || '|' || event_type || '|' || CAST(event_id % 11 AS STRING)
 || '|src=' || ip || ' spt=' || port || ' dst=192.168.0.' || CAST(user_id % 256 AS STRING) || ' dpt=443 proto=TCP suser=' || usr
 || ' outcome=' || CASE event_id % 3 WHEN 0 THEN 'allowed' WHEN 1 THEN 'Denied' ELSE 'x' END
"""

WEL_COLUMNS = [
    ("TimeCreated", "iso"),
    (
        "Id",
        "CASE event_id % 6 WHEN 0 THEN '4624' WHEN 1 THEN '4625' WHEN 2 THEN '4688' "
        "WHEN 3 THEN '4740' WHEN 4 THEN '9999' ELSE 'n/a' END",
    ),
    ("MachineName", "host"),
    ("TargetUserName", "usr"),
    ("IpAddress", "ip"),
    ("LogonType", "CAST(2 + event_id % 5 AS STRING)"),
    ("NewProcessName", "'/opt/bin/' || event_type || '.exe'"),
    ("NewProcessId", "eid"),
]

WAZUH_SQL = """
'{"timestamp":"' || iso || '","agent":{"name":"' || host || '","ip":"' || ip || '"},"rule":{"id":"'
 || CAST(5700 + event_id % 20 AS STRING) || '","level":' || CAST(event_id % 18 AS STRING) || ',"description":"' || event_type
 || ' alert","groups":["' || CASE event_id % 5 WHEN 0 THEN 'authentication_failed' WHEN 1 THEN 'process_creation'
 WHEN 2 THEN 'firewall' WHEN 3 THEN 'web' ELSE 'other' END || '"],"mitre":{"id":["T1110"]}},"data":{"win":{"system":{"eventID":"'
 || CASE event_id % 3 WHEN 0 THEN '4625' ELSE '' END || '"},"eventdata":{"targetUserName":"' || usr || '"}}}}'
"""

# File integrity alerts inside the wrapper of a search index; every seventh has a broken rule.
WAZUH_FILE_SQL = """
'{"_source":{"timestamp":"' || iso || '","agent":{"name":"' || host || '"},"rule":'
 || CASE event_id % 7 WHEN 6 THEN 'null' ELSE '{"id":' || CAST(550 + event_id % 3 AS STRING)
 || ',"level":"7","groups":["ossec","syscheck","ossec"],"mitre":{"id":"syscheck"}}' END
 || ',"syscheck":{"path":"/etc/' || event_type || '.conf","event":"' || CASE event_id % 4 WHEN 0 THEN 'added'
 WHEN 1 THEN 'modified' WHEN 2 THEN 'Deleted' ELSE 'moved' END
 || '","md5_after":"AB' || eid || '","sha256_before":"CD' || eid || '"},"data":{"audit":{"auid":"' || usr || '"}}}}'
"""

SYSMON_SQL = """
'<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><EventID>'
 || CAST(1 + event_id % 30 AS STRING) || '</EventID><TimeCreated SystemTime="' || iso || '"/><Computer>' || host
 || '</Computer></System><EventData><Data Name="RuleName">technique_id=T1059.001,technique_name=x</Data><Data Name="ProcessId">'
 || eid || '</Data><Data Name="Image">/opt/bin/' || event_type || '.exe</Data><Data Name="Hashes">MD5=AB' || eid || ',SHA256=CD' || eid
 || '</Data><Data Name="User">CORP' || chr(92) || usr || '</Data><Data Name="SourceIp">' || ip || '</Data><Data Name="SourcePort">' || port
 || '</Data><Data Name="Protocol">TCP</Data><Data Name="Initiated">true</Data></EventData></Event>'
"""

JSON_SQL = """
'{"time":"' || iso || '","host":"' || host || '","srcip":"' || ip || '","src-port":' || port || ',"user":"' || usr
 || '","act":"' || event_type || '","status":"' || CASE event_id % 4 WHEN 0 THEN 'allowed' WHEN 1 THEN 'DENIED' WHEN 2 THEN '0' ELSE '200' END
 || '","severity":' || CAST(event_id % 150 AS STRING) || '}'
"""

WEL_DOCUMENT_SQL = (
    "'" + ",".join(name for name, _ in WEL_COLUMNS) + "' || chr(10) || "
    + " || ',' || ".join(f"'\"' || {sql} || '\"'" for _, sql in WEL_COLUMNS)
)

# A load of many sources: the sixth kind is one that nobody supports.
MIXED_SQL = f"""
CASE event_id % 6 WHEN 0 THEN {SYSLOG_SQL} WHEN 1 THEN {CEF_SQL} WHEN 2 THEN {WEL_DOCUMENT_SQL}
 WHEN 3 THEN {WAZUH_SQL} WHEN 4 THEN {SYSMON_SQL} ELSE 'x' END
"""
MIXED_SOURCE_SQL = """
CASE event_id % 6 WHEN 0 THEN 'Syslog' WHEN 1 THEN 'cef' WHEN 2 THEN 'WEL'
 WHEN 3 THEN 'wazuh' WHEN 4 THEN 'sysmon' ELSE 'netflow' END
"""
SESSION_SQL = "'s' || CAST(event_id % 13 AS STRING)"


def events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


# Rows of the table from which one task makes and sorts the records of a load, and the fewest worth a task.
_ROWS_PER_TASK, _ROWS_OF_A_TASK = 500_000, 20_000


def dealt(events: DataFrame) -> DataFrame:
    """``events`` dealt out by time to tasks of bounded size: a small file grows a hundredfold in memory as records."""
    rows, cores = events.count(), events.sparkSession.sparkContext.defaultParallelism
    tasks = max(min(cores, rows // _ROWS_OF_A_TASK), -(-rows // _ROWS_PER_TASK))
    return events.repartitionByRange(tasks, "ts", "event_id") if tasks > 1 else events


# ``monotonically_increasing_id`` has the task above these bits and the row within it in them.
_TASK_BITS = 33


def numbered(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows``, written once, with a ``number`` from 0 on without gaps; and how many they are."""
    spark, folder = rows.sparkSession, scratch_path(rows.sparkSession, "numbered")
    placed = rows.withColumn("_place", F.monotonically_increasing_id())
    placed.write.parquet(folder)
    task = F.shiftright("_place", _TASK_BITS)
    placed = spark.read.schema(placed.schema).parquet(folder).withColumn("_task", task)
    # A row per task.
    tasks = placed.groupBy("_task").agg(F.count(F.lit(1)).alias("_rows"))
    tasks = tasks.withColumn("_end", F.sum("_rows").over(Window.orderBy("_task")))
    count = tasks.agg(F.max("_end")).first()[0] or 0
    within = F.col("_place") - F.shiftleft("_task", _TASK_BITS)
    return placed.join(F.broadcast(tasks), "_task").select(
        *rows.columns, (F.col("_end") - F.col("_rows") + within).alias("number")), count


def base(events: DataFrame) -> DataFrame:
    """The parts of a record, per row of ``events``."""
    return events.sparkSession.sql(BASE_SQL.format(events="{events}"), events=events)


def raw_records(events: DataFrame, record_sql: str, *carried: str) -> DataFrame:
    """``event_id``, the carried expressions and the raw record of every row."""
    return base(events).selectExpr("event_id", *carried, f"{record_sql} AS raw")


def wel_rows(events: DataFrame) -> DataFrame:
    """Windows event rows, split into CSV columns already."""
    return base(events).selectExpr(
        "event_id AS row_id", *[f"{sql} AS {name}" for name, sql in WEL_COLUMNS]
    )


def as_events(lineitem: DataFrame) -> DataFrame:
    """``lineitem`` in the columns of ``events``, for larger runs."""
    return lineitem.selectExpr(
        "l_orderkey * 8 + l_linenumber AS event_id",
        "l_shipdate AS ts",
        "l_suppkey AS user_id",
        "l_returnflag AS event_type",
        "'{}' AS props",
    )
