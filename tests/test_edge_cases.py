"""Single records with results worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from logweave.functions.shape import truncate_original_log
from logweave.operators import dispatch, flat, store
from logweave.sources import records, wel
from logweave.sources.cef import normalize_cef
from logweave.sources.sysmon import normalize_sysmon
from logweave.sources.syslog import normalize_syslog
from logweave.sources.wazuh import normalize_wazuh

HEAD = "Apr  3 01:02:03 h "
NS = 'xmlns="http://schemas.microsoft.com/win/2004/08/events/event"'


def run(spark, job, raw, documents=None, **options):
    """Status and event (as a dict) of every record in the text."""
    df = spark.createDataFrame([(raw,)], "raw STRING")
    if documents:
        df = documents(df)
    rows = job(df, **options).select("_status", flat.event_json().alias("event")).collect()
    return [(r["_status"], json.loads(r["event"])) for r in rows]


def at(event, path):
    for part in path.split("."):
        event = event.get(part) if isinstance(event, dict) else None
    return event


def check(got, status, expected):
    assert got[0] == status
    for path, value in expected.items():
        assert at(got[1], path) == value, path


def sysmon_xml(data="", event_id="1", attributes="", name="Event"):
    return (
        f"<{name} {attributes}><System><EventID>{event_id}</EventID><Computer>pc</Computer>"
        f'<TimeCreated SystemTime="2024-01-01T00:00:00Z"/></System><EventData>{data}</EventData></{name}>'
    )


def data(**values):
    return "".join(f'<Data Name="{k}">{v}</Data>' for k, v in values.items())


SYSLOG = [
    (HEAD + "sshd[9]: Accepted password for bob from 1.2.3.4 port 22 ssh2", "ok", {
        "event.created": "2023 Apr 03 01:02:03", "event.action": "SSH accepted (password)",
        "event.severity": 0, "event.outcome": "success", "network.source.port": 22,
        "tags": ["T1021.004"], "process.pid": 9, "log.original_log.host": "h"}),
    (HEAD + "sshd[9]: Invalid user eve from 1.2.3.4 port 5", "ok", {
        "event.action": "SSH invalid user", "event.severity": 35, "event.outcome": "failure",
        "network.source.port": None, "tags": ["T1110"]}),
    (HEAD + "sshd[9]: pam_unix(sshd:session): session opened for user bob", "ok", {
        "event.category": ["network"], "event.type": ["info"],
        "event.action": "sshd: pam_unix(sshd:session): session opened for user bob"}),
    (HEAD + "CRON[9]: pam_unix(cron:session): session opened for user root", "ok", {
        "event.action": "PAM session opened (cron)", "user.name": "root"}),
    (HEAD + "usermod[9]: change user 'bob'", "ok", {
        "event.category": ["iam"], "event.type": ["creation"], "event.severity": 25,
        "user": None, "tags": ["T1136"]}),
    ("2024-01-01 12:00:00 h p[1]: m", "ok", {"event.created": "2024-01-01 12:00:00"}),
    ("<34>1 2024-01-01T00:00:00Z h app 12 ID1 - hello", "ok", {
        "log.original_log.msg": "- hello", "process.pid": 12}),
    ("<34>Oct 11 22:14:15 h su: x", "dropped", {}),
    (HEAD + "sshd[9]: Accepted password for b from fe80::1 port 22", "ok", {
        "event.category": ["network"], "event.type": ["info"]}),
    (HEAD + "su: Successful su for root by bob", "ok", {"event.action": "su to root by bob"}),
    (HEAD + "su: nothing known", "ok", {"event.action": "su: nothing known"}),
    (HEAD + "systemd-cron[1]: Failed x.service.", "ok", {
        "event.action": "systemd: Failed x.service", "event.severity": 10,
        "event.outcome": "failure"}),
    (HEAD + "cron: Started x.", "ok", {"event.action": "cron: Started x."}),
    (HEAD + "sshd: Failed none for u from 1.1.1.1 port 1 Accepted x for y from 2.2.2.2 port 2",
     "ok", {"event.action": "SSH accepted (x)", "user.name": "y"}),
    (HEAD + "kernel: " + "é" * 120, "ok", {"event.action": "kernel: " + "é" * 120}),
]


@pytest.mark.parametrize("raw, status, expected", SYSLOG)
def test_syslog(spark, raw, status, expected):
    [got] = run(spark, normalize_syslog, raw, default_year=2023)
    check(got, status, expected)


SYSMON = [
    (sysmon_xml(attributes=NS), ["ok"], {"event.action": "Process created"}),
    (sysmon_xml(attributes=NS) * 2, ["ok", "ok"], {}),
    ("<Event><System></Event>", ["dropped"], {}),
    ("<Event><Foo/></Event>", ["failed"], {}),
    (sysmon_xml(event_id="x"), ["ok"], {
        "event.action": "Sysmon event 0", "event.type": ["info"],
        "event.original_event_id": "0", "log.original_log.EventID": "x"}),
    (sysmon_xml(data(RuleName="technique_id=T1055"), "8"), ["ok"], {"tags": ["T1055", "T1055"]}),
    (sysmon_xml(data(Image=r"C:\Windows\a.exe")), ["ok"], {"process.name": "a.exe"}),
    (sysmon_xml(data(QueryName="x.com", DestinationHostname="y"), "22"), ["ok"], {
        "network.destination.domain": "x.com"}),
    (sysmon_xml(data(ParentProcessId="7", TargetFileName="/a/b.tar.gz"), "11"), ["ok"], {
        "process.ppid": 7, "process.parent.pid": 7, "file.name": "b.tar.gz",
        "file.extension": "gz"}),
    (sysmon_xml(data(Details="d", TargetObject="k"), "12"), ["ok"], {
        "registry.path": "k", "registry.value.data": "d",
        "event.type": ["creation", "deletion"]}),
    ('<?xml version="1.0"?><Events>' + sysmon_xml() + "</Events>", ["ok"], {}),
]


@pytest.mark.parametrize("raw, statuses, expected", SYSMON)
def test_sysmon(spark, raw, statuses, expected):
    got = run(spark, normalize_sysmon, raw, records.sysmon_records)
    assert [s for s, _ in got] == statuses
    check(got[0], statuses[0], expected)


def test_posix_paths(spark):
    [got] = run(spark, normalize_sysmon, sysmon_xml(data(Image=r"C:\W\a.exe")), path_style="posix")
    assert at(got[1], "process.name") == r"C:\W\a.exe"


WEL = [
    ("Id\n0\nx\n\n", ["failed", "failed"], {}),
    ("Id,LogonType\n4624,10", ["ok"], {"event.action": "User logon (remoteinteractive)"}),
    ("Id,LogonType\n4624,99", ["ok"], {"event.action": "User logon (type-99)"}),
    ("Id,LogonType\n4624,", ["ok"], {"event.action": "User logon"}),
    ("Id,IpAddress\n4688,1.2.3.4", ["ok"], {"network": None}),
    ("Id,Message\n4624,a,b", ["failed"], {}),
    ("Id,Message,IpAddress\n4624,a", ["ok"], {"log.original_log.Message": "a"}),
    (" Id\n4624", ["ok"], {}),
    ("Id,NewProcessId\n4688,0x1a4", ["ok"], {"process": None}),
    ("Id,TargetUserName\n4624,CORP\\bob", ["ok"], {"user.domain": "CORP", "user.name": "bob"}),
    ('Id,Message\n4624,"a ""b"", c\nd"\n4625,x', ["ok", "ok"], {
        "log.original_log.Message": 'a "b", c\nd'}),
    ('Id,Message\n4624,5" disk\n4625,y', ["ok", "ok"], {"log.original_log.Message": '5" disk'}),
    ("eventid,cmdline\n4688,run", ["ok"], {"process.command_line": "run"}),
    ("Id,Message\n4624," + "m" * 300, ["ok"], {"log.original_log.Message": "m" * 300}),
]


@pytest.mark.parametrize("raw, statuses, expected", WEL)
def test_wel(spark, raw, statuses, expected):
    got = run(spark, wel.normalize_wel, raw, wel.rows_from_text)
    assert [s for s, _ in got] == statuses
    check(got[0], statuses[0], expected)


def test_wel_long_quoted_cell(spark):
    """Neither length nor many quotes grow the stack of the cell pattern."""
    cell = 'x""\n' * 50_000
    got = run(spark, wel.normalize_wel, f'Id,CommandLine\n4688,"{cell}"', wel.rows_from_text)
    assert at(got[0][1], "process.command_line") == cell.replace('""', '"').strip()


WAZUH = [
    ('{"rule":{"level":20}}', ["ok"], {"event.severity": 90, "event.action": "Wazuh alert"}),
    ('{"rule":{"level":-1}}', ["ok"], {"event.severity": -5}),
    ('{"rule":null}', ["failed"], {}),
    ('{"data":"text"}', ["failed"], {}),
    ('{"data":{"win":null}}', ["failed"], {}),
    ('{"data":{"win":[1]}}', ["failed"], {}),
    ('{"agent":null,"syscheck":5,"data":{"audit":null}}', ["ok"], {}),
    ('{"rule":{"groups":["a","a"],"mitre":{"id":["a"]}}}', ["ok"], {"tags": ["a"]}),
    ('{"rule":{"groups":["a","a"],"mitre":{"id":"T1"}}}', ["ok"], {"tags": ["T1", "a", "a"]}),
    ('{"rule":{"groups":["a",1]}}', ["failed"], {}),
    ('{"rule":{"groups":[null]}}', ["failed"], {}),
    ('{"rule":{"groups":[]}}', ["ok"], {"tags": []}),
    ('{"rule":{"groups":["q\\"],[","b"]}}', ["ok"], {"tags": ['q"],[', "b"]}),
    ('{"rule":{"groups":3}}', ["failed"], {}),
    ('{"rule":{"groups":null}}', ["ok"], {}),
    ('{"syscheck":{"event":"modified","path":"/etc/x.conf"}}', ["ok"], {
        "event.category": ["file"], "event.type": ["change"], "event.action": "File modified",
        "file.extension": "conf", "file.name": "x.conf"}),
    ('{"syscheck":{"event":7}}', ["failed"], {}),
    ('no json\n{"rule":\n{"rule":{"id":5}}', ["dropped", "dropped", "ok"], {}),
    ("[5]", ["failed"], {}),
    ('[{"_source":{"rule":{"id":"7"}}},{"_source":null}]', ["ok", "failed"], {
        "event.original_event_id": "7"}),
    ('{"rule":{}} trailing', ["dropped"], {}),
    ('{"a":1,"a":2}', ["failed"], {}),
    ('{"data":{"audit":{"uid":"0","execve":{"a0":"ls"}}}}', ["ok"], {
        "user.name": "0", "process.command_line": "ls"}),
    ('{"data":{"win":{"system":{"eventId":"4688"}}}}', ["ok"], {
        "host.os.type": "windows", "event.outcome": "success", "event.action": "Process event"}),
]


@pytest.mark.parametrize("raw, statuses, expected", WAZUH)
def test_wazuh(spark, raw, statuses, expected):
    got = run(spark, normalize_wazuh, raw, records.wazuh_records)
    assert [s for s, _ in got] == statuses
    check(got[0], statuses[0], expected)


CEF = [
    ("CEF:0|a|b", ["failed"], {}),
    ("Jan 1 h CEF:0|a|b|c|d|e|1|", ["dropped"], {}),
    ("CEF:0|V|P|1|s|N|1|request=http://x?a=1 msg=two words", ["ok"], {
        "event.action": "two words", "log.source_tool": "V/P"}),
    ("CEF:0|V|P|1|s|N|1|act=x msg=", ["ok"], {"event.action": "N"}),
    ("CEF:0|V|P|1|s|N|1|act=x msg=y act=z", ["ok"], {"event.action": "y"}),
    ("CEF:0|V|P|1|s|N|High|", ["ok"], {"event.severity": 0}),
    ("CEF:0|V|P|1|s|N|5|severity=7", ["ok"], {"event.severity": 7}),
    ("CEF:0|V|P|1|s|N|12|filehash=AB", ["ok"], {"event.severity": 100, "file": None}),
    ("CEF:0|||1|s|N|1|", ["ok"], {"log.source_tool": "cef"}),
    ('{"severity":250,"filehash":"AB"}', ["ok"], {
        "event.severity": 250, "file.hash.sha256": "ab"}),
    ('{"status":0}', ["ok"], {"event.outcome": "success"}),
    ('{"status":200}', ["ok"], {"event.outcome": "unknown"}),
    ('{"result":true}', ["ok"], {"event.outcome": "unknown"}),
    ('[{"a":1},5]', ["ok"], {}),
    ('{"a":1,"b":null}', ["ok"], {
        "event.category": ["process"], "event.type": ["info"], "event.action": None}),
    ('{"act":null,"msg":"y","act":"x"}', ["ok"], {"event.action": "y"}),
    ('{"act":"x","msg":null}', ["ok"], {"event.action": "x"}),
    ('{"Src-Port":"80","Host":" h "}', ["ok"], {"network.source.port": 80, "host.name": "h"}),
    ('{"a":{"b":1}}', ["ok"], {"log.original_log.a": '{"b":1}'}),
    ("{broken\ncef:0|V|P|1|s|login|1|\nnoise", ["dropped", "ok", "dropped"], {}),
]


@pytest.mark.parametrize("raw, statuses, expected", CEF)
def test_cef_and_json(spark, raw, statuses, expected):
    got = run(spark, normalize_cef, raw, records.cef_records)
    assert [s for s, _ in got] == statuses
    check(got[0], statuses[0], expected)


def test_original_log_is_whole_unless_cut(spark):
    df = spark.createDataFrame([(json.dumps({"k": "v" * 5000}),)], "raw STRING")
    whole, cut = dispatch.normalize(df, "cef"), dispatch.normalize(df, "cef", original_log_max_chars=100)
    assert whole.select("log.original_log").first()[0] == {"k": "v" * 5000}
    assert cut.select("log.original_log").first()[0] == {"k": "v" * 100 + "…"}
    assert truncate_original_log(normalize_cef(df)).select("log.original_log").first()[0] == {"k": "v" * 5000}


def test_documents_without_records_leave_a_row(spark):
    for source, text in (("sysmon", "garbage"), ("cef", "[5,6]"), ("syslog", " \n "), ("wazuh", "[]")):
        df = spark.createDataFrame([(text, 7)], "raw STRING, event_uid BIGINT")
        rows = dispatch.normalize(df, source).collect()
        assert [r["_status"] != "ok" for r in rows] == [True], source


def test_records_of_a_document_have_ids_of_their_own(spark):
    lines = "\n".join(f"2024-01-01T00:00:0{k}Z h p: m" for k in range(3))
    df = spark.createDataFrame([(lines, "d1"), (lines, "d2")], "raw STRING, event_uid STRING")
    ids = [r[0] for r in dispatch.normalize(df, "syslog").select("event.id").collect()]
    assert sorted(ids) == ["d1", "d1-2", "d1-3", "d2", "d2-2", "d2-3"]


def test_a_load_without_events_leaves_no_session(spark):
    df = spark.createDataFrame([("s", "nonsense")], "session_id STRING, raw STRING")
    assert store.session_rollup(normalize_syslog(df)).count() == 0


def test_unknown_source(spark):
    df = spark.createDataFrame([("x",)], "raw STRING")
    with pytest.raises(ValueError, match="sysmon, wel, wazuh, syslog, cef"):
        dispatch.normalize(df, "netflow")


def test_registered_source(spark):
    dispatch.register_source("Plain", lambda df: normalize_syslog(df))
    try:
        df = spark.createDataFrame([(HEAD + "a: b",)], "raw STRING")
        events = dispatch.normalize(df, "PLAIN", original_log=False)
        assert events.filter("_status = 'ok'").count() == 1
        assert events.select(F.col("log")).schema["log"].dataType.names == [
            "source_type", "source_tool", "original_event_id"]
    finally:
        dispatch._SOURCES.pop("plain")
