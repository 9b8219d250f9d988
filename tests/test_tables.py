"""Invariants over whole tables, files, streams and plans."""

import glob
import os
import re
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from logweave import configure
from logweave.functions import ids, text
from logweave.operators import dispatch, flat, page_directory, search, search_index, store
from logweave.plans import queries, rawlogs
from logweave.plans.queries import _mixed_load, _stored, _syslog_load, _write_long
from logweave.schema import EVENT_COLUMNS, event_schema
from logweave.sources import records, sysmon, syslog, wazuh, wel
from logweave.streaming import pipeline

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_schema_of_every_source(spark):
    for name in dispatch.supported_sources():
        df = spark.createDataFrame([("x",)], "raw STRING")
        events = dispatch.normalize(df, name, id_mode="content").select(*EVENT_COLUMNS)
        assert [(f.name, f.dataType.simpleString()) for f in events.schema] == [
            (f.name, f.dataType.simpleString()) for f in event_schema()
        ]


def test_required_fields_and_no_empty_structs(spark):
    events = _mixed_load(spark, SF_DIR).filter("_status = 'ok'")
    missing = ["schema_version", "event.id", "event.created", "event.source_type",
               "log.source_type", "tags"]

    def structs(kind, prefix=""):
        for field in kind.fields:
            if isinstance(field.dataType, StructType):
                yield prefix + field.name, field.dataType
                yield from structs(field.dataType, prefix + field.name + ".")

    empty = [
        F.count_if(
            F.col(path).isNotNull()
            & F.coalesce(*[F.col(f"{path}.{c}").cast("string") for c in kind.names]).isNull()
        ).alias(path)
        for path, kind in structs(event_schema())
    ]
    [row] = events.agg(
        *[F.count_if(F.col(path).isNull()).alias("no " + path) for path in missing], *empty
    ).collect()
    assert {k: v for k, v in row.asDict().items() if v} == {}


def test_outcomes_add_up(spark):
    events = _mixed_load(spark, SF_DIR)
    [row] = dispatch.outcome_counts(events).collect()
    assert row["total"] + row["dropped"] == 1000


def test_ids_repeat_and_number_copies(spark, monkeypatch):
    monkeypatch.setattr(ids, "_COPIES_PER_TASK_ROW", 7)
    lines = spark.range(200).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'same' WHEN id % 3 = 1 THEN NULL ELSE concat('l', id) END AS raw",
        "'s' AS session_id",
    )
    first = {tuple(r) for r in ids.with_event_ids(lines).collect()}
    again = {tuple(r) for r in ids.with_event_ids(lines.repartition(5)).collect()}
    assert len(first) == 200 and first == again
    assert len({r[2] for r in first}) == 200
    monkeypatch.setattr(ids, "_COPIES_PER_TASK_ROW", 100_000)
    assert {tuple(r) for r in ids.with_event_ids(lines).collect()} == first


def test_far_pages_equal_near_ones(spark):
    rows = _stored(spark, SF_DIR).withColumn("indexed_at", F.substring("indexed_at", 1, 9)).cache()
    for page in (1, 7, 14, 15, 99):
        ordered = rows.orderBy(F.desc("indexed_at"), "event_id")
        want = search.listing(ordered.offset((page - 1) * 70).limit(70)).collect()
        assert search.events_page(rows, page, 70).collect() == want
    assert search.page_limits(3, 999) == (1998, 999)
    for wrong in ((0, 5), (1, 0)):
        with pytest.raises(ValueError):
            search.page_limits(*wrong)


@pytest.mark.parametrize("term, hit, miss", [
    ("a%c", "xabcx", "ca"), ("a_c", "abc", "ac"), ("a\\%c", "a%c", "abc"),
    ("a\\bc", "abc", "a\\bc"), ("a\\\\b", "a\\b", "ab"), ("A", "A", "a"),
])
def test_like_terms(spark, term, hit, miss):
    df = spark.createDataFrame([(hit,), (miss,)], "v STRING")
    assert [r[0] for r in df.filter(F.col("v").like(text.like_term(term))).collect()] == [hit]


def test_filters_are_not_computed_twice(spark):
    """A search over fresh events keeps one pass of the patterns."""
    fresh = store.stored_rows(_syslog_load(spark, SF_DIR), F.col("iso"))
    found = search.find_events(fresh, search="root", host_name="host")
    assert plan(found).count("Accepted (") == 1


def test_plans_without_shuffle(spark):
    events = syslog.normalize_syslog(rawlogs.raw_records(
        rawlogs.events_table(spark, SF_DIR), rawlogs.SYSLOG_SQL))
    assert "Exchange" not in plan(events)
    coded = sysmon.normalize_sysmon(rawlogs.raw_records(
        rawlogs.events_table(spark, SF_DIR), rawlogs.SYSMON_SQL))
    assert "BroadcastHashJoin" in plan(coded) and "SortMergeJoin" not in plan(coded)


def test_stored_scan_prunes(spark, tmp_path):
    path = str(tmp_path / "events")
    store.write_events(_stored(spark, SF_DIR), path)
    table = store.read_events(spark, path)
    found = search.find_events(table, source_type="syslog", session_id="s1").select("event_id")
    text_plan = plan(found)
    assert "PartitionFilters: [isnotnull(source_type" in text_plan
    assert "EqualTo(session_id,s1)" in text_plan
    assert "ReadSchema: struct<event_id:string,session_id:string>" in text_plan


def test_fallback_and_switches(spark, tmp_path):
    load = _syslog_load(spark, SF_DIR)
    blocked = tmp_path / "file"
    blocked.write_text("in the way")
    assert not store.save_events(load, str(tmp_path / "none"), save=False)
    aside = str(tmp_path / "aside")
    assert not store.save_events(load, str(blocked / "events"), fallback_path=aside)
    assert spark.read.json(aside).count() == 1000
    with pytest.raises(Exception):
        store.save_events(load, str(blocked / "events"))


def test_missing_path(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        records.read_lines(spark, str(tmp_path / "nothing"))


def test_invalid_utf8_and_large_files(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"Apr  3 01:02:03 h p: caf\xe9\r\n\r\n")
    (tmp_path / "b.log").write_bytes(b"x" * 200_000)
    path = str(tmp_path / "*.log")
    kept = records.read_lines(spark, path, max_file_mb=0.1)
    [row] = syslog.normalize_syslog(kept).select("event.action").collect()
    assert row[0] == "p: caf\ufffd"
    [rejected] = records.rejected_files(spark, path, 0.1).collect()
    assert rejected["source_file"].endswith("b.log") and rejected["file_size"] == 200_000


def test_csv_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Id,Message\n4624,"x\ny"\n4625\n4688,m,extra\n')
    rows = records.read_wel(spark, str(tmp_path / "a.csv"), multi_line=True)
    events = wel.normalize_wel(rows)
    got = {r[0]: (r[1], r[2]) for r in events.select(
        "event.original_event_id", "_status", F.col("log.original_log")["Message"]).collect()}
    assert got == {"4624": ("ok", "x\ny"), "4625": ("ok", ""), "4688": ("failed", "m")}


@pytest.mark.parametrize("multi_line", [False, True])
def test_csv_headers_of_each_file(spark, tmp_path, multi_line):
    files = {"a": "Id,Computer,User\n4624,h,u\n", "b": "User,Id,Computer\nu,4624,h\n",
             "c": "id,Id,Computer\n1,4624,h\n", "d": "Id,Computer,Computer\n4624,x,h\n",
             "e": "Id,Computer\n4624,h,\n4624,h\n"}
    for name, text_ in files.items():
        (tmp_path / f"{name}.csv").write_text(text_)
    read = records.read_wel(spark, str(tmp_path / "*.csv"), multi_line=multi_line)
    texts = spark.createDataFrame([(n, t) for n, t in files.items()], "source_file STRING, raw STRING")

    def got(rows):
        events = wel.normalize_wel(rows).select("source_file", "_status", "host.name", "event.original_event_id")
        return sorted((r[0][-5:].removesuffix(".csv")[-1], *r[1:]) for r in events.collect())

    assert got(read) == got(records.wel_records(texts))
    assert [r[1:3] for r in got(read)] == [("ok", "h")] * 4 + [("failed", "h"), ("ok", "h")]


def test_csv_cells_with_breaks_are_whole_by_default(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Id,Message\n4624,"x\n4688,y\nz"\n4625,z\n')
    events = wel.normalize_wel(records.read_wel(spark, str(tmp_path / "a.csv")))
    got = events.select("event.original_event_id", "_status", F.col("log.original_log")["Message"]).collect()
    assert sorted(map(tuple, got)) == [("4624", "ok", "x\n4688,y\nz"), ("4625", "ok", "z")]


def test_open_quote_fails_by_line(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Id,Message\n4624,"x\ny"\n4625,z\n')
    events = wel.normalize_wel(records.read_wel(spark, str(tmp_path / "a.csv"), multi_line=False))
    assert sorted(r[0] for r in events.select("_status").collect()) == ["failed", "failed", "ok"]


def test_repeated_keys_are_read_where_configured(spark):
    alert = '{"rule":{"level":3,"level":7,"groups":["a"]},"agent":{"name":"h"},"agent":{"name":"g"}}'
    session = spark.newSession()
    configure(session)
    [row] = wazuh.normalize_wazuh(session.createDataFrame([(alert,)], "raw STRING")).select(
        "_status", "host.name", "event.severity").collect()
    assert tuple(row) == ("ok", "g", 35)


def test_mixed_input_is_read_once(spark):
    text_plan = plan(_mixed_load(spark, SF_DIR))
    scans = re.findall(r"PartitionFilters: \[isnotnull\(_source_key#\d+\), \(_source_key#\d+ = (\w+)\)", text_plan)
    assert "events.parquet" not in text_plan and sorted(scans) == sorted(dispatch.supported_sources())


def test_pretty_json(spark):
    [row] = store.export_json(_syslog_load(spark, SF_DIR).limit(1), pretty=True).collect()
    assert row[0].startswith('{\n  "schema_version"')


def test_batch_equals_stream(spark, tmp_path):
    raw = rawlogs.raw_records(rawlogs.events_table(spark, SF_DIR), rawlogs.SYSLOG_5424_SQL)
    source = str(tmp_path / "in")
    raw.select("raw").union(raw.select("raw").limit(3)).repartition(3).write.text(source)

    batch = dispatch.normalize(
        records.read_lines(spark, source), "syslog", documents=False
    ).filter("_status = 'ok'")
    wanted = {(r[0], r[1]) for r in batch.select("event.id", "event.action").collect()}

    paths = [str(tmp_path / p) for p in ("events", "sessions", "rejects", "check")]
    for _ in range(2):
        pipeline.store_stream(
            pipeline.stream_lines(spark, source), "syslog", paths[0], paths[1],
            paths[3], dead_letter_path=paths[2],
        ).awaitTermination()
    stored = store.read_events(spark, paths[0]).select("event_id", "event_action").collect()
    assert {(r[0], r[1]) for r in stored} == wanted and len(stored) == len(wanted)
    sessions = store.current_sessions(spark, paths[1]).agg(F.sum("total_events")).collect()
    assert sessions[0][0] == len(wanted)
    assert spark.read.json(paths[2]).count() == 1003 - len(wanted)


def test_stream_sessions_over_batches(spark, tmp_path):
    """A session over five batches, each after a restart, has the totals of a batch load; equal lines count."""
    source = str(tmp_path / "in")
    paths = [str(tmp_path / p) for p in ("events", "sessions", "check")]
    line = "2024-01-01T00:00:00Z h p: m"
    for k in range(5):
        spark.createDataFrame([(f"{line}{k}",), (f"{line} again",), ("no log line",)][: 2 + k % 2], "v STRING").coalesce(
            1).write.mode("append").text(source)
        lines = pipeline.stream_lines(spark, source).withColumn("session_id", F.lit("s"))
        pipeline.store_stream(lines, "syslog", *paths, session_id="session_id").awaitTermination()
    whole = dispatch.normalize(
        records.read_lines(spark, source).withColumn("session_id", F.lit("s")), "syslog", documents=False)
    [want] = store.session_rollup(whole).collect()
    [got] = store.current_sessions(spark, paths[1]).collect()
    totals = ("session_id", "source_type", "total_events", "failed_count")
    assert [got[c] for c in totals] == [want[c] for c in totals] and got["total_events"] >= 10


def test_bucketed_insert_shuffles_the_load_only(spark, tmp_path):
    name = "bucketed_events"
    rows = _stored(spark, SF_DIR).drop("load_date")
    try:
        store.insert_bucketed(rows.limit(100), name, 4, str(tmp_path / "table"))
        new = store.insert_bucketed(rows, name, 4)
        before = spark.conf.get("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        text_plan = plan(new)
        spark.conf.set("spark.sql.adaptive.enabled", before)
        stored_side = text_plan[text_plan.index("SortMergeJoin"):]
        assert text_plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in stored_side
        assert spark.table(name).count() == spark.table(name).select("event_id").distinct().count() == rows.count()
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_bucketed_insert_of_a_large_load(spark, tmp_path, monkeypatch):
    """More tasks than buckets, none of which holds rows of two; the table stays bucketed, and each id is stored once."""
    monkeypatch.setattr(store, "_ROWS_PER_TASK", 50)
    name = "bucketed_large"
    rows = _stored(spark, SF_DIR).drop("load_date")
    n = rows.count()
    try:
        store.insert_bucketed(rows.limit(n // 2).unionByName(rows.limit(20)), name, 4, str(tmp_path / "table"))
        new = store.insert_bucketed(rows, name, 4)
        assert "hashpartitioning(event_id" in plan(new) and f", {4 * -(-n // 200)})" in plan(new)
        assert new.count() == 0
        table = spark.table(name)
        assert table.count() == table.select("event_id").distinct().count() == n
        buckets = table.select(F.regexp_extract(F.input_file_name(), r"_(\d+)\.c", 1).cast("int").alias("b"), "event_id")
        assert buckets.filter(F.expr("b <> pmod(hash(event_id), 4)")).count() == 0
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_search_index_reads_files_with_candidates(spark, tmp_path):
    path, index = str(tmp_path / "events"), str(tmp_path / "index")
    rows = _stored(spark, SF_DIR).drop("load_date")
    for k in range(4):
        some = rows.filter(F.col("event_id").cast("bigint") % 4 == k)
        if k == 2:
            some = some.withColumn("host_name", F.lit("rare%box"))
        store.write_events(some, path)
        if k < 3:
            assert search_index.update_index(spark, path, index) > 0
    files = len(store.read_events(spark, path).inputFiles())
    new = len(search_index.candidate_files(spark, path, index, "no such text"))
    assert 0 < new < files
    rare = search_index.candidate_files(spark, path, index, r"re\%b_x")
    assert new < len(rare) < files
    assert search_index.needed_grams(r"re\%b_x") == ["e%b", "re%"] and search_index.needed_grams("a%b") == []
    for term in (r"re\%b_x", "root", "u1%2", "%", "_", "no such text", "host3", "\\\\"):
        wanted = search.find_events(store.read_events(spark, path), search=term)
        found = search_index.find_indexed(spark, path, index, term)
        assert sorted(r[0] for r in found.select("event_id").collect()) == sorted(
            r[0] for r in wanted.select("event_id").collect())
    assert search_index.update_index(spark, path, index) == new
    assert search_index.update_index(spark, path, index) == 0
    assert search_index.candidate_files(spark, path, index, "no such text") == []
    assert search_index.find_indexed(spark, path, index, "no such text").collect() == []


def test_files_clustered_by_time(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    path, key = str(tmp_path / "events"), "spark.sql.adaptive.coalescePartitions.enabled"
    rows = store.stored_rows(_syslog_load(spark, SF_DIR), F.lit("2024-02-01T00:00:00.000Z"))
    before = spark.conf.get(key)
    spark.conf.set(key, "false")  # the rows are few
    try:
        store.write_events(rows, path, by_time=True)
    finally:
        spark.conf.set(key, before)
    ranges = []
    for file in glob.glob(f"{path}/*/*/*.parquet"):
        times = pq.read_table(file, columns=["event"]).column("event").combine_chunks().field("created_ts").to_pylist()
        assert times == sorted(times)
        ranges.append((times[0], times[-1]))
    ranges.sort()
    assert len(ranges) > 3 and all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    found = search.find_events(store.read_events(spark, path), since="2024-01-10T06:00:00Z", until="2024-01-10T09:30:00Z")
    text_plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(event.created_ts" in text_plan and "LessThan(event.created_ts" in text_plan
    assert 0 < found.count() < rows.count()


def test_stream_without_repeats(spark, tmp_path):
    source = str(tmp_path / "in")
    line = "2024-01-01T00:00:00Z h p: m"
    for k, lines in enumerate(([line], [line, line + "2", line + "2"])):
        spark.createDataFrame([(x,) for x in lines], "v STRING").coalesce(1).write.mode("append").text(source)
    events = pipeline.without_repeats(
        pipeline.normalize_stream(pipeline.stream_lines(spark, source), "syslog")
    )
    out = str(tmp_path / "out")
    events.select("event.action").writeStream.option(
        "checkpointLocation", str(tmp_path / "check")
    ).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    # The equal lines stand in files of their own, so both are events.
    assert sorted(r[0] for r in spark.read.parquet(out).collect()) == ["p: m", "p: m", "p: m2"]


def test_sample_event(spark):
    """The documented sample event, rebuilt from XML."""
    values = {
        "RuleName": "technique_id=T1059.001", "ProcessId": "4812", "ParentProcessId": "1204",
        "Image": r"C:\Windows\System32\WindowsPowerShell\v1.0\powershell.exe",
        "CommandLine": "powershell.exe -enc SQBFAFgA...", "ParentImage": r"C:\Windows\System32\cmd.exe",
        "ParentCommandLine": "cmd.exe /c start powershell", "User": r"WIN11X01\jdoe",
        "Hashes": "MD5=7353F60B1739074EB17C5F4DDDEFE239,SHA256=DE96",
    }
    xml = (
        "<Event><System><EventID>1</EventID><TimeCreated SystemTime='2026-04-13T10:30:00.000Z'/>"
        "<Computer>Win11x01</Computer></System><EventData>"
        + "".join(f"<Data Name='{k}'>{v}</Data>" for k, v in values.items())
        + "</EventData></Event>"
    )
    [row] = sysmon.normalize_sysmon(spark.createDataFrame([(xml,)], "raw STRING")).collect()
    event, process = row["event"], row["process"]
    assert (event["action"], event["outcome"], event["severity"]) == ("Process created", "unknown", 0)
    assert event["created_ts"].isoformat() == "2026-04-13T10:30:00"
    assert (process["name"], process["pid"], process["ppid"]) == ("powershell.exe", 4812, 1204)
    assert process["parent"].asDict() == {
        "pid": 1204, "name": "cmd.exe", "executable": r"C:\Windows\System32\cmd.exe",
        "command_line": "cmd.exe /c start powershell"}
    assert process["hash"].asDict() == {"md5": "7353f60b1739074eb17c5f4dddefe239", "sha256": "de96"}
    assert row["user"].asDict() == {"name": "jdoe", "domain": "WIN11X01", "id": None}
    assert row["tags"] == ["T1059.001"] and row["network"] is None and row["file"] is None
    assert flat is not None


def test_clearing_keeps_rows_without_session(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = _stored(spark, SF_DIR).limit(2).collect()
    one, other = (spark.createDataFrame([r], store.stored_schema()) for r in rows)
    store.write_events(one.withColumn("session_id", F.lit("x")).unionByName(
        other.withColumn("session_id", F.lit(None).cast("string"))), path)
    assert store.clear_session(spark, path, "x") == 1
    assert [r[0] for r in store.read_events(spark, path).select("session_id").collect()] == [None]


def test_clearing_leaves_files_of_other_sessions(spark, tmp_path):
    path = str(tmp_path / "odd #%20 events")
    rows = [r.asDict() | {"source_type": source, "indexed_at": time} for r, source, time in zip(
        _stored(spark, SF_DIR).limit(6).collect(), "aaaaba", ["2024-02-01T00:00:00Z"] * 5 + [None])]
    sessions = [["x", "y"], ["y", None], ["x"], ["x"]]
    for load in sessions:
        some = [spark.createDataFrame([rows.pop(0) | {"session_id": name}], store.stored_schema()) for name in load]
        store.write_events(reduce(DataFrame.unionByName, some).coalesce(1), path)
    files = {r["file"]: r["held"] for r in store.read_events(spark, path).groupBy(
        F.col("_metadata.file_path").alias("file")).agg(F.collect_list(F.coalesce("session_id", F.lit(""))).alias("held")).collect()}
    assert store.clear_session(spark, path, "x") == 3
    after = store.read_events(spark, path)
    assert sorted(r[0] or "" for r in after.select("session_id").collect()) == ["", "y", "y"]
    assert after.where("event_id is not null and source_type = 'a'").count() == 3
    # The file without the session is the one that was there, and no file with it is left.
    names = {r[0] for r in after.select("_metadata.file_path").distinct().collect()}
    assert names & set(files) == {name for name, held in files.items() if "x" not in held}
    assert store.clear_session(spark, path, "x") == 0


def test_a_load_is_dealt_to_tasks_of_bounded_size(spark, monkeypatch):
    events = rawlogs.events_table(spark, SF_DIR)
    assert rawlogs.dealt(events).rdd.getNumPartitions() == 1
    monkeypatch.setattr(rawlogs, "_ROWS_PER_TASK", 50)
    dealt = rawlogs.dealt(events.unionByName(events).withColumn("ts", F.when(F.col("event_id") % 2 == 0, F.col("ts"))))
    assert dealt.exceptAll(dealt.limit(0)).count() == 2000
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 30 and max(sizes) < 150


def test_long_records_take_few_bytes_in_files_over_the_limit(spark, tmp_path):
    path, count = str(tmp_path / "long"), 1045
    rows = spark.range(count, numPartitions=5).selectExpr("'r' || CAST(id div 2 AS STRING) || ' ' AS raw")
    _write_long(rows, path)
    # A task without rows may leave a file of some bytes.
    sizes = [size for name in glob.glob(f"{path}/part-*") if (size := os.path.getsize(name)) > 100]
    # One file of 1000, two of 20, five of one.
    assert len(sizes) == 8 and min(sizes) > 1.5 * 1024 * 1024 and sum(sizes) < 20e6
    read = records.read_lines(spark, path).select(F.length("raw").alias("n"), F.regexp_replace("raw", "x*$", "").alias("raw"))
    assert sorted(r["raw"] for r in read.collect()) == sorted(r["raw"] for r in rows.collect())
    assert read.where("n = length(raw) + 2000000").count() == count
    assert records.read_lines(spark, path, 1.5).count() == 0


def test_each_file_of_long_records_has_a_task_of_its_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "_LONG_FILES", (("lz4", 210), ("none", 1)))
    path = str(tmp_path / "long")
    _write_long(spark.range(1262, numPartitions=3).selectExpr("'r' || CAST(id AS STRING) || ' ' AS raw"), path)
    names = [os.path.basename(name) for name in glob.glob(f"{path}/part-*.lz4") if os.path.getsize(name) > 100]
    assert sorted(name[:10] for name in names) == [f"part-0000{k}" for k in range(6)]
    assert records.read_lines(spark, path, 1.5).count() == 0
    assert records.read_lines(spark, path).count() == 1262


def test_blank_lines_are_told_without_a_walk_through_the_others(spark, tmp_path):
    blank = ["", " ", "\t \x0b", "\u3000", "\x85\u2003 ", "\x1c\u00a0"]
    filled = ["!", "~", "~~", " a", "\u3000b", "\x7f", "\u00e9", "a\u3000", "#"]
    (tmp_path / "a.log").write_bytes("\n".join(blank + filled).encode() + b"\n\x80\n \xe3\x80\n\xa0 \n")
    lines = records.read_lines(spark, str(tmp_path / "a.log"))
    assert sorted(r["raw"] for r in lines.collect()) == sorted([*filled, "\ufffd", " \ufffd", "\ufffd "])
    counted = lines.agg(F.count(F.lit(1)))._jdf.queryExecution().optimizedPlan().toString()
    # The first byte comes before the walk, and the text is made valid nowhere else.
    assert ">= !" in counted.partition("makeValid")[0] and counted.count("makeValid") == 1


def test_rows_are_numbered_without_gaps(spark):
    for rows in (spark.range(100, numPartitions=7).where("id % 9 > 2"), spark.range(0)):
        numbered, count = rawlogs.numbered(rows)
        assert sorted(r["number"] for r in numbered.collect()) == list(range(count)) and count == rows.count()


def test_the_later_of_two_saves_wins(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "sessions")
    monkeypatch.setattr(store, "now_text", lambda: F.lit("2024-01-01T00:00:00.000Z"))
    for total in (5, 3):
        store.save_sessions(spark.createDataFrame([("s", "cef", "f", "c", total, 0)], store.SESSION_DDL), path)
    assert [r["total_events"] for r in store.current_sessions(spark, path).collect()] == [3]


def test_a_broken_load_is_an_error_not_a_fallback(spark, tmp_path):
    broken = _syslog_load(spark, SF_DIR).withColumn("session_id", F.raise_error(F.lit("bad")).cast("string"))
    with pytest.raises(Exception, match="bad"):
        store.save_events(broken, str(tmp_path / "t"), fallback_path=str(tmp_path / "aside"))
    assert not (tmp_path / "aside").exists()


def test_lookups_and_clearing_prune(spark, tmp_path):
    path = str(tmp_path / "events")
    store.write_events(_stored(spark, SF_DIR), path)
    day = store.read_events(spark, path).select(F.min("load_date")).first()[0]
    known = store.read_events(spark, path).filter(F.col("load_date") == day)
    text_plan = plan(store.insert_if_absent(known, _stored(spark, SF_DIR)))
    assert "ReadSchema: struct<event_id:string>" in text_plan
    assert "PartitionFilters: [isnotnull(load_date" in text_plan
    assert search.get_event(store.read_events(spark, path), "17").count() == 1


def test_file_that_breaks_off_gives_no_event(spark, tmp_path):
    whole = ("<Event><System><EventID>1</EventID><Computer>h</Computer></System>"
             "<EventData><Data Name='Image'>a</Data></EventData></Event>")
    (tmp_path / "a.xml").write_text("<Events>" + whole + whole[:60])
    events = sysmon.normalize_sysmon(records.read_sysmon(spark, str(tmp_path / "a.xml")))
    assert sorted(r[0] for r in events.select("_status").collect()) == ["dropped", "ok"]


def test_times_do_not_depend_on_the_session_zone(spark):
    line = spark.createDataFrame([("Apr  3 01:02:03 h p: m",), ("2024-04-03T01:02:03+02:00 h p: m",)], "raw STRING")
    seen = set()
    before = spark.conf.get("spark.sql.session.timeZone")
    for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        events = syslog.normalize_syslog(line, default_year=2024)
        seen.add(tuple(r[0] for r in events.select(F.unix_seconds("event.created_ts")).collect()))
    spark.conf.set("spark.sql.session.timeZone", before)
    assert seen == {(1712106123, 1712098923)}


def test_nothing_is_cut(spark, tmp_path):
    message = "long " * 1000
    (tmp_path / "a.log").write_text(f"2024-01-01T00:00:00Z h p: {message}\n")
    (tmp_path / "b.json").write_text('{"message": "' + "x" * (51 << 20) + '"}')
    [row] = syslog.normalize_syslog(records.read_lines(spark, str(tmp_path / "a.log"))).select(
        "event.action", F.col("log.original_log")["msg"]).collect()
    assert row[1] == message.strip() and row[0] == f"p: {message.strip()}"
    documents = records.read_documents(spark, str(tmp_path / "b.json"))
    assert [r[0] for r in documents.select(F.length("raw")).collect()] == [(51 << 20) + 15]


def test_no_scratch_folder_is_an_error():
    from types import SimpleNamespace

    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        store.scratch_path(unset, "x")


def test_page_directory(spark, tmp_path):
    """Every page is that of the plain search, whatever the directory knows, and reads the files of its blocks."""
    path, directory = str(tmp_path / "events"), str(tmp_path / "pages")
    rows = _stored(spark, SF_DIR).withColumn("indexed_at", F.substring("indexed_at", 1, 9)).persist()
    loads = [rows, rows.withColumn("event_id", F.concat(F.lit("x"), "event_id"))
             .withColumn("indexed_at", F.concat(F.lit("2024-03-0"), F.length("event_id").cast("string"), F.lit("T10:00:30")))]
    loads.append(rows.limit(40).withColumn("event_id", F.concat(F.lit("y"), "event_id"))
                 .withColumn("indexed_at", F.concat(F.lit("2024-04-01T10:00:"), F.substring("event_id", 2, 2))))
    for k, load in enumerate(loads):
        store.write_events(load.coalesce(3), path)
        if k != 1:
            page_directory.update_directory(spark, path, directory)
        table = store.read_events(spark, path)
        total = table.count()
        for page, per_page in ((3, 13), (2, total // 3), (total // 50 + 1, 50)):
            want = search.events_page(table, page, per_page).collect()
            assert page_directory.events_page(spark, path, directory, page, per_page).collect() == want
        assert page_directory.events_page(spark, path, directory, source_type="none").collect() == []
        count = page_directory.page_count(spark, path, directory, 50).first()
        assert count == search.page_count(table, 50).first() and count["total"] == total
    newest = page_directory.events_page(spark, path, directory, 1, 20)
    assert len(newest.inputFiles()) <= 3 < len(table.inputFiles())
    # An update written twice changes nothing, nor do entries of files that are gone.
    spark.read.parquet(directory).write.mode("append").parquet(str(tmp_path / "again"))
    spark.read.parquet(str(tmp_path / "again")).write.mode("append").parquet(directory)
    assert page_directory.page_count(spark, path, directory).first()["total"] == total
    store.clear_all(spark, path)
    assert page_directory.page_count(spark, path, directory, 50).first() == (0, 1)
    assert page_directory.events_page(spark, path, directory).collect() == []
    rows.unpersist()
