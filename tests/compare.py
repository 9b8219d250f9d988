"""Runs registered queries against their SQL counterparts; also a script.

    python tests/compare.py /root/testdata/sf0.01 [query ...]
"""

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _family(kind):
    kind = str(kind).upper()
    if kind in ("STRING", "VARCHAR"):
        return "text"
    if kind in ("INT", "INTEGER"):
        return "int"
    if kind in ("BIGINT", "LONG"):
        return "bigint"
    return kind


def compare(spark, connection, name, build, sql, sf_dir):
    """Problems of one query; an empty list means the results are equal."""
    frame = build(spark, sf_dir)
    columns = sorted(frame.columns)
    kinds = {f.name: _family(f.dataType.simpleString()) for f in frame.schema.fields}
    got = sorted(
        (tuple(r[c] for c in columns) for r in frame.collect()), key=lambda r: repr(r)
    )
    result = connection.execute(sql)
    theirs = {d[0]: _family(d[1]) for d in result.description}
    names = [d[0] for d in result.description]
    if sorted(names) != columns:
        return [f"columns {columns} against {sorted(names)}"]
    order = [names.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=lambda r: repr(r))
    problems = []
    if kinds != theirs:
        problems.append(f"types {[(c, kinds[c], theirs[c]) for c in columns if kinds[c] != theirs[c]]}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} against {len(want)}")
    if got != want:
        wrong = [(a, b) for a, b in zip(got, want) if a != b]
        if wrong:
            a, b = wrong[0]
            diff = {c: (x, y) for c, x, y in zip(columns, a, b) if x != y}
            problems.append(f"{len(wrong)} rows differ, first {diff}")
    if not got:
        problems.append("no rows")
    return problems


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as contract

    sf_dir = sys.argv[1]
    only = sys.argv[2:]
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    oracle = contract.oracle_sql()
    connection = duck(sf_dir)
    bad = 0
    for name, build in contract.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            if name in oracle:
                problems = compare(session, connection, name, build, oracle[name], sf_dir)
            else:
                problems = [] if build(session, sf_dir).count() else ["no rows"]
        except Exception as error:  # noqa: BLE001
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        bad += bool(problems)
        print(f"{'ok  ' if not problems else 'BAD '} {name} {time.time() - start:.1f}s", *problems, flush=True)
    print("bad:", bad)
