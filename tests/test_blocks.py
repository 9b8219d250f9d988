"""Large files cut by many tasks: CSV with breaks in cells, JSON arrays."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from logweave.sources import blocks, cef, records, wazuh, wel


@pytest.fixture
def split(spark, monkeypatch):
    """Reads files in blocks of so many bytes; written tables are read as always."""
    read = blocks.read_pieces

    def small(size):
        def pieces(*args):
            keys = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": 0}
            before = {k: spark.conf.get(k) for k in keys}
            for k, v in keys.items():
                spark.conf.set(k, str(v))
            try:
                return read(*args)
            finally:
                for k, v in before.items():
                    spark.conf.set(k, v)
        monkeypatch.setattr(blocks, "read_pieces", pieces)

    return small


@pytest.fixture(params=[23, 300])
def splits(split, request):
    split(request.param)
    return request.param


@pytest.fixture(params=[False, True])
def longer(monkeypatch, request):
    """Whether files are read in pieces of several lines, however short the files are."""
    if request.param:
        monkeypatch.setattr(blocks, "_FEWER", 0)
        monkeypatch.setattr(blocks, "_MANY", 0)
        monkeypatch.setattr(blocks, "_LONG_PART_BITS", 1)
    return request.param


def read_rows(spark, path):
    return sorted((r["source_file"].rpartition("/")[2], r["_header"], r["_cells"])
                  for r in records.read_wel(spark, path).collect())


def python_rows(name, text):
    rows = [r for r in csv.reader(io.StringIO(text.strip(), newline="")) if r]
    return [(name, [c.strip() for c in rows[0]], r) for r in rows[1:]]


CELLS = ["4624", "", "a b", '"x, y"', '"two\nlines"', '"he said ""no"""', '"\n\n"', 'in"side', '"a"b', '"",""',
         '"very\nlong\ncell, with ""quotes""\nand more of it than a block holds"', '"\r\n"', "é"]


@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
def test_csv_equals_python(spark, splits, tmp_path, line_end):
    draw = random.Random(splits)
    expected = []
    for k in range(4):
        head = ["Id,Message,User", '"Id","Mess\nage",User', "Id", '"Id ","a ""b"""'][k]
        lines = [",".join(draw.choice(CELLS) for _ in range(draw.randrange(1, 4))) for _ in range(12)]
        text = "\n" * k + line_end.join([head, *[x for x in lines if x]]) + line_end * (k % 3)
        (tmp_path / f"{k}.csv").write_bytes(text.encode())
        expected += python_rows(f"{k}.csv", text)
    assert read_rows(spark, str(tmp_path / "*.csv")) == sorted(expected)


def test_csv_odd_files(spark, splits, tmp_path):
    files = {"empty": "", "blank": " \n\n ", "header": "Id,User\n", "open": 'Id,User\n1,"never\nclosed\nagain',
             "blanks": "\n  \nId\n1\n\n2\n \n", "cr": "Id,User\r1,a\r2,b"}
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
    got = {}
    for name, _, cells in read_rows(spark, str(tmp_path / "*.csv")):
        got.setdefault(name, []).append(cells)
    assert got == {"open.csv": [["1", "never\nclosed\nagain"]], "blanks.csv": [["1"], ["2"]],
                   "cr.csv": [["1", "a"], ["2", "b"]]}


def test_csv_state_of_each_block(spark, splits, tmp_path):
    """What a block says of its start, without its text before, is what the text says."""
    text = 'Id,Message\n' + "".join(f'{k},"line\n{k}""\n"\n' if k % 3 else f"{k},plain\n" for k in range(30))
    (tmp_path / "a.csv").write_text(text)
    pieces = blocks.csv_pieces(spark, str(tmp_path / "a.csv"), None)
    first = {r[0]: r[1] for r in pieces.groupBy("_start").agg(F.min_by("raw", "_place")).collect()}
    entry = {r["_start"]: r["_entry"] for r in blocks.csv_blocks(pieces).collect()}
    assert set(entry) == set(first)
    assert len(entry) > 1
    for start, inside in entry.items():
        # A split begins after the first line end in it.
        at = start if start == 0 else text.index("\n", start) + 1
        assert inside == (text[:at].count('"') % 2 == 1)


def test_csv_memory_stays_small(spark, tmp_path):
    """10,000 rows in one document: the header alone goes along to the rows."""
    document = "Id,Message\n" + "".join(f'{k},"message {k} {"x" * 60}"\n' for k in range(10_000))
    frame = spark.createDataFrame([("d", document)], "name string, raw string")
    rows = wel.rows_from_text(frame)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    [explode] = [line for line in plan.splitlines() if "posexplode" in line and "Generate" in line]
    assert "_records" not in explode.partition("), ")[2].partition("]")[0]
    assert rows.count() == 10_000


def test_csv_of_one_file_by_many_tasks(spark, split, tmp_path):
    text = "Id,Message\n" + "".join(f'{k},"a\nb {k}"\n' for k in range(20_000))
    (tmp_path / "a.csv").write_text(text)
    split(20_000)
    pieces = blocks.csv_pieces(spark, str(tmp_path / "a.csv"), None)
    assert pieces.select("_start").distinct().count() > 10
    rows = records.read_wel(spark, str(tmp_path / "a.csv"))
    assert rows.select(F.count(F.lit(1)), F.sum(rows["_cells"][0].cast("long"))).first()[:] == (20_000, 199_990_000)


# ---- JSON -----------------------------------------------------------------------

VALUES = [1, "x", 'a } b', 'q " }{ [', "back \\", None, True, {"k": [1, {"z": "}"}]}, [], [[{"a": 1}]], "\\\"}", "]["]


def element(draw, k):
    if draw.random() < 0.2:
        return draw.choice([1, "text }", None, [1, {"a": 2}], [[]]])
    return {"id": k, "v": draw.choice(VALUES), **({"rule": {"level": 3, "x": draw.choice(VALUES)}} if k % 2 else {})}


@pytest.mark.parametrize("kind", ["wazuh", "cef"])
def test_json_equals_whole_documents(spark, splits, tmp_path, kind):
    draw = random.Random(splits)
    for k, indent in enumerate([None, 1, None, 4]):
        body = json.dumps([element(draw, n) for n in range(10)], indent=indent)
        (tmp_path / f"a{k}.json").write_text(" \n" * k + body + "\n" * (k % 2))
    others = {"one": '{"a": {"b": 1},\n "c": "}"}\n', "tight": '{"a":1}', "lines": '{"a":1}\n{"b":"}{"}\n', "none": "[]",
              "spaces": "[ ]\n", "numbers": "[1, 2]", "two": '[{"a":1}]\n[{"b":2}]\n', "broken": '[{"a":1},',
              "text": "no json } at all\nCEF:0|a|b|c|1|n|3|x=1\n", "blank": "\n", "inner": '[[{"a":1}],[{"b":[2]}]]',
              "string": '["a","}"]'}
    for name, text in others.items():
        (tmp_path / f"{name}.json").write_text(text)
    path = str(tmp_path / "*.json")
    cut = {"wazuh": records.wazuh_records, "cef": records.cef_records}[kind]
    whole = cut(records.read_documents(spark, path)).filter("raw IS NOT NULL")

    def got(rows):
        return sorted((r["source_file"].rpartition("/")[2], r["raw"]) for r in rows.collect())

    assert got(records.read_json(spark, path, kind)) == got(whole)


def test_json_array_with_a_broken_element(spark, splits, tmp_path):
    (tmp_path / "a.json").write_text('[{"id":1},{"id":2 3},{"id":4}]')
    got = sorted(r["raw"] for r in records.read_json(spark, str(tmp_path / "a.json")).collect())
    assert len(got) == 3 and '{"id":1}' in got and '{"id":4}' in got
    events = wazuh.normalize_wazuh(records.read_json(spark, str(tmp_path / "a.json")))
    assert events.filter("_status <> 'ok'").count() >= 1


def test_json_of_one_file_by_many_tasks(spark, split, tmp_path):
    rows = [{"host": f"h{k}", "message": "}" * (k % 5), "severity": k % 10} for k in range(5000)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    split(20_000)
    pieces = blocks.json_pieces(spark, str(tmp_path / "a.json"), None)
    assert pieces.select("_start").distinct().count() > 10
    events = cef.normalize_json(records.read_json(spark, str(tmp_path / "a.json"), "cef"))
    assert events.filter("_status = 'ok'").select(F.countDistinct("host.name")).first()[0] == 5000


# ---- size -----------------------------------------------------------------------


def test_a_split_of_short_pieces_is_many_blocks(spark, tmp_path, monkeypatch):
    """No task sorts or buffers a split's lines alone; records cross the borders in it."""
    monkeypatch.setattr(blocks, "_PART_BITS", 3)
    text = "Id,Message\n" + "".join(f'{k},"a\nb ""{k}""\n"\n' for k in range(50))
    (tmp_path / "a.csv").write_text(text)
    pieces = blocks.csv_pieces(spark, str(tmp_path / "a.csv"), None)
    assert pieces.groupBy(*blocks.BLOCK).count().agg(F.max("count")).first()[0] == 8
    assert read_rows(spark, str(tmp_path / "a.csv")) == sorted(python_rows("a.csv", text))
    values = [element(random.Random(3), k) for k in range(60)]
    (tmp_path / "a.json").write_text(json.dumps(values))
    read = records.read_json(spark, str(tmp_path / "a.json"), "cef").collect()
    key = lambda v: json.dumps(v, sort_keys=True)
    assert sorted(key(json.loads(r["raw"])) for r in read) == sorted(key(v) for v in values if isinstance(v, dict))


@pytest.mark.parametrize("most", [0, 1000])
def test_arrays_are_not_read_by_line(spark, tmp_path, monkeypatch, most):
    """An array of one line would be one row of the file's length."""
    (tmp_path / "a b.json").write_text('[{"a": 1}]')
    (tmp_path / "l [1].json").write_text('{"a": 2}\n{"a": 3}')
    monkeypatch.setattr(records, "_MOST_NAMES", most)
    read = records.read_json(spark, str(tmp_path / "*.json"), "cef")
    assert sorted(json.loads(r["raw"])["a"] for r in read.collect()) == [1, 2, 3]
    kinds = spark.createDataFrame([("x", "array")], "source_file string, _kind string")
    assert records._by_line(spark, str(tmp_path / "*.json"), kinds).rdd.getNumPartitions() == 0


def test_records_are_put_together_once(spark, tmp_path):
    """The lines' texts are shuffled once, not for each part that reads the records."""
    (tmp_path / "a.csv").write_text("Id,Message\n1,x\n")
    plan = records.read_wel(spark, str(tmp_path / "a.csv"))._jdf.queryExecution().executedPlan().toString()
    assert "_chain" in plan and "_texts" not in plan


# ---- longer pieces --------------------------------------------------------------


@pytest.mark.parametrize("size", [23, 70])
@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
def test_csv_in_longer_pieces_equals_python(spark, split, longer, tmp_path, line_end, size):
    split(size)
    draw = random.Random(size)
    expected = []
    for k in range(5):
        head = ["Id,Message,User", '"Id","Mess\nage",User', "Id", '"Id ","a ""b"""', '"Id"'][k]
        lines = [",".join(draw.choice(CELLS) for _ in range(draw.randrange(1, 4))) for _ in range(12)]
        text = "\n" * k + line_end.join([head, *[x for x in lines if x], ["1", '"2"', 'in"', "3", '"4\n"'][k]]) + line_end * (k % 3)
        (tmp_path / f"{k}.csv").write_bytes(text.encode())
        expected += python_rows(f"{k}.csv", text)
    files = {"header": "Id,User\n", "open": 'Id,User\n1,"never\nclosed\nagain', "blanks": '\n  \n"Id"\n"1"\n\n2\n \n',
             "quote": 'Id\n"1"', "quotes": 'Id\n"1"\n', "inside": 'Id\n1,a"\n2,b"', "blank": " \n\n "}
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
        if name != "open":
            expected += python_rows(f"{name}.csv", text)
    expected.append(("open.csv", ["Id", "User"], ["1", "never\nclosed\nagain"]))
    assert read_rows(spark, str(tmp_path / "*.csv")) == sorted(expected)


@pytest.mark.parametrize("kind", ["wazuh", "cef"])
def test_json_in_longer_pieces_equals_whole_documents(spark, split, longer, tmp_path, kind):
    split(40)
    draw = random.Random(5)
    for k, indent in enumerate([None, 1, None, 4]):
        body = json.dumps([element(draw, n) for n in range(14)], indent=indent)
        (tmp_path / f"a{k}.json").write_text(" \n" * k + body + "\n" * (k % 2))
    others = {"one": '{"a": {"b": 1},\n "c": "}"}\n', "tight": '{"a":{"b":[1]}}', "lines": '{"a":1}\n{"b":"}{"}\n', "none": "[]",
              "spaces": "[ ]\n", "numbers": "[1, 2]", "two": '[{"a":1}]\n[{"b":2}]\n', "broken": '[{"a":1},', "cut": '[{"a":1},{"',
              "text": "no json } at all\nCEF:0|a|b|c|1|n|3|x=1\n", "blank": "\n", "inner": '[[{"a":1}],[{"b":[2]}]]',
              "string": '["a","}"]', "after": '{"a":1} x', "escaped": '[{"a":"\\\\"},{"b":"{\\"}{"}, {"c":1}]'}
    for name, text in others.items():
        (tmp_path / f"{name}.json").write_text(text)
    path = str(tmp_path / "*.json")
    cut = {"wazuh": records.wazuh_records, "cef": records.cef_records}[kind]
    whole = cut(records.read_documents(spark, path)).filter("raw IS NOT NULL")

    def got(rows):
        return sorted((r["source_file"].rpartition("/")[2], r["raw"]) for r in rows.collect())

    assert got(records.read_json(spark, path, kind)) == got(whole)


def test_texts_full_of_ends_are_read_in_long_pieces(spark, tmp_path):
    """Not a piece for each line or brace inside a text."""
    message = 'a ""b"",\nc\n' * 30
    (tmp_path / "a.csv").write_text("Id,Message\n" + "".join(f'{k},"{message}"\n' for k in range(100)))
    assert blocks.csv_pieces(spark, str(tmp_path / "a.csv"), None).count() <= 101
    assert records.read_wel(spark, str(tmp_path / "a.csv")).count() == 100
    (tmp_path / "a.json").write_text(json.dumps([{"id": k, "m": '} " {' * 30} for k in range(100)]))
    assert blocks.json_pieces(spark, str(tmp_path / "a.json"), None).count() <= 301
    assert records.read_json(spark, str(tmp_path / "a.json")).count() == 100


def test_long_pieces_are_left_for_short_ones_and_lose_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blocks, "_LONGEST", 200)
    text = "Id,Message\n" + '1,"a"\n' + "".join(f"{k},b\n" for k in range(2, 2000))
    (tmp_path / "a.csv").write_text(text)
    (tmp_path / "b.csv").write_text('Id\n"1"\n')
    separator, _ = blocks._separator(spark, str(tmp_path / "*.csv"), "\n", blocks._CSV_LONGER, None)
    assert separator == "\n" and records.read_wel(spark, str(tmp_path / "*.csv")).count() == 2000


def test_json_object_that_ends_its_file_keeps_its_braces(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a":{"b":[1]}}')
    assert [r["raw"] for r in records.read_json(spark, str(tmp_path / "a.json"), "cef").collect()] == ['{"a":{"b":[1]}}']
