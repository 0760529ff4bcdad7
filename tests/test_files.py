"""Readers: extensions, CSV, both JSON layouts, bad and empty files, name cleaning."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import types as T

from tablepulse.functions.names import clean_columns
from tablepulse.sources import files
from tablepulse.sources.tables import first_existing, scan


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


@pytest.mark.parametrize("name,extension", [("a.csv", ".csv"), ("A.B.JSON", ".json"), ("x.JsonL", ".jsonl")])
def test_extension(name, extension):
    assert files.file_extension(name) == extension


@pytest.mark.parametrize("name", ["a.xlsx", "noextension", "csv", ""])
def test_unsupported_extension(name):
    with pytest.raises(files.UnsupportedFileType):
        files.file_extension(name)


@pytest.mark.parametrize("name,kind", [("a.csv", "csv"), ("a.JSON", "json"), ("a.jsonl", "jsonl"), ("a.txt", "csv"), ("a", "csv")])
def test_source_type(name, kind):
    assert files.source_type(name) == kind


def test_csv_types_and_names(spark, tmp_path):
    path = write(tmp_path, "f.csv", "ID,First Name,Price ($)\n1,Ann,2.5\n2,Bo,3\n")
    df = files.read_file(spark, path)
    assert df.columns == ["id", "first_name", "price"]
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["int", "string", "double"]
    assert df.count() == 2


def test_csv_quotes_breaks_and_missing_marks(spark, tmp_path):
    path = write(tmp_path, "f.csv", 'id,text,v\n1,"he said ""hi, you"" ok",NA\n2,"two\nlines",3\nN/A,plain,null\n')
    df = files.read_file(spark, path)
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["int", "string", "int"]
    assert [tuple(r) for r in df.collect()] == [(1, 'he said "hi, you" ok', None), (2, "two\nlines", 3), (None, "plain", None)]


def test_csv_times_and_large_numbers(spark, tmp_path):
    path = write(tmp_path, "f.csv", "d,t,n,b,x\n2024-01-01,2024-01-01 10:00:00,3000000000,true,007\n,,,,\n")
    df = files.read_file(spark, path)
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["date", "timestamp", "bigint", "boolean", "int"]


def test_json_object_over_lines(spark, tmp_path):
    path = write(tmp_path, "f.json", '{"id": 1,\n "city": "Oslo"}')
    assert files.read_file(spark, path).first().asDict() == {"id": 1, "city": "Oslo"}


def test_later_malformed_record_is_unreadable(spark, tmp_path):
    path = write(tmp_path, "f.csv", "a\n" + "1\n" * 50 + "x\n")
    with pytest.raises(files.UnreadableFile):
        files.read_file(spark, path, T.StructType.fromDDL("a int"))


def test_csv_with_schema_is_not_inferred(spark, tmp_path):
    path = write(tmp_path, "f.csv", "a,b\n1,x\n")
    schema = T.StructType.fromDDL("a string, b string")
    assert files.read_file(spark, path, schema).first().asDict() == {"a": "1", "b": "x"}


def test_json_lines(spark, tmp_path):
    path = write(tmp_path, "f.jsonl", '{"id": 1, "a b": "x"}\n{"id": 2}\n')
    df = files.read_file(spark, path)
    assert sorted(df.columns) == ["a_b", "id"] and df.count() == 2


@pytest.mark.parametrize("indent", [None, 2])
def test_json_document(spark, tmp_path, indent):
    path = write(tmp_path, "f.json", json.dumps([{"id": 1, "city": "Oslo"}, {"id": 2, "city": "Rom"}], indent=indent))
    df = files.read_file(spark, path)
    assert sorted((r["id"], r["city"]) for r in df.collect()) == [(1, "Oslo"), (2, "Rom")]


def test_json_document_with_schema(spark, tmp_path):
    path = write(tmp_path, "f.json", json.dumps([{"id": 1}, {"id": 2}], indent=1))
    df = files.read_file(spark, path, T.StructType.fromDDL("id bigint"))
    assert sorted(r["id"] for r in df.collect()) == [1, 2]


@pytest.mark.parametrize("name,text", [("f.csv", "id,name\n"), ("g.csv", ""), ("h.json", "[]"), ("i.jsonl", "")])
def test_no_rows(spark, tmp_path, name, text):
    with pytest.raises(files.EmptyFile):
        files.read_file(spark, write(tmp_path, name, text))


@pytest.mark.parametrize("text", [b"\x00\x01\x02 not json", b'{"id": 1}\n{"id": \n'])
def test_unreadable_json(spark, tmp_path, text):
    with pytest.raises(files.UnreadableFile):
        files.read_file(spark, write(tmp_path, "f.json", text)).collect()


def test_rejected_records_go_to_quarantine(spark, tmp_path):
    path = write(tmp_path, "f.csv", "a,b\n1,2\nx,3\n4,5\n")
    df = files.read_file(spark, path, T.StructType.fromDDL("a int, b int"), rejects=True).cache()
    good, bad = files.split_rejects(df)
    assert sorted((r["a"], r["b"]) for r in good.collect()) == [(1, 2), (4, 5)]
    assert [r[files.CORRUPT] for r in bad.collect()] == ["x,3"]


def test_malformed_first_json_line(spark, tmp_path):
    path = write(tmp_path, "f.jsonl", '{"id": 0\n{"id": 1}\n{"id": 2}\n')
    good, bad = files.split_rejects(files.read_file(spark, path, rejects=True, landing=str(tmp_path / "landing")))
    assert sorted(r["id"] for r in good.collect()) == [1, 2]
    assert [r["_corrupt_record"] for r in bad.collect()] == ['{"id": 0']


def test_rejected_json_records(spark, tmp_path):
    path = write(tmp_path, "f.jsonl", '{"id": 1}\n{broken\n{"id": 2}\n')
    df = files.read_file(spark, path, rejects=True).cache()
    good, bad = files.split_rejects(df)
    assert sorted(r["id"] for r in good.collect()) == [1, 2]
    assert [r[files.CORRUPT] for r in bad.collect()] == ["{broken"]


@pytest.mark.parametrize(
    "names,cleaned",
    [
        (["First Name", "Price ($)", "1st_column"], ["first_name", "price", "col_1st_column"]),
        (["  x  ", "a--b", "__y__"], ["x", "a_b", "y"]),
        (["", "é"], ["col_0", "col_1"]),
        (["a b", "a-b", "a_b_2", "A.B"], ["a_b", "a_b_2", "a_b_2_2", "a_b_3"]),
    ],
)
def test_clean_columns(spark, names, cleaned):
    schema = T.StructType([T.StructField(n, T.IntegerType()) for n in names])
    assert clean_columns(spark.createDataFrame([], schema)).columns == cleaned


def test_scan_of_missing_table(spark, tmp_path):
    assert scan(spark, "no_such_table") is None
    assert scan(spark, str(tmp_path / "missing")) is None


def test_scan_sample(spark, folder):
    whole = scan(spark, f"{folder}/events.parquet")
    assert 0 < scan(spark, f"{folder}/events.parquet", 0.2).count() < whole.count()


def test_usage_falls_back_to_a_zero_row(spark):
    row = first_existing(spark, ["missing_a", "missing_b"], "credits double, runs int", [0.0, 1]).first()
    assert (row["credits"], row["runs"]) == (0.0, 1)


# --- files in many splits -----------------------------------------------------

def csv_rows(some, n):
    """Texts with quotes, commas, line breaks, stray quotes and carriage returns."""
    words = ["plain", 'he "said" so', "a,b", "two\nlines", "\n", '"', '""', 'x,"\n",y', "", "end\n\n", "tab\t", "é\r\nü"]
    return [(str(i), " ".join(some.choice(words) for _ in range(some.randrange(1, 4))), some.choice(["1", "2.5", "NA"])) for i in range(n)]


def as_csv(rows, some=None):
    """CSV text; a field that needs no quotes is quoted at random."""
    def field(text):
        needs = any(c in text for c in '",\n\r') or text == ""
        return '"' + text.replace('"', '""') + '"' if needs or (some and some.random() < 0.3) else text

    return "".join(",".join(map(field, row)) + "\n" for row in rows)


@pytest.mark.parametrize("split", [97, 256, 4096, 1 << 20])
def test_quoted_csv_over_splits(spark, tmp_path, split):
    some = random.Random(split)
    rows = csv_rows(some, 250)
    # One text runs over many splits.
    rows.insert(200, ("big", "line, one\n" * 90 + 'and "more"', "1"))
    folder = tmp_path / "many.csv"
    folder.mkdir()
    for number, part in enumerate((rows[:150], rows[150:151], rows[151:])):
        write(folder, f"{number}.csv", as_csv([("id", "some text", "v"), *part], some))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        found = [tuple(r) for r in files.read_file(spark, str(folder), places=True).select("id", "some_text", "v", "_row_no").collect()]
        tasks = files.records(spark, str(folder)).rdd.getNumPartitions() if split == 256 else None
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert tasks is None or tasks >= sum(f.stat().st_size for f in folder.glob("*.csv")) // 256
    lines = lambda part: [(*row, sum(as_csv([r]).count("\n") for r in part[:i]) + 1) for i, row in enumerate(part)]
    expected = [r for part in (rows[:150], rows[150:151], rows[151:]) for r in lines(part)]
    number = lambda v: None if v == "NA" else float(v)
    # The empty text is a mark of a missing value.
    assert sorted(found, key=repr) == sorted(((i, text or None, number(v), n) for i, text, v, n in expected), key=repr)


def test_stray_quotes_open_nothing(spark, tmp_path):
    """A quote inside a field without quotes is a letter, as Spark's own reader takes it."""
    path = write(tmp_path, "f.csv", 'id,size,note\n1,5" pipe,x\n2,6",y\n3,"7"" pipe","two\nlines"\n4,"a","b"\n')
    assert [tuple(r) for r in files.read_file(spark, path).orderBy("id").collect()] == [
        (1, '5" pipe', "x"), (2, '6"', "y"), (3, '7" pipe', "two\nlines"), (4, "a", "b")
    ]


def test_same_as_the_reader_of_one_task(spark, tmp_path):
    some = random.Random(9)
    path = write(tmp_path, "f.csv", as_csv([("id", "t", "v"), *csv_rows(some, 300)], some).replace("\r", ""))
    plain = spark.read.options(header=True, multiLine=True, escape='"').csv(path).fillna("")
    texts = files.records(spark, path).where("_row_no > 0 and value != ''")
    assert texts.count() == plain.count() == 300


def test_records_of_json_lines_have_places(spark, tmp_path):
    path = write(tmp_path, "f.jsonl", '{"a": 1}\n\n{"a": 2}\r\n{"a": 3}')
    assert [tuple(r)[:1] + (r["_row_no"],) for r in files.read_file(spark, path, places=True).orderBy("a").collect()] == [(1, 0), (2, 2), (3, 3)]


def test_landing_keeps_rejects_and_places(spark, tmp_path):
    path = write(tmp_path, "f.csv", "a,b\n1,2\n3\n5,6\n")
    df = files.read_file(spark, path, rejects=True, places=True, landing=str(tmp_path / "landed"))
    good, bad = files.split_rejects(df)
    assert sorted((r.a, r.b, r._row_no) for r in good.collect()) == [(1, 2, 1), (5, 6, 3)]
    assert [r[0] for r in bad.collect()] == ["3"]
    with pytest.raises(files.UnreadableFile):
        files.read_file(spark, path, landing=str(tmp_path / "again"))


def test_small_splits_share_tasks(spark, tmp_path, monkeypatch):
    """The number of tasks does not grow with that of the splits, and no task takes the starts of all splits along."""
    from tablepulse.sources import splits

    monkeypatch.setattr(splits, "TASKS_PER_CORE", 1)
    some = random.Random(4)
    rows = csv_rows(some, 400)
    path = write(tmp_path, "f.csv", as_csv([("id", "t", "v"), *rows], some))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 64)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 100
        found = files.records(spark, path)
        tasks = splits._lines(spark, path).rdd.getNumPartitions()
        ids = [r["value"].split(",")[0].strip('"') for r in found.orderBy("_row_no").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert tasks <= spark.sparkContext.defaultParallelism
    assert ids == ["id", *(r[0] for r in rows)]
