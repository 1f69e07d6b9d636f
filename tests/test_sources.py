"""Readers and writers."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmine.session import materialise, scratch_dir
from gridmine.sources import readers, writers


def test_line_numbers_per_file(spark):
    path = scratch_dir(spark) + "/lines"
    lines = spark.range(0, 1000, 1, 3).select(F.concat(F.lit("line "), F.col("id").cast("string")).alias("t"))
    writers.write_lines(lines, "t", path)
    rows = readers.read_lines(spark, path).orderBy("file", "line_no").collect()
    assert len(rows) == 1000
    per_file = {}
    for r in rows:
        assert r.line_no == len(per_file.setdefault(r.file, []))
        per_file[r.file].append(int(r.value.split()[1]))
    assert len(per_file) == 3
    assert all(v == sorted(v) for v in per_file.values())


def test_delimited_round_trip_with_quotes_and_breaks(spark):
    path = scratch_dir(spark) + "/d"
    df = spark.createDataFrame([(1, 'a "b" ~ c\nd', ["x", "y"]), (2, "", [])], "id int, t string, xs array<string>")
    writers.write_delim(df, path, "~")
    schema = T.StructType().add("id", T.IntegerType()).add("t", T.StringType()).add("xs", T.StringType())
    rows = readers.read_delim(spark, path, "~", schema, multiline=True).orderBy("id").collect()
    assert [(r.id, r.t or "", r.xs) for r in rows] == [(1, 'a "b" ~ c\nd', '["x","y"]'), (2, "", "[]")]


def test_payload(spark):
    df = spark.createDataFrame([(1, bytearray(b"1|a|HMD\r\n2|b|c|D\n"))], "id int, blob binary")
    rows = readers.explode_payload(df, "blob", ("id",)).collect()
    assert [(r.line_no, r.fields, r.tag) for r in rows] == [(0, ["1", "a", "HMD"], "HMD"), (1, ["2", "b", "c", "D"], "D")]


def test_materialise(spark):
    df = materialise(spark.range(10))
    assert df.count() == 10
