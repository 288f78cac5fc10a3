"""Quoted records over many blocks against the reader that takes a file whole."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tabloom.sources import delimited
from tabloom.sources.records import read_records


def whole(spark, path, width, header=False):
    """Rows of the unsplit reader, in file order."""
    df = spark.read.csv(
        str(path), header=header, inferSchema=False, escape='"', multiLine=True, ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False, schema=", ".join(f"c{i} string" for i in range(width)),
    )
    return [tuple(r) for r in df.collect()]


def by_blocks(spark, path, width, header=False):
    options = dict(sep=",", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    rows = delimited._parsed(read_records(spark, [str(path)], ",", False), width, header, options, True)
    return [tuple(r)[:width] for r in rows.orderBy("_file", "_block", "_line").collect()]


@pytest.fixture
def small_blocks(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


def test_random_records_over_many_blocks(spark, tmp_path, small_blocks):
    draw = random.Random(4)

    def field():
        text = "".join(draw.choice('ab ,"\n') for _ in range(draw.randrange(14)))
        plain = not any(c in text for c in ',"\n')
        return text if plain and draw.random() < 0.7 else '"' + text.replace('"', '""') + '"'

    for ending in ("\n", "\r\n"):
        path = tmp_path / f"{len(ending)}.csv"
        lines = [f"{i},{field()},{field()}" for i in range(400)]
        path.write_bytes(("a,b,c" + ending + ending.join(lines) + ending).encode())
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 20
        got = by_blocks(spark, path, 3, header=True)
        assert got == whole(spark, path, 3, header=True) and len(got) == 400


@pytest.mark.parametrize("body", [
    '1,5" pipe,x\n2,b,y\n3,c,z\n' * 30,  # a quote inside a plain field opens nothing
    'a,b,c\n1,"x"y,z\n2,"p ""q"" r",s\n\n\n3,"line\n\nline",t\n',  # text behind a closing quote; blank lines outside and inside
    'a,"b\n' + "c,d\n" * 40 + 'e",f\ng,h,i\n' + "j,k,l\n" * 40,  # a record over many blocks
    "a,b,c\n" * 20 + 'd,"never closed\n' + "e,f,g\n" * 20,
    "a,b,c\r\n" * 20 + 'd,"never closed\r\n' + "e,f,g\r\n" * 20,
    "a,b,c\n" * 20 + 'd,"never closed\n' + "e,f,g\n" * 20 + "h,i,j",
    '"",,""\n"\n",x,""""\n',
])
def test_odd_quotes_equal_the_unsplit_reader(spark, tmp_path, small_blocks, body):
    path = tmp_path / "x.csv"
    path.write_bytes(body.encode())
    assert by_blocks(spark, path, 3) == whole(spark, path, 3)


def test_a_stray_quote_leaves_a_file_in_many_tasks(spark, tmp_path, small_blocks):
    path = tmp_path / "x.csv"
    path.write_text("n,size\n" + "".join(f'{i},{i}{chr(34) * (i == 7)} inch\n' for i in range(300)))
    marks = delimited.scan_files(spark, str(path)).first()
    assert marks["spans_lines"] and not marks["bare_returns"]
    df = delimited.read_delimited(spark, str(path), row_id="at")
    rows = df.orderBy("at").collect()
    assert [r["n"] for r in rows] == list(range(300)) and rows[7]["size"] == '7" inch'
    blocks = read_records(spark, [str(path)], ",", False).select("block").distinct().count()
    assert blocks > 20


def test_encodings_headers_and_bare_returns(spark, tmp_path, small_blocks):
    (tmp_path / "a.csv").write_bytes('﻿t,n\r\n"ü\r\nx",1\r\n'.encode())
    (tmp_path / "b.csv").write_bytes('t,n\n"€\ny",2\nz,3\n'.encode("cp1252"))
    (tmp_path / "c.csv").write_bytes(b't,n\r"p\rq",4\rr,5\r')
    marks = {r["file"][-5]: r for r in delimited.scan_files(spark, str(tmp_path)).collect()}
    assert [marks[f]["bare_returns"] for f in "abc"] == [False, False, True]
    got = delimited.read_delimited(spark, str(tmp_path), encodings=("utf-8", "cp1252"))
    # the unsplit reader, which c.csv still needs, also unifies line ends inside fields with those of the file
    assert sorted((r["n"], r["t"]) for r in got.collect()) == [(1, "ü\nx"), (2, "€\ny"), (3, "z"), (4, "p\nq"), (5, "r")]


def test_effects_of_lines(spark):
    from tabloom.sources.records import ends_inside

    cases = {'a,b': (False, True), '"': (True, False), 'a,"b': (True, False), 'a"b': (False, False), '"a""': (True, False), 'a,""': (False, True)}
    rows = spark.createDataFrame([(k,) for k in cases], "v string")
    got = rows.select("v", ends_inside(F.col("v"), ",", False).alias("out"), ends_inside(F.col("v"), ",", True).alias("in")).collect()
    assert {r["v"]: (r["out"], r["in"]) for r in got} == cases
