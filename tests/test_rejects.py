from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexweave.operators import rejects as R
from tests.conftest import rows

CASES = [
    ("abstract", "12\tA title\tSome text.", None),
    ("abstract", "12\t\tSome text.", None),
    ("abstract", ' 012 \t"A ""so-called"" case"\t"a\tb"', None),
    ("abstract", '12\tsays "hi" there\tSome "quoted" text', None),
    ("abstract", '12\t"open\tSome text', "quoting"),
    ("abstract", '12\tx\t"closed" too soon', "quoting"),
    ("abstract", '12\tx\t"""', "quoting"),
    ("abstract", '"12\tx', "quoting"),
    ("abstract", '12\tx\t""', "value"),
    ("abstract", '12\tx\t"  "', "value"),
    ("abstract", "12\tx\t ", "value"),
    ("abstract", "12\tx", "columns"),
    ("abstract", "", "columns"),
    ("abstract", "12\tx\ty\t", "columns"),
    ("abstract", None, "columns"),
    (None, "12\tx\ty", "columns"),
    ("other", "12\tx\ty", "columns"),
    ("abstract", "0\tx\ty", "value"),
    ("abstract", "000\tx\ty", "value"),
    ("abstract", "2147483647\tx\ty", None),
    ("abstract", "2147483648\tx\ty", "value"),
    ("abstract", "00000000000000000000012\tx\ty", None),
    ("abstract", "99999999999999999999999\tx\ty", "value"),
    ("abstract", "1e3\tx\ty", "value"),
    ("abstract", "+3\tx\ty", "value"),
    ("abstract", "٣\tx\ty", "value"),
    ("abstract", "3\n\tx\ty", "value"),
    ("abstract", "3\tx\tbad � here", "value"),
    ("abstract", "3\tx\tbad \x1a here", "value"),
    ("abstract", '3\tx\t"good\there"', None),
    ("abstract", "3\tx\t" + "long " * 200_000, None),
    ("abstract", '3\tx\t"' + '""' * 100_000 + '"', None),
    ("qualifier", "5\tHuman\tblood\tY", None),
    ("qualifier", '5\tHuman\tblood\t "N" ', "value"),
    ("qualifier", '5\tHuman\tblood\t"N"', None),
    ("qualifier", "5\tHuman\tblood\tN  ", None),
    ("qualifier", "5\tHuman\tblood\ty", "value"),
    ("qualifier", "5\tHuman\tY\tblood", "value"),
    ("qualifier", "5\tHuman\tblood", "columns"),
    ("qualifier", "pmid\tdescriptor_name\tqualifier_name\tqualifier_name_major_yn", "header"),
    ("abstract", "pmid\tdescriptor_name\tqualifier_name\tqualifier_name_major_yn", "columns"),
]

@pytest.fixture(scope="module")
def feed(spark):
    data = [(i, f, None, line, None) for i, (f, line, _) in enumerate(CASES)]
    return spark.createDataFrame(data, "line_id long, feed string, file_name string, line string, received_at timestamp")


def test_reasons(feed):
    got = {r.line_id: r.reason for r in R.rejected(feed).collect()}
    want = {i: reason for i, (_, _, reason) in enumerate(CASES) if reason not in (None, "header")}
    assert got == want


def test_every_line_is_loaded_rejected_or_a_header(feed):
    bad = {r.line_id for r in R.rejected(feed).select("line_id").collect()}
    good = {r.line_id for f in R.FEEDS for r in R.loaded(feed, f).select("line_id").collect()}
    header = {i for i, c in enumerate(CASES) if c[2] == "header"}
    assert bad | good | header == set(range(len(CASES))) and not bad & good


def test_cells_are_unquoted_and_typed(feed):
    row = R.loaded(feed, "abstract").filter("line_id = 2").first()
    assert tuple(row)[1:] == (12, 'A "so-called" case', "a\tb")
    assert R.loaded(feed, "qualifier").schema["pmid"].dataType.simpleString() == "int"


def test_broken_fields_are_named(spark):
    df = spark.createDataFrame([(1, "qualifier", "x\ta\tb\tz")], "line_id long, feed string, line string")
    assert rows(R.rejected(df)) == [(1, "qualifier", "value", ["pmid", "qualifier_name_major_yn"])]


def test_repeated_and_empty(spark, feed):
    assert R.rejected(feed.limit(0)).count() == 0
    df = spark.createDataFrame([(1, "abstract", "x")] * 2, "line_id long, feed string, line string")
    assert R.rejected(df.withColumn("cells", F.lit(1))).count() == 2
