from __future__ import annotations

import datetime as dt

import pytest

from lexweave.operators.current import current_rows
from tests.conftest import rows

T = [dt.datetime(2024, 1, i) for i in range(1, 5)]
DATA = [(1, "a", T[0]), (1, "b", T[1]), (2, "c", T[0]), (2, "c", T[0]), (3, "d", None), (3, None, T[0]), (4, "e", None), (4, "f", None), (None, "g", T[0]), (5, None, T[2])]


@pytest.mark.parametrize("limit", [1000, 0])
def test_latest_row_of_each_key(spark, limit):
    df = spark.createDataFrame(DATA, "k int, v string, t timestamp")
    assert rows(current_rows(df, "k", "t", ["v"], limit)) == [(1, "b"), (2, "c"), (3, None), (4, "f"), (5, None)]


def test_empty(spark):
    df = spark.createDataFrame([], "k int, v string, t timestamp")
    assert current_rows(df, "k", "t", ["k", "v"]).count() == 0
