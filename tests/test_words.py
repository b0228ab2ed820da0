from __future__ import annotations

import pytest

from lexweave.functions import text as X
from lexweave.operators import words as V
from lexweave.sources import readers as R
from pyspark.sql import functions as F
from tests.conftest import rows


def test_lemmas(spark):
    words = ["cells", "studies", "boxes", "making", "stopped", "stop", "cell", "study", "box", "make", "higher", "high", "glass", "glasses", "women", "woman", "as", "bus", "running", None]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r.word: r.lemma for r in V.lemmas(df, "w", df).collect()}
    assert got == {"cells": "cell", "studies": "study", "boxes": "box", "making": "make", "higher": "high", "glasses": "glass", "women": "woman"}
    assert V.lemmas(df.limit(0), "w", df).count() == 0


def test_by_lemma_keeps_words_without_one(spark, monkeypatch):
    df = spark.createDataFrame([(1, "cells"), (1, "gut"), (2, "cells")], "doc int, term string")
    side = spark.createDataFrame([("cells", "cell")], "word string, lemma string")
    want = [(1, "cells", "cell"), (1, "gut", "gut"), (2, "cells", "cell")]
    assert rows(V.by_lemma(df, side).select("doc", "term", "lemma")) == want
    monkeypatch.setattr(V, "is_small", lambda *_: False)
    assert rows(V.by_lemma(df, side).select("doc", "term", "lemma")) == want


def test_counted_words(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, None), (4, ["a"] * 5000)], "k int, w array<string>")
    got = {r.k: r.c for r in df.select("k", F.sort_array("w").alias("w")).select("k", X.counted(F.col("w")).alias("c")).collect()}
    assert [tuple(e) for e in got[1]] == [("a", 1), ("b", 2)] and got[2] == [] and got[3] is None and [tuple(e) for e in got[4]] == [("a", 5000)]


def test_samples_lookups_and_tables(spark):
    df = spark.range(20_000)
    a = V.sampled(df, ["id"], 0.2, "1")
    assert 3700 < a.count() < 4300 and rows(a) == rows(V.sampled(df.repartition(7), ["id"], 0.2, "1")) != rows(V.sampled(df, ["id"], 0.2, "2"))
    assert V.sampled(df, ["id"], 0.0, "1").count() == 0 and V.sampled(df, ["id"], 1.0, "1").count() == 20_000
    assert V.lookup(df, "id", 7).id == 7
    with pytest.raises(KeyError):
        V.lookup(df, "id", -1)
    small = spark.createDataFrame([(2, "b"), (1, None)], "k int, name string")
    assert [r.line for r in V.table_lines(small, "k").orderBy("i").collect()] == ["+-+----+", "|k|name|", "+-+----+", "|1|    |", "|2|b   |", "+-+----+"]


def test_fetched_neighbours(spark):
    ids = spark.createDataFrame([(1,), (1,), (2,), (None,)], "pmid int")
    got = R.fetched_neighbours(ids, lambda i: [(i * 10, 5, "x")] if i == 1 else [])
    assert rows(got) == [(1, 10, 5, "x")]
