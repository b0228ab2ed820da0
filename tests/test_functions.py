from __future__ import annotations

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexweave.functions import text as X
from lexweave.functions import weights as W
from lexweave.functions.stemmer import stem
from lexweave.functions.tagging import PhraseTrie, annotator, cascade


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in values.items()])
    return df.select(column.alias("r")).first()[0]


@pytest.mark.parametrize(
    "function, value, want",
    [
        (X.strip_sections, '<AbstractText Label="A" NlmCategory="B">x</AbstractText> <AbstractText Label="C">y</AbstractText>', "x y"),
        (X.strip_sections, "<AbstractText>x</AbstractText>", "<AbstractText>x"),
        (X.tabs_to_spaces, "a\tb", "a b"),
        (X.drop_non_ascii, "naïve", "nave"),
        (X.trim_quotes, ' "a" ', "a"),
        (X.word_count, "a b  c  ", 4),
        (X.word_count, "", 1),
        (X.normalize_phrase, "Heart-Attack,  Acute", "heart attack acute"),
        (X.sort_words, "b a c", "a b c"),
        (X.analysed_phrase, "The Heart of the Matter", "heart matter"),
        (X.strip_balanced, "(abc)", "abc"),
        (X.strip_balanced, "(abc", "(abc"),
        (X.is_ascii, "é", False),
        (X.part_name, 7, "part-00007"),
    ],
)
def test_text(spark, function, value, want):
    assert one(spark, function(F.col("v")), v=value) == want


def test_counts_and_lists(spark):
    count = X.substring_count(F.col("v"), F.col("n"))
    assert one(spark, count, v="aaaa", n="aa") == 2 and one(spark, count, v="abc", n="") == 0
    assert one(spark, X.ngrams(F.col("v"), 2), v=["a", "b", "c"]) == ["a b", "b c"]
    assert one(spark, X.ngrams(F.col("v"), 4), v=["a", "b", "c"]) == []
    assert one(spark, X.strip_marks(F.col("v")), v=["(a,", "--", "..."]) == ["a", "--"]
    assert one(spark, X.decapitalise_first(F.col("v")), v=["The", "End"]) == ["the", "End"]
    assert one(spark, X.decapitalise_first(F.col("v")), v=["DNA", "End"]) == ["DNA", "End"]
    assert one(spark, X.weight_pair(F.col("k"), F.col("w")), k=7, w=0.5) == "7,0.500000"
    with pytest.raises(Exception, match="neither Y nor N"):
        one(spark, X.yes_no(F.col("v")), v="x")


def test_weights(spark):
    w = lambda idf, tf, n: one(spark, W.two_poisson(F.col("i"), F.col("t"), F.col("n")), i=idf, t=tf, n=n)
    assert w(0.0, 1, 5) == 0 and math.isclose(w(4.0, 1, 0), 1.0)
    assert w(4.0, 2, 10) > w(4.0, 1, 10) > w(4.0, 1, 100)
    ratio = W.overlap_ratio(F.col("c"), F.col("a"), F.col("b"))
    assert one(spark, ratio, c=2, a=3, b=4) == 0.4 and one(spark, ratio, c=0, a=0, b=0) == 0
    assert one(spark, W.dot(F.col("a"), F.col("b")), a=[1.0, 2.0], b=[3.0, 4.0]) == 11
    assert one(spark, W.normalised(F.col("a")), a=[3.0, 4.0]) == [0.6, 0.8]
    assert math.isnan(one(spark, W.normalised(F.col("a")), a=[0.0])[0])
    assert math.isclose(one(spark, W.idf(F.lit(7), F.lit(2), "integer")), math.log(3))


def test_stems():
    pairs = dict(caresses="caress", ponies="poni", cats="cat", agreed="agre", matting="mat", relational="relat", hopefulness="hope", electrical="electr", adoption="adopt", controll="control", sky="sky", at="at")
    assert {w: stem(w) for w in pairs} == pairs


@given(st.text("abcdefghijklmnopqrstuvwxyz", max_size=20))
@settings(max_examples=200, deadline=None)
def test_stem_never_grows_by_more_than_an_e(word):
    assert len(stem(word)) <= len(word) + 1


def test_trie():
    t = PhraseTrie([("a b", 1), ("c d", 2)])
    assert t.find("a b c d".split()) == [1, 2] and t.find("a b c d".split(), compat=True) == [1]
    t = PhraseTrie([("a b", 1), ("a b c d", 2)])
    assert t.find("a b c x".split()) == [1] and t.find("a b c x".split(), compat=True) == []
    assert PhraseTrie().find(["a"]) == [] and t.find([]) == []


def test_cascade_levels(spark):
    words = spark.createDataFrame([(1, "Heart Attack"), (2, "lung-disease"), (3, "kidney stone"), (4, "pain of head"), (None, "x")], "cui long, str string")
    phrases = spark.createDataFrame([("Heart Attack",), ("Lung Disease",), ("stone, kidney",), ("the pain in head",), ("nothing",), (None,)], "phrase string")
    got = {r.phrase: (r.level, r.cui, r.score) for r in cascade(phrases, "phrase", words).collect()}
    assert got == {"Heart Attack": ("exact", 1, 100.0), "Lung Disease": ("norm", 2, 45.0), "stone, kidney": ("sorted", 3, 80.0), "the pain in head": ("analysed", 4, 52.5)}


def test_annotation(spark):
    tag = annotator([(1, "heart attack"), (2, "heart"), (3, "acute pain")])
    df = spark.createDataFrame([("heart attack",), ("bad heart attack plus acute pain",), ("",), (None,)], "t string")
    got = [None if r[0] is None else [(x.matched, x.cui) for x in r[0]] for r in df.select(tag("t")).collect()]
    assert got == [[("heart attack", 1)], [("heart attack", 1), ("acute pain", 3)], [], None]
