from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from lexweave.functions.tagging import PhraseTrie, annotated, annotator, phrases_of
from lexweave.plans import registry

N = 620


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """One article for each of more headings than the taggers once had entries; the last article has three."""
    at = tmp_path_factory.mktemp("many")
    rows = [(i, f"word{i:03d} thing{i % 7}") for i in range(N)] + [(N - 1, "the tail"), (N - 1, "Zz/word617 thing1")]
    rows = [(i, m, "N", datetime.datetime(2020, 1, 1)) for i, m in rows]
    spark.createDataFrame(rows, "pmid int, mesh string, major string, loaded_at timestamp").write.parquet(str(at / "mesh_heading.parquet"))
    return str(at)


def test_every_heading_is_an_entry(spark, many):
    q = registry.queries()
    found = q["trie_phrases"](spark, many).groupBy("pmid").count().collect()
    assert {r[0] for r in found} == set(range(N)) and sum(r[1] for r in found) == N + 2
    assert q["cascade_match"](spark, many).count() == N + 2
    tagged = q["concept_annotation"](spark, many).collect()
    assert {r.pmid for r in tagged} == set(range(N)) and len({r.cui for r in tagged}) == N + 2


def test_joined_taggers_find_what_those_in_memory_do(spark):
    rnd = random.Random(7)
    words = ["a", "b", "The", "of", "heart", "Heart", "x-y", "", "é", "b,"]
    make = lambda n: " ".join(rnd.choice(words) for _ in range(rnd.randint(1, n)))
    entries = [(i, make(4)) for i in range(60)] + [(60, "a  b"), (61, "a b")]
    texts = [make(12) for _ in range(150)] + ["", "zzz"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "pmid int, t string")
    df = docs.select("pmid", F.split("t", " ").alias("w"))
    got = phrases_of(df, "pmid", "w", spark.createDataFrame(entries, "id int, str string"))
    want = {i: PhraseTrie([(p, n) for n, p in entries]).find(t.split(" ")) for i, t in enumerate(texts)}
    there: dict[int, list[int]] = {i: [] for i in want}
    for r in got.collect():
        there[r.pmid].append(r.phrase_id)
    assert there == want
    inmem = {r.pmid: r.c for r in docs.select("pmid", annotator(entries)("t").alias("c")).collect()}
    joined = {r.pmid: r.concepts for r in annotated(docs, "t", spark.createDataFrame(entries, "cui long, str string")).collect()}
    assert {k: v for k, v in inmem.items() if v} == {k: v for k, v in joined.items() if v}


def test_golden_stems(spark, tmp_path):
    """Documents of each stem of the titles, and the stems of all words of all documents, whatever their language."""
    t = datetime.datetime(2020, 1, 1)
    titles = [(1, "Caresses of ponies", None, t), (2, "A pony agreed; cats matting", None, t), (3, "CATS and a caress", None, t), (3, "An older title", None, t - datetime.timedelta(1)), (4, None, "x", t)]
    spark.createDataFrame(titles, "pmid int, title string, abs string, loaded_at timestamp").write.parquet(str(tmp_path / "abstracts.parquet"))
    docs = [(1, "relational cats", "en"), (2, "Cats, hopping", None), (3, None, "de")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    q = registry.queries()
    assert {r.stem: r.df for r in q["stem_df"](spark, str(tmp_path)).collect()} == {"caress": 2, "of": 1, "poni": 2, "agre": 1, "cat": 2, "mat": 1, "and": 1}
    assert {r.word: r.stem for r in q["porter_stem"](spark, str(tmp_path)).collect()} == {"relational": "relat", "cats": "cat", "hopping": "hop"}
