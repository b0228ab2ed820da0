from __future__ import annotations

import pytest

from lexweave import schemas
from lexweave.sources import readers as R
from lexweave.sources import writers as W
from lexweave.streaming import requests
from tests.conftest import rows


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_documents(spark, tmp_path):
    path = put(tmp_path, "raw", '1\tT\t<AbstractText Label="A">x</AbstractText>\nx\tT\tB\n2\tT\n3\tT\tB\textra\n \t4\tT\tB\n5\tT\tB\t\t\n')
    assert rows(R.documents(spark, path)) == [(1, "T", "x"), (4, "T", "B"), (5, "T", "B")]
    with pytest.raises(Exception, match="not three fields"):
        R.documents(spark, path, strict=True).collect()


def test_tables(spark, tmp_path):
    q = put(tmp_path, "q", "pmid\tdescriptor_name\tqualifier_name\tqualifier_name_major_yn\n1\ta\tb\tY\n2\ta\tc\tN\n")
    assert rows(R.qualifiers(spark, q)) == [(1, "a", "b", True), (2, "a", "c", False)]
    assert rows(R.ids(spark, put(tmp_path, "i", "3\n1\nx\n2\n"), 2)) == [(1,), (2,)]
    assert rows(R.neighbours(spark, put(tmp_path, "n", "1\t2\t30\tlink\n"))) == [(1, 2, 30, "link")]
    assert rows(R.dictionary(spark, put(tmp_path, "d", '"C1","a, b"\n'))) == [("C1", "a, b")]
    assert rows(R.weight_lines(R.lines(spark, put(tmp_path, "w", "7\t1,0.5\t2,0.25\tbad\n8\n")), "t", "p")) == [(7, 1, 0.5), (7, 2, 0.25)]


def test_annotations(spark, tmp_path):
    path = put(tmp_path, "a", "1|t|title\n1\t0\t3\tabc\tGene\t9\n1\t0\t3\tabc\tDisease\n\n2\t0\t1\tx\tGene\t8\n")
    df = R.annotations(spark, path)
    assert df.count() == 3 and df.filter("id is null").count() == 1
    symbols = spark.createDataFrame([("9", "ABC1")], "id string, symbol string")
    assert rows(R.entities(df, "Gene", symbols)) == [(1, "ABC1", "9")]
    assert rows(R.annotation_words(spark, path)) == [(1, "abc"), (2, "x")]


def test_json_and_xml(spark, tmp_path):
    j = put(tmp_path, "j", '{"pmid": 1, "articleTitle": "", "abstractText": "x"}\n{"pmid": 2}\n')
    assert rows(R.articles_json(spark, j)) == [(1, "no title", "x"), (2, "no title", "no abstract")]
    x = put(tmp_path, "x", "<Set><Citation><PMID>1</PMID><ArticleTitle>T</ArticleTitle><AbstractText>a b</AbstractText><DescriptorName>h</DescriptorName><DescriptorName>i</DescriptorName></Citation><Citation><PMID>no</PMID></Citation></Set>")
    assert [tuple(r) for r in R.citations_xml(spark, x).collect()] == [(1, "T", "a b", ["h", "i"], 2)]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(10, "a"), (9, "b")], "k int, line string")
    out = str(tmp_path / "out")
    W.guard(spark, out)
    W.parquet(df, out)
    with pytest.raises(W.PathExists):
        W.guard(spark, str(tmp_path / "other"), out)
    W.local_file(df, str(tmp_path / "one"), "k")
    assert (tmp_path / "one").read_text() == "a\nb\n"
    W.dictionary(spark, {"a": 0.5}, str(tmp_path / "dict"))
    assert rows(spark.read.parquet(str(tmp_path / "dict"))) == [("a", 0.5)]
    W.per_source(df, str(tmp_path / "reports"), "k", "line")
    assert rows(spark.read.text(str(tmp_path / "reports")).select("value", "k")) == [("a", 10), ("b", 9)]


def test_key_value_flushes_the_rest(spark, tmp_path):
    at = str(tmp_path / "store")

    def put_rows(client, held):
        with open(client, "a") as f:
            f.write("".join(f"{r.k}\n" for r in held))

    W.key_value(spark.range(25).toDF("k").coalesce(1), lambda: at, put_rows, 10)
    assert sorted(map(int, open(at).read().split())) == list(range(25))


def test_jdbc(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows_ = [(1, "T\tx", "naïve"), (2, "U", ""), (3, "V", "z")]
    df = spark.createDataFrame(rows_, "pmid int, article_title string, abstract_text string")
    W.jdbc(df, url, "medline_citation", createTableColumnTypes="article_title varchar(100), abstract_text varchar(100)")
    got = R.citations_jdbc(spark, url)
    assert rows(got) == [(1, "T x", "nave"), (3, "V", "z")]
    assert R.title_and_abstract(got, 3) == ("V", "z") and R.title_and_abstract(got, 9) == ("", "")
    q = R.jdbc(spark, url, 'select max("pmid") as m from medline_citation')
    assert q.first()[0] == 3


def test_request_needs_an_output(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a").write_text("1\tT\tword word\n")
    vocab = spark.createDataFrame([("word", 1, 2.0)], "term string, term_id int, idf double")
    mat = spark.createDataFrame([(1, 5, 0.5)], schemas.MATRIX)
    run = lambda n: requests.score_requests(spark, str(inbox), vocab, mat, str(tmp_path / f"out{n}"), str(tmp_path / f"check{n}"))
    with pytest.raises(Exception, match="no output line"):
        run(1).awaitTermination()
    (inbox / "a").unlink()
    (inbox / "b").write_text("output\t/x\ncallback\tq\n1\tT\tword word\n2\tT\tother\n")
    run(2).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out2")).select("src", "rel", "output")
    assert rows(got) == [(1, 5, "/x")]


def test_printed_batches(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a").write_text("one\ntwo\n")
    shown: list[str] = []
    requests.printed(spark, str(inbox), str(tmp_path / "check"), shown.append).awaitTermination()
    assert shown[0] == "Batch 0: 2 lines" and sorted(shown[1:]) == ["one", "two"]
