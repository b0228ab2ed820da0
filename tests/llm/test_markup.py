from __future__ import annotations

import pytest

from lexweave.llm import markup as Q

H, M, W, L = "html", "markdown", "wiki", "latex"
CASES = [
    ("Plain text, p < 0.05 and n > 30.", set()),
    ("Sample #3 was lost; set {1, 2} was kept. Doses of 2*3 and 4 * 5 mg in the R&D unit.", set()),
    ("Sites A_1 and B_2_x were merged (see [4]). Gene ab_cd_1 and 5' ends or 3'' marks were read.", set()),
    ("Uptake of [3H]-label. The ratio a = b / c holds if x == y. The price rose from $40 to $65 per dose.", set()),
    (r"Files lay under D:\assay\plate7 until read. Limits (<LOD) were kept, those >ULN not.", set()),
    ('<AbstractText Label="null" NlmCategory="UNLABELLED">x</AbstractText>', {(H, "other")}),
    ("<AbstractText>x</AbstractText>", {(H, "other")}),
    ('<AbstractText Label="AIM" NlmCategory="AIM">x</AbstractText>\n<AbstractText Label=\'END\'>y</AbstractText>', {(H, "heading")}),
    ("A &#946;-form and &amp; sign", {(H, "other")}),
    ("a &lt;b&gt; c", {(H, "other")}),
    ("Ca<sup>2+</sup> and H<SUB>2</SUB>O<br/>", {(H, "other")}),
    ("x<OL><LI>a<LI>b</OL> y", {(H, "list")}),
    ("<h2>X</h2>y <math><mi>k</mi><mo>=</mo><mn>1</mn></math>", {(H, "heading"), (H, "formula")}),
    ("a\n<pre><code># fit\ny = f(x) * 2\nif y < 0: y = 0\n- x\n</code></pre>\nb", {(H, "code")}),
    ("## Head\n\ntext", {(M, "heading")}),
    ("text\n\nHead part\n=========\n\ntext", {(M, "heading")}),
    ("a\n\n- b\n- c\n", {(M, "list")}),
    ("a\n1. b\n2. c\n", {(M, "list")}),
    ("a\n\n```\n# load\nx <- scan('a')\n- x\n```\n\nb", {(M, "code")}),
    ("The call `fit(x, k=2)` was used.", {(M, "code")}),
    ("This **a** and the __b__ group. See [the set](/data/3).", {(M, "other")}),
    ("a\n== Head ==\nb", {(W, "heading")}),
    ("a\n* [[b]]\n* [[c]]\nd", {(W, "list"), (W, "other")}),
    (r"Here <math>k_{1} = \frac{a}{b}</math> holds for [[x]].", {(W, "formula"), (W, "other")}),
    ("The '''a''' and ''b'' forms {{cite|x|1999}}.", {(W, "other")}),
    (r"\section{A} text", {(L, "heading")}),
    ("a\n\\begin{itemize}\n\\item b\n\\end{itemize}", {(L, "list")}),
    ("a\n\\begin{verbatim}\nrun x --n 5 \\item # y\n\\end{verbatim}", {(L, "code")}),
    (r"With $\mu = 0.2$ and \(x^{2} \leq \beta\) or \[ y = 5 \].", {(L, "formula")}),
    (r"About 5\% of G\"orlan~et al.\ cases were {\bf x}.", {(L, "other")}),
    (r"The \textit{a} type is \emph{b}~\cite{c5}.", {(L, "other")}),
    ("", set()),
    ("<", set()),
    ("& && &; &nosuch; <> </> <3", set()),
]


@pytest.mark.parametrize("text, want", CASES)
def test_elements(text, want):
    assert Q.elements(text) == want


@pytest.mark.parametrize("text", [t for t, want in CASES if not want])
def test_plain_text_stays(text):
    assert Q.clean(text) == (text, [])


@pytest.mark.parametrize(
    "text, want",
    [
        ('<AbstractText Label="AIM">Some text, <i>here</i> &amp; now.</AbstractText>', "# AIM\nSome text, here & now."),
        ("Text one.<ul><li>a</li><li>b</li></ul>Text two.", "Text one.\n- a\n- b\nText two."),
        ("## Head\n\nA **bold** [link](/x).\n\n```\n- x\n```\n", "# Head\nA bold link.\n```\n- x\n```"),
        ("a\n== Head ==\n'''b''' [[c|d]] <math>k_1</math>", "a\n# Head\nb d $k_1$"),
        (r"\section{A} It is \emph{b}, 5\% of $\mu$.", "# A\nIt is b, 5% of $\\mu$."),
        ("<p>Kept text.</p><script>var x = 1;</script>", "Kept text."),
    ],
)
def test_clean(text, want):
    assert Q.clean(text)[0] == want


def test_noise_paths_go_and_structure_stays():
    nodes = [Q.Node(("p", "text"), "text", "A long sentence, with commas, of many words. " * 10)] * 5
    nodes += [Q.Node(("nav", "text"), "text", "Home")] * 8 + [Q.Node(("h2", "heading"), "heading", "B")]
    kept = {n.path[0] for n in Q.content(nodes)}
    assert kept == {"p", "h2"}


def test_long_and_null_texts(spark):
    long = "<p>" + "word " * 300_000 + "</p>" + "<i>" * 2000 + "*" * 5000 + "[" * 5000
    df = spark.createDataFrame([(1, None), (2, ""), (3, long), (3, "<i>a</i>")], "pmid int, abs string")
    out = Q.cleaned(df, "pmid", "abs").collect()
    assert [(r._key, r.text is None, len(r.elements)) for r in out if r._key < 3] == [(1, True, 0), (2, False, 0)]
    assert sum(r._key == 3 for r in out) == 2


def test_empty_and_odd_tables(spark, empty_sf, odd_sf, sf):
    assert Q.p2_found(spark, empty_sf).count() == 0
    plain, odd = ({tuple(r) for r in Q.p2_found(spark, d).collect()} for d in (sf, odd_sf))
    assert plain == odd


P1 = "The uptake rose in all cases, as the first series showed; the level fell after that, and stayed low."
P2 = "It is not known why, but the second series, of 27 subjects, agrees with the first in all respects."
#: Pages, the lines that are content, and the lines that are noise.
LABELLED = [
    (f'<html><body><nav><ul><li><a href="/">Home</a></li><li><a href="/b">Browse</a></li></ul></nav><h1>Head</h1><p>{P1}</p><p>{P2}</p><ul><li>gamma</li></ul><footer>Copyright 2020</footer></body></html>', {"# Head", P1, P2, "- gamma"}, {"Home", "- Home", "Browse", "- Browse", "Copyright 2020"}),
    (f'<div><a href="/s">Share</a> | <a href="/t">Tweet</a></div><div><p>{P1}</p><p>{P2} {P1}</p></div><aside>Read more</aside>', {P1, f"{P2} {P1}"}, {"Share | Tweet", "Read more"}),
    (f"{P1}\n\n{P2}\n\n[Home](/) | [Up](/up)\n\n- one\n- two\n\n```\nx = 1\n```", {P1, P2, "- one", "- two", "x = 1"}, {"Home | Up"}),
    (f"== Head ==\n{P1}\n{P2}\n* [[Link one]]\n* [[Link two]]\n", {"# Head", P1, P2, "- Link one", "- Link two"}, set()),
    (f"{P1} {P2} {P1} <p>Gamma was next.</p> {P1} {P2}<footer><p>All rights reserved.</p></footer>", {"Gamma was next."}, {"All rights reserved."}),
    (f'<AbstractText Label="AIM">{P1}</AbstractText><AbstractText Label="END">It held.</AbstractText>', {"# AIM", P1, "# END", "It held."}, set()),
    (f"<p>{P1}</p><p>Short, but so.</p><p>{P2}</p><pre>run x</pre>", {P1, "Short, but so.", P2, "`run x`"}, set()),
    (f"<nav><h3>Menu</h3><a href='/a'>A</a></nav><article><h2>Head</h2><p>{P1}</p><p>{P2}</p></article>", {"# Head", P1, P2}, {"A", "# Menu"}),
]


def test_paths_select_content_in_a_labelled_set():
    kept = dropped = content = noise = 0
    for page, good, bad in LABELLED:
        lines = set(Q.clean(page)[0].split("\n"))
        kept, content = kept + len(good & lines), content + len(good)
        dropped, noise = dropped + len(bad - lines), noise + len(bad)
    assert kept == content and dropped == noise


def test_the_threshold_decides():
    nodes = [Q.Node(("p", "text"), "text", P1), Q.Node(("p", "text"), "text", P2), Q.Node(("aside", "text"), "text", "Read more"), Q.Node(("div", "text"), "text", P2)]
    smooth, mean = Q.ratios(nodes)
    assert mean[2] < Q.KEEP * smooth.std() <= min(mean[0], mean[1], mean[3])


@pytest.mark.parametrize("text, path", [("<div><ul><li>a</li></ul></div>", ("html", "div", "ul", "li", "list")), ("<AbstractText Label='A'>x `y`</AbstractText>", ("markdown", "abstracttext", "code")), ("x<OL><LI>a<LI>b</OL> &amp;", ("html", "other"))])
def test_paths_of_the_tree(text, path):
    assert path in {m.path for m in Q.analysed(text)[0].marks}


@pytest.mark.parametrize(
    "text, want",
    [
        ("> quoted ~~old~~ [text][r]\n\n[r]: http://x.y\n\n***\n\n**b** one", "quoted old text\nb one"),
        ("'''a''' __TOC__ [http://x.y label] here", "a  label here"),
        (r"\textbf{a \emph{b \textit{c \textsc{d \textsf{e}}}}} end", "a b c d e end"),
    ],
)
def test_what_is_found_is_removed(text, want):
    assert Q.clean(text)[0] == want


GOLDEN = {
    1: {("html", "heading")},
    2: {("wiki", "heading"), ("wiki", "list"), ("wiki", "other")},
    3: {("latex", "formula"), ("latex", "other")},
    5: {("markdown", "code"), ("markdown", "list")},
}


def test_golden_rows(spark, tmp_path):
    """The current row of each article counts, with all that it holds and nothing else."""
    rows = [
        (1, "<AbstractText Label='AIM'>x</AbstractText>", "2020-02-01"), (1, "== Old ==", "2020-01-01"), (2, "== H ==\n* [[a]]\n* [[b]]", "2020-01-01"),
        (3, r"\emph{a} is $\mu = 2$", "2020-01-01"), (3, r"\emph{a} is $\mu = 2$", "2020-01-01"), (4, "plain, p < 0.05", "2020-01-01"), (5, "a\n\n- b\n- `c`\n", "2020-01-01"), (6, None, "2020-01-01"), (None, "<b>x</b>", "2020-01-01"),
    ]
    spark.createDataFrame(rows, "pmid int, abs string, l string").selectExpr("pmid", "abs", "timestamp(l) loaded_at").write.parquet(str(tmp_path / "abstracts.parquet"))
    got = sorted((r.pmid, r.markup, r.element) for r in Q.p2_found(spark, str(tmp_path)).collect())
    assert got == sorted((k, *p) for k, ps in GOLDEN.items() for p in ps)
