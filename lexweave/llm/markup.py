"""Problem 2: markup residue in text documents."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from html.entities import html5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.operators.current import current_rows
from lexweave.session import table

# Names of the public markup languages.
HEADING_TAGS = set("h1 h2 h3 h4 h5 h6".split())
LIST_TAGS = set("ul ol li dl dt dd menu dir list list-item".split())
CODE_TAGS = "pre code tt kbd samp"
WIKI_CODE_TAGS = "nowiki source syntaxhighlight"
BLOCK_TAGS = set("p div section article header footer nav aside main table tr td th thead tbody caption blockquote figure figcaption form sec body abstract abstracttext title hr".split())
INLINE_TAGS = set(
    "i b em strong sup sub a br span u s small big font del ins q cite abbr acronym img mark strike center address var dfn bdo bdi wbr label input button "
    "select option textarea script style noscript iframe html head meta link base ref references italic bold sc xref ext-link underline inf otherabstract copyrightinformation".split()
)
LATEX_HEADINGS = set("part chapter section subsection subsubsection paragraph subparagraph title".split())
LATEX_LISTS = set("itemize enumerate description".split())
LATEX_CODE = "verbatim lstlisting minted Verbatim alltt"
LATEX_FORMULAS = "equation align displaymath math eqnarray gather multline alignat flalign"
LATEX_OTHER = set(
    "textit textbf texttt textsc textrm textsf textsl textup textmd emph bf it rm sf sc tt sl em cite citep citet ref eqref label footnote url href underline caption "
    "includegraphics centering noindent newline newpage linebreak pagebreak hspace vspace mbox hbox text ldots dots LaTeX TeX par item author date maketitle "
    "tiny small large Large LARGE huge Huge footnotesize normalsize documentclass usepackage input include bibliography bibliographystyle "
    "alpha beta gamma delta epsilon varepsilon zeta eta theta kappa lambda mu nu xi pi rho sigma tau phi chi psi omega "
    "Gamma Delta Theta Lambda Xi Pi Sigma Phi Psi Omega frac sqrt sum prod int leq geq neq approx times cdot pm infty rightarrow leftarrow to mathrm mathbf mathit".split()
)
DROPPED_TAGS = "script style noscript"
VOID_TAGS = set("br hr img input meta link base wbr".split())
#: Tags that the next of their kind ends.
ENDED_BY_NEXT = set("li dt dd p tr td th option".split())

#: What a text must hold, inside a line or at its beginning, for any markup to be looked for. Every branch begins with a sign of
#: its own, so that plain text is passed over quickly.
ANY = re.compile(r"<[A-Za-z/!?]|&[#A-Za-z]\w*;|[\\`\[{$*]|''|_\S")
_LINE = r"[ ]{0,3}(?:#|=|[-+] |\d{1,3}[.)] |>|-{3})"
FIRST_LINE, NEXT_LINE = re.compile(_LINE), re.compile(r"\n" + _LINE)

_words = lambda names: "|".join(sorted(names.split(), key=lambda w: (-len(w), w)))
#: What a text must hold for any of SPANS to be looked for.
SPAN_START = re.compile(r"[`$]|\\[\[(]|\\begin|\\verb|~~~|<(?:!--|" + "|".join([DROPPED_TAGS, CODE_TAGS, WIKI_CODE_TAGS, "math"]).replace(" ", "|") + r"|\w+:math)\b", re.I)
#: Spans whose contents are no markup: code, formulas, comments.
SPANS = re.compile(
    rf"""(?P<fence>^[ ]{{0,3}}(?P<f>`{{3,}}|~{{3,}})[^\n`]*\n(?P<fence_in>.*?)(?:^[ ]{{0,3}}(?P=f)[`~]*[ \t]*$|\Z))
|(?P<comment><!--.*?-->)
|(?P<dropped><(?P<d>{_words(DROPPED_TAGS)})\b[^<>]*>.*?</(?P=d)\s*>)
|(?P<pre><(?P<p>{_words(CODE_TAGS)}|{_words(WIKI_CODE_TAGS)})\b(?P<pa>[^<>]*)>(?P<pre_in>.*?)</(?P=p)\s*>)
|(?P<math><(?P<m>(?:[a-z]+:)?math)\b[^<>]*>(?P<math_in>.*?)</(?P=m)\s*>)
|(?P<verbatim>\\begin\{{(?P<v>(?:{_words(LATEX_CODE)})\*?)\}}(?P<verbatim_in>.*?)\\end\{{(?P=v)\}})
|(?P<verb>\\verb\*?(?P<vq>[^\w\s*])(?P<verb_in>[^\n]*?)(?P=vq))
|(?P<equation>\\begin\{{(?P<e>(?:{_words(LATEX_FORMULAS)})\*?)\}}(?P<equation_in>.*?)\\end\{{(?P=e)\}})
|(?P<display>(?<!\\)\\\[(?P<display_in>.*?)\\\])
|(?P<inline>(?<!\\)\\\((?P<inline_in>.*?)\\\))
|(?P<dollars>(?<![\\$])\$\$(?P<dollars_in>[^$]+?)\$\$)
|(?P<dollar>(?<![\\$\w])\$(?=[^\s$])(?P<dollar_in>[^$\n]*?)(?<![\s\\])\$(?![\d$]))
|(?P<tick>(?<!`)(?P<t>`{{1,2}})(?!`)(?P<tick_in>[^`\n]+)(?P=t)(?!`))""",
    re.X | re.S | re.M | re.I,
)
TAG = re.compile(r"<(?P<close>/?)(?P<name>[A-Za-z][A-Za-z0-9]*(?:[:-][A-Za-z0-9]+)*)(?P<attrs>(?:\s[^<>]*)?)(?P<self>/?)>|<!(?:DOCTYPE|\[CDATA\[)[^<>]*>|<\?xml[^<>]*>", re.I)
LABEL = re.compile(r"""\bLabel\s*=\s*(?:"([^"]*)"|'([^']*)')""", re.I)
CHARREF = re.compile(r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
WIKI_HEADING = re.compile(r"^(={2,6})[ \t]*([^=\n][^\n]*?)[ \t]*\1[ \t]*$", re.M)
WIKI_LIST = re.compile(r"^[*#:;]+[ \t]*\S", re.M)
WIKI_LINK = re.compile(r"\[\[[^\[\]\n]+\]\]")
WIKI_TEMPLATE = re.compile(r"\{\{[^{}]+\}\}")
WIKI_QUOTES = re.compile(r"(?<![\w'])('{2,5})(?=[^\s'])([^\n]*?[^\s'])\1(?!['\w])")
WIKI_OTHER = re.compile(r"^\{\|.*?^\|\}|__(?:TOC|NOTOC|NOEDITSECTION|FORCETOC)__|\[https?://[^\s\]]+(?:\s[^\]\n]*)?\]|~{4}", re.M | re.S)
WIKI_OTHER_START = re.compile(r"\{\||__[A-Z]|\[http|~~~~")
MD_ATX = re.compile(r"^[ ]{0,3}(#{1,6})[ \t]+(\S[^\n]*?)[ \t]*#*[ \t]*$", re.M)
MD_SETEXT = re.compile(r"^(?=[^\n]*\w)[ ]{0,3}(?![-+*>#=])(\S[^\n]*)\n[ ]{0,3}(=+|-{2,})[ \t]*$", re.M)
MD_LIST = re.compile(r"^[ \t]{0,8}(?:[-+*]|\d{1,3}[.)])[ \t]+\S", re.M)
MD_OTHER_LIST = re.compile(r"^[ \t]{0,8}(?:[-+]|\d{1,3}[.)])[ \t]+\S", re.M)
MD_LINK = re.compile(r"!?\[[^\[\]\n]+\](?:\([^()\s]+(?:\s+\"[^\"\n]*\")?\)|\[[^\[\]\n]*\])|^[ ]{0,3}\[[^\]\n]+\]:[ \t]+\S+|<(?:https?|mailto):[^\s<>]+>", re.M)
MD_STRONG = re.compile(r"(?<![\w*])\*\*(?=[^\s*])[^*\n]*[^\s*]\*\*(?![\w*])|(?<![\w_])__(?=[^\s_])[^\n]*?[^\s_]__(?![\w_])|~~(?=\S)[^~\n]+~~")
MD_EMPHASIS = re.compile(r"(?<![\w*])\*(?=[^\s*])[^*\n]*[^\s*]\*(?![\w*])|(?<![\w_])_(?=[^\s_])[^_\n]*[^\s_]_(?![\w_])")
MD_OTHER = re.compile(r"^[ ]{0,3}>[ \t]+\S|^[ ]{0,3}(?:-[ ]?){3,}$|^[ ]{0,3}(?:\*[ ]?){3,}$|^[ ]{0,3}\|.*\|[ \t]*$", re.M)
MD_ESCAPE = re.compile(r"\\[*_`#+\-!>\[\]()]")
TEX_COMMAND = re.compile(r"(?<!\\)\\([A-Za-z]+)\*?(?![A-Za-z\\])")
TEX_ARGUMENT = re.compile(r"(?<!\\)\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}")
TEX_ENV = re.compile(r"\\(?:begin|end)\{([A-Za-z]+)\*?\}")
TEX_ESCAPE = re.compile(r"(?<![\\:\w])\\[%&#_{}$](?!\w*\\)|(?<=[\w.,;)])\\[%&#_$]|\\[\"'`^~=.](?:\{[A-Za-z]\}|[A-Za-z])|(?<=\.)\\ (?=\S)")
#: A link out of the text; links between pages of a wiki are part of it.
LINKED = re.compile(r"<a\b[^<>]*>.*?</a\s*>|!?\[[^\[\]\n]+\]\([^()\s]+(?:\s+\"[^\"\n]*\")?\)|\\href\{[^{}]*\}\{[^{}]*\}", re.I | re.S)
#: What of a node isn't read: holes, tags, addresses of links.
UNSEEN = re.compile(r"\x00\d+\x00|</?[A-Za-z][^<>]*>|(?<=\])\([^()\s]+(?:\s+\"[^\"\n]*\")?\)")
MATHML = re.compile(r"<(?:\w+:)?m(?:i|o|n|row|sup|sub|frac|sqrt|text|table|style|space|over|under|fenced)\b", re.I)

HOLE = "\x00"
HOLES = re.compile("\x00(\\d+)\x00")


@dataclass
class Node:
    """A piece of text below a root-to-leaf path of tags, with what kind of structure it is."""

    path: tuple[str, ...]
    kind: str
    text: str


@dataclass
class Mark:
    """A construct of a markup in the tree: its path leads from the markup over the open tags to the element."""

    path: tuple[str, ...]
    at: int

    @property
    def pair(self) -> tuple[str, str]:
        return self.path[0], self.path[-1]


class Tree:
    """The constructs of a text by their places, below the tags that are open there."""

    def __init__(self) -> None:
        self.marks: list[Mark] = []
        self.steps: list[tuple[int, tuple[str, ...]]] = [(0, ())]

    def open(self, at: int, name: str) -> None:
        self.steps.append((at, (*self.steps[-1][1], name)))

    def close(self, at: int, name: str) -> None:
        path = self.steps[-1][1]
        if name in path:
            self.steps.append((at, path[: len(path) - 1 - path[::-1].index(name)]))

    def put(self, markup: str, element: str, at: int) -> None:
        path = self.steps[bisect_right(self.steps, at, key=lambda s: s[0]) - 1][1]
        self.marks.append(Mark((markup, *path, element), at))

    def pairs(self) -> set[tuple[str, str]]:
        return {m.pair for m in self.marks}


def _known(name: str, closed: set[str]) -> bool:
    name = name.lower()
    return name in HEADING_TAGS or name in LIST_TAGS or name in BLOCK_TAGS or name in INLINE_TAGS or name in CODE_TAGS.split() or name == "math" or name in closed


def _spans(text: str) -> tuple[str, list[tuple[str, str]]]:
    """The text with a hole for each code, formula and comment, and their kinds and contents."""
    found: list[tuple[str, str]] = []

    def take(m: re.Match) -> str:
        kind = m.lastgroup if m.lastgroup in KINDS else next(k for k in KINDS if m.group(k) is not None)
        inside = m.group(f"{kind}_in") if kind not in ("comment", "dropped") else ""
        if kind == "dollar" and not re.search(r"[\\^_=+{}<>]|^[A-Za-z]$", inside):
            return m.group()
        if kind == "pre" and m.group("p").lower() in WIKI_CODE_TAGS.split():
            kind = "wikipre"
        elif kind == "math" and not MATHML.search(inside):
            kind = "texmath"
        found.append((kind, re.sub(r"^\s*<(?:code|pre)[^<>]*>|</(?:code|pre)\s*>\s*$", "", inside, flags=re.I) if kind == "pre" else inside))
        return f"{HOLE}{len(found) - 1}{HOLE}"

    text = text.replace(HOLE, " ")
    may = any(c in text for c in "`$\\<") or "~~~" in text
    return (SPANS.sub(take, text) if may and SPAN_START.search(text) else text), found


KINDS = ["fence", "comment", "dropped", "pre", "math", "verbatim", "verb", "equation", "display", "inline", "dollars", "dollar", "tick"]
CODE_KINDS = {"fence": "markdown", "tick": "markdown", "pre": "html", "wikipre": "wiki", "verbatim": "latex", "verb": "latex"}
FORMULA_KINDS = {"math": "html", "equation": "latex", "display": "latex", "inline": "latex", "dollars": "latex", "dollar": "latex"}


def elements(text: str) -> set[tuple[str, str]]:
    """The pairs (markup, element) that a text holds."""
    return analysed(text)[0].pairs()


def _html(tree: Tree, rest: str, kinds: set[str]) -> None:
    """Tags, which open and close the paths of the tree, character references, comments."""
    tags = list(TAG.finditer(rest)) if "<" in rest else []
    opened = {m["name"].lower() for m in tags if m["name"] and not m["close"]}
    closed = {m["name"].lower() for m in tags if m["name"] and m["close"]} & opened
    unopened = 0
    for m in tags:
        name, at = (m["name"] or "").lower(), m.start()
        if not name:
            tree.put("html", "other", at)
            continue
        if not _known(name, closed):
            continue
        if m["close"]:
            unopened += name == "abstracttext" and name not in tree.steps[-1][1]
            tree.close(at, name)
        elif not m["self"] and name not in VOID_TAGS:
            if name in ENDED_BY_NEXT:
                tree.close(at, name)
            tree.open(at, name)
        if name != "abstracttext":
            tree.put("html", "heading" if name in HEADING_TAGS else "list" if name in LIST_TAGS else "code" if name in CODE_TAGS.split() else "formula" if name == "math" else "other", at)
        elif not m["close"]:
            label = LABEL.search(m["attrs"] or "")
            label = ((label[1] or label[2] or "") if label else "").strip()
            tree.put("html", "heading" if label and label != "null" else "other", at)
    if unopened:
        tree.put("html", "other", len(rest))
    if "&" in rest:
        for m in CHARREF.finditer(rest):
            if m[0][1] == "#" or m[0][1:] in html5:
                tree.put("html", "other", m.start())
    if kinds & {"comment", "dropped"}:
        tree.put("html", "other", 0)


def _tex(tree: Tree, rest: str) -> None:
    """Commands, environments and escapes of LaTeX."""
    if "\\" not in rest:
        return
    for m in TEX_COMMAND.finditer(rest):
        name, at = m[1], m.start()
        argument = TEX_ARGUMENT.match(rest, at)
        if name in LATEX_HEADINGS and argument:
            tree.put("latex", "heading", at)
        elif name == "item":
            tree.put("latex", "list", at)
        elif name in ("begin", "end"):
            if env := TEX_ENV.match(rest, at):
                tree.put("latex", "list" if env[1] in LATEX_LISTS else "code" if env[1] in LATEX_CODE.split() else "formula" if env[1] in LATEX_FORMULAS.split() else "other", at)
        elif name in LATEX_OTHER and not (at and rest[at - 1] == ":") or argument:
            tree.put("latex", "other", at)
    if m := TEX_ESCAPE.search(rest):
        tree.put("latex", "other", m.start())


def analysed(text: str) -> tuple[Tree, str, list[tuple[str, str]], bool]:
    """The tree of a text's markup, the text with holes for code and formulas, what stood in them, and whether it is wiki text."""
    tree = Tree()
    if not (ANY.search(text) or FIRST_LINE.match(text) or NEXT_LINE.search(text)):
        return tree, text, [], False
    rest, spans = _spans(text)
    kinds = {k for k, _ in spans}
    _html(tree, rest, kinds)
    blocks = bool(tree.pairs() - {("html", "other")})

    # wiki and Markdown, told apart by what only one of them has
    look = lambda sign, pattern: pattern.search(rest) if sign in rest else None
    heading, link = WIKI_HEADING.search(rest), look("[[", WIKI_LINK)
    other = link or look("{{", WIKI_TEMPLATE) or look("''", WIKI_QUOTES) or (WIKI_OTHER_START.search(rest) and WIKI_OTHER.search(rest))
    atx, setext = look("#", MD_ATX), look("\n", MD_SETEXT)
    md_link = MD_LINK.search(rest) if "[" in rest or "<http" in rest or "<mailto:" in rest else None
    strong = MD_STRONG.search(rest) if "**" in rest or "__" in rest or "~~" in rest else None
    markdown = bool(kinds & {"fence", "tick"} or atx and not link or md_link or strong or setext)
    wiki = bool(heading or other or "wikipre" in kinds or "texmath" in kinds and not blocks)
    if heading:
        tree.put("wiki", "heading", heading.start())
    if other:
        tree.put("wiki", "other", other.start())
    listed = WIKI_LIST.search(rest) if wiki and not (markdown and not heading and not other) else None
    if listed:
        tree.put("wiki", "list", listed.start())
    _tex(tree, rest)
    tex = any(m == "latex" for m, _ in tree.pairs())
    if atx and not wiki or setext:
        tree.put("markdown", "heading", (setext or atx).start())
    if m := (MD_OTHER_LIST if listed else MD_LIST).search(rest):
        tree.put("markdown", "list", m.start())
    emphasis = MD_EMPHASIS.search(rest) if "*" in rest or "_" in rest else None
    if m := md_link or strong or emphasis or MD_OTHER.search(MD_SETEXT.sub("", rest) if setext else rest):
        tree.put("markdown", "other", m.start())
    md = any(m == "markdown" for m, _ in tree.pairs()) or bool(kinds & {"fence", "tick"})
    if md and not tex and (m := MD_ESCAPE.search(rest)):
        tree.put("markdown", "other", m.start())

    # code and formulas belong to the markup the text is otherwise written in
    html_blocks = any(m == "html" and e != "other" for m, e in tree.pairs())
    for m in HOLES.finditer(rest):
        kind = spans[int(m[1])][0]
        if kind in CODE_KINDS:
            tree.put("wiki" if kind == "pre" and wiki and not html_blocks else CODE_KINDS[kind], "code", m.start())
        elif kind == "texmath":
            tree.put("wiki" if wiki else "html", "formula", m.start())
        elif kind in FORMULA_KINDS:
            tied = kind in ("dollar", "dollars") and md and not tex and not kinds & {"equation", "display", "inline"}
            tree.put("markdown" if tied else FORMULA_KINDS[kind], "formula", m.start())
    return tree, rest, spans, wiki


def _nodes(rest: str, wiki: bool) -> list[Node]:
    """Nodes of a text with holes, each with its root-to-leaf path of block tags; inline tags belong to their block."""
    nodes: list[Node] = []
    path: list[str] = []
    at = 0

    def flush(piece: str) -> None:
        for block in re.split(r"\n", piece):
            if not block.strip():
                continue
            kind, own, body = "text", tuple(path), block.strip()
            if m := re.match(r"(={2,6})\s*(.+?)\s*\1\s*$", body) if wiki else None:
                kind, body = "heading", m[2]
            elif (m := re.match(r"(#{1,6})\s+(.+?)\s*#*$", body)) and not wiki:
                kind, body = "heading", m[2]
            elif m := re.match(r"\\(part|chapter|(?:sub)*section|(?:sub)?paragraph)\*?\{([^{}]*)\}\s*(.*)$", body):
                nodes.append(Node((*own, "heading"), "heading", m[2]))
                body = m[3]
            elif m := re.match(r"(?:[-+*]|\d{1,3}[.)]|\\item\b)\s*(.+)$", body) if re.match(r"(?:[-+*]|\d{1,3}[.)])\s+\S|\\item\b", body) else None:
                kind, body = "list", m[1]
            elif wiki and (m := re.match(r"[*#]+\s*(.+)$", body)):
                kind, body = "list", m[1]
            elif nodes and re.fullmatch(r"=+|-{2,}", body) and nodes[-1].kind == "text" and "\n" not in nodes[-1].text:
                nodes[-1] = Node((*own, "heading"), "heading", nodes[-1].text)
                continue
            elif re.fullmatch(r"\\(?:begin|end)\{[A-Za-z]+\*?\}", body):
                continue
            if kind == "text":
                inside = [t for t in path if t in HEADING_TAGS or t in LIST_TAGS or t == "title"]
                kind = "heading" if inside and (inside[-1] in HEADING_TAGS or inside[-1] == "title") else "list" if inside else "text"
            if body:
                leaf = "a" if LINKED.search(body) and not re.search(r"\w", LINKED.sub("", body)) else kind
                nodes.append(Node((*own, leaf) if leaf not in own else own, "link" if leaf == "a" else kind, body))

    for m in TAG.finditer(rest):
        name = (m["name"] or "").lower()
        if name and name not in INLINE_TAGS and (name in BLOCK_TAGS or name in LIST_TAGS or name in HEADING_TAGS):
            flush(rest[at : m.start()])
            at = m.end()
            if m["close"]:
                if name in path:
                    while path.pop() != name:
                        pass
            elif not m["self"] and name != "hr":
                if name == "li" and path and path[-1] == "li":
                    path.pop()
                path.append(name)
                label = LABEL.search(m["attrs"] or "") if name == "abstracttext" else None
                label = ((label[1] or label[2] or "").strip() if label else "")
                if label and label != "null":
                    nodes.append(Node((*path, "heading"), "heading", label))
    flush(rest[at:])
    return nodes


#: A path is content if its fused ratio is at least this share of the spread over the text's nodes.
KEEP = 0.8
#: Weights of a node and its neighbours when ratios are smoothed along the text.
SMOOTH = np.array([0.1, 0.8, 0.1])
#: Kinds that are structure; they are kept wherever they stand. Text that closes a sentence is kept but below FRAME tags.
STRUCTURE = {"heading", "list"}
FRAME = set("nav header footer aside form menu".split())
SENTENCE = re.compile(r"[.!?。！？][\"')\]”»]*\s*$")


def ratios(nodes: list[Node]) -> tuple[np.ndarray, np.ndarray]:
    """Of each node the fused ratio of its path, smoothed along the text, and the mean of that over the path's nodes.

    For each root-to-leaf path the text length and the punctuation of its nodes are summed and divided by their number;
    the two ratios are fused by product.
    """
    paths: dict[tuple[str, ...], int] = {}
    of = np.array([paths.setdefault(n.path, len(paths)) for n in nodes])
    count = np.bincount(of)
    seen = [" ".join(UNSEEN.sub("", n.text).split()) for n in nodes]
    length = np.bincount(of, [len(t) for t in seen]) / count
    marks = np.bincount(of, [sum(t.count(c) for c in ".,;:!?。，；：！？") for t in seen]) / count
    line = (length * (1 + marks))[of]
    reach = len(SMOOTH) // 2
    smooth = np.convolve(np.pad(line, reach, mode="edge"), SMOOTH, mode="valid")
    return smooth, (np.bincount(of, smooth) / count)[of]


def content(nodes: list[Node]) -> list[Node]:
    """The nodes of content paths: those whose mean smoothed ratio is at least KEEP times the spread of the ratios.

    A text of a single path is content. Headings, items of lists that aren't mere links, code and formulas are structure and
    kept, and so are sentences, unless they stand below a tag of a page's frame; a heading in front of dropped nodes only
    goes with them.
    """
    if len({n.path for n in nodes}) < 2:
        return nodes
    smooth, mean = ratios(nodes)
    limit = KEEP * float(smooth.std())
    sentence = [n.kind == "text" and not FRAME.intersection(n.path) and bool(SENTENCE.search(UNSEEN.sub("", n.text))) for n in nodes]
    keep = [n.kind in STRUCTURE or HOLE in n.text or s or v >= limit for n, s, v in zip(nodes, sentence, mean)]
    for i, n in enumerate(nodes):
        if n.kind == "heading":
            after = [keep[k] for k in range(i + 1, next((k for k in range(i + 1, len(nodes)) if nodes[k].kind == "heading"), len(nodes)))]
            keep[i] = not after or any(after)
    return [n for n, k in zip(nodes, keep) if k]


def _plain(text: str, spans: list[tuple[str, str]], found: set[tuple[str, str]], wiki: bool) -> str:
    """A node's text without inline markup, its code and formulas put back between ` and $ signs."""
    markups = {m for m, _ in found}
    if "html" in markups:
        text = TAG.sub(lambda m: " " if (m["name"] or "").lower() == "br" else "" if not m["name"] or _known(m["name"], {m["name"].lower()}) else m[0], text)
    if wiki:
        text = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]+)\]\]", r"\1", text)
        text = WIKI_TEMPLATE.sub("", text)
        text = re.sub(r"__(?:TOC|NOTOC|NOEDITSECTION|FORCETOC)__|~{4}", "", text)
        text = re.sub(r"\[https?://[^\s\]]+(?:\s([^\]\n]*))?\]", lambda m: m[1] or "", text)
        text = re.sub(r"^(?:\{\|[^\n]*|\|\}|\|-[^\n]*|\|\+?|!)\s*", "", text).replace("||", " ").replace("!!", " ")
        text = WIKI_QUOTES.sub(r"\2", text)
    if "markdown" in markups:
        text = re.sub(r"^[ ]{0,3}(?:>[ \t]*)+", "", text)
        text = re.sub(r"^[ ]{0,3}\[[^\]\n]+\]:[ \t]+\S+[^\n]*$|^[ ]{0,3}(?:[-*][ ]?){3,}$|^\|?(?:\s*:?-{2,}:?\s*\|)+\s*:?-*:?\s*$", "", text)
        text = re.sub(r"!?\[([^\[\]\n]+)\]\[[^\[\]\n]*\]", r"\1", text)
        text = re.sub(r"~~(?=\S)([^~\n]+)~~", r"\1", text)
        text = re.sub(r"<((?:https?|mailto):[^\s<>]+)>", r"\1", text)
        text = re.sub(r"!?\[([^\[\]\n]+)\]\([^()\s]+(?:\s+\"[^\"\n]*\")?\)", r"\1", text)
        text = re.sub(r"(?<![\w*])(\*{1,2})(?=[^\s*])([^*\n]*[^\s*])\1(?![\w*])", r"\2", text)
        text = re.sub(r"(?<![\w_])(_{1,2})(?=[^\s_])([^\n]*?[^\s_])\1(?![\w_])", r"\2", text)
        if ("latex", "other") not in found:
            text = MD_ESCAPE.sub(lambda m: m[0][1:], text)
    if "latex" in markups:
        text = re.sub(r"\\(?:cite[pt]?|label|ref|eqref)\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}", "", text)
        before = None
        while before != text:
            before, text = text, re.sub(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{([^{}\n]*)\}", r"\1", text)
        text = re.sub(r"\{\\[A-Za-z]+\s+([^{}\n]*)\}", r"\1", text)
        text = re.sub(r"\\([%&#_{}$])", r"\1", text)
        text = re.sub(r"\\[\"'`^~=.]\{?([A-Za-z])\}?", r"\1", text)
        text = text.replace("\\ ", " ").replace("~", " ")
    if "html" in markups:
        text = CHARREF.sub(lambda m: html.unescape(m[0]), text)

    def back(m: re.Match) -> str:
        kind, inside = spans[int(m[1])]
        if kind in ("comment", "dropped"):
            return ""
        if kind in CODE_KINDS:
            inside = html.unescape(inside) if kind == "pre" else inside
            return f"\n```\n{inside.strip()}\n```\n" if "\n" in inside.strip("\n") or kind in ("fence", "verbatim") else f"`{inside.strip()}`"
        return f"${re.sub(r'<[^<>]*>', '', inside).strip()}$"

    return HOLES.sub(back, text).strip()


def clean(text: str) -> tuple[str, list[tuple[str, str]]]:
    """The clean text, and the pairs (markup, element) that it held, sorted.

    Headings begin with "# ", list items with "- ", code stands between ` or ``` and formulas between $ signs. A text
    without markup comes out as it is.
    """
    tree, rest, spans, wiki = analysed(text)
    found = tree.pairs()
    if not found:
        return text, []
    start = {"heading": "# ", "list": "- "}
    out = [start.get(n.kind, "") + body for n in content(_nodes(rest, wiki)) if (body := _plain(n.text, spans, found, wiki))]
    return "\n".join(out), sorted(found)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("markup", pa.string()), ("element", pa.string())]))
    for batch in batches:
        done = [clean(t) if t is not None else (None, []) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([[{"markup": m, "element": e} for m, e in es] for _, es in done], kind)], names=["_key", "text", "elements"]
        )


def cleaned(df: DataFrame, key: str, text: str) -> DataFrame:
    """(_key, text, elements): the clean text of every row, and what markup it held.

    One pass over the rows, without a shuffle. A null text stays null and an empty one empty, both without elements. Texts
    of any length are taken whole.
    """
    return df.select(F.col(key).cast("long").alias("_key"), F.col(text)).mapInArrow(_run, "_key long, text string, elements array<struct<markup:string,element:string>>")


def p2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pmid, text, elements) of the current row of every article."""
    rows = current_rows(table(spark, sf_dir, "abstracts"), "pmid", "loaded_at", ["abs"])
    return cleaned(rows, "pmid", "abs").select(F.col("_key").cast("int").alias("pmid"), "text", "elements")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pmid, markup, element): what markup the current abstract of every article holds."""
    return p2_clean(spark, sf_dir).select("pmid", F.explode("elements").alias("e")).select("pmid", "e.markup", "e.element")


QUERIES = {"p2_found": p2_found, "p2_clean": p2_clean}
SQL: dict[str, str] = {}
