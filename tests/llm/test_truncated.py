from __future__ import annotations

import pytest

from lexweave.llm import truncated as Q

import random

NAMES = ["lomi", "kepa", "vodu", "tira", "sube", "gano", "feri", "mazu"]
ENDS = ["maine", "gase", "pol", "tity", "rosis"]


def body(seed: int, n: int = 14) -> str:
    r = random.Random(seed)
    name = lambda: r.choice(NAMES) + r.choice(NAMES) + r.choice(ENDS)
    frames = [
        "The uptake of {} was {}% lower after {}, e.g. in {}.", "It is not known why {} depends on {}.", "We followed {} in {} subjects with {}.",
        "The level of {} was 0.{} in all of them.", "Does {} protect against {}?", "Changes in {} were slow, and {} held at {} units.", "{} was tied to the outcome in our {} cases.",
    ]
    out = []
    for _ in range(n):
        frame = r.choice(frames)
        for piece in range(frame.count("{}")):
            number = frame[: frame.index("{}")].endswith(("0.", "was ", "in ", "at ", "our ")) and frame[frame.index("{}") + 2 :].startswith(("%", " subj", " in all", " units", " cases"))
            frame = frame.replace("{}", str(r.randint(2, 98)) if number else name(), 1)
        out.append(frame)
    return " ".join(out)


FULL = "Effects of alpha on gamma\n" + body(-1)
COMPLETE = [
    FULL,
    FULL + ' "It held."',
    FULL + " [12]",
    FULL + " (Funded by award KV-12.)",
    FULL + "</AbstractText>",
    FULL + "  \n",
    FULL + "\nKeywords: alpha; beta; gamma",
    FULL + "\nTrial registration: ZQT-12345",
    FULL + " Does it hold?",
    FULL + " « Cela a tenu. »",
    FULL + " „Es hielt stand.“",
    FULL + " ¿Y después?",
    FULL + " All else concerned alpha, beta, gam.",
    "Effects of alpha on gamma",
    "Effects of beta on delta ",
]
CUT = [
    FULL + " The uptake of al",
    FULL + " The uptake of",
    FULL + " The uptake of alpha was 14% lower,",
    FULL + " The uptake of…",
    FULL + " The uptake of ...",
    FULL + " The uptake [...]",
    FULL + " The uptake of [truncated]",
    FULL + " The uptake of (TEXT CUT AT 150 WORDS)",
    FULL + " [truncated]",
    FULL + " The upt</AbstractText>",
    FULL + " The upt�",
    FULL + " The upt \t",
    FULL + " The uptake <su",
    FULL + " Some markers, e.g.",
    FULL + " As shown in Fig.",
    FULL + " Einige Marker, z.B.",
    FULL + " The mean was 0.",
    FULL + ' He said "',
    FULL + " (Funded by award KV-",
]


def test_verdicts(spark):
    texts = [*COMPLETE, *CUT, None, "", "   "]
    filler = [f"Effects of {body(i, 1).split()[2]} on {body(i, 1).split()[-1]}\n{body(i)}" for i in range(600)] + [f"Effects of {a}{b}ine on {b}{a}ol" for a in NAMES for b in NAMES]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts + filler)], "doc_id long, text string, lang string").repartition(3)
    got = {r.id for r in Q.judged(df, "doc_id", "text", "lang").filter("cut").collect()}
    want = set(range(len(COMPLETE), len(COMPLETE) + len(CUT)))
    assert [texts[i][-40:] for i in want - got] == [] and [(texts + filler)[i][-40:] for i in got - want] == []


@pytest.mark.parametrize("text, want", [(t, "went.") for t in ("It went.", 'It went."', "It went. [12]", "It went.</p> ", "(It went.)", "It went. (3, 4)")] + [(t, "It we") for t in ("It we…", "It we [...]", "It we [truncated]", "It we<su", "It we&am", "It we\ufffd ")])
def test_end_of(text, want):
    assert Q.end_of(text).endswith(want)


def test_counts_are_the_same_whenever_they_are_merged():
    segments = [("en", "body", Q.encoded(body(i))) for i in range(40)]
    at_once, bit_by_bit = Q.Counts(), Q.Counts()
    at_once.add(segments)
    for one in segments:
        bit_by_bit.add([one])
        for k in Q.ORDERS:
            bit_by_bit._merge(k)

    def total(c):
        out = {}
        for b in c.batches():
            for r in b.to_pylist():
                e, n = out.get((r["k"], r["ctx"]), (0, 0))
                out[r["k"], r["ctx"]] = (e + r["n_end"], n + r["n_cont"])
        return out

    assert total(at_once) == total(bit_by_bit)


def test_counts_are_those_of_every_position():
    c = Q.Counts()
    c.add([("en", "body", Q.encoded("ab ab")), ("en", "body", Q.encoded("ab"))])
    found = {}
    for b in c.batches():
        for row in b.to_pylist():
            e, n = found.get((row["k"], row["ctx"]), (0, 0))
            found[row["k"], row["ctx"]] = (e + row["n_end"], n + row["n_cont"])
    ab = int(Q._contexts(Q.encoded("ab"), 2)[-1])
    assert found[2, ab] == (2, 1)
    assert sum(e for e, _ in (v for (k, _), v in found.items() if k == 2)) == 2


def test_long_and_empty_parts():
    text = "<" * 3000 + "word " * 100_000 + "</p>" * 3000
    assert Q.end_of(text) and Q.parts(text) and Q.doubtful(text)
    for t in (".", "<", "\n", ">", "</p>", "a", "�"):
        Q.parts(t), Q.doubtful(t), Q.end_of(t)


def test_empty_and_odd_tables(spark, empty_sf, odd_sf, sf):
    assert Q.p10_found(spark, empty_sf).count() == 0 and Q.p10_sources(spark, empty_sf).count() == 0
    plain, odd = ({tuple(r) for r in Q.p10_found(spark, d).collect()} for d in (sf, odd_sf))
    assert plain == odd
