"""Problem 10: text cut off by field limits."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.session import small_or_shuffled, staged, table

#: Lengths of the contexts of the model, the shortest first.
ORDERS = (2, 3, 5)
#: Times that the shortest context must have been seen elsewhere for the model to judge a text.
SUPPORT = 5
#: What the chance of an end after a shorter context counts in that after a longer one, in times seen.
PRIOR = 5.0
#: How far below the threshold the end of a title or a trailing line must score; words there end anywhere.
FAR_BELOW = 1.0
#: Texts that are counted at a time, and distinct contexts that a task holds before it hands its counts on.
STEP, HELD = 1000, 2_000_000
#: Texts that end with the same characters, so many of them, are copies of one another as to their ends.
TAIL = 60

# Fixed values of the exact check: words of notices that a text was cut, and abbreviations whose stop ends no sentence.
NOTICE_WORDS = "truncated cut abridged shortened clipped continued more gekürzt abgeschnitten gekuerzt fortsetzung tronqué tronquée abrégé abrégée coupé suite truncado recortado cortado abreviado continúa"
ABBREVIATIONS = "e.g.|i.e.|cf.|vs.|viz.|fig.|figs.|eq.|eqs.|nos.|approx.|ca.|dr.|prof.|mr.|mrs.|incl.|z.b.|z. b.|d.h.|d. h.|u.a.|u. a.|bzw.|vgl.|abb.|nr.|sog.|ggf.|p.ex.|p. ex.|par ex.|env.|p.ej.|p. ej.|núm."

NOTICE = re.compile(rf"[\[({{<]\s*(?:\.{{2,}}|…|[^\[\](){{}}<>]*\b(?:{'|'.join(NOTICE_WORDS.split())})\b[^\[\](){{}}<>]*)\s*[\])}}>]\s*$|(?:\.{{3,}}|…)\s*$", re.I)
ABBREVIATED = re.compile(r"(?:^|[\s(\[,;])(?:" + "|".join(map(re.escape, ABBREVIATIONS.split("|"))) + ")$", re.I)
ZERO = re.compile(r"(?:^|[\s(=<>±])[-+]?0\.$")
SENTENCE_END = re.compile(r"[.!?。？！]$")

WHOLE_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
FIRST_TAG = re.compile(r"\A\s*<[A-Za-z][^<>]*>")
OPEN_TAG = re.compile(r"<(?:[A-Za-z/!][^<>]*)?")
#: Half a character reference.
OPEN_REFERENCE = re.compile(r"&(?:#?\w{0,8})$")
#: What may stand after the end of a sentence, or after a cut: reference numbers, a remark in brackets or dots, closing quotes and brackets.
REFERENCE = re.compile(r"\s*(?:\[\s*\d+(?:\s*[,;–-]\s*\d+)*\s*\]|\(\s*\d+(?:\s*[,;–-]\s*\d+)*\s*\))$")
REMARK = re.compile(r"\s*(?:[\[({<][^\[\](){}<>]*[^\W\d_][^\[\](){}<>]*[\])}>]|[\[({]\s*(?:\.{2,}|…)\s*[\])}]|\.{2,}|…)$")
CLOSERS = re.compile(r"\s*[\"'”“„’»«)\]}]+$")
TRAILER = re.compile(r"^[^\W\d_][^\n:.!?]{2,30}\s?:\s\S[^.!?]*$")
STOP = re.compile(r"[.!?](?:\s|$)")

_FIRST = 0x3000
#: The code of digits; those below it are letters.
DIGIT = 26


def _alphabet() -> np.ndarray:
    """A code below 62 for each character: letters without case and accents, one for digits, one for white space."""
    signs = ".,;:?!\"'()[]{}<>-/%&=+*_…„“”«»’"
    codes = np.full(_FIRST, 61, np.int64)
    for i in range(_FIRST):
        c = chr(i)
        base = unicodedata.normalize("NFD", c)[0].lower()[:1]
        if "a" <= base <= "z":
            codes[i] = ord(base) - 97
        elif c.isdigit():
            codes[i] = DIGIT
        elif c.isspace():
            codes[i] = 27
        elif c in signs:
            codes[i] = 28 + signs.index(c)
    return codes


ALPHABET = _alphabet()
assert int(ALPHABET.max()) == 61


def encoded(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return ALPHABET[np.minimum(points, _FIRST - 1)]


def bare(text: str) -> str:
    """The text without white space, damaged characters and whole tags at its end."""
    while True:
        text = text.rstrip()
        if text.endswith("\ufffd"):
            text = text[:-1]
        elif text.endswith(">") and (at := text.rfind("<")) >= 0 and WHOLE_TAG.fullmatch(text, at):
            text = text[:at]
        else:
            return text


def core(text: str) -> str:
    """The text without what may follow a cut or an end: white space, damaged characters, whole tags, half a tag or reference."""
    text = bare(text)
    return bare(text[:at]) if (at := half(text)) is not None else text


def half(text: str) -> int | None:
    """Where half a tag or half a character reference begins that the text ends with, or None."""
    if (at := text.rfind("<")) > text.rfind(">") and OPEN_TAG.fullmatch(text, at):
        return at
    found = OPEN_REFERENCE.search(text[-10:])
    return len(text) - len(text[-10:]) + found.start() if found else None


def parts(text: str) -> list[tuple[str, str]]:
    """(column, text) of the parts of a text, the last of which holds its end: title, body, and a trailing line."""
    text = FIRST_TAG.sub("", core(text))
    head, mark, rest = text.partition("\n")
    rest = rest.strip()
    out: list[tuple[str, str]] = []
    if not mark or not rest:
        if not STOP.search(head):
            return [("title", head)]
        return [("body", head)]
    out.append(("title", head) if not STOP.search(head) else ("body", head))
    before, _, last = rest.rpartition("\n")
    if TRAILER.match(last.strip()):
        if before.strip():
            out.append(("body", before.strip()))
        out.append(("trailer", last.strip()))
    else:
        out.append(("body", rest))
    return out


def _without(pattern: re.Pattern, text: str, reach: int) -> str:
    """The text without what the pattern finds in its last `reach` characters; a text is never emptied."""
    at = max(0, len(text) - reach)
    found = pattern.search(text[at:])
    return text[: at + found.start()] if found and at + found.start() else text


def end_of(text: str) -> str:
    """A body up to the place where it ends or was cut: without what may stand after that."""
    text = core(_without(REFERENCE, core(text), 60))
    text = core(_without(REMARK, text, 200))
    return _without(CLOSERS, text, 6).rstrip() or text


def doubtful(text: str) -> bool:
    """The exact check: a notice of a cut, half a tag or reference, an abbreviation or a lone `0.` at the end of a text."""
    end = bare(text)
    if NOTICE.search(end[-200:]) or half(end) is not None:
        return True
    end = end_of(text)[-40:]
    return bool(ABBREVIATED.search(end) or ZERO.search(end))


def segments_of(text: str) -> list[tuple[str, str]]:
    """(column, text) of the parts of a text that the model reads, bodies up to their ends."""
    return [(c, end_of(p) if c == "body" else p) for c, p in parts(text) if p]


def _contexts(code: np.ndarray, order: int) -> np.ndarray:
    """The context that ends at each position, read backwards; -1 where the text is too short."""
    out = np.full(len(code), -1, np.int64)
    if len(code) >= order:
        at = np.zeros(len(code) - order + 1, np.int64)
        for j in range(order):
            at |= code[order - 1 - j : len(code) - j] << (6 * j)
        out[order - 1 :] = at
    return out


class Counts:
    """Ends and continuations of contexts, by group: of bodies the ends of texts, of the rest the ends of words."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.merged: dict[int, tuple[np.ndarray, np.ndarray]] = {k: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for k in ORDERS}
        self.pending: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {k: [] for k in ORDERS}
        self.waiting = dict.fromkeys(ORDERS, 0)

    def add(self, segments: list[tuple[str, str, np.ndarray]]) -> None:
        size = np.array([len(c) for _, _, c in segments])
        code = np.concatenate([c for _, _, c in segments])
        group = np.repeat([self.groups.setdefault(s[:2], len(self.groups)) for s in segments], size)
        begin = np.repeat(np.cumsum(size) - size, size)
        place = np.arange(len(code)) - begin
        last = place == np.repeat(size - 1, size)
        within = np.append((code[:-1] <= DIGIT) & (code[1:] <= DIGIT), False)
        last |= np.repeat([s[1] != "body" for s in segments], size) & ~within
        for k in ORDERS:
            ok = place >= k - 1
            key = (_contexts(code, k)[ok] | group[ok] << (6 * max(ORDERS) + 1)) << 1 | last[ok]
            self.pending[k].append(np.unique(key, return_counts=True))
            self.waiting[k] += len(self.pending[k][-1][0])
            if self.waiting[k] > max(len(self.merged[k][0]), 100_000):
                self._merge(k)

    def _merge(self, k: int) -> None:
        """Joins what waits with what is merged; it waits until it is as much, so that each count is moved a few times only."""
        own = [self.merged[k], *self.pending[k]]
        keys = np.concatenate([o[0] for o in own])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], np.concatenate([o[1] for o in own])[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        self.merged[k] = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        self.pending[k], self.waiting[k] = [], 0

    def held(self) -> int:
        return len(self.merged[ORDERS[-1]][0]) + self.waiting[ORDERS[-1]]

    def batches(self) -> Iterator[pa.RecordBatch]:
        names = list(self.groups)
        bits = 6 * max(ORDERS) + 1
        for k in ORDERS:
            self._merge(k)
            keys, counts = self.merged[k]
            ends = keys & 1
            context = keys >> 1
            group = context >> bits
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([names[g][0] for g in group.tolist()], pa.string()),
                    pa.array([names[g][1] for g in group.tolist()], pa.string()),
                    pa.array(np.full(len(group), k, np.int32)),
                    pa.array(context & ((1 << bits) - 1)),
                    pa.array(counts * ends),
                    pa.array(counts * (1 - ends)),
                ],
                names=["lang", "col", "k", "ctx", "n_end", "n_cont"],
            )


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = Counts()
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i in range(0, len(texts), STEP):
            segments = [(lang, c, encoded(p)) for lang, text in zip(langs[i : i + STEP], texts[i : i + STEP]) for c, p in segments_of(text) if p]
            if segments:
                counts.add(segments)
            if counts.held() > HELD:
                yield from counts.batches()
                counts = Counts()
    yield from counts.batches()


def _finals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols, ctx, tails, doubts, stops = [], [], [], [], []
        for text in batch.column(2).to_pylist():
            c, p = (segments_of(text) or [("body", text)])[-1]
            code = encoded(p[-max(ORDERS) :])
            cols.append(c)
            ctx.append([int(_contexts(code, k)[-1]) if len(code) >= k else -1 for k in ORDERS])
            tails.append(p[-TAIL:])
            doubts.append(c == "body" and doubtful(text))
            stops.append(c != "body" or bool(SENTENCE_END.search(p[-8:])))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(cols, pa.string()), pa.array(ctx, pa.list_(pa.int64())), pa.array(tails, pa.string()), pa.array(doubts, pa.bool_()), pa.array(stops, pa.bool_())],
            names=["id", "lang", "col", "ctx", "tail", "doubtful", "stopped"],
        )


def model_of(rows: DataFrame) -> DataFrame:
    """(lang, col, k, ctx, n_end, n_cont): how often each backward context ended a part of a text, and how often it went on."""
    local = rows.select("lang", "text").mapInArrow(_train, "lang string, col string, k int, ctx long, n_end long, n_cont long")
    sums = [F.sum("n_end").alias("n_end"), F.sum("n_cont").alias("n_cont")]
    return staged(local.groupBy("lang", "col", "k", "ctx").agg(*sums), "ngrams")


def _log_odds(end, cont):
    return F.log((end + F.lit(0.5)) / (cont + F.lit(0.5)))


def thresholds(model: DataFrame, by: list[str]) -> DataFrame:
    """(*by, threshold, base): half way between the mean log-odds of ends and of continuations, and the share of ends."""
    score = _log_odds(F.col("n_end"), F.col("n_cont"))
    means = model.filter(F.col("k") == ORDERS[1]).groupBy(*by).agg(
        (F.sum(F.col("n_end") * score) / F.sum("n_end")).alias("e"), (F.sum(F.col("n_cont") * score) / F.sum("n_cont")).alias("c"), (F.sum("n_end") / F.sum(F.col("n_end") + F.col("n_cont"))).alias("base")
    )
    return means.select(*by, ((F.coalesce("e", "c") + F.coalesce("c", "e")) / 2).alias("threshold"), F.greatest("base", F.lit(1e-9)).alias("base"))


def _scored(ends: DataFrame, model: DataFrame, by: list[str], copies: str) -> DataFrame:
    """ends with `score`, `threshold`, `support` and `gone_on` from the model's counts by `by`.

    ends has one row for each different final context, so that no context of many texts makes a task long. The counts of
    the texts themselves, `copies` of them, are taken out first. The chance of an end after each context is weighed with
    PRIOR times that after the next shorter one; of bodies the lowest of the chances after the contexts longer than the
    shortest counts. support is how often the shortest context was seen elsewhere, gone_on how often the longest went on.
    """
    keys = ["lang", "col", "ctx", "own", "all"]
    limits = staged(thresholds(model, by), "thresholds")
    long = ends.select(*keys, F.posexplode("ctx").alias("_i", "_ctx")).withColumn("k", F.element_at(F.array(*[F.lit(k) for k in ORDERS]), F.col("_i") + 1))
    seen = long.join(small_or_shuffled(staged(model.filter("n_end > 0").withColumnRenamed("ctx", "_ctx"), "ends")), [*by, "k", "_ctx"])
    at = lambda k: F.max(F.when(F.col("k") == k, F.struct(F.greatest(F.col("n_end") - F.col(copies), F.lit(0)).alias("e"), F.col("n_cont").alias("c")))).alias(f"n{k}")
    out = seen.groupBy(*keys).agg(*[at(k) for k in ORDERS]).join(small_or_shuffled(limits), by)
    chance, scores = F.col("base"), []
    for k in ORDERS:
        e, c = F.coalesce(F.col(f"n{k}.e"), F.lit(0)), F.coalesce(F.col(f"n{k}.c"), F.lit(0))
        chance = (e + F.lit(PRIOR) * chance) / (e + c + F.lit(PRIOR))
        scores.append(F.log(chance / (1 - chance)))
    first, last = f"n{ORDERS[0]}", f"n{ORDERS[-1]}"
    return out.select(*keys, F.when(F.col("col") == "body", F.least(*scores[1:])).otherwise(scores[-1]).alias("score"), "threshold", F.coalesce(F.col(f"{first}.e") + F.col(f"{first}.c"), F.lit(0)).alias("support"), F.coalesce(F.col(f"{last}.c"), F.lit(0)).alias("gone_on"))


def judged(df: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """(id, lang, col, score, threshold, all_score, all_threshold, decided, cut) of every value that isn't null or blank.

    A backward character n-gram model counts, for each language and column (title, body, trailing line), how often each
    context ended a part of a text and how often it went on; in titles and trailing lines, which are no sentences, how often
    it ended a word and how often the word went on. A body is read up to where it ends or was cut: white space, damaged
    characters, tags, reference numbers, remarks in brackets and dots may stand after that. A value's score is the log-odds
    of its final context, its own end and those of its copies left out. It is `cut` if its score is below the threshold of its
    column both in its language and in all languages together, as the language may be wrong; a title or a trailing line if
    FAR_BELOW it in its own language and in every other.

    The model can't tell where the final context was hardly seen elsewhere, or never went on inside any text. There,
    and where the model calls a text complete, an exact check follows: a notice of a cut, half a tag, an abbreviation or a
    lone `0.`, and for contexts hardly seen elsewhere whether a stop is there; `decided` says `model` or `check`. A null language is a language of its own.
    Null and blank texts are left out. The key may repeat: rows are judged one by one.
    """
    rows = df.filter(F.col(text).isNotNull() & (F.trim(text) != "")).select(
        F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.col(text).alias("text")
    )
    model = model_of(rows)
    kind = rows.schema["_key"].dataType.simpleString()
    finals = rows.select(F.struct("_row", "_key").alias("id"), "lang", "text")
    finals = finals.mapInArrow(_finals, f"id struct<_row:bigint,_key:{kind}>, lang string, col string, ctx array<long>, tail string, doubtful boolean, stopped boolean")
    finals = staged(finals.withColumn("tail", F.xxhash64("tail")), "finals")
    own = finals.groupBy("tail", "col", "lang").agg(F.count(F.lit(1)).alias("own"))
    several = own.groupBy("tail", "col").agg(F.sum("own").alias("all")).filter("`all` > 1")
    copies = staged(own.join(several, ["tail", "col"]), "copies")
    finals = finals.join(small_or_shuffled(copies), ["tail", "col", "lang"], "left").fillna(1, ["own", "all"])
    keys = ["lang", "col", "ctx", "own", "all"]
    ends = staged(finals.select(*keys).distinct(), "contexts")
    pooled = staged(model.groupBy("col", "k", "ctx").agg(F.sum("n_end").alias("n_end"), F.sum("n_cont").alias("n_cont")), "pooled")
    each = _scored(ends, model, ["lang", "col"], "own").select(*keys, "score", "threshold")
    every = _scored(ends, pooled, ["col"], "all").select(*keys, F.col("score").alias("all_score"), F.col("threshold").alias("all_threshold"), "support", "gone_on")
    limits = staged(thresholds(model, ["lang", "col"]), "thresholds")
    margin = _log_odds(F.col("n_end"), F.col("n_cont")) - F.col("threshold")
    words = model.filter((F.col("col") != "body") & (F.col("n_end") > 0) & (F.col("n_end") + F.col("n_cont") >= SUPPORT)).join(small_or_shuffled(limits), ["lang", "col"])
    best = words.groupBy("col", "k", F.col("ctx").alias("_ctx")).agg(F.max(margin).alias("_m"))
    long = ends.filter("col <> 'body'").select(*keys, F.posexplode("ctx").alias("_i", "_ctx")).withColumn("k", F.element_at(F.array(*[F.lit(k) for k in ORDERS]), F.col("_i") + 1))
    anywhere = long.join(small_or_shuffled(best), ["col", "k", "_ctx"]).groupBy(*keys).agg(F.max_by("_m", "k").alias("best_margin"))
    scores = staged(each.join(every, keys).join(anywhere, keys, "left"), "scores")
    out = finals.join(small_or_shuffled(scores), keys, "left")
    known = F.coalesce(F.col("support") >= SUPPORT, F.lit(False))
    body = (F.col("score") < F.col("threshold")) & (F.col("all_score") < F.col("all_threshold"))
    other = (F.col("score") < F.col("threshold") - FAR_BELOW) & F.coalesce(F.col("best_margin") < -FAR_BELOW, F.lit(False))
    below = known & F.when(F.col("col") == "body", body).otherwise(other)
    check = (F.col("doubtful") | ~known & ~F.col("stopped")) & ~below
    decided = F.when(check | ~known | ((F.col("gone_on") == 0) & ~below), "check").otherwise("model")
    return out.select(F.col("id._key").alias("id"), "lang", "col", "score", "threshold", "all_score", "all_threshold", decided.alias("decided"), (below | check).alias("cut"))


def p10_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, col, score, threshold, all_score, all_threshold, decided, cut) of every document."""
    return judged(table(spark, sf_dir, "documents"), "doc_id", "text", "lang").withColumnRenamed("id", "doc_id").drop("lang")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id) of the texts that were cut off."""
    return p10_judged(spark, sf_dir).filter("cut").select("doc_id")


def p10_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, n_texts, n_cut, share_cut) of every source, the null one included."""
    docs = table(spark, sf_dir, "documents")
    cut = p10_found(spark, sf_dir).withColumn("_cut", F.lit(1))
    per = docs.select("doc_id", "source").join(cut, "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("n_texts"), F.count("_cut").alias("n_cut"))
    return per.withColumn("share_cut", F.col("n_cut") / F.col("n_texts"))


QUERIES = {"p10_found": p10_found, "p10_judged": p10_judged, "p10_sources": p10_sources}
SQL: dict[str, str] = {}
