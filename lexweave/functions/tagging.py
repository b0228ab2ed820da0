"""Dictionary taggers: a phrase trie, a cascade of key levels, and concept annotation of phrases."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.text import STOP_WORDS, analysed_phrase, normalize_phrase, sort_words
from lexweave.session import small_or_shuffled

#: Levels of the cascade and what an exact hit on each is worth.
LEVELS = [("exact", 100.0), ("norm", 90.0), ("sorted", 80.0), ("analysed", 70.0)]


class PhraseTrie:
    """Phrases by their words."""

    def __init__(self, phrases: list[tuple[str, int]] = ()) -> None:
        self.root: dict = {}
        for phrase, number in phrases:
            self.add(phrase, number)

    def add(self, phrase: str, number: int) -> None:
        node = self.root
        for word in phrase.split():
            node = node.setdefault(word, {})
        if node is not self.root:
            node[None] = number

    def find(self, words: list[str], compat: bool = False) -> list[int]:
        """The phrases in a row of words, leftmost and longest first, not overlapping.

        compat: a phrase is only given when the word after it doesn't go on from it, the word that breaks a match begins
        none, and a shorter phrase is lost where a longer one fails midway.
        """
        return self._compat(words) if compat else self._longest(words)

    def _longest(self, words: list[str]) -> list[int]:
        found, at = [], 0
        while at < len(words):
            node, end, best = self.root, at, None
            for i in range(at, len(words)):
                node = node.get(words[i])
                if node is None:
                    break
                if None in node:
                    best, end = node[None], i + 1
            if best is None:
                at += 1
            else:
                found.append(best)
                at = end
        return found

    def _compat(self, words: list[str]) -> list[int]:
        found, node = [], self.root
        for word in words:
            to = node.get(word)
            if to is None:
                if None in node:
                    found.append(node[None])
                node = self.root
            else:
                node = to
        if None in node:
            found.append(node[None])
        return found


def trie_phrases(phrases: list[tuple[str, int]], compat: bool = False):
    """A column function from an array of words to the numbers of the phrases in it; the phrases are a bounded dictionary."""
    trie = PhraseTrie(phrases)

    @F.pandas_udf("array<int>")
    def find(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in words:
            yield part.map(lambda ws: trie.find(list(ws), compat) if ws is not None else None)

    return find


def phrases_of(docs: DataFrame, key: str, words: str, dictionary: DataFrame) -> DataFrame:
    """(key, phrase_id): the phrases of (id, str), a dictionary of any size, in each row of words, as PhraseTrie finds them.

    Only entries that are a run of words of a row can be found in it. So the runs of the lengths that entries have are joined
    with the dictionary, and each row gets a trie of its own hits. Each row must have a key of its own. Of entries with the
    same words the one with the highest id is taken.
    """
    spaces = r"[\s\x1c-\x1f\x85\p{Z}]+"
    entries = dictionary.dropna(subset=["id", "str"]).select("id", F.filter(F.split("str", spaces, -1), lambda w: w != "").alias("_w"))
    entries = entries.filter(F.size("_w") > 0).groupBy(F.array_join("_w", " ").alias("_run"), F.size("_w").alias("_size")).agg(F.max("id").alias("_id"))
    sizes = [r[0] for r in entries.select("_size").distinct().collect()]

    @F.pandas_udf("array<string>")
    def runs(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda ws: list({" ".join(ws[i : i + n]) for n in sizes for i in range(len(ws) - n + 1)} if ws is not None else []))

    @F.pandas_udf("array<long>")
    def find(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, hits in parts:
            yield pd.Series([PhraseTrie([(h["_run"], h["_id"]) for h in own]).find(list(ws)) for ws, own in zip(texts, hits)])

    found = docs.select(F.col(key).alias("_key"), F.explode(runs(words)).alias("_run")).join(small_or_shuffled(entries.select("_run", "_id")), "_run")
    found = found.groupBy("_key").agg(F.collect_list(F.struct("_run", "_id")).alias("_hits"))
    return docs.join(found, F.col(key).eqNullSafe(F.col("_key"))).select(key, F.explode(find(words, "_hits")).alias("phrase_id"))


def keyed(df: DataFrame, phrase: str) -> DataFrame:
    """df with a key column for each level of the cascade."""
    p = F.col(phrase)
    return df.withColumns({"exact": p, "norm": F.trim(normalize_phrase(p)), "sorted": sort_words(F.trim(normalize_phrase(p))), "analysed": sort_words(analysed_phrase(p))})


def _ratio(a: Column, b: Column) -> Column:
    """The smaller number of words by the larger."""
    n, m = F.size(F.split(a, " ")), F.size(F.split(b, " "))
    return F.least(n, m) / F.greatest(n, m)


def cascade(phrases: DataFrame, phrase: str, dictionary: DataFrame) -> DataFrame:
    """phrases with (level, cui, score) of the first level that hits; no row where none does.

    dictionary has (cui, str). Of several entries with a key the one with the least cui is taken. Empty keys don't match.
    """
    left = keyed(phrases, phrase)
    words = keyed(dictionary.dropna(subset=["cui", "str"]), "str")
    for level, _ in LEVELS:
        side = words.filter(F.col(level) != "").groupBy(F.col(level).alias(f"_k_{level}")).agg(F.min(F.struct("cui", "str")).alias(f"_h_{level}"))
        left = left.join(small_or_shuffled(side), F.col(level) == F.col(f"_k_{level}"), "left").drop(f"_k_{level}")
    hit = F.coalesce(*[F.when(F.col(f"_h_{level}").isNotNull(), F.struct(F.lit(level).alias("level"), F.lit(worth).alias("worth"), F.col(f"_h_{level}.cui").alias("cui"), F.col(f"_h_{level}.str").alias("str"))) for level, worth in LEVELS])
    out = left.withColumn("_hit", hit).filter("_hit is not null")
    score = F.col("_hit.worth") * _ratio(F.col(phrase), F.col("_hit.str"))
    return out.select(*phrases.columns, F.col("_hit.level").alias("level"), F.col("_hit.cui").alias("cui"), score.alias("score"))


def _norm(text: str) -> str:
    return " ".join("".join(c.lower() if c.isalnum() or c.isspace() else " " for c in text).split())


def _forms(text: str, stops: set[str]) -> list[str]:
    """The keys of a text at each of the LEVELS."""
    norm = _norm(text)
    return [text, norm, " ".join(sorted(norm.split())), " ".join(sorted(w for w in norm.split() if w not in stops))]


def _finder(entries: list[tuple[int, str]], stops: set[str]):
    tables: list[dict[str, tuple[int, str]]] = [{} for _ in LEVELS]
    for cui, text in sorted(entries):
        for key, known in zip(_forms(text, stops), tables):
            if key:
                known.setdefault(key, (cui, text))

    def match(text: str) -> tuple[str, int, float] | None:
        for key, known, (_, worth) in zip(_forms(text, stops), tables, LEVELS):
            if key and (hit := known.get(key)):
                n, m = len(text.split()), len(hit[1].split())
                return text, hit[0], worth * min(n, m) / max(n, m)
        return None

    def concepts(text: str) -> list[dict]:
        words = text.split()
        found = [hit] if words and (hit := match(" ".join(words))) else []
        if not found:
            used = [False] * len(words)
            for n in range(len(words) - 1, 0, -1):
                for i in range(len(words) - n + 1):
                    if not all(used[i : i + n]) and (hit := match(" ".join(words[i : i + n]))):
                        found.append(hit)
                        used[i : i + n] = [True] * n
        first: dict[int, tuple[str, int, float]] = {}
        for hit in found:
            first.setdefault(hit[1], hit)
        return [{"matched": m, "cui": c, "score": s} for m, c, s in sorted(first.values(), key=lambda h: (-h[2], h[1]))]

    return concepts


CONCEPTS = "array<struct<matched:string,cui:long,score:double>>"


def annotator(entries: list[tuple[int, str]]):
    """A column function from a phrase to its concepts: array of (matched, cui, score), by descending score.

    The whole phrase is tried first. Else runs of words from the longest to single ones are, left to right, but not those
    whose words have all been matched before. Each concept counts once, as first found. The entries (cui, str) are a
    bounded dictionary; annotated() takes one of any size.
    """
    concepts = _finder(entries, set(STOP_WORDS))

    @F.pandas_udf(CONCEPTS)
    def annotate(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield part.map(lambda t: concepts(t) if t is not None else None)

    return annotate


def annotated(phrases: DataFrame, phrase: str, dictionary: DataFrame) -> DataFrame:
    """phrases with an array `concepts` as annotator() gives it, for a dictionary (cui, str) of any size; rows without hits are left out.

    The keys of the word runs of each distinct phrase are joined with the keys of the dictionary, and each phrase is
    annotated from the entries that it hits, which are all that can be found in it.
    """
    stops = set(STOP_WORDS)
    pair = "array<struct<level:int,key:string>>"
    keys = lambda texts: [{"level": i, "key": k} for i, k in {(i, k) for t in texts for i, k in enumerate(_forms(t, stops)) if k}]
    spans = lambda ws: (" ".join(ws[i:j]) for i in range(len(ws)) for j in range(i + 1, len(ws) + 1))

    @F.pandas_udf(pair)
    def own_keys(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda t: keys([t]))

    @F.pandas_udf(pair)
    def run_keys(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda t: keys(spans(t.split())))

    @F.pandas_udf(CONCEPTS)
    def annotate(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, hits in parts:
            yield pd.Series([_finder([(h["cui"], h["str"]) for h in own], stops)(t) for t, own in zip(texts, hits)])

    words = dictionary.dropna(subset=["cui", "str"]).select("cui", "str", F.explode(own_keys("str")).alias("_k"))
    words = words.groupBy("_k").agg(F.min(F.struct("cui", "str")).alias("_hit"))
    each = phrases.select(F.col(phrase).alias("_phrase")).dropna().distinct()
    found = each.select("_phrase", F.explode(run_keys("_phrase")).alias("_k")).join(small_or_shuffled(words), "_k")
    found = found.groupBy("_phrase").agg(F.collect_set("_hit").alias("_hits")).select("_phrase", annotate("_phrase", "_hits").alias("concepts"))
    return phrases.join(small_or_shuffled(found), F.col(phrase) == F.col("_phrase")).select(*phrases.columns, "concepts")
