"""Lemmas by a lexicon, samples, lookups and tables as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from lexweave.operators.similarity import with_ids
from lexweave.operators.skew import keyed_join
from lexweave.session import is_small, small_or_shuffled

# The detachment rules of the public WordNet lemmatiser (morphy) for nouns, verbs and adjectives, in this order.
RULES = [
    ("ies", "y"), ("ches", "ch"), ("shes", "sh"), ("sses", "ss"), ("xes", "x"), ("zes", "z"), ("ses", "s"), ("men", "man"), ("es", "e"), ("es", ""), ("s", ""),
    ("ing", "e"), ("ing", ""), ("ed", "e"), ("ed", ""), ("est", "e"), ("est", ""), ("er", "e"), ("er", ""),
]
#: Letters of the shortest lemma that a rule may give.
SHORTEST = 3


def lemmas(words: DataFrame, word: str, lexicon: DataFrame) -> DataFrame:
    """(word, lemma) of the words that have one: the first of RULES whose result is in the lexicon, a table of one column.

    Every distinct word is looked up once, however often it occurs. Words that no rule fits, or whose results the lexicon
    doesn't know, have no row; nulls neither. Irregular forms can be added to the result as rows.
    """
    known = lexicon.select(F.col(lexicon.columns[0]).alias("_base")).dropna().distinct()
    each = words.select(F.col(word).alias("_word")).dropna().distinct()
    candidate = lambda i, a, b: F.when(F.col("_word").endswith(a), F.struct(F.lit(i).alias("i"), F.concat(F.substring(F.col("_word"), F.lit(1), F.length("_word") - len(a)), F.lit(b)).alias("base")))
    bases = F.filter(F.array(*[candidate(i, a, b) for i, (a, b) in enumerate(RULES)]), lambda c: c.isNotNull() & (F.length(c["base"]) >= SHORTEST))
    found = each.select("_word", F.explode(bases).alias("c")).select("_word", "c.i", F.col("c.base").alias("_base")).join(small_or_shuffled(known), "_base")
    return found.groupBy(F.col("_word").alias("word")).agg(F.min_by("_base", "i").alias("lemma"))


def by_lemma(df: DataFrame, lemma: DataFrame, word: str = "term") -> DataFrame:
    """df with a column `lemma`: that of its word, or the word itself."""
    side = lemma.select(F.col("word").alias(word), F.col("lemma").alias("_lemma"))
    if is_small(side):
        return df.join(F.broadcast(side), word, "left").withColumn("lemma", F.coalesce("_lemma", word)).drop("_lemma")
    every = df.select(word).distinct().join(side, word, "left").select(word, F.coalesce("_lemma", word).alias("lemma"))
    return keyed_join(df, every, word, [c for c in df.columns if c != word])


def sampled(df: DataFrame, keys: list[str], share: float, seed: str) -> DataFrame:
    """A Bernoulli sample without replacement: each row with the chance `share`, by a hash of its keys, so the same each time.

    Rows with equal keys are in it together.
    """
    place = F.conv(F.substring(F.md5(F.concat_ws("\x01", *[F.col(k).cast("string") for k in keys], F.lit(seed))), 1, 8), 16, 10).cast("long")
    return df.filter(place < int(share * (1 << 32)))


def lookup(df: DataFrame, key: str, value: object) -> Row:
    """The one row with a key; a KeyError if there is none."""
    row = df.filter(F.col(key) == value).first()
    if row is None:
        raise KeyError(value)
    return row


def table_lines(df: DataFrame, order: str) -> DataFrame:
    """(i, line): a table drawn with signs, one line for each row in the order of a column, with a head and rules. Nulls are empty."""
    cells = df.select(F.col(order).alias("_o"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])
    most = cells.agg(*[F.max(F.length(c)).alias(c) for c in df.columns]).first()
    width = {c: max(len(c), most[c] or 0) for c in df.columns}
    drawn = lambda parts, sep: F.concat(F.lit(sep), *[x for p in parts for x in (p, F.lit(sep))])
    rule = drawn([F.lit("-" * w) for w in width.values()], "+")
    body = with_ids(cells, "_o", "_i").select((F.col("_i") + 4).alias("i"), drawn([F.rpad(c, w, " ") for c, w in width.items()], "|").alias("line"))
    n = df.count()
    one = df.sparkSession.range(1)
    head = [(1, rule), (2, drawn([F.lit(c.ljust(w)) for c, w in width.items()], "|")), (3, rule), (n + 4, rule)]
    for i, line in head:
        body = body.unionByName(one.select(F.lit(i).cast("long").alias("i"), line.alias("line")))
    return body
