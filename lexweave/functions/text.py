"""Text expressions. Each takes and gives columns, stays in the JVM and maps null to null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters stripped from the ends of a token, and the markup of abstract sections.
MARKS = "{}[]()\"'<>,.:;!?"
OPEN_SECTION = r"<AbstractText\s.+?>"
CLOSE_SECTION = "</AbstractText>"
# The default English stop words of Spark's ML library.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs "
    "themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or "
    "because as until while of at by for with about against between into through during before after above below to from up down in out on off over under "
    "again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t "
    "can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've "
    "we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't "
    "cannot could here's how's let's ought that's there's what's when's where's who's why's would"
).split()


def strip_sections(text: Column) -> Column:
    """Without abstract section tags; an opening tag must have an attribute."""
    return F.regexp_replace(F.regexp_replace(text, OPEN_SECTION, ""), CLOSE_SECTION, "")


def tabs_to_spaces(text: Column) -> Column:
    return F.translate(text, "\t", " ")


def drop_non_ascii(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "")


def printable(text: Column) -> Column:
    """ASCII letters, digits, punctuation and white space only."""
    return F.regexp_replace(text, r"[^\x20-\x7E\t\n\r\x0B\f]", "")


def trim_quotes(text: Column) -> Column:
    """Without outer white space, then without outer double quotes."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), '^"+|"+$', "")


def substring_count(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of a literal needle; 0 for an empty one."""
    return F.when(needle == "", F.lit(0)).otherwise(((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).cast("int"))


def regex_count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def word_count(text: Column) -> Column:
    """Pieces between single spaces; trailing empty ones don't count, an empty text is one piece."""
    cut = F.regexp_replace(text, " +$", "")
    return F.when((cut == "") & (text != ""), F.lit(0)).otherwise(F.size(F.split(cut, " ", -1)))


def normalize_phrase(text: Column) -> Column:
    """Lower case, ASCII punctuation to spaces, runs of white space to one space."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", " "), r"\s+", " ")


def sort_words(text: Column) -> Column:
    return F.array_join(F.array_sort(F.split(text, " ", -1)), " ")


def drop_stop_words(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.isin(STOP_WORDS))


def analysed_phrase(text: Column) -> Column:
    """Lower-cased runs of letters and digits without stop words, joined by spaces."""
    return F.array_join(drop_stop_words(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)), " ")


def decapitalise_first(words: Column) -> Column:
    """The first word in lower case if it is one character or only its first is upper case; all-capital words stay."""
    first = F.get(words, F.lit(0))
    rest = F.substring(first, F.lit(2), F.length(first))
    low = (F.length(first) == 1) | (rest == F.lower(rest))
    return F.when(F.size(words) > 0, F.concat(F.array(F.when(low, F.lower(first)).otherwise(first)), F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))))).otherwise(words)


def strip_marks(words: Column) -> Column:
    """Every word without marks at its ends; words that become empty are dropped."""
    return F.filter(F.transform(words, lambda w: F.btrim(w, F.lit(MARKS))), lambda w: w != "")


def strip_balanced(word: Column) -> Column:
    """Without one pair of brackets or quotes that encloses the whole word."""
    inner = F.substring(word, F.lit(2), F.length(word) - 2)
    pairs = [("(", ")"), ("[", "]"), ("{", "}"), ('"', '"'), ("'", "'")]
    both = [(word.startswith(a) & word.endswith(b) & (F.length(word) >= 2)) for a, b in pairs]
    some = both[0]
    for one in both[1:]:
        some = some | one
    return F.when(some, inner).otherwise(word)


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words joined by spaces; none if there are fewer, null for null."""
    last = F.size(words) - n + 1
    return F.when(words.isNull(), None).when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def yes_no(flag: Column) -> Column:
    """Y and N to true and false; anything else, null included, raises an error."""
    return F.when(flag == "Y", True).when(flag == "N", False).otherwise(F.raise_error(F.concat(F.lit("neither Y nor N: "), F.coalesce(flag, F.lit("null")))).cast("boolean"))


def part_name(number: Column) -> Column:
    return F.concat(F.lit("part-"), F.lpad(number.cast("string"), 5, "0"))


def has_scheme(path: Column, scheme: str) -> Column:
    """Whether a path begins with the name of a file system."""
    return path.startswith(scheme)


def is_ascii(text: Column) -> Column:
    return text.rlike(r"\A[\x00-\x7F]*\z")


def terms(text: Column) -> Column:
    """Runs of at least two of a-z and 0-9 in the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{2,}"), 0)


def counted(words: Column) -> Column:
    """Each different word of a sorted array and how often it is there, as structs (term, tf) in order; null for null.

    The runs of the array are measured, so that the words of a row needn't leave it to be counted. `words` is looked up at
    each place; it should be a plain column, not an expression.
    """
    n = F.size(words)
    starts = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & ((i == 1) | (F.get(words, i - 1) != F.get(words, i - 2))))
    ends = F.concat(F.slice(starts, F.lit(2), F.greatest(n, F.lit(1))), F.array(n + 1))
    return F.when(n > 0, F.zip_with(starts, ends, lambda a, b: F.struct(F.get(words, a - 1).alias("term"), (b - a).cast("long").alias("tf")))).when(n == 0, F.array().cast("array<struct<term:string,tf:bigint>>"))


def weight_pair(key: Column, weight: Column) -> Column:
    """`key,weight` with six decimals."""
    return F.format_string("%d,%f", key, weight)


def line_of(key: Column, pairs: Column) -> Column:
    """`key` and its pairs, separated by tabs."""
    return F.concat_ws("\t", key.cast("string"), pairs)
