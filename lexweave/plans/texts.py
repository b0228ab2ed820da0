"""Queries that apply the text functions to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.functions import text as X
from lexweave.session import table


def docs(s, d):
    return table(s, d, "documents").select("doc_id", "text")


def abstracts(s, d):
    return table(s, d, "abstracts").select("pmid", "title", "abs", "loaded_at")


def _doc(expr, name="value"):
    return lambda s, d: docs(s, d).select("doc_id", expr(F.col("text")).alias(name))


def tokens(s, d):
    """Words of all sentences: the first word of each decapitalised, marks stripped, empty ones dropped.

    A sentence ends with its line, or with a closing mark before white space.
    """
    sentences = F.split(F.regexp_replace("text", r"([.!?])\s+", "$1\n"), "\n", -1)
    words = F.flatten(F.transform(sentences, lambda x: X.strip_marks(X.decapitalise_first(F.split(x, " ", -1)))))
    return docs(s, d).select("doc_id", F.array_join(words, "|").alias("value"))


def json_default(s, d):
    """Fields of a JSON article, with placeholders for missing and empty ones."""
    made = abstracts(s, d).select("pmid", F.to_json(F.struct("pmid", F.col("title").alias("articleTitle"), F.col("abs").alias("abstractText"))).alias("j"))
    row = F.from_json("j", "pmid int, articleTitle string, abstractText string")
    get = lambda c, default: F.coalesce(F.nullif(F.trim(row[c]), F.lit("")), F.lit(default))
    return made.select(row["pmid"].alias("pmid"), get("articleTitle", "no title").alias("title"), F.length(get("abstractText", "no abstract")).alias("n"))


def annotation_lines(s, d):
    """`pmid|t|title` and `pmid|a|abstract` with printable characters only."""
    line = lambda tag, c: F.concat_ws("|", F.col("pmid").cast("string"), F.lit(tag), X.printable(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\t\n\r]", " ")))
    return abstracts(s, d).select("pmid", F.explode(F.array(line("t", F.col("title")), line("a", F.col("abs")))).alias("line"))


QUERIES = {
    "markup_strip": lambda s, d: abstracts(s, d).select("pmid", "loaded_at", X.strip_sections(F.col("abs")).alias("value")),
    "tabs_to_spaces": _doc(lambda t: X.tabs_to_spaces(t)),
    "drop_non_ascii": _doc(lambda t: X.drop_non_ascii(t)),
    "printable": _doc(lambda t: X.printable(t)),
    "trim_quotes": _doc(lambda t: X.trim_quotes(t)),
    "substring_count": _doc(lambda t: X.substring_count(t, F.lit("in"))),
    "regex_count": _doc(lambda t: X.regex_count(t, "[0-9]+")),
    "word_count": _doc(lambda t: X.word_count(t)),
    "normalize_phrase": _doc(lambda t: X.normalize_phrase(t)),
    "sort_words": lambda s, d: abstracts(s, d).select("pmid", "loaded_at", X.sort_words(F.col("title")).alias("value")),
    "analysed_phrase": lambda s, d: abstracts(s, d).select("pmid", "loaded_at", X.analysed_phrase(F.col("title")).alias("value")),
    "first_line_tokens": tokens,
    "strip_balanced": lambda s, d: docs(s, d).select("doc_id", F.posexplode(F.split("text", r"\s+")).alias("i", "w")).select("doc_id", "i", X.strip_balanced(F.col("w")).alias("value")),
    "ngrams": lambda s, d: abstracts(s, d).select("pmid", "loaded_at", F.array_join(X.ngrams(F.split("title", " "), 3), "|").alias("value")),
    "yes_no": lambda s, d: table(s, d, "mesh_heading").filter("major in ('Y', 'N')").groupBy("mesh").agg(F.sum(X.yes_no(F.col("major")).cast("long")).alias("n_major")),
    "part_names": lambda s, d: docs(s, d).select("doc_id", X.part_name(F.col("doc_id") % 1000).alias("value")),
    "is_ascii": _doc(lambda t: X.is_ascii(t)),
    "term_match_filter": lambda s, d: docs(s, d).select("doc_id", F.size(F.filter(F.split("text", " "), lambda w: ~w.rlike("^-.*-$"))).alias("value")),
    "min_length_words": lambda s, d: docs(s, d).select("doc_id", F.size(F.filter(F.split("text", " "), lambda w: F.length(w) > 1)).alias("value")),
    "weight_pairs": lambda s, d: table(s, d, "term_doc_weight").filter("weight is not null and not isnan(weight)").select("term_id", "pmid", X.weight_pair(F.col("pmid"), F.col("weight")).alias("value")),
    "json_default": json_default,
    "annotation_lines": annotation_lines,
    "json_props": lambda s, d: table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")),
    "distinct_words": lambda s, d: docs(s, d).select("doc_id", F.explode(F.split("text", r"\s+")).alias("word")).filter("word <> ''").dropDuplicates(["doc_id", "word"]),
}

_T = "select doc_id, {} as value from documents"
_A = "select pmid, loaded_at, {} as value from abstracts"
_PUNCT = r"[!-/:-@\[-`{-~]"


def SQL() -> dict[str, str]:
    stop = ", ".join("'" + w.replace("'", "''") + "'" for w in X.STOP_WORDS)
    cut = "regexp_replace(text, ' +$', '')"
    marks = X.MARKS.replace("'", "''")
    low = "case when length(w[1]) = 1 or substr(w[1], 2) = lower(substr(w[1], 2)) then lower(w[1]) else w[1] end"
    return {
        "markup_strip": _A.format(r"replace(regexp_replace(abs, '<AbstractText\s.+?>', '', 'g'), '</AbstractText>', '')"),
        "tabs_to_spaces": _T.format("replace(text, chr(9), ' ')"),
        "drop_non_ascii": _T.format(r"regexp_replace(text, '[^\x00-\x7F]', '', 'g')"),
        "printable": _T.format(r"regexp_replace(text, '[^\x20-\x7E\t\n\r\x0B\f]', '', 'g')"),
        "trim_quotes": _T.format(r"""trim(regexp_replace(text, '^\s+|\s+$', '', 'g'), '"')"""),
        "substring_count": _T.format("cast((length(text) - length(replace(text, 'in', ''))) // 2 as int)"),
        "regex_count": _T.format("cast(len(regexp_extract_all(text, '[0-9]+')) as int)"),
        "word_count": _T.format(f"cast(case when {cut} = '' and text <> '' then 0 else len(string_split({cut}, ' ')) end as int)"),
        "normalize_phrase": _T.format(rf"regexp_replace(regexp_replace(lower(text), '{_PUNCT}', ' ', 'g'), '\s+', ' ', 'g')"),
        "sort_words": _A.format("array_to_string(list_sort(string_split(title, ' ')), ' ')"),
        "analysed_phrase": _A.format(f"array_to_string(list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda w: w not in ({stop})), ' ')"),
        "first_line_tokens": rf"with s as (select doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)) s from documents), w as (select doc_id, unnest(range(len(s))) i, string_split(unnest(s), ' ') w from s), f as (select doc_id, i, [{low}] || w[2:] w from w), k as (select doc_id, i, list_filter(list_transform(w, lambda x: trim(x, '{marks}')), lambda x: x <> '') w from f) select doc_id, array_to_string(flatten(list(w order by i)), '|') as value from k group by doc_id",
        "strip_balanced": r"with w as (select doc_id, regexp_split_to_array(text, '\s+') w from documents), u as (select doc_id, unnest(w) w, unnest(range(len(w))) i from w) select doc_id, cast(i as int) i, case when length(w) >= 2 and (w[1] || w[-1]) in ('()', '[]', '{}', '""', '''''') then w[2:length(w)-1] else w end as value from u",
        "ngrams": _A.format("array_to_string(list_transform(range(1, len(string_split(title, ' ')) - 1), lambda i: array_to_string(string_split(title, ' ')[i:i+2], ' ')), '|')"),
        "yes_no": "select mesh, count(*) filter (major = 'Y') n_major from mesh_heading where major in ('Y', 'N') group by mesh",
        "part_names": _T.format("'part-' || lpad(cast(doc_id % 1000 as varchar), 5, '0')"),
        "is_ascii": _T.format(r"not regexp_matches(text, '[^\x00-\x7F]')"),
        "term_match_filter": _T.format("cast(len(list_filter(string_split(text, ' '), lambda w: not regexp_full_match(w, '-.*-'))) as int)"),
        "min_length_words": _T.format("cast(len(list_filter(string_split(text, ' '), lambda w: length(w) > 1)) as int)"),
        "weight_pairs": "select term_id, pmid, printf('%d,%.6f', pmid, weight) as value from term_doc_weight where weight is not null and not isnan(weight)",
        "json_default": "select pmid, coalesce(nullif(trim(title, ' '), ''), 'no title') title, cast(length(coalesce(nullif(trim(abs, ' '), ''), 'no abstract')) as int) n from abstracts",
        "annotation_lines": r"select pmid, unnest([pmid || '|t|' || regexp_replace(regexp_replace(coalesce(title, ''), '[\t\n\r]', ' ', 'g'), '[^\x20-\x7E]', '', 'g'), pmid || '|a|' || regexp_replace(regexp_replace(coalesce(abs, ''), '[\t\n\r]', ' ', 'g'), '[^\x20-\x7E]', '', 'g')]) line from abstracts",
        "json_props": "select event_id, cast(json_extract_string(props, '$.k') as bigint) k from events",
        "distinct_words": r"select distinct doc_id, word from (select doc_id, unnest(regexp_split_to_array(text, '\s+')) word from documents) where word <> ''",
    }
