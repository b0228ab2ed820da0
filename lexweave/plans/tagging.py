"""Queries with the stemmer and the dictionary taggers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.functions import tagging as G
from lexweave.functions import text as X
from lexweave.functions.stemmer import porter
from lexweave.operators import similarity as S
from lexweave.plans.headings import heads, texts
from lexweave.session import staged, table


def dictionary(s, d):
    """(cui, str): all distinct headings, numbered from 1 by their order."""
    h = S.with_ids(heads(s, d).select("mesh").distinct(), "mesh", "i")
    return h.select((F.col("i") + 1).alias("cui"), F.col("mesh").alias("str"))


def titles(s, d):
    return texts(s, d).filter("title is not null").select("pmid", "title")


def trie_phrases(s, d):
    h = table(s, d, "mesh_heading").filter("mesh is not null").select("pmid", F.split(F.lower(F.trim("mesh")), " ").alias("w"))
    rows = h.groupBy("pmid").agg(F.flatten(F.array_sort(F.collect_list("w"))).alias("w"))
    words = dictionary(s, d).select(F.col("cui").cast("int").alias("id"), "str")
    return G.phrases_of(staged(rows, "words"), "pmid", "w", words).select("pmid", F.col("phrase_id").cast("int").alias("phrase_id"))


def cascade_match(s, d):
    phrases = table(s, d, "mesh_heading").filter("mesh is not null").select(F.regexp_replace("mesh", "/", " of ").alias("phrase")).distinct()
    return G.cascade(phrases, "phrase", dictionary(s, d))


def annotated(s, d):
    h = heads(s, d).select("pmid", F.regexp_replace("mesh", "[/ ]", " and ").alias("phrase"))
    return G.annotated(h, "phrase", dictionary(s, d)).select("pmid", "phrase", F.explode("concepts").alias("c")).select("pmid", "phrase", "c.matched", "c.cui", "c.score")


def stems(s, d):
    words = table(s, d, "documents").select(F.explode(X.terms(F.col("text"))).alias("word")).distinct()
    return words.select("word", porter("word").alias("stem"))


def stem_df(s, d):
    """Documents of each stem: every distinct word is stemmed once and joined back."""
    pairs = titles(s, d).select("pmid", F.explode(X.terms(F.col("title"))).alias("word")).distinct()
    stemmed = pairs.select("word").distinct().select("word", porter("word").alias("stem"))
    return pairs.join(stemmed, "word").select("pmid", "stem").distinct().groupBy("stem").agg(F.count(F.lit(1)).alias("df"))


QUERIES = {"trie_phrases": trie_phrases, "cascade_match": cascade_match, "concept_annotation": annotated, "porter_stem": stems, "stem_df": stem_df}


def SQL() -> dict[str, str]:
    from lexweave.plans.headings import _HEADS

    stops = ", ".join("'" + w.replace("'", "''") + "'" for w in X.STOP_WORDS)
    norm = lambda c: rf"trim(regexp_replace(regexp_replace(lower({c}), '[!-/:-@\[-`{{-~]', ' ', 'g'), '\s+', ' ', 'g'), ' ')"
    forms = {
        "exact": lambda c: c,
        "norm": norm,
        "sorted": lambda c: f"array_to_string(list_sort(string_split({norm(c)}, ' ')), ' ')",
        "analysed": lambda c: f"array_to_string(list_sort(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda w: w not in ({stops}))), ' ')",
    }
    dictionary = f"{_HEADS}, dict as (select row_number() over (order by mesh) cui, mesh str from (select distinct mesh from heads))"
    hits = " union all ".join(
        f"select phrase, {i} lv, '{level}' as level, {worth} worth, d.cui, d.str from p join (select {forms[level]('str')} k, min(cui) cui, arg_min(str, cui) str from dict group by 1) d on d.k = {forms[level]('phrase')} where d.k <> ''"
        for i, (level, worth) in enumerate(G.LEVELS)
    )
    split = r"list_filter(regexp_split_to_array({}, '\s+'), lambda x: x <> '')"
    plain = lambda c: split.format(rf"regexp_replace(lower({c}), '[^\pL\pN\s]', ' ', 'g')")
    runs = {
        "exact": lambda c: c,
        "norm": lambda c: f"array_to_string({plain(c)}, ' ')",
        "sorted": lambda c: f"array_to_string(list_sort({plain(c)}), ' ')",
        "analysed": lambda c: f"array_to_string(list_sort(list_filter({plain(c)}, lambda w: w not in ({stops}))), ' ')",
    }
    run_hits = " union all ".join(
        f"select t, {i} lv, {worth} worth, d.cui, d.str from ts join (select {runs[level]('str')} k, min(cui) cui, arg_min(str, cui) str from dict group by 1) d on d.k = {runs[level]('t')} where d.k <> ''"
        for i, (level, worth) in enumerate(G.LEVELS)
    )
    size = f"len({split})"
    words = "len(string_split({}, ' '))"
    n, m = words.format("phrase"), words.format("str")
    return {
        "cascade_match": f"with {dictionary}, p as (select distinct replace(mesh, '/', ' of ') phrase from mesh_heading where mesh is not null), h as ({hits}) select phrase, level, cui, worth * least({n}, {m}) / greatest({n}, {m}) score from h qualify row_number() over (partition by phrase order by lv) = 1",
        "concept_annotation": f"""with recursive {dictionary}, hp as (select pmid, regexp_replace(mesh, '[/ ]', ' and ', 'g') phrase from heads),
w as (select phrase, {split.format("phrase")} ws from (select distinct phrase from hp)), s as (select phrase, ws, unnest(range(1, len(ws) + 1)) i from w),
r as (select phrase, len(ws) l, i, unnest(range(1, len(ws) - i + 2)) n, ws from s), rt as (select phrase, l, i, n, array_to_string(ws[i:i + n - 1], ' ') t from r),
ts as (select distinct t from rt), h as ({run_hits}), b as (select t, cui, worth * least({size.format("t")}, {size.format("str")}) / greatest({size.format("t")}, {size.format("str")}) score from h qualify row_number() over (partition by t order by lv) = 1),
c as (select phrase, l, n, t, cui, score, ((1::bigint << n::int) - 1) << (i - 1)::int bits, row_number() over (partition by phrase order by n desc, i) k from rt join b using (t)),
walk as (select phrase, k, t, cui, score, bits mask, n = l whole, true acc from c where k = 1 union all
  select c.phrase, c.k, c.t, c.cui, c.score, case when (walk.mask & c.bits) <> c.bits then walk.mask | c.bits else walk.mask end, false, (walk.mask & c.bits) <> c.bits from walk join c on c.phrase = walk.phrase and c.k = walk.k + 1 and not walk.whole),
f as (select phrase, cui, arg_min(t, k) matched, arg_min(score, k) score from walk where acc group by 1, 2)
select pmid, phrase, matched, cui, score from hp join f using (phrase)""",
        "trie_phrases": rf"""with recursive {dictionary}, w as (select pmid, string_split(lower(trim(mesh, ' ')), ' ') w from mesh_heading where mesh is not null),
t as (select pmid, list_filter(flatten(list(w order by w)), lambda x: true) ws from w group by pmid),
e as (select array_to_string(list_filter(regexp_split_to_array(str, '\s+'), lambda x: x <> ''), ' ') run, len(list_filter(regexp_split_to_array(str, '\s+'), lambda x: x <> '')) size, max(cui) id from dict group by 1, 2),
z as (select distinct size from e where size > 0), pl as (select pmid, ws, unnest(range(1, len(ws) + 1)) i from t),
c as (select pmid, i, e.size, e.id from pl, z, e where e.size = z.size and i + z.size - 1 <= len(ws) and e.run = array_to_string(ws[i:i + z.size - 1], ' ')),
b as (select pmid, i, max(size) size, arg_max(id, size) id from c group by 1, 2),
nx as (select pmid, i, size, id, i + size as after from b),
step as (select a.pmid, a.i, a.after, a.id, min(n.i) nxt from nx a left join nx n on n.pmid = a.pmid and n.i >= a.after group by all),
walk as (select s.pmid, s.i, s.id, s.nxt from step s where s.i = (select min(i) from nx where nx.pmid = s.pmid) union all select s.pmid, s.i, s.id, s.nxt from walk join step s on s.pmid = walk.pmid and s.i = walk.nxt)
select pmid, cast(id as int) phrase_id from walk""",
    }
