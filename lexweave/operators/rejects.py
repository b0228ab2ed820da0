"""Problem 3: lines that fail to parse, separated from the rows that load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.session import table

#: Fields of each feed in order: name, rule.
FEEDS = {
    "abstract": [("pmid", "id"), ("title", "any"), ("abs", "text")],
    "qualifier": [("pmid", "id"), ("descriptor_name", "any"), ("qualifier_name", "any"), ("qualifier_name_major_yn", "yn")],
}
#: What the value of each rule must match as a whole (Java), and what it must not contain.
RULES = {
    "id": (r"^\x20*[0-9]+\x20*$", r"[^\x200-9]"),
    "text": (r"(?s)^.*[^\s\p{Z}].*$", r"\x{FFFD}|[\p{Cc}&&[^\t]]"),
    "yn": (r"^\x20*[YN]\x20*$", r"\n"),
    "any": (r"(?s)^.*$", r"(?!)"),
}
#: The order in which reasons apply.
REASONS = ["quoting", "columns", "value"]

_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"(?=\t|\z)'
_PLAIN = r'(?!")[^\t]*+'
_FIELD = rf"(?>{_QUOTED}|{_PLAIN})"
WELL_QUOTED = rf"^{_FIELD}(?:\t{_FIELD})*+\z"
EACH_FIELD = rf"\t({_FIELD})"


def rule_table(spark: SparkSession) -> DataFrame:
    """(feed, col, name, must, must_not, top): one row for each field of each feed."""
    rows = [(feed, i, name, *RULES[rule], 2147483647 if rule == "id" else None) for feed, fields in FEEDS.items() for i, (name, rule) in enumerate(fields)]
    return spark.createDataFrame(rows, "feed string, col int, name string, must string, must_not string, top long")


def _unquoted(cell: Column) -> Column:
    return F.when(cell.startswith('"'), F.replace(F.substring(cell, F.lit(2), F.length(cell) - 2), F.lit('""'), F.lit('"'))).otherwise(cell)


def parsed(df: DataFrame, line_id: str = "line_id", feed: str = "feed", line: str = "line") -> DataFrame:
    """(line_id, feed, cells, reason) of every line that isn't a header.

    cells are the fields without their quotes. reason is `quoting` where a quoted field doesn't end as it must, else
    `columns` where the number of fields isn't that of the feed, else null. A null line, or one of a feed that isn't known
    or null, has the reason `columns`.
    """
    header = "\t".join(name for name, _ in FEEDS["qualifier"])
    widths = F.create_map(*[F.lit(x) for f, fields in FEEDS.items() for x in (f, len(fields))])
    rows = df.select(F.col(line_id).alias("line_id"), F.col(feed).alias("feed"), F.col(line).alias("_line")).filter(
        ~F.coalesce((F.col("feed") == "qualifier") & (F.col("_line") == header), F.lit(False))
    )
    quoted = F.col("_line").rlike(WELL_QUOTED)
    raw = F.when(quoted, F.regexp_extract_all(F.concat(F.lit("\t"), F.col("_line")), F.lit(EACH_FIELD), 1))
    rows = rows.withColumn("_raw", raw)
    width = F.try_element_at(widths, F.coalesce(F.col("feed"), F.lit("")))
    reason = F.when(~quoted, "quoting").when(F.coalesce(F.size("_raw") == width, F.lit(False)), None).otherwise("columns")
    return rows.select("line_id", "feed", F.transform("_raw", _unquoted).alias("cells"), reason.alias("reason"))


def cell_errors(lines: DataFrame) -> DataFrame:
    """(line_id, feed, col, name, value) of every cell of well-formed lines that breaks the rule of its field.

    The cells are exploded into row, column and value and joined with the rule table, which has seven rows.
    """
    cells = lines.filter("reason is null").select("line_id", "feed", F.posexplode("cells").alias("col", "value"))
    ruled = cells.join(F.broadcast(rule_table(lines.sparkSession)), ["feed", "col"])
    digits = F.regexp_replace(F.trim("value"), "^0+", "")
    number = F.when(F.length(digits) <= 18, digits.try_cast("long"))
    broken = ~F.expr("value rlike must") | F.expr("value rlike must_not") | (F.col("top").isNotNull() & ~F.coalesce(number.between(F.lit(1), F.col("top")), F.lit(False)))
    return ruled.filter(broken).select("line_id", "feed", "col", "name", "value")


def rejected(df: DataFrame) -> DataFrame:
    """(line_id, feed, reason, fields): the lines that fail, with the first reason that applies and the broken fields."""
    lines = parsed(df)
    shape = lines.filter("reason is not null").select("line_id", "feed", "reason", F.array().cast("array<string>").alias("fields"))
    value = cell_errors(lines).groupBy("line_id", "feed").agg(F.lit("value").alias("reason"), F.array_sort(F.collect_set("name")).alias("fields"))
    return shape.unionByName(value)


def loaded(df: DataFrame, feed: str) -> DataFrame:
    """The typed rows of a feed: (line_id, pmid int, ...), the lines that don't fail. Empty titles stay empty."""
    lines = parsed(df.filter(F.col("feed") == feed))
    good = lines.filter("reason is null").join(cell_errors(lines).select("line_id").distinct(), "line_id", "left_anti")
    types = {"id": lambda c: F.trim(c).cast("int"), "yn": F.trim, "text": lambda c: c, "any": lambda c: c}
    return good.select("line_id", *[types[rule](F.col("cells")[i]).alias(name) for i, (name, rule) in enumerate(FEEDS[feed])])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_id, reason) of the lines of feed_line that fail."""
    return rejected(table(spark, sf_dir, "feed_line")).select("line_id", "reason")


def p3_abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_id, pmid, title, abs) of the valid lines of the abstract feed."""
    return loaded(table(spark, sf_dir, "feed_line"), "abstract")


def p3_qualifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_id, pmid, descriptor_name, qualifier_name, qualifier_name_major_yn) of the valid lines of that feed."""
    return loaded(table(spark, sf_dir, "feed_line"), "qualifier")


_SQL_FIELD = r'(?:"(?:[^"]|"")*"|(?:[^"\t][^\t]*)?)'
_SQL_PARSED = rf"""
l as (select line_id, feed, line, regexp_full_match(line, '(?s){_SQL_FIELD}(?:\t{_SQL_FIELD})*') ok from feed_line
  where not coalesce(feed = 'qualifier' and line = concat_ws(chr(9), 'pmid', 'descriptor_name', 'qualifier_name', 'qualifier_name_major_yn'), false)),
c as (select *, [case when x[1] = '"' then replace(x[2:len(x)-1], '""', '"') else x end
  for x in regexp_extract_all(chr(9) || line, '(?s)\t({_SQL_FIELD})', 1)] cells from l),
w as (select *, case feed when 'abstract' then 3 when 'qualifier' then 4 end width, ltrim(trim(cells[1], ' '), '0') id from c),
v as (select *, case when not coalesce(ok, true) then 'quoting' when line is null or width is null or len(cells) <> width then 'columns'
  when not regexp_full_match(trim(cells[1], ' '), '[0-9]+') or len(id) not between 1 and 10 or try_cast(id as bigint) > 2147483647 then 'value'
  when feed = 'abstract' and (not regexp_matches(cells[3], '[^\s\pZ]') or regexp_matches(cells[3], '[\x{{FFFD}}\x00-\x08\x0a-\x1f\x7f-\x{{9f}}]')) then 'value'
  when feed = 'qualifier' and trim(cells[4], ' ') not in ('Y', 'N') then 'value' end reason from w)
"""

QUERIES = {"p3_found": p3_found, "p3_abstracts": p3_abstracts, "p3_qualifiers": p3_qualifiers}
SQL = {
    "p3_found": f"with {_SQL_PARSED} select line_id, reason from v where reason is not null",
    "p3_abstracts": f"with {_SQL_PARSED} select line_id, cast(trim(cells[1], ' ') as int) pmid, cells[2] title, cells[3] abs from v where reason is null and feed = 'abstract'",
    "p3_qualifiers": f"with {_SQL_PARSED} select line_id, cast(trim(cells[1], ' ') as int) pmid, cells[2] descriptor_name, cells[3] qualifier_name, trim(cells[4], ' ') qualifier_name_major_yn from v where reason is null and feed = 'qualifier'",
}
