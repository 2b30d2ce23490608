"""Exact values from a dictionary of marked values, found in texts as whole words, whatever their case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafwork.operators import recognise

#: Score of a value that people marked (fixed value).
SCORE = 0.85
_WORD = r"(?U)[\w&&[^\p{M}]]+"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, r"\p{M}", "\u0001")), F.lit(_WORD), F.lit(0))


def literal(value: Column) -> Column:
    """A pattern for ``value`` itself, whatever characters it has."""
    return F.regexp_replace(value, r"([^\p{L}\p{N}\s])", r"\\$1")


def marked(text: Column, pattern: Column) -> Column:
    """The text with every match of a pattern, which is a column, between the marks that ``recognise.positions`` reads."""
    return F.regexp_replace(F.regexp_replace(text, r"[\u0001-\u0003]", "\u0001"), pattern, F.lit("\u0002$0\u0003"))


def spans(texts: DataFrame, key: str, entries: DataFrame, text: str = "text") -> DataFrame:
    """(key, entity_type, start_pos, end_pos, value, score) of the ``entries`` (entity_type, value) in the texts.

    Entries and texts meet by the first word of an entry, so neither is sent anywhere whole: only texts that have the
    word are searched. Blank entries, null ones and repeated ones count once or not at all; an entry without any letter
    or digit is looked for in every text. Null and empty texts have no spans.
    """
    known = entries.select("entity_type", F.trim("value").alias("_v")).where((F.length("_v") > 0) & (F.trim("entity_type") != "")).distinct()
    known = known.withColumn("_w", F.coalesce(F.try_element_at(_words(F.col("_v")), F.lit(1)), F.lit("")))
    base = texts.where(F.length(text) > 0).select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    words = base.select("_k", F.explode(F.array_union(F.array(F.lit("")), F.array_distinct(_words(F.col("_t"))))).alias("_w"))
    meet = words.join(known, "_w").groupBy("_k").agg(F.collect_set(F.struct("entity_type", "_v")).alias("_e"))
    hit = base.join(meet, "_k").select("_k", "_t", F.explode("_e").alias("_e"))
    hit = hit.select("*", marked(F.col("_t"), F.concat(F.lit(r"(?Ui)\b"), literal(F.col("_e")["_v"]), F.lit(r"\b"))).alias("_r"))
    at = hit.select("_k", "_t", "_e", F.explode(F.expr(recognise.positions("_r"))).alias("p"))
    return at.select(F.col("_k").alias(key), F.col("_e")["entity_type"].alias("entity_type"), F.col("p.a").alias("start_pos"), (F.col("p.a") + F.col("p.n")).alias("end_pos"), F.substring("_t", F.col("p.a") + 1, F.col("p.n")).alias("value"), F.lit(SCORE).alias("score"))


def spans_sql(table: str, key: str, entries: str, text: str = "text") -> str:
    """The same in SQL, entries against every text that holds them."""
    return f"""with d as ({entries}), k as (select * from d where length(value) > 0 and length(entity_type) > 0),
j as (select {key}, entity_type, value as wanted, {text}, {recognise.masked_sql(text)} as m, '(?i)\\b' || regexp_replace({recognise.masked_sql('value')}, '([^A-Za-z0-9_\\s])', '\\\\\\1', 'g') || '\\b' as pattern from {table}, k where contains(lower({text}), lower(value))),
f as (select *, regexp_extract_all(m, pattern) as found, string_split_regex(m, pattern) as gaps from j),
e as (select {key}, entity_type, wanted, {text}, unnest(found) as hit, unnest(range(len(found))) as i, found, gaps from f),
p as (select {key}, entity_type, wanted, {text}, length(hit)::integer as n, (list_sum(list_transform(gaps[1:i+1], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i], lambda x: length(x))), 0))::integer as a from e)
select {key}, entity_type, a as start_pos, a + n as end_pos, substring({text}, a + 1, n) as value, {SCORE}::double as score from p where lower(substring({text}, a + 1, n)) = lower(wanted)"""
