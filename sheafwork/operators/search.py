"""Known values of a document sought on all its pages: parts of names, missed repeats, and manual marks laid over.

Values and pages meet by document and by the first word of a value, so only pages that have the word are searched and
no page is compared with every value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sheafwork.operators import dictionary, recognise

#: Types whose parts are sought, their weights, and the least lengths.
PARENTS = ("PERSON", "UK_ADDRESS")
PART, REPEAT, KNOWN = 0.8, 0.7, 0.75
SHORTEST, SHORTEST_KNOWN = 3, 4


def occurrences(pages: DataFrame, wanted: DataFrame, by: str, ignore_case: bool, words: bool = True) -> DataFrame:
    """Every occurrence of ``wanted`` (``by``, value) in the pages (``by``, page, text) of the same ``by``.

    (by, page, value, start_pos, end_pos, found). ``words``: only between word boundaries; else anywhere, and then
    values and pages meet by ``by`` alone. Null and empty texts and values have none.
    """
    base = pages.where(F.length("text") > 0).select(by, "page", "text")
    known = wanted.select(by, "value").where(F.length("value") > 0).distinct()
    if words:
        known = known.withColumn("_w", F.coalesce(F.try_element_at(dictionary._words(F.col("value")), F.lit(1)), F.lit("")))
        each = base.select(by, "page", F.explode(F.array_union(F.array(F.lit("")), F.array_distinct(dictionary._words(F.col("text"))))).alias("_w"))
        pairs = each.join(known, [by, "_w"]).groupBy(by, "page").agg(F.collect_set("value").alias("_v"))
        hit = base.join(pairs, [by, "page"]).select(by, "page", "text", F.explode("_v").alias("value"))
    else:
        hit = base.join(known, by).where(F.contains("text", "value"))
    edge = F.lit(r"\b" if words else "")
    pattern = F.concat(F.lit("(?Ui)" if ignore_case else "(?U)"), edge, dictionary.literal(F.col("value")), edge)
    at = hit.select("*", dictionary.marked(F.col("text"), pattern).alias("_r")).select(by, "page", "text", "value", F.explode(F.expr(recognise.positions("_r"))).alias("p"))
    return at.select(by, "page", "value", F.col("p.a").alias("start_pos"), (F.col("p.a") + F.col("p.n")).alias("end_pos"), F.substring("text", F.col("p.a") + 1, F.col("p.n")).alias("found"))


def _new(hits: DataFrame, have: DataFrame) -> DataFrame:
    """``hits`` that overlap no entity of their type on their page; of one place the first by ``rank`` stays."""
    h, e = hits.alias("h"), have.alias("e")
    meets = (F.col("h.cell") == F.col("e.cell")) & (F.col("h.page") == F.col("e.page")) & (F.col("h.entity_type") == F.col("e.entity_type")) & (F.col("h.end_pos") > F.col("e.start_pos")) & (F.col("e.end_pos") > F.col("h.start_pos"))
    free = h.join(e, meets, "left_anti")
    first = W.partitionBy("cell", "page", "start_pos", "end_pos").orderBy("rank", "value")
    return free.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def parts(entities: DataFrame, pages: DataFrame) -> DataFrame:
    """Words of names and addresses of several words, wherever else they stand in the document; case matters.

    ``entities``: (cell, document, page, rank, entity_type, value, start_pos, end_pos, score), a cell being one
    detector's answers on one document; ``pages``: (document, page, text).
    """
    tokens = entities.where(F.col("entity_type").isin(*PARENTS)).select("cell", "document", "rank", "entity_type", "score", F.col("value").alias("parent"), F.posexplode(F.filter(F.split(F.trim("value"), r"\s+"), lambda t: t != "")).alias("at", "value"))
    several = F.size(F.filter(F.split(F.trim("parent"), r"\s+"), lambda t: t != "")) >= 2
    tokens = tokens.where(several & (F.length("value") >= SHORTEST) & (F.col("value") != F.col("parent")))
    hits = occurrences(pages, tokens, "document", False).join(tokens, ["document", "value"])
    out = _new(hits.withColumn("rank", F.col("rank") * 1000 + F.col("at")), entities)
    return out.select("cell", "document", "page", "entity_type", F.col("found").alias("value"), "start_pos", "end_pos", F.round(F.col("score") * PART, 6).alias("score"), "parent", F.lit("substring_of").alias("discovery"))


def repeats(entities: DataFrame, pages: DataFrame) -> DataFrame:
    """Every value found somewhere in the document, wherever a detector missed it; whatever its case."""
    first = W.partitionBy("cell", "value", "entity_type").orderBy("page", "rank")
    unique = entities.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("cell", "document", "rank", "entity_type", "score", F.trim("value").alias("value"), F.col("page").alias("_p")).where(F.length("value") >= SHORTEST)
    hits = occurrences(pages, unique, "document", True).join(unique, ["document", "value"])
    out = _new(hits.withColumn("rank", F.coalesce("_p", F.lit(0)) * 10**10 + F.col("rank")), entities)
    return out.select("cell", "document", "page", "entity_type", F.col("found").alias("value"), "start_pos", "end_pos", F.round(F.col("score") * REPEAT, 6).alias("score"), F.col("value").alias("parent"), F.lit("search_only").alias("discovery"))


def overlay(entities: DataFrame, marks: DataFrame) -> DataFrame:
    """Entities with manual marks (document, page, entity_type, value, mark_id) laid over, for every cell of a document.

    The first entity of a mark's page, type and text (case aside) becomes ``both``; a mark without one is added as
    ``manual_only`` with score 1 and no place. Blank marks are left out.
    """
    marks = marks.select("document", "page", "entity_type", F.trim("value").alias("_v"), "mark_id").where((F.length("_v") > 0) & (F.col("page") >= 0))
    cells = entities.select("cell", "document").distinct()
    wanted = cells.join(marks, "document").withColumn("_l", F.lower("_v"))
    place = W.partitionBy("cell", "page", "entity_type", "_l").orderBy("rank")
    e = entities.withColumn("_l", F.lower("value")).withColumn("_n", F.row_number().over(place))
    by = ["cell", "document", "page", "entity_type", "_l"]
    one = wanted.groupBy(*by).agg(F.max("mark_id").alias("mark_id"))
    kept = e.join(one.withColumn("_n", F.lit(1)), [*by, "_n"], "left").select("cell", "document", "page", "entity_type", "value", "start_pos", "end_pos", "score", "mark_id", F.when(F.col("mark_id").isNull(), "lib").otherwise("both").alias("discovery"))
    new = wanted.join(e.select(*by).distinct(), by, "left_anti").select("cell", "document", "page", "entity_type", F.col("_v").alias("value"), F.lit(-1).alias("start_pos"), F.lit(-1).alias("end_pos"), F.lit(1.0).alias("score"), "mark_id", F.lit("manual_only").alias("discovery"))
    return kept.unionByName(new)


def known_everywhere(values: DataFrame, regions: DataFrame, spans: DataFrame) -> DataFrame:
    """Every known value of at least four characters in every region of its document, but for spans already there.

    ``values``: (document, value, entity_type, rank); ``regions``: (document, page, text), ``page`` naming the region;
    ``spans``: (page, start_pos, end_pos). The first type of a value is its type; of one place the first value stays.
    """
    first = W.partitionBy("document", "value").orderBy("rank")
    known = values.where(F.length("value") >= SHORTEST_KNOWN).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    hits = occurrences(regions, known, "document", False, False).join(known, ["document", "value"])
    free = hits.join(spans.select("page", "start_pos", "end_pos"), ["page", "start_pos", "end_pos"], "left_anti")
    one = W.partitionBy("page", "start_pos", "end_pos").orderBy("rank", "value")
    return free.withColumn("_n", F.row_number().over(one)).where("_n = 1").select("document", "page", "entity_type", "start_pos", "end_pos", F.col("found").alias("value"), F.lit(KNOWN).alias("score"))
