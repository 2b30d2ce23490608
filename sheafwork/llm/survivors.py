"""One surviving record per group of duplicates: skyline selection with fills from dominance layers.

A record is dominated when another one is at least as good in completeness, trust and recency and better in one.
Layer 1 holds the undominated records, layer 2 those that only layer 1 dominates, and so on. The survivor is the
first record of layer 1 by the lexicographic policy completeness, trust, recency, earliest seen; its null fields
come from the first record that has them, by layer and then by policy.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sheafwork.session import cut


@dataclass(frozen=True)
class Policy:
    """``complete`` (a small whole number), ``trust`` and ``recency`` (larger is better; null is worst), and the order
    among equals: smaller ``first`` and then smaller ``record_id``."""

    complete: Column
    trust: Column
    recency: Column
    first: Column
    record_id: str


#: Groups up to this size are solved inside one row; larger ones by window sweeps that never hold a group in memory.
IN_ROW = 128
#: Values of completeness in groups above that size; more are refused.
MAX_LEVELS = 64


def _rank() -> Column:
    """The policy as one comparable value; larger is better."""
    return F.struct("_c", "_t", "_r", (-F.col("_f")).alias("_nf"), (-F.col("_id")).alias("_nid"))


def scored(records: DataFrame, keys: list[str], policy: Policy, fields: list[str]) -> DataFrame:
    """One row per distinct record: ``_k`` (the group), criteria, and the fields. Repeated deliveries count once."""
    recency = F.coalesce(policy.recency.cast("timestamp").cast("double") * 1_000_000, F.lit(-9e18)).cast("long")
    first = F.coalesce(policy.first.cast("timestamp").cast("double") * 1_000_000, F.lit(9e18)).cast("long")
    return records.select(
        F.struct(*keys).alias("_k"),
        F.coalesce(policy.complete.cast("int"), F.lit(0)).alias("_c"),
        F.coalesce(policy.trust.cast("double"), F.lit(0.0)).alias("_t"),
        recency.alias("_r"),
        first.alias("_f"),
        F.col(policy.record_id).cast("long").alias("_id"),
        F.struct(*fields).alias("_v"),
    )


def _layers_in_row(items: Column) -> Column:
    """Adds ``layer`` to records that are sorted by policy, best first: one more than the deepest dominating layer.

    Every dominating record comes earlier in this order, so one pass settles all layers.
    """

    def step(done: Column, x: Column) -> Column:
        above = F.filter(done, lambda y: (y["_c"] >= x["_c"]) & (y["_t"] >= x["_t"]) & (y["_r"] >= x["_r"]) & ((y["_c"] > x["_c"]) | (y["_t"] > x["_t"]) | (y["_r"] > x["_r"])))
        layer = F.coalesce(F.array_max(F.transform(above, lambda y: y["layer"])), F.lit(0)) + 1
        return F.concat(done, F.array(x.withField("layer", layer)))

    empty = F.filter(F.transform(items, lambda x: x.withField("layer", F.lit(0))), lambda _: F.lit(False))
    return F.aggregate(items, empty, step)


def _solve_small(rows: DataFrame, fields: list[str]) -> DataFrame:
    best_first = F.sort_array(F.array_distinct(F.collect_list(F.struct(F.col("_c"), F.col("_t"), F.col("_r"), (-F.col("_f")).alias("_nf"), (-F.col("_id")).alias("_nid"), "_v"))), asc=False)
    # Equal ids are one record, whatever the rest of a repeated delivery says: the better one stays.
    one_each = F.filter(F.col("_a"), lambda x, i: ~F.exists(F.slice(F.col("_a"), 1, i), lambda y: y["_nid"] == x["_nid"]))
    grouped = rows.groupBy("_k").agg(best_first.alias("_a")).select("_k", one_each.alias("_a")).select("_k", _layers_in_row(F.col("_a")).alias("_a"))
    by_layer = F.sort_array(F.transform("_a", lambda x: F.struct((-x["layer"]).alias("nl"), x["_c"], x["_t"], x["_r"], x["_nf"], x["_nid"], x["_v"])), asc=False)
    picked = grouped.select("_k", F.size("_a").alias("n_records"), F.size(F.filter("_a", lambda x: x["layer"] == 1)).alias("n_skyline"), F.try_element_at("_a", F.lit(1)).alias("_s"), by_layer.alias("_b"))

    def first_value(f: str) -> Column:
        return F.try_element_at(F.filter(F.transform("_b", lambda x: x["_v"][f]), lambda v: v.isNotNull()), F.lit(1)).alias(f)

    fill = [first_value(f) for f in fields]
    return picked.select("_k", (-F.col("_s")["_nid"]).alias("survivor_id"), "n_records", "n_skyline", F.filter(F.array(*(F.when(F.col("_s")["_v"][f].isNull() & fill[i].isNotNull(), F.lit(f)) for i, f in enumerate(fields))), lambda x: x.isNotNull()).alias("filled"), *fill)


def skyline(rows: DataFrame) -> DataFrame:
    """``rows`` with ``on_skyline``, for groups of any size: sweeps over (group, trust) instead of pairs.

    A record is dominated when the newest record that is at least as complete and trusted, and better in one of both,
    is at least as new, or when an equal one in both is newer. The newest are prefix maxima over trust, taken first
    over trust ranges (at most 1,001 a group) and then inside a range, so no task has to read a whole group.
    """
    levels = [r[0] for r in rows.select("_c").distinct().orderBy("_c").limit(MAX_LEVELS + 1).collect()]
    if len(levels) > MAX_LEVELS:
        raise ValueError(f"completeness has more than {MAX_LEVELS} values; make it coarser")
    bin_of = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_t"))) * 1000)
    points = rows.groupBy("_k", bin_of.alias("_b"), "_t", "_c").agg(F.max("_r").alias("_m"))
    coarse = W.partitionBy("_k").orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)
    newest = lambda x, level: F.max(F.when(F.col("_c") >= level, F.col(x)))
    bins = points.groupBy("_k", "_b").agg(*(newest("_m", c).alias(f"_m{c}") for c in levels))
    bins = bins.select("_k", "_b", *(F.max(f"_m{c}").over(coarse).alias(f"_p{c}") for c in levels))
    at = points.groupBy("_k", "_b", "_t").agg(*(newest("_m", c).alias(f"_m{c}") for c in levels))
    strict = W.partitionBy("_k", "_b").orderBy(F.desc("_t")).rowsBetween(W.unboundedPreceding, -1)
    at = at.select("_k", "_b", "_t", *(f"_m{c}" for c in levels), *(F.max(f"_m{c}").over(strict).alias(f"_q{c}") for c in levels)).join(bins, ["_k", "_b"])
    pick = lambda make: F.coalesce(*(F.when(F.col("_c") == c, make(i, c)) for i, c in enumerate(levels)), F.lit(None))
    trusted = pick(lambda i, c: F.greatest(F.coalesce(F.col(f"_p{c}"), F.lit(-(2**63))), F.coalesce(F.col(f"_q{c}"), F.lit(-(2**63)))))
    fuller = pick(lambda i, c: F.col(f"_m{levels[i + 1]}") if i + 1 < len(levels) else F.lit(None).cast("long"))
    marked = rows.withColumn("_b", bin_of).join(points.withColumnRenamed("_m", "_same"), ["_k", "_b", "_t", "_c"]).join(at, ["_k", "_b", "_t"])
    over = F.greatest(F.coalesce(trusted, F.lit(-(2**63))), F.coalesce(fuller, F.lit(-(2**63))))
    return marked.select(*rows.columns, (~((over >= F.col("_r")) & (over > -(2**63)) | (F.col("_same") > F.col("_r")))).alias("on_skyline"))


def _solve_large(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Peels layer after layer with ``skyline``, as long as a group has records left that could fill a field it lacks.

    A field that no record of the group has is lacked by none, and a group whose open fields none of the remaining
    records has is done, so a field that is null everywhere peels nothing. A group is peeled down to the layer of the
    last value that it needs, each layer a round over the groups still open.
    """
    left = cut(rows.groupBy("_k", "_id").agg(F.max_by(F.struct("_c", "_t", "_r", "_f", "_v"), _rank()).alias("_x")).select("_k", "_id", "_x.*"))
    # what a group can have at all
    can = cut(left.groupBy("_k").agg(F.count(F.lit(1)).alias("n_records"), *(F.max(F.col("_v")[f].isNotNull()).alias(f"_can_{f}") for f in fields)))
    held: DataFrame | None = None
    while True:
        layer = skyline(left)
        rank = _rank()
        top = layer.where("on_skyline").groupBy("_k").agg(F.max_by("_id", rank).alias("survivor_id"), F.count(F.lit(1)).alias("n_skyline"), *(F.max_by(F.col("_v")[f], F.when(F.col("_v")[f].isNotNull(), rank)).alias(f) for f in fields), F.max_by("_v", rank).alias("_own"))
        if held is None:
            held = cut(top.join(can, "_k"))
        else:
            more = top.select("_k", *(F.col(f).alias(f"_n_{f}") for f in fields))
            held = cut(held.join(more, "_k", "left").select("_k", "survivor_id", "n_skyline", "n_records", "_own", *(f"_can_{f}" for f in fields), *(F.coalesce(F.col(f), F.col(f"_n_{f}")).alias(f) for f in fields)))
        lacks = held.select("_k", *((F.col(f).isNull() & F.col(f"_can_{f}")).alias(f"_lack_{f}") for f in fields)).where(" or ".join(f"`_lack_{f}`" for f in fields))
        useful = None
        for f in fields:
            fills = F.col(f"_lack_{f}") & F.col("_v")[f].isNotNull()
            useful = fills if useful is None else useful | fills
        rest = layer.where("not on_skyline").drop("on_skyline").join(lacks, "_k")
        open_groups = cut(rest.where(useful).select("_k").distinct())
        left = cut(rest.join(open_groups, "_k", "left_semi").select(*left.columns))
        if not left.take(1):
            break
    return held.select("_k", "survivor_id", F.col("n_records").cast("int"), F.col("n_skyline").cast("int"), F.filter(F.array(*(F.when(F.col("_own")[f].isNull() & F.col(f).isNotNull(), F.lit(f)) for f in fields)), lambda x: x.isNotNull()).alias("filled"), *fields)


def survivors(records: DataFrame, keys: list[str], policy: Policy, fields: list[str], in_row: int = IN_ROW) -> DataFrame:
    """One row per group: ``keys``, ``survivor_id``, ``n_records`` (distinct ids), ``n_skyline``, ``filled`` (the fields
    that were taken from other records) and ``fields``.

    Nulls: a null key value is a group of its own; null criteria are worst (trust counts as 0); a field that is null in
    every record stays null. Equal records tie on the earliest ``first`` and then the smallest id. An empty input has no
    groups. Groups above ``in_row`` rows are peeled by sweeps, so a group may hold any share of the rows.
    """
    rows = scored(records, keys, policy, fields)
    sizes = rows.groupBy("_k").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > in_row).select("_k")
    hot = cut(sizes)
    if not hot.take(1):
        out = _solve_small(rows, fields)
    else:
        # struct keys with null parts compare as equal only through the null-safe operator
        rows, hot = rows.withColumn("_h", F.xxhash64("_k")), hot.withColumn("_h", F.xxhash64("_k")).withColumnRenamed("_k", "_hk")
        same = (F.col("_h") == F.col("_hh")) & F.col("_k").eqNullSafe(F.col("_hk"))
        hot = hot.withColumnRenamed("_h", "_hh")
        small = rows.join(hot, same, "left_anti").drop("_h")
        large = rows.join(hot, same, "left_semi").drop("_h")
        out = _solve_small(small, fields).unionByName(_solve_large(large, fields))
    return out.select(*(F.col("_k")[k].alias(k) for k in keys), "survivor_id", "n_records", "n_skyline", "filled", *fields)


#: Ways in which one document id is written: case, blanks, an upload prefix, a file suffix.
def document_key(column: str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(column)), r"^uploads/", ""), r"\.pdf$", "")


PAGE_FIELDS = ["width", "height", "dpi", "pdf_kind", "doc_format", "confidence", "regions", "n_tables", "full_text"]


def page_survivors(pages: DataFrame, runs: DataFrame) -> DataFrame:
    """Page results of one document, solution and page from several runs, reduced to one record each.

    Completeness is having regions or tables, trust the confidence (percentages are brought to 0..1, null is 0),
    recency the latest ``updated_at`` of the run over all its saved states.
    """
    latest = runs.where(F.col("run_id").isNotNull()).groupBy("run_id").agg(F.max("updated_at").alias("_updated"), F.min("started_at").alias("_started"))
    confidence = F.when(F.col("confidence") > 1, F.col("confidence") / 100).otherwise(F.col("confidence"))
    named = pages.select("page_row_id", "run_id", "solution", "page_index", document_key("document_id").alias("document_key"), *(f for f in PAGE_FIELDS if f != "confidence"), confidence.alias("confidence"))
    joined = named.join(latest, "run_id", "left")
    has_data = ((F.coalesce(F.size("regions"), F.lit(0)) > 0) | (F.coalesce("n_tables", F.lit(0)) > 0)).cast("int")
    policy = Policy(has_data, F.col("confidence"), F.col("_updated"), F.col("_started"), "page_row_id")
    return survivors(joined, ["document_key", "solution", "page_index"], policy, PAGE_FIELDS)
