"""Masks, redaction, scoring and search over found and detected values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafwork.operators import evaluate, masking, recognise, search, span_algebra
from sheafwork.plans import spans_plans
from sheafwork.plans.declare import Declared
from sheafwork.session import table

_d = Declared()
QUERIES, ORACLES = _d.queries, _d.oracles
RUN = "run-1"


# found and merged spans of all documents, and the same as SQL
def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_algebra.merged(recognise.spans(spans_plans.documents(spark, sf_dir), "doc_id"), "doc_id")


def found_sql(texts: str, key: str, recognisers: tuple[recognise.Recogniser, ...] = recognise.RECOGNISERS) -> str:
    return " union all ".join(f"select {key}, {i} as place, start_pos, end_pos, '{r.entity_type}' as entity_type, score from ({recognise.spans_sql(texts, key, r)})" for i, r in enumerate(recognisers))


_MERGED = span_algebra.merged_sql(found_sql("documents", "doc_id"), "doc_id")
_APART = f"select doc_id, unnest(list_reduce(list([{{'s': start_pos, 'e': end_pos, 't': entity_type, 'c': score}}] order by start_pos, score desc, end_pos), lambda acc, x: case when x[1].s >= acc[len(acc)].e then list_concat(acc, x) else acc end)) as u from ({_MERGED}) group by 1"
_CUT = f"select doc_id, u.s as start_pos, u.e as end_pos, u.t as entity_type, substring(text, u.s + 1, u.e - u.s) as value from ({_APART}) join documents using (doc_id)"


def _applied_sql(new: str) -> str:
    prev = "(case when i = 1 then 0 else k[i - 1].e end)"
    return f"""with rows as (select *, {new} as new from ({_CUT})), l as (select doc_id, list({{'s': start_pos, 'e': end_pos, 'm': new}} order by start_pos) as k from rows group by 1),
j as (select doc_id, text, coalesce(k, []) as k from documents left join l using (doc_id))
select doc_id, array_to_string(list_transform(range(1, len(k) + 1), lambda i: concat(substring(text, {prev} + 1, k[i].s - {prev}), k[i].m)), '') || substring(text, coalesce(k[len(k)].e, 0) + 1) as new_text, len(k)::integer as n from j"""


def merge_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)


def _documents_with(new: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = spans_plans.documents(spark, sf_dir)
        rows = masking.replaced(docs, _merged(spark, sf_dir), "doc_id", new)
        return masking.applied(docs, rows, "doc_id").select("doc_id", "new_text", "n")

    return query


def mask_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each masked value stood and where its mask stands."""
    docs = spans_plans.documents(spark, sf_dir)
    rows = masking.replaced(docs, _merged(spark, sf_dir), "doc_id", masking.default_sql())
    return masking.applied(docs, rows, "doc_id").select("doc_id", F.inline("spans"))


def redact_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every replaced value with its stand-in."""
    return masking.replaced(spans_plans.documents(spark, sf_dir), _merged(spark, sf_dir), "doc_id", masking.mock_sql(RUN)).withColumnsRenamed({"value": "original", "new": "mock"})


def redact_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per type: values replaced, distinct stand-ins, and stand-ins that stand for several originals."""
    each = redact_spans(spark, sf_dir).groupBy("entity_type", "mock").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("original").alias("o"))
    return each.groupBy("entity_type").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_mocks"), F.count(F.when(F.col("o") > 1, 1)).alias("n_collisions"))


def redact_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of every text after redaction and restoring: offsets of same-length stand-ins stay where they were."""
    docs = spans_plans.documents(spark, sf_dir)
    rows = masking.replaced(docs, _merged(spark, sf_dir), "doc_id", masking.mock_sql(RUN))
    back = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", F.col("value").alias("new")))).alias("b"))
    new = masking.applied(docs, rows, "doc_id").join(back, "doc_id", "left")
    restored = F.when(F.col("b").isNull(), F.col("new_text")).otherwise(masking.spliced(F.col("new_text"), F.col("b")))
    return new.select("doc_id", F.md5(restored).alias("digest"), F.length("new_text").cast("long").alias("n_chars"))


_d.put("redact_restored", redact_restored, "select doc_id, md5(text) as digest, length(text)::bigint as n_chars from documents")
_d.put("merge_spans", merge_spans, _MERGED)
_d.put("redact_documents", _documents_with(masking.mask_sql("replace")), _applied_sql(masking.mask_sql("replace", 1)))
_d.put("mask_documents", _documents_with(masking.default_sql()), _applied_sql(masking.default_sql(1)))
_d.put("mask_documents_hash", _documents_with(masking.default_sql(0, {"PERSON": "hash"}, "hash")), _applied_sql(masking.default_sql(1, {"PERSON": "hash"}, "hash")))
_d.put("redact_text", _documents_with(masking.mock_sql(RUN)), _applied_sql(masking.mock_sql(RUN, 1)))
_d.put("mask_mapping", mask_mapping, f"with rows as (select *, {masking.default_sql(1)} as new from ({_CUT})) select doc_id, start_pos, end_pos, (start_pos + coalesce(sum(length(new) - (end_pos - start_pos)) over w, 0))::integer as new_start, (start_pos + coalesce(sum(length(new) - (end_pos - start_pos)) over w, 0) + length(new))::integer as new_end from rows window w as (partition by doc_id order by start_pos rows between unbounded preceding and 1 preceding)")
_d.put("redact_spans", redact_spans, f"select doc_id, start_pos, end_pos, entity_type, value as original, {masking.mock_sql(RUN, 1)} as mock from ({_CUT})")
_d.put("redact_index", redact_index, f"with m as (select entity_type, value, {masking.mock_sql(RUN, 1)} as mock from ({_CUT})), e as (select entity_type, mock, count(*) as n, count(distinct value) as o from m group by 1, 2) select entity_type, sum(n)::bigint as n, count(*)::bigint as n_mocks, count(case when o > 1 then 1 end)::bigint as n_collisions from e group by 1")
# the reduction of a redacted page's lines: which lines hold a replaced value, and what of it
_d.put(
    "line_diff",
    lambda spark, sf_dir: spark.sql(
        """with l as (select doc_id, no, line, cast(coalesce(sum(length(line) + 1) over (partition by doc_id order by no rows between unbounded preceding and 1 preceding), 0) as int) as a from (select doc_id, posexplode(split(text, '\\n')) as (no, line) from {docs} where length(text) > 0))
select l.doc_id, l.no as line_no, cast(greatest(s.start_pos, a) - a as int) as from_pos, cast(least(s.end_pos, a + length(line)) - a as int) as to_pos, s.entity_type from l join {spans} s on s.doc_id = l.doc_id and s.start_pos < a + length(line) and s.end_pos > a""",
        docs=spans_plans.documents(spark, sf_dir), spans=_merged(spark, sf_dir),
    ),
    f"""with l as (select doc_id, line, no - 1 as no, coalesce(sum(length(line) + 1) over (partition by doc_id order by no rows between unbounded preceding and 1 preceding), 0) as a from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as no from documents where length(text) > 0))
select l.doc_id, no::integer as line_no, (greatest(s.start_pos, a) - a)::integer as from_pos, (least(s.end_pos, a + length(line)) - a)::integer as to_pos, s.entity_type from l join ({_MERGED}) s on s.doc_id = l.doc_id where s.start_pos < a + length(line) and s.end_pos > a""",
)
_TOKEN = "concat('TOKEN_', entity_type, '_', lpad(cast(row_number() over (partition by entity_type order by {key}) as string), 6, '0'))"
_d.add("mask_tokenise", "detections", f"select detection_id, {_TOKEN.replace('{key}', 'detection_id')} as token from (select detection_id, {{label}} as entity_type from {{detections}} where entity_text is not null and entity_type is not null) d")
_d.add("mask_values", "detections", "select detection_id, " + ", ".join(f"{{{m}}} as m_{m}" for m in masking.MASKS) + " from (select detection_id, {label} as entity_type, entity_text as value from {detections} where entity_text is not null and entity_type is not null) d", **{m: (masking.mask_sql(m), masking.mask_sql(m, 1)) for m in masking.MASKS})
_d.add("mock_values", "detections", "select entity_type, value as entity_text, {mock} as mock from (select distinct {label} as entity_type, entity_text as value from {detections} where entity_text is not null and entity_type is not null) d", mock=(masking.mock_sql(RUN), masking.mock_sql(RUN, 1)))

# scoring of four sets of recognisers against the marked items
SETS = {"all": recognise.RECOGNISERS, "global": tuple(r for r in recognise.RECOGNISERS if r.jurisdiction == "GLOBAL_COMMON"), "legacy": recognise.LEGACY, "uk": tuple(r for r in recognise.RECOGNISERS if r.jurisdiction == "UK")}


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "gold_items").select("item_id", F.posexplode("entities").alias("place", "e")).select("item_id", "place", "e.entity_type", "e.start_pos", "e.end_pos")


def _predicted(spark: SparkSession, sf_dir: str, name: str = "all") -> DataFrame:
    """Merged spans of one set; ``place`` is their order in the text."""
    items = table(spark, sf_dir, "gold_items").select("item_id", "text")
    return span_algebra.merged(recognise.spans(items, "item_id", recognisers=SETS[name]), "item_id").select("*", (F.col("start_pos") * 100000 + F.col("end_pos")).alias("place"))


def _scores(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """(detector, mode, entity_type, tp, fp, fn) in both modes, and the whole as type ``*``."""
    pred, gold = _predicted(spark, sf_dir, name), _gold(spark, sf_dir)
    exact = span_algebra.exact_score(pred, gold, "item_id").select(F.lit("exact").alias("mode"), "entity_type", "tp", "fp", "fn")
    side = lambda s: F.count(F.when(F.col("side") == s, 1)).alias(s)
    part = evaluate.partial(pred, gold, "item_id").groupBy("entity_type").agg(side("tp"), side("fp"), side("fn")).select(F.lit("partial").alias("mode"), "entity_type", "tp", "fp", "fn")
    return exact.unionByName(part).rollup("mode", "entity_type").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))).where("mode is not null").select(F.lit(name).alias("detector"), "mode", F.coalesce("entity_type", F.lit("*")).alias("entity_type"), "tp", "fp", "fn")


def eval_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scores(spark, sf_dir, "all")
    return s.select("mode", "entity_type", "tp", "fp", "fn", *evaluate.rates(F.col("tp"), F.col("fp"), F.col("fn")))


def eval_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """False positives and false negatives of the partial pass."""
    return evaluate.partial(_predicted(spark, sf_dir), _gold(spark, sf_dir), "item_id").where("side <> 'tp'")


def _overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = None
    for name in SETS:
        one = _scores(spark, sf_dir, name).where("entity_type = '*' and mode = 'exact'")
        rows = one if rows is None else rows.unionByName(one)
    return rows.select("detector", "tp", "fp", "fn", *evaluate.rates(F.col("tp"), F.col("fp"), F.col("fn")))


def detector_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of each set by f1, recall and precision; equals keep the order of the sets."""
    return spark.sql("select *, " + ", ".join(f"row_number() over (order by {m} desc, detector) as by_{m}" for m in ("f1", "recall", "precision")) + " from {o}", o=_overall(spark, sf_dir))


_GOLD = "select item_id, place - 1 as place, e.entity_type as t, e.start_pos as s, e.end_pos as e from (select item_id, unnest(entities) as e, generate_subscripts(entities, 1) as place from gold_items)"


def _scores_sql(name: str) -> str:
    pred = span_algebra.merged_sql(found_sql("gold_items", "item_id", SETS[name]), "item_id")
    return f"""select '{name}' as detector, mode, coalesce(entity_type, '*') as entity_type, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn from (
 with pred as (select item_id, start_pos as s, end_pos as e, entity_type as t from ({pred})), gold as ({_GOLD}),
 ep as (select item_id, s, e, t, count(*) as n from pred group by all), eg as (select item_id, s, e, t, count(*) as n from gold group by all),
 ex as (select coalesce(ep.t, eg.t) as entity_type, least(coalesce(ep.n, 0), coalesce(eg.n, 0)) as tp, coalesce(ep.n, 0) - least(coalesce(ep.n, 0), coalesce(eg.n, 0)) as fp, coalesce(eg.n, 0) - least(coalesce(ep.n, 0), coalesce(eg.n, 0)) as fn from ep full join eg on ep.item_id = eg.item_id and ep.s = eg.s and ep.e = eg.e and ep.t = eg.t),
 gl as (select item_id, list({{'s': s, 'e': e, 't': t}} order by place) as g from gold group by 1), pl as (select item_id, list({{'s': s, 'e': e, 't': t}} order by s, e) as p from pred group by 1),
 b as (select item_id, coalesce(p, []) as p, coalesce(g, []) as g from pl full join gl using (item_id)),
 c as (select item_id, p, g, list_transform(p, lambda x: list_filter(range(1, len(g) + 1), lambda i: g[i].t = x.t and g[i].s < x.e and x.s < g[i].e)) as can from b),
 h as (select item_id, p, g, list_reduce(list_prepend([]::bigint[], can), lambda acc, x: list_append(acc, coalesce(list_filter(x, lambda i: not list_contains(acc, i))[1], 0))) as hit from c),
 pa as (select u.x.t as entity_type, (u.h > 0)::int as tp, (u.h = 0)::int as fp, 0 as fn from (select unnest(list_transform(range(1, len(p) + 1), lambda i: {{'x': p[i], 'h': hit[i]}})) as u from h)
  union all select u.t, 0, 0, 1 from (select unnest(list_transform(list_filter(range(1, len(g) + 1), lambda i: not list_contains(hit, i)), lambda i: g[i])) as u from h))
 select 'exact' as mode, * from ex union all select 'partial', * from pa) group by grouping sets ((mode, entity_type), (mode))"""


def _rates_sql(scores: str, columns: str) -> str:
    return f"select {columns}, tp, fp, fn, round(p, 4) as precision, round(r, 4) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 4) as f1 from (select *, case when tp + fp > 0 then tp / (tp + fp)::double else 0 end as p, case when tp + fn > 0 then tp / (tp + fn)::double else 0 end as r from ({scores}))"


_OVERALL = _rates_sql("select * from (" + " union all ".join(f"({_scores_sql(n)})" for n in SETS) + ") where entity_type = '*' and mode = 'exact'", "detector")
_d.put("eval_gold", eval_gold, _rates_sql(_scores_sql("all"), "mode, entity_type"))
_d.put("eval_errors", eval_errors)
_d.put("detector_ranking", detector_ranking, f"select *, row_number() over (order by f1 desc, detector)::integer as by_f1, row_number() over (order by recall desc, detector)::integer as by_recall, row_number() over (order by precision desc, detector)::integer as by_precision from ({_OVERALL})")
_d.put("eval_report", lambda spark, sf_dir: spark.sql("select detector, concat_ws(' | ', detector, format_number(precision, 3), format_number(recall, 3), format_number(f1, 3)) as line from {o}", o=_overall(spark, sf_dir)), f"select detector, concat_ws(' | ', detector, printf('%.3f', precision), printf('%.3f', recall), printf('%.3f', f1)) as line from ({_OVERALL})")
_d.put(
    "eval_pivot",
    lambda spark, sf_dir: _scores(spark, sf_dir, "all").unionByName(_scores(spark, sf_dir, "uk")).where("mode = 'exact'").groupBy("entity_type").pivot("detector", ["all", "uk"]).agg(F.sum("tp").alias("tp"), F.sum("fn").alias("fn")).select("entity_type", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("all_tp", "all_fn", "uk_tp", "uk_fn"))),
    "select entity_type, " + ", ".join(f"coalesce(sum({c}) filter (where detector = '{n}'), 0)::bigint as {n}_{c}" for n in ("all", "uk") for c in ("tp", "fn")) + f" from (({_scores_sql('all')}) union all ({_scores_sql('uk')})) where mode = 'exact' group by 1",
)
