"""Made gold records, region-level spans on page offsets, draw lists, stages and producers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafwork.operators import detectors, recognise
from sheafwork.plans.declare import Declared, values
from sheafwork.plans.layout_plans import _R
from sheafwork.plans.pii_plans import found_sql
from sheafwork.session import table
from sheafwork.sources import readers

_d = Declared()
QUERIES, ORACLES = _d.queries, _d.oracles

# gold records made by rule: seven kinds in the shares .30 .25 .20 .10 .05 .05 .05, two values each, offsets by construction
_V = "lpad(cast((k * 7919) % 100000000 as string), 8, '0')"
_S = "concat(lpad(cast((k * 31) % 100 as string), 2, '0'), '-', lpad(cast((k * 17) % 100 as string), 2, '0'), '-', lpad(cast((k * 13) % 100 as string), 2, '0'))"
_M = "concat('user', cast(k as string), '@mail.example.org')"
_P = "concat('07700 9', lpad(cast((k * 37) % 100000 as string), 5, '0'))"
_C = "concat('SW', cast(k % 9 + 1 as string), ' ', cast(k % 10 as string), 'AB')"
_KINDS = [
    (6, "uk_structured", "Post it to ", _C, "UK_POSTCODE", " or ring ", _P, "UK_PHONE_NUMBER"),
    (11, "banking", "Sort code ", _S, "UK_SORT_CODE", ", account ", _V, "UK_BANK_ACCOUNT_NUMBER"),
    (15, "names_addresses", "Write to ", _M, "EMAIL_ADDRESS", " at ", _C, "UK_POSTCODE"),
    (17, "customer_service", "The caller left ", _P, "UK_PHONE_NUMBER", " and ", _M, "EMAIL_ADDRESS"),
    (18, "noisy_ocr", "S0rt c0de: ", _S, "UK_SORT_CODE", " acc0unt: ", _V, "UK_BANK_ACCOUNT_NUMBER"),
    (19, "sensitive", "The customer is ", "'recently bereaved'", "VULNERABLE_CUSTOMER_INDICATOR", "; reply to ", _M, "EMAIL_ADDRESS"),
]
_case = lambda pick, other: "case " + " ".join(f"when k % 20 < {kind[0]} then {pick(kind)}" for kind in _KINDS) + f" else {other} end"
_q = lambda s: f"'{s}'"
_MADE = f"select k, {_case(lambda x: _q(x[1]), _q('negative'))} as category, {_case(lambda x: _q(x[2]), _q('Nothing to see here today.'))} as p1, {_case(lambda x: x[3], _q(''))} as v1, {_case(lambda x: _q(x[4]), 'cast(null as string)')} as t1, {_case(lambda x: _q(x[5]), _q(''))} as p2, {_case(lambda x: x[6], _q(''))} as v2, {_case(lambda x: _q(x[7]), 'cast(null as string)')} as t2 from (select cast(c_custkey as bigint) as k from {{customer}}) c"
_d.add("gold_synth", "customer", f"with m as ({_MADE}), e as (select k, category, concat(p1, v1, p2, v2) as text, t1 as entity_type, length(p1) as a, length(v1) as n from m where t1 is not null union all select k, category, concat(p1, v1, p2, v2), t2, length(p1) + length(v1) + length(p2), length(v2) from m where t2 is not null) select k, category, text, entity_type, cast(a as int) as start_pos, cast(a + n as int) as end_pos, substring(text, cast(a + 1 as int), cast(n as int)) as value from e")


# spans found in single regions, on the offsets of the page text (regions in reading order, one line each)
_BASE = f"select page_row_id, region_uid, trim(text) as text, coalesce(sum(length(trim(text)) + 1) over (partition by page_row_id order by coalesce(y, -1.0), coalesce(x, -1.0), region_uid rows between unbounded preceding and 1 preceding), 0) as base, x, y, w, h from {_R} r where length(trim(text)) > 0"


def legacy_page_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = spark.sql(_BASE, regions=table(spark, sf_dir, "regions"))
    found = detectors.legacy(base, "region_uid")
    return spark.sql("select b.page_row_id, s.entity_type, cast(b.base + s.start_pos as bigint) as start_pos, cast(b.base + s.end_pos as bigint) as end_pos, s.score, round(b.x + b.w * s.start_pos / length(b.text), 4) as x, round(greatest(2.0, b.w * (s.end_pos - s.start_pos) / length(b.text)), 4) as w from {s} s join {b} b on b.region_uid = s.region_uid", s=found, b=base)


_LEGACY = found_sql("b", "region_uid", recognise.LEGACY)
_d.put("legacy_page_spans", legacy_page_spans, f"with b as ({_BASE.replace('{regions}', 'regions')}), s as (select region_uid, entity_type, start_pos, end_pos, max(score) as score from ({_LEGACY}) group by all) select b.page_row_id, s.entity_type, (b.base + s.start_pos)::bigint as start_pos, (b.base + s.end_pos)::bigint as end_pos, s.score, round(b.x + b.w * s.start_pos / length(b.text), 4) as x, round(greatest(2.0, b.w * (s.end_pos - s.start_pos) / length(b.text)), 4) as w from s join b using (region_uid)")
# what a renderer would draw, as rows
_COLOURS = {"image": (140, 90, 60), "logo": (0, 180, 0), "handwriting_signature": (240, 140, 0), "seal": (160, 60, 200), "watermark": (220, 200, 0), "kv_pair": (60, 160, 160), "table": (9, 105, 218), "table_cell": (100, 150, 220), "table_header": (60, 90, 200)}
_HEX = "case kind " + " ".join(f"when '{k}' then '#{r:02x}{g:02x}{b:02x}'" for k, (r, g, b) in _COLOURS.items()) + " else '#808080' end"
_d.add("draw_list", "regions", f"select page_row_id, region_uid, round(x, 2) as x, round(y, 2) as y, round(w, 2) as w, round(h, 2) as h, concat(kind, ' ', cast(cast(round(coalesce(confidence, 0) * 100) as int) as string), '%') as label, {_HEX} as colour from {_R} r where w > 0 and h > 0")
# stages that every producer passes after its own (fixed values), as edges
_TAIL = ("producer", "pii", "doc_format", "custom_table", "table_crop", "table_obfuscate", "render")
_d.add("stage_edges", "page_results", "select s.solution, e.a as from_stage, e.b as to_stage, e.i as place from (select distinct solution from {page_results} where solution is not null) s cross join (values " + ", ".join(f"('{a}', '{b}', {i})" for i, (a, b) in enumerate(zip(_TAIL, _TAIL[1:]))) + ") as e(a, b, i)")


def producer_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every producer on every page: ready, or skipped for want of its library; counted."""
    pages = table(spark, sf_dir, "page_results").where("page_row_id is not null").select("page_row_id").distinct()
    return readers.producer_rows(pages).groupBy("producer", "status", "reason").agg(F.count(F.lit(1)).alias("n_pages"))


def detector_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detectors by name on the gold items; those without their library answer with the recognisers alone."""
    items = table(spark, sf_dir, "gold_items").select("item_id", "text")
    out = None
    for name in ("presidio_regex", "presidio_legacy", "presidio_spacy", "gliner", "piiranha", "hybrid"):
        one = detectors.detect(name, items, "item_id").groupBy("status", "entity_type").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("detector"), "status", "entity_type", "n")
        out = one if out is None else out.unionByName(one)
    return out


_d.put("producer_status", producer_status)
_d.put("detector_fallback", detector_fallback)
_d.add("slots", "nation", "select cast(n_nationkey as bigint) as free_gb, cast(greatest(1, least(16, cast(floor(n_nationkey / 3.0) as int))) as bigint) as at_once from {nation}")
_d.add("error_tail", "runs", "select snapshot_id, left(concat('run ', coalesce(run_id, '?'), ' ended as ', coalesce(status, '?')), 300) as tail, case when status = 'error' then 'failed' when status = 'partial' then 'recovered' else '' end as hint from {runs}")
_d.add("text_types", "regions", f"select kind in {values(('normal_text', 'kv_pair', 'table_cell', 'table_row', 'table_header', 'unknown'))} as holds_text, {{count}} as n, cast(sum(length(coalesce(text, ''))) as bigint) as n_chars from {_R} r group by 1")
