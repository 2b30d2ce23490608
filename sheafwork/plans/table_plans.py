"""Queries over detections, pages, regions, runs, reviews and audit events.

Each is one declarative statement; where both engines agree on the dialect the same text serves as SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sheafwork.operators import recognise
from sheafwork.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, tables: str, text: str, duck: str | None = None, **alike: tuple[str, str]) -> None:
    """``{name}`` in the text stands for a piece that the engines write differently: (Spark, DuckDB)."""
    spark_text, duck_text = text, duck or text
    for k, (a, b) in alike.items():
        spark_text, duck_text = spark_text.replace("{" + k + "}", a), duck_text.replace("{" + k + "}", b)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(spark_text, **{t: table(spark, sf_dir, t) for t in tables.split()})

    for t in tables.split():
        duck_text = duck_text.replace("{" + t + "}", t)
    QUERIES[name], ORACLES[name] = query, duck_text


DOC = "regexp_replace(regexp_replace(lower(trim({c})), '^uploads/', ''), '[.]pdf$', '')"
doc = lambda c: DOC.replace("{c}", c)
LABEL = ("regexp_replace(regexp_replace(upper(trim(entity_type)), '[ \\\\-]+', '_'), '^[BI]_', '')", "regexp_replace(regexp_replace(upper(trim(entity_type)), '[ \\-]+', '_', 'g'), '^[BI]_', '')")
COUNT = ("count(*)", "count(*)::bigint")

# masking (one value per mode), categories and risk
_add("obfuscate", "regions", """select distinct region_uid, translate(text, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 'qwertyuiopasdfghjklzxcvbnmQWERTYUIOPASDFGHJKLZXCVBNM7394102856') as cipher from {regions} where text is not null""")
# spans: composite risk, occurrences, cells
_add(
    "cell_summary",
    "detections",
    """select {doc} as document_id, page_index, lower(trim(detector)) as detector, {count} as entity_count, count(distinct {label}) as n_types, count(case when {label} in ('EMAIL_ADDRESS', 'URL') then 1 end) as n_network, count(case when score is null then 1 end) as n_unscored, round(avg(score), 6) as mean_score from {detections} where entity_type is not null and upper(trim(entity_type)) <> 'NONE' group by 1, 2, 3""",
    label=LABEL, doc=(doc("document_id"), doc("document_id")), count=COUNT,
)
_add("risk_by_detector", "detections", """select lower(trim(detector)) as detector, coalesce(risk_level, 'medium') as risk_level, {count} as n from {detections} group by 1, 2""", count=COUNT)
_add("gold_type_counts", "gold_items", "select coalesce(category, 'none') as category, e.entity_type as entity_type, {count} as n from (select category, {x}(entities) as e from {gold_items}) t group by 1, 2", x=("explode", "unnest"), count=COUNT)
# pages and regions
_R = "(select distinct region_uid, page_row_id, lower(trim(region_type)) as kind, bbox.x as x, bbox.y as y, bbox.w as w, bbox.h as h, text, confidence from {regions})"
_add(
    "region_offsets",
    "regions",
    f"""select page_row_id, region_uid, cast(coalesce(sum(length(trim(text)) + 1) over (partition by page_row_id order by y, x, region_uid rows between unbounded preceding and 1 preceding), 0) as bigint) as start_pos, length(trim(text)) as n from {_R} r where length(trim(text)) > 0""",
)
_add(
    "page_text",
    "regions",
    f"select page_row_id, {{join}} as full_text from {_R} r where length(trim(text)) > 0 group by 1",
    join=("array_join(transform(array_sort(collect_list(struct(y, x, region_uid, trim(text) as t))), s -> s.t), '\\n')", "string_agg(trim(text), chr(10) order by y, x, region_uid)"),
)
# the box of every recognised span of the whole page text
_ORDER = "coalesce(y, -1.0), coalesce(x, -1.0), region_uid"
_OFFSETS = f"select page_row_id, x, y, w, h, length(trim(text)) as n, coalesce(sum(length(trim(text)) + 1) over (partition by page_row_id order by {_ORDER} rows between unbounded preceding and 1 preceding), 0) as a from {_R} r where length(trim(text)) > 0"
_BOXES = """c as (select page_row_id, recogniser, start_pos, end_pos, x + w * (greatest(start_pos, a) - a) / n as x1, x + w * (least(end_pos, a + n) - a) / n as x2, y, h from s join o using (page_row_id) where a < end_pos and a + n > start_pos)
select page_row_id, recogniser, start_pos, end_pos, round(min(x1), 4) as x, round(min(y), 4) as y, round(greatest(2.0, max(x2) - min(x1)), 4) as w, round(greatest(2.0, max(y + h) - min(y)), 4) as h from c group by 1, 2, 3, 4"""


def char_to_bbox_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box of every recognised span of every page text."""
    regions = table(spark, sf_dir, "regions")
    texts = spark.sql(f"select page_row_id, array_join(transform(array_sort(collect_list(struct(coalesce(y, -1.0D) as b, coalesce(x, -1.0D) as a, region_uid, trim(text) as t))), s -> s.t), '\\n') as text from {_R} r where length(trim(text)) > 0 group by 1", regions=regions)
    return spark.sql(f"with o as ({_OFFSETS}), s as (select * from {{spans}}), {_BOXES}", regions=regions, spans=recognise.spans(texts, "page_row_id"))


QUERIES["char_to_bbox_spans"] = char_to_bbox_spans
ORACLES["char_to_bbox_spans"] = f"with o as ({_OFFSETS}), texts as (select page_row_id, string_agg(trim(text), chr(10) order by {_ORDER}) as text from {_R} r where length(trim(text)) > 0 group by 1), s as (".replace("{regions}", "regions") + " union all ".join(f"select '{r.name}' as recogniser, page_row_id, start_pos, end_pos from ({recognise.spans_sql('texts', 'page_row_id', r)})" for r in recognise.RECOGNISERS) + f"), {_BOXES}"
_add(
    "iou_join",
    "regions",
    f"""with r as {_R}, t as (select * from r where kind = 'table'), o as (select t.region_uid as a_uid, c.region_uid as b_uid, least(t.x + t.w, c.x + c.w) - greatest(t.x, c.x) as ix, least(t.y + t.h, c.y + c.h) - greatest(t.y, c.y) as iy, t.w * t.h as ta, c.w * c.h as ca from t join r c on c.page_row_id = t.page_row_id and c.region_uid <> t.region_uid and least(t.x + t.w, c.x + c.w) > greatest(t.x, c.x) and least(t.y + t.h, c.y + c.h) > greatest(t.y, c.y))
select a_uid, b_uid, round(ix * iy / (ta + ca - ix * iy), 3) as iou from o where ix * iy / (ta + ca - ix * iy) > 0.05""",
)
_add("region_type_counts", "regions", f"select coalesce(kind, 'unknown') as kind, {{count}} as n, count(case when length(text) > 0 then 1 end) as n_text from {_R} r group by 1", count=COUNT)
_add("candidate_regions", "regions", f"select region_uid from {_R} r where kind in ('normal_text', 'table_cell', 'table_header', 'table_row', 'kv_pair', 'unknown') and length(trim(text)) > 0 and w > 0 and h > 0")
_add("report_regions", "regions", f"select page_row_id, region_uid, place, t from (select page_row_id, region_uid, left(text, 140) as t, row_number() over (partition by page_row_id order by y, x, region_uid) as place from {_R} r) q where place <= 60")
# runs
_S = "(select *, row_number() over (partition by run_id order by updated_at desc nulls last, ingested_at desc, snapshot_id desc) as place from {runs})"
_add("run_state", "runs", f"select run_id, {{doc}} as document_id, status, n_pages from {_S} s where place = 1", doc=(doc("document_id"), doc("document_id")))
_add("batch_status", "runs", f"select batch_id, {{count}} as runs, count(case when status = 'done' then 1 end) as done, count(case when status = 'error' then 1 end) as error, count(case when status = 'running' then 1 end) as running, case when sum(case when status in ('done', 'error', 'partial') then 0 else 1 end) = 0 then 'done' else 'running' end as status from {_S} s where place = 1 group by 1", count=COUNT)
_add("incomplete_runs", "runs", f"select run_id from {_S} s where place = 1 and (status in ('error', 'partial') or status not in ('done', 'skipped'))")
_add("recent_runs", "runs", f"select run_id, snapshot_id from {_S} s where place = 1 and updated_at is not null order by updated_at desc, run_id limit 50")
# every run of a document against the one before it in time
_add(
    "run_diff_all",
    "page_results",
    """with p as (select distinct page_row_id, {doc} as document_id, solution, run_id, case when confidence > 1 then confidence / 100 else confidence end as c, n_tables, created_at from {page_results} where run_id is not null),
m as (select document_id, run_id, solution, avg(c) as c, sum(n_tables) as t from p group by 1, 2, 3), r as (select document_id, run_id, min(created_at) as began from p group by 1, 2),
k as (select document_id, run_id, lag(run_id) over (partition by document_id order by began nulls last, run_id) as before from r),
a as (select k.document_id, k.before as run_a, k.run_id as run_b, m.solution, m.c, m.t from k join m on m.document_id = k.document_id and m.run_id = k.before),
b as (select k.document_id, k.before as run_a, k.run_id as run_b, m.solution, m.c, m.t from k join m on m.document_id = k.document_id and m.run_id = k.run_id where k.before is not null)
select coalesce(a.document_id, b.document_id) as document_id, coalesce(a.run_a, b.run_a) as run_a, coalesce(a.run_b, b.run_b) as run_b, coalesce(a.solution, b.solution) as solution, case when b.run_b is null then 'a' when a.run_a is null then 'b' else 'both' end as side, round(b.c - a.c + 0.000000001, 6) as d_confidence, cast(b.t - a.t as double) as d_tables from a full outer join b on a.document_id = b.document_id and a.run_a = b.run_a and a.run_b = b.run_b and a.solution = b.solution""",
    doc=(doc("document_id"), doc("document_id")),
)
_add("runs_by_document", "runs", "select {doc} as document_id, count(distinct run_id) as n_runs, cast(count(case when status = 'running' then 1 end) as bigint) as running from {runs} group by 1", doc=(doc("document_id"), doc("document_id")))
_add("solutions_of_runs", "runs", "select s as solution, count(distinct run_id) as n from (select run_id, {x}(solution_names) as s from {runs}) t group by 1", x=("explode", "unnest"))
# reviews over orders, audit over events, words and cells over line items
_add("review_order", "orders", "select o_orderkey, o_custkey, row_number() over (partition by o_custkey, o_orderpriority order by o_orderdate, o_orderkey) as place from {orders}")
_add("review_stats", "orders", "select o_orderpriority as category, o_orderstatus as solution, {count} as accepts, count(distinct o_custkey) as pages from {orders} group by 1, 2", count=COUNT)
_add("best_available", "orders", "select o_custkey, o_orderkey from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_totalprice desc, o_orderkey) as place from {orders}) q where place = 1")
_add("stage_status", "events", "select user_id, min(case event_type when 'error' then 0 when 'purchase' then 1 else 2 end) as worst, {count} as invocations, max({k}) as top from {events} group by 1", count=COUNT, k=("cast(get_json_object(props, '$.k') as int)", "json_extract_string(props, '$.k')::int"))
_add("audit_timeline", "events", "select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) as step, round(sum(value) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row), 4) as total from {events}")
_add("line_index", "page_results", "select page_row_id, {no} as line_no, line from (select distinct page_row_id, full_text from {page_results} where full_text is not null) p {x}", no=("line_no", "cast(line_no - 1 as int)"), x=("lateral view posexplode(split(full_text, '\\n')) l as line_no, line", ", unnest(string_split(full_text, chr(10))) with ordinality as l(line, line_no)"))
for _short, _whole in (("char_to_bbox", "char_to_bbox_spans"), ("run_diff", "run_diff_all")):
    QUERIES[_short], ORACLES[_short] = QUERIES[_whole], ORACLES[_whole]
