"""Runs, pages and cells compared, merged and counted; reviews composed."""

from __future__ import annotations

from sheafwork.operators import masking, recognise
from sheafwork.plans import layout_plans
from sheafwork.plans.declare import Declared, values

_d = Declared()
QUERIES, ORACLES = _d.queries, _d.oracles

# a saved page result, re-delivered ones once; confidence on one scale
_PG = "(select distinct page_row_id, {doc} as document, run_id, solution, page_index, case when confidence > 1 then confidence / 100 else confidence end as c, coalesce(n_tables, 0) as n_tables, coalesce({size}, 0) as n_regions, full_text, pdf_kind, created_at from {page_results})"
_SIZE = ("case when regions is null then 0 else size(regions) end", "len(regions)")
_RUN = "(select run_id, {doc} as document, filename, n_pages, status, batch_id, started_at, updated_at, solution_names, row_number() over (partition by run_id order by updated_at desc nulls last, ingested_at desc, snapshot_id desc) as place from {runs})"
_DET = "(select detection_id, item_id, pii_run_id, {doc} as document, page_index, lower(trim(detector)) as detector, {label} as entity_type, entity_text, start_pos, end_pos, score, risk_level from {detections})"

_d.add(
    "pdf_kind",
    "page_results runs",
    f"""with g as (select document, page_index, max(length(trim(coalesce(full_text, '')))) as n from {_PG} p where page_index is not null group by 1, 2), k as (select document, count(*) as n_pages, sum(case when n >= 32 then 1 else 0 end) as v from g group by 1), a as (select distinct {{doc}} as document from {{runs}} where document_id is not null union select document from k)
select a.document, coalesce(k.n_pages, 0) as n_pages, case when k.n_pages is null then 'unknown' when v = n_pages then 'vector' when v = 0 then 'scanned' else 'mixed' end as pdf_kind from a left join k on k.document = a.document""",
    size=_SIZE,
)
_d.add(
    "composite_risk",
    "detections",
    f"""with d as (select * from {_DET} t where entity_type is not null and entity_type <> 'NONE'),
f as (select *, {', '.join(f"max(case when entity_type = '{t}' then 1 else 0 end) over (partition by document, page_index, detector) as {n}" for n, t in (('srt', 'UK_SORT_CODE'), ('acc', 'UK_BANK_ACCOUNT_NUMBER'), ('per', 'PERSON'), ('pos', 'UK_POSTCODE'), ('dob', 'DATE_OF_BIRTH')))} from d),
r as (select *, case when srt + acc = 2 and entity_type in ('UK_SORT_CODE', 'UK_BANK_ACCOUNT_NUMBER') then 'sort_code_plus_account_number' when per + pos = 2 and entity_type in ('PERSON', 'UK_POSTCODE') then 'name_plus_postcode' when per + dob = 2 and entity_type in ('PERSON', 'DATE_OF_BIRTH') then 'name_plus_date_of_birth' end as composite_rule from f)
select detection_id, entity_type, composite_rule, case when composite_rule is not null then 'high' when risk_level is not null then risk_level when entity_type in {values(recognise.HIGH_RISK)} then 'high' when entity_type in {values(recognise.LOW_RISK)} then 'low' else 'medium' end as risk_level, case when entity_type in {values(recognise.SPECIAL)} then 'special_category' else 'personal_data' end as sensitivity from r""",
)
_CONF = layout_plans._d
_d.add("solution_confidence", "page_results regions", f"with c as (select page_row_id, coalesce(sum(coalesce(confidence, 0) * {layout_plans._AREA}) / sum({layout_plans._AREA}), 0) as c, sum(case when kind in ('table', 'table_row', 'table_cell') then 1 else 0 end) as tl from {layout_plans._R} r where w is not null and h is not null group by 1) select solution, round(avg(coalesce(c.c * case when tl > 0 and p.n_tables = 0 then 0.7 else 1.0 end, 0)), 6) as confidence, {{count}} as n_pages, cast(sum(p.n_tables) as bigint) as n_tables from {_PG} p left join c on c.page_row_id = p.page_row_id group by 1", size=_SIZE)
# which run's page stays when runs of a document are merged: data first, then confidence, then the latest run
_d.add(
    "run_merge",
    "page_results runs",
    f"""with u as (select run_id, max(updated_at) as made from {{runs}} group by 1), p as (select p.*, u.made, case when n_regions > 0 or n_tables > 0 then 1 else 0 end as has from {_PG} p left join u on u.run_id = p.run_id),
n as (select *, row_number() over (partition by document, solution, page_index order by has desc, case when has = 1 then coalesce(c, 0) end desc nulls last, case when has = 1 then made end desc nulls last, run_id, page_row_id) as place, count(*) over (partition by document, solution, page_index) as versions from p)
select document, solution, page_index, page_row_id, run_id, versions from n where place = 1""",
    size=_SIZE,
)
_d.add(
    "solution_merge",
    "page_results runs",
    f"""with s as (select p.document, p.solution, p.run_id, avg(coalesce(p.c, 0)) as c, max(case r.status when 'done' then 2 when 'partial' then 1 else 0 end) as usable, min(r.started_at) as began from {_PG} p left join (select * from {_RUN} r0 where place = 1) r on r.run_id = p.run_id group by 1, 2, 3),
n as (select *, row_number() over (partition by document, solution order by case when usable > 0 then 1 else 0 end desc, case when usable > 0 then c end desc nulls last, began nulls last, run_id) as place, count(*) over (partition by document, solution) as merged_from from s)
select document, solution, run_id, round(c, 6) as confidence, merged_from from n where place = 1""",
    size=_SIZE,
)
_d.add("run_metrics", "page_results detections", f"select p.document, p.run_id, p.solution, cast(sum(n_regions) as bigint) as regions, cast(sum(n_tables) as bigint) as tables, cast(sum(coalesce(d.n, 0)) as bigint) as pii, round(avg(coalesce(c, 0)), 6) as confidence from {_PG} p left join (select document, page_index, count(distinct item_id) as n from {_DET} d0 where entity_type <> 'NONE' group by 1, 2) d on d.document = p.document and d.page_index = p.page_index group by 1, 2, 3", size=_SIZE)
_d.add(
    "missing_pages",
    "page_results runs",
    f"""with r as (select run_id, n_pages from {_RUN} r0 where place = 1 and n_pages > 0), e as (select run_id, n_pages, {{each}} as i from r), m as (select e.run_id, e.n_pages, e.i from e left join (select distinct run_id, page_index from {{page_results}} where page_index is not null) p on p.run_id = e.run_id and p.page_index = e.i where p.run_id is null),
g as (select run_id, {{count}} as n_missing, {{list}} as first_missing from (select *, row_number() over (partition by run_id order by i) as k from m) m1 group by 1)
select r.run_id, cast(r.n_pages as bigint) as n_pages, coalesce(g.n_missing, 0) as n_missing, coalesce(g.first_missing, '') as first_missing, case when g.run_id is null then 'ok' else 'partial' end as status from r left join g on g.run_id = r.run_id""",
    each=("explode(sequence(0, n_pages - 1))", "unnest(range(0, n_pages))"),
    list=("array_join(transform(array_sort(collect_list(case when k <= 10 then i + 1 end)), x -> cast(x as string)), ',')", "coalesce(string_agg(case when k <= 10 then (i + 1)::varchar end, ',' order by i), '')"),
)
# detectors by producers: a cell is what a detector says on the pages that a producer read
_d.add(
    "benchmark_matrix",
    "page_results detections",
    f"""with o as (select distinct solution from {{page_results}} where solution is not null), t as (select distinct detector from {_DET} d0 where detector is not null), pg as (select distinct solution, document, page_index from {_PG} p0),
c as (select pg.solution, d.detector, {{count}} as n, count(distinct d.entity_type) as n_types, sum(case when d.entity_type is null then 1 else 0 end) as n_open from pg join {_DET} d on d.document = pg.document and d.page_index = pg.page_index group by 1, 2)
select o.solution, t.detector, coalesce(c.n, 0) as n, coalesce(c.n_types, 0) as n_types, case when c.n is null then 'pending' when c.n_open = c.n then 'error' else 'ok' end as status from o cross join t left join c on c.solution = o.solution and c.detector = t.detector""",
    size=_SIZE,
)
_d.add(
    "matrix_status",
    "page_results detections",
    f"""with o as (select distinct solution from {{page_results}} where solution is not null), t as (select distinct detector from {_DET} d0 where detector is not null), c as (select distinct p.solution, d.detector from {_PG} p join {_DET} d on d.document = p.document and d.page_index = p.page_index)
select o.solution, cast(sum(case when c.detector is not null then 1 else 0 end) as bigint) as ok, cast(sum(case when c.detector is null then 1 else 0 end) as bigint) as pending, cast(0 as bigint) as error from o cross join t left join c on c.solution = o.solution and c.detector = t.detector group by 1""",
    size=_SIZE,
)
_d.add(
    "stub_cells",
    "page_results runs detections",
    f"""with bad as (select r.run_id, r.document, r.status, case when r.n_pages > 0 then r.n_pages else 1 end as n from {_RUN} r where place = 1 and status in ('error', 'partial')), e as (select run_id, document, status, {{each}} as page_index from bad), t as (select distinct detector from {_DET} d0 where detector is not null)
select e.run_id, e.document, e.page_index, t.detector, e.status from e cross join t""",
    each=("explode(sequence(0, coalesce(n, 1) - 1))", "unnest(range(0, coalesce(n, 1)))::integer"),
)
_d.add("compare_types", "detections", f"select entity_type, " + ", ".join(f"cast(sum(case when detector = '{x}' then 1 else 0 end) as bigint) as {x}" for x in ("presidio_regex", "presidio_spacy", "presidio_legacy", "gliner", "piiranha", "hybrid", "user_custom", "manual_a", "manual_b")) + f" from {_DET} d where entity_type is not null group by 1")
_d.add("cell_types", "detections", f"select document, page_index, detector, kind as entity_type, case when kind in ('QR_CODE', 'BAR_CODE') then 'Visual' when kind = 'LAT_LONG_PAIR' or kind like 'MAP_URL%' then 'Location' when kind in ('EMAIL_ADDRESS', 'URL') then 'Network' else 'PII' end as category, {{count}} as n from (select *, coalesce(entity_type, '?') as kind from {_DET} d0) d group by document, page_index, detector, 4, 5")
_d.add("dedupe_legacy", "detections", f"select document, page_index, entity_type, start_pos, end_pos, score, detection_id from (select *, row_number() over (partition by document, page_index, entity_type, start_pos, end_pos order by coalesce(score, 0) desc, detection_id) as n from {_DET} d where entity_type is not null and start_pos is not null) q where n = 1")
_d.add(
    "token_rollup",
    "detections",
    f"""with f as (select document, entity_text, entity_type, detection_id, page_index, min(detection_id) over (partition by document, entity_text) as first_id from {_DET} d where entity_text is not null and entity_type is not null),
t as (select f.document, concat('tok_', left({{sha}}, 8)) as token, g.entity_type, f.page_index from f join f g on g.document = f.document and g.entity_text = f.entity_text and g.detection_id = f.first_id)
select document, token, entity_type, {{count}} as n, {{pages}} as pages from t group by 1, 2, 3""",
    sha=("sha2(f.entity_text, 256)", "sha256(f.entity_text)"), pages=("array_join(transform(array_sort(collect_set(page_index)), p -> cast(p as string)), ',')", "coalesce(array_to_string(list_transform(list_sort(list(distinct page_index)), lambda p: p::varchar), ','), '')"),
)
_d.add("mapping_dedup", "detections", f"select entity_type, mock, min(value) as first_text, {{count}} as occurrences, count(distinct value) as originals from (select entity_type, value, {{mock}} as mock from (select entity_type, entity_text as value from {_DET} d where entity_text is not null and entity_type is not null) v) m group by 1, 2", mock=(masking.mock_sql("run-1"), masking.mock_sql("run-1", 1)))
_d.add("paired_runs", "runs detections", f"select d.document, d.pii_run_id, r.run_id, r.status from (select distinct document, pii_run_id from {_DET} d0 where pii_run_id is not null) d left join (select *, row_number() over (partition by document order by started_at desc nulls last, run_id) as newest from {_RUN} r0 where place = 1) r on r.document = d.document and r.newest = 1")
_d.add("resumable_runs", "runs page_results", f"select r.run_id, r.status, coalesce(p.done, 0) as done from {_RUN} r left join (select run_id, count(distinct page_index) as done from {{page_results}} group by 1) p on p.run_id = r.run_id where r.place = 1 and (r.status in ('error', 'partial') or r.status not in ('done', 'skipped') or coalesce(p.done, 0) < r.n_pages)")
_d.add("batch_documents", "runs", f"select batch_id, document, count(distinct run_id) as n_runs, max(case when status = 'done' then 1 else 0 end) as any_done, max(filename) as filename from {_RUN} r where place = 1 and batch_id is not null group by 1, 2")
_d.add("newest_runs", "runs", f"select document, run_id, n from (select document, run_id, row_number() over (partition by document order by started_at desc nulls last, run_id) as n from {_RUN} r where place = 1) q where n <= 10")
_d.add("unknown_solutions", "runs page_results", "select distinct s as solution from (select {explode}(solution_names) as s from {runs}) t except select distinct solution from {page_results}")
_d.add("solutions_common", "runs page_results", "select s as solution from (select {explode}(solution_names) as s from {runs}) t intersect select solution from {page_results}")
# producers by what they are and what they need
_GROUPS = {"native_pymupdf": "native_pdf", "native_pdfplumber": "native_pdf", "ocr_tesseract_baseline": "ocr_baseline", "opencv_tesseract": "ocr_baseline", "easyocr_baseline": "ocr_baseline", "doctr_baseline": "ocr_baseline", "paddleocr_baseline": "ocr_baseline", "img2table_tesseract": "img2table", "camelot_lattice": "vector_camelot", "camelot_stream": "vector_camelot", "docling_solution": "vision_ml", "deepdoc_baseline": "deepdoc"}
_KINDS = {"camelot_lattice": ("vector", "mixed"), "camelot_stream": ("vector", "mixed"), "native_pymupdf": ("vector",), "native_pdfplumber": ("vector",)}
_TAGS = {"native_pymupdf": "Vector PDF", "native_pdfplumber": "Vector PDF", "ocr_tesseract_baseline": "OCR", "img2table_tesseract": "OCR,Subprocess", "camelot_lattice": "Vector PDF,Subprocess", "easyocr_baseline": "OCR,Subprocess,Vision", "doctr_baseline": "OCR,Subprocess,Vision", "paddleocr_baseline": "OCR,Subprocess,Vision", "docling_solution": "OCR,Subprocess,Vision", "deepdoc_baseline": "OCR,Subprocess,Vision"}
_CAPABLE = "(values " + ", ".join(f"('{s}', '{g}', '{_TAGS.get(s, 'OCR')}', {str('vector' in _KINDS.get(s, ('vector',))).lower()}, {str('mixed' in _KINDS.get(s, ('mixed',))).lower()}, {str('scanned' in _KINDS.get(s, ('scanned',))).lower()})" for s, g in _GROUPS.items()) + ")"
_d.add(
    "supports_kind",
    "page_results",
    f"""select p.solution, p.pdf_kind, case when t.solution is null or (p.pdf_kind = 'vector' and t.vec) or (p.pdf_kind = 'scanned' and t.sca) or t.mix then 'run' else 'skipped' end as decision, {{count}} as n from {_PG} p left join {_CAPABLE} as t(solution, grp, tags, vec, mix, sca) on t.solution = p.solution group by 1, 2, 3""",
    size=_SIZE,
)
_d.add("solution_groups", "page_results", f"select coalesce(t.grp, 'other') as grp, count(distinct p.solution) as n_solutions, {{count}} as n_pages, round(avg(coalesce(c, 0)), 6) as confidence from {_PG} p left join {_CAPABLE} as t(solution, grp, tags, vec, mix, sca) on t.solution = p.solution group by 1", size=_SIZE)
_d.add("solutions_with_tags", "page_results", f"select distinct p.solution from {_PG} p join {_CAPABLE} as t(solution, grp, tags, vec, mix, sca) on t.solution = p.solution where t.tags like '%OCR%' and t.tags like '%Vision%'", size=_SIZE)
# reviews: an order stands for an accept of (page, category) in favour of one producer
_ACC = "(select o_custkey as page, o_orderpriority as category, o_orderstatus as solution, o_orderkey as id, o_orderdate as made, o_totalprice as c from {orders})"
_d.add("review_upsert", "orders", f"select page, category, solution, id, row_number() over (partition by page, category order by first_at, id) as place from (select *, min(made) over (partition by page, category, solution) as first_at, row_number() over (partition by page, category, solution order by made desc, id desc) as n from {_ACC} a) q where n = 1")
_d.add("review_reorder", "orders", f"with u as (select page, category, solution, id, row_number() over (partition by page, category order by made, id) as ord from (select *, row_number() over (partition by page, category, solution order by made desc, id desc) as n from {_ACC} a) q where n = 1) select page, category, solution, row_number() over (partition by page, category order by case solution when 'P' then 1 when 'O' then 2 else 3 end, ord) as place from u")
_d.add(
    "review_compose",
    "orders",
    f"""with a as (select page, category, solution, row_number() over (partition by page, category order by made, id) as n from {_ACC} x), pg as (select distinct page from {_ACC} x1), cat as (select distinct category from {_ACC} x2), pa as (select page, solution from (select page, solution, row_number() over (partition by page order by made desc, id desc) as n from {_ACC} x3 where category = '1-URGENT') z where n = 1), best as (select page, solution from (select page, solution, row_number() over (partition by page order by c desc, id) as n from {_ACC} x4) z where n = 1)
select pg.page, cat.category, coalesce(a.solution, pa.solution, best.solution) as solution, case when a.solution is not null then 'category' when pa.solution is not null then 'page' else 'best' end as chosen_by from pg cross join cat left join a on a.page = pg.page and a.category = cat.category and a.n = 1 left join pa on pa.page = pg.page left join best on best.page = pg.page""",
)
_d.add("category_winner", "orders", f"with u as (select category, solution, cast(row_number() over (partition by page, category order by made, id) as double) as ord from {_ACC} a), m as (select category, solution, avg(ord) as mean_order, {{count}} as n from u group by 1, 2) select category, solution, round(mean_order, 6) as mean_order, n from (select *, row_number() over (partition by category order by mean_order, n desc, solution) as k from m) q where k = 1")
# usage carried by events: last model, summed units
_d.add("usage_rollup", "events", "select user_id, cast(sum({k}) as bigint) as units, {last} as last_type, {count} as steps from {events} group by 1", k=("cast(get_json_object(props, '$.k') as int)", "json_extract_string(props, '$.k')::int"), last=("max_by(event_type, struct(ts, event_id))", "arg_max(event_type, (ts, event_id))"))
_d.add("latest_progress", "events", "select user_id, event_type, {v} as value from {events} group by 1, 2", v=("max_by(value, struct(ts, event_id))", "arg_max(value, (ts, event_id))"))
# rank by counting, not by gathering a group's values: equal values are counted first
_RANKS = ", ".join(f"max(case when below <= {{r{p}}} and {{r{p}}} < below + n then value end) as p{p}" for p in (50, 95, 99))
_d.add(
    "latency_nearest_rank",
    "events",
    f"with v as (select event_type, value, count(*) as n from {{events}} where value is not null group by 1, 2), b as (select event_type, value, n, sum(n) over (partition by event_type order by value rows between unbounded preceding and current row) - n as below, sum(n) over (partition by event_type) as total, sum(n * value) over (partition by event_type) as s from v) select event_type, round(p50, 2) as p50, round(p95, 2) as p95, round(p99, 2) as p99, round(m, 2) as mean_ms from (select event_type, {_RANKS}, max(s / total) as m from b group by 1) q",
    "select event_type, round({v50}, 2) as p50, round({v95}, 2) as p95, round({v99}, 2) as p99, round(avg(value), 2) as mean_ms from {events} where value is not null group by 1",
    **{f"r{p}": (f"rint({p / 100}D * (total - 1))", "") for p in (50, 95, 99)}, **{f"v{p}": ("", f"list_sort(list(value))[round_even({p / 100}::double * (count(*) - 1), 0)::int + 1]") for p in (50, 95, 99)},
)
_d.add("overlay_list", "detections", f"select document, page_index, detection_id, place from (select document, page_index, detection_id, row_number() over (partition by document, page_index order by start_pos nulls last, detection_id) as place from {_DET} d where entity_type in ('EMAIL_ADDRESS', 'URL', 'PERSON', 'UK_POSTCODE')) q where place <= 50")
_d.add("pages_windowed", "page_results", f"select document, run_id, page_index, page_row_id, coalesce(lead(page_row_id) over (partition by document, run_id order by page_index, page_row_id), -1) as next_row, row_number() over (partition by document, run_id order by page_index, page_row_id) as place from {_PG} p where page_index is not null", size=_SIZE)
# what several producers of one run say of a page, put together in their order
_d.add(
    "page_append_merge",
    "page_results",
    f"select document, run_id, page_index, cast(sum(n_regions) as bigint) as regions, cast(sum(n_tables) as bigint) as tables, {{join}} as full_text from {_PG} p group by 1, 2, 3",
    size=_SIZE, join=("array_join(transform(array_sort(collect_list(case when length(full_text) > 0 then struct(solution, page_row_id, full_text) end)), s -> s.full_text), '\\n')", "coalesce(string_agg(case when length(full_text) > 0 then full_text end, chr(10) order by solution, page_row_id), '')"),
)
# tables of a page and their crops by position, where both have one at it
_d.add(
    "tables_by_position",
    "regions page_results",
    f"""with t as (select page_row_id, region_uid, row_number() over (partition by page_row_id order by y, x, region_uid) as place from {layout_plans._R} r where kind = 'table'), n as (select distinct page_row_id, coalesce(n_tables, 0) as n from {{page_results}})
select t.page_row_id, t.region_uid, t.place, t.place <= n.n as has_model from t join n on n.page_row_id = t.page_row_id""",
)
