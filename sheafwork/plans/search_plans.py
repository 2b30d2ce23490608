"""Search over pages, manual marks, occurrences and the cells of detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheafwork.operators import recognise, search
from sheafwork.plans.declare import COMMON, DOC, Declared, values
from sheafwork.session import table

_d = Declared()
QUERIES, ORACLES = _d.queries, _d.oracles

# one cell: a detector's latest answers on a document; the same statement for both engines
_ENTITIES = """select concat(document, '/', detector) as cell, document, detector, page, rank, entity_type, value, start_pos, end_pos, score from (
 select {doc} as document, lower(trim(detector)) as detector, page_index as page, detection_id as rank, {label} as entity_type, entity_text as value, start_pos, end_pos, coalesce(score, 0.5) as score,
 row_number() over (partition by item_id, lower(trim(detector)) order by detected_at desc nulls last, detection_id desc) as n from {detections} where entity_type is not null and entity_text is not null) t where n = 1 and entity_type <> 'NONE' and document is not null"""
_PAGES = """select document, cast(page_row_id as bigint) as page, text from (select p.document, r.page_row_id, {join} as text from (select distinct region_uid, page_row_id, bbox.x as x, bbox.y as y, text from {regions} where length(trim(text)) > 0) r
 join (select distinct page_row_id, {doc} as document from {page_results}) p on p.page_row_id = r.page_row_id group by p.document, r.page_row_id) q"""
_JOIN = ("array_join(transform(array_sort(collect_list(struct(coalesce(y, -1.0D) as b, coalesce(x, -1.0D) as a, region_uid, trim(text) as t))), s -> s.t), '\\n')", "string_agg(trim(text), chr(10) order by coalesce(y, -1.0), coalesce(x, -1.0), region_uid)")
# a page of a text is named by its row; entities name the page by index, so both are brought to (document, page row)
_PLACED = "select e.cell, e.document, p.page, e.rank, e.entity_type, e.value, e.start_pos, e.end_pos, e.score from ({entities}) e left join (select document, page_index, min(page_row_id) as page from (select distinct {doc} as document, page_index, page_row_id from {page_results} where page_row_id in (select page_row_id from {regions})) t group by 1, 2) p on p.document = e.document and p.page_index = e.page"
_NAMES = ("detections", "page_results", "regions")
_MARKS = "select {doc} as document, page_index as page, {label} as entity_type, entity_text as value, detection_id as mark_id from {detections} where lower(trim(detector)) in ('manual_a', 'manual_b') and entity_type is not null and entity_text is not null and {label} <> 'NONE'"


def _text(sql: str, engine: int) -> str:
    pieces = {**COMMON, "join": _JOIN, "entities": (_ENTITIES, _ENTITIES)}
    for _ in range(2):
        for k, v in pieces.items():
            sql = sql.replace("{" + k + "}", v[engine])
    if engine:
        for n in _NAMES:
            sql = sql.replace("{" + n + "}", n)
    return sql


def _frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(_text(sql, 0), **{n: table(spark, sf_dir, n) for n in _NAMES})


_duck = lambda sql: _text(sql, 1)


def _occ(pages: str, wanted: str, ignore_case: bool, words: bool = True) -> str:
    """Occurrences in SQL: all pairs of a document that hold the value, then the masked text split by the value."""
    edge, flag = ("\\b" if words else ""), ("(?i)" if ignore_case else "")
    low = (lambda c: f"lower({c})") if ignore_case else (lambda c: c)
    masked = recognise.masked_sql if words else (lambda c: c)
    return f"""select document, page, value, a::integer as start_pos, (a + n)::integer as end_pos, substring(text, a + 1, n) as found from (
 select document, page, value, text, length(hit)::integer as n, (list_sum(list_transform(gaps[1:i+1], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i], lambda x: length(x))), 0))::integer as a from (
  select *, unnest(hits) as hit, unnest(range(len(hits))) as i from (select *, regexp_extract_all(m, pattern) as hits, string_split_regex(m, pattern) as gaps from (
   select p.document, p.page, p.text, w.value, {masked('p.text')} as m, '{flag}{edge}' || regexp_replace({masked('w.value')}, '([^A-Za-z0-9_\\s])', '\\\\\\1', 'g') || '{edge}' as pattern
   from ({pages}) p join (select distinct document, value from ({wanted}) where length(value) > 0) w on w.document = p.document and contains({low('p.text')}, {low('w.value')}))))) where {low('substring(text, a + 1, n)')} = {low('value')}"""


def _new_sql(hits: str, have: str) -> str:
    return f"select * exclude (nth) from (select *, row_number() over (partition by cell, page, start_pos, end_pos order by rank, value) as nth from ({hits}) h where not exists (select 1 from ({have}) e where e.cell = h.cell and e.page = h.page and e.entity_type = h.entity_type and e.end_pos > h.start_pos and h.end_pos > e.start_pos)) where nth = 1"


_TOKENS = f"select * from (select cell, document, rank, entity_type, score, value as parent, unnest(tokens) as value, generate_subscripts(tokens, 1) - 1 as at from (select *, list_filter(string_split_regex(trim(value), '\\s+'), lambda t: t <> '') as tokens from ({_PLACED}) x where entity_type in {values(search.PARENTS)}) where len(tokens) >= 2) where length(value) >= 3 and value <> parent"
_PARTS = _duck("with pl as (" + _PLACED + "), pg as (" + _PAGES + "), tk as (" + _TOKENS + ")") + f"""
select cell, document, page, entity_type, found as value, start_pos, end_pos, round(score * {search.PART}, 6) as score, parent, 'substring_of' as discovery from ({_new_sql("select t.cell, t.document, o.page, o.start_pos, o.end_pos, o.found, t.entity_type, t.score, t.parent, t.value, t.rank * 1000 + t.at as rank from (" + _occ("select * from pg", "select document, value from tk", False) + ") o join tk t on t.document = o.document and t.value = o.value", "select * from pl")})"""
_UNIQUE = "select cell, document, rank, entity_type, score, trim(value) as value, page as p from (select *, row_number() over (partition by cell, value, entity_type order by page nulls first, rank) as n from pl) where n = 1 and length(trim(value)) >= 3"
_REPEATS = _duck("with pl as (" + _PLACED + "), pg as (" + _PAGES + f"), un as ({_UNIQUE})") + f"""
select cell, document, page, entity_type, found as value, start_pos, end_pos, round(score * {search.REPEAT}, 6) as score, value as parent, 'search_only' as discovery from ({_new_sql("select u.cell, u.document, o.page, o.start_pos, o.end_pos, o.found, u.entity_type, u.score, u.value, coalesce(u.p, 0) * 10000000000 + u.rank as rank from (" + _occ("select * from pg", "select document, value from un", True) + ") o join un u on u.document = o.document and u.value = o.value", "select * from pl")})"""
_d.put("substring_search", lambda s, d: search.parts(_frame(s, d, _PLACED), _frame(s, d, _PAGES)), _PARTS)
_d.put("fallback_search", lambda s, d: search.repeats(_frame(s, d, _PLACED), _frame(s, d, _PAGES)), _REPEATS)
_d.put(
    "manual_overlay",
    lambda s, d: search.overlay(_frame(s, d, _ENTITIES).where("detector not in ('manual_a', 'manual_b')"), _frame(s, d, _MARKS)).fillna(-1, ["mark_id"]),
    _duck(f"""with e as (select *, lower(value) as l, row_number() over (partition by cell, page, entity_type, lower(value) order by rank) as n from ({_ENTITIES}) where detector not in ('manual_a', 'manual_b')),
m as (select document, page, entity_type, trim(value) as value, mark_id from ({_MARKS}) where length(trim(value)) > 0 and page >= 0), w as (select c.cell, m.* from (select distinct cell, document from e) c join m using (document))
select cell, document, page, entity_type, value, start_pos, end_pos, score, coalesce(mark_id, -1) as mark_id, case when mark_id is null then 'lib' else 'both' end as discovery from (select e.*, case when n = 1 then (select max(w.mark_id) from w where w.cell = e.cell and w.page = e.page and w.entity_type = e.entity_type and lower(w.value) = e.l) end as mark_id from e)
union all select cell, document, page, entity_type, value, -1, -1, 1.0, mark_id, 'manual_only' from w where not exists (select 1 from e where e.cell = w.cell and e.page = w.page and e.entity_type = w.entity_type and e.l = lower(w.value))"""),
)
_REGION_TEXTS = "select p.document, r.region_uid as page, r.text from (select distinct region_uid, page_row_id, text from {regions} where length(text) > 0) r join (select distinct page_row_id, {doc} as document from {page_results}) p on p.page_row_id = r.page_row_id"
_KNOWN = "select document, value, entity_type, min(rank) as rank from ({entities}) e group by 1, 2, 3"
_d.put(
    "universal_mask",
    lambda s, d: search.known_everywhere(_frame(s, d, _KNOWN), _frame(s, d, _REGION_TEXTS), recognise.spans(_frame(s, d, _REGION_TEXTS), "page", recognisers=recognise.LEGACY)),
    _duck(f"with rt as ({_REGION_TEXTS}), kn as (select document, value, entity_type, rank from (select *, row_number() over (partition by document, value order by rank) as n from ({_KNOWN})) where n = 1 and length(value) >= 4), sp as (" + " union all ".join(f"select page, start_pos, end_pos from ({recognise.spans_sql('rt', 'page', r)})" for r in recognise.LEGACY) + "), ") + f"h as ({_occ('select * from rt', 'select document, value from kn', False, False)}) select document, page, entity_type, start_pos, end_pos, value, 0.75::double as score from (select h.document, h.page, kn.entity_type, h.start_pos, h.end_pos, h.found as value, row_number() over (partition by h.page, h.start_pos, h.end_pos order by kn.rank, kn.value) as nth from h join kn on kn.document = h.document and kn.value = h.value where not exists (select 1 from sp where sp.page = h.page and sp.start_pos = h.start_pos and sp.end_pos = h.end_pos)) where nth = 1",
)
# occurrences per cell with where they came from, after the overlay
_OVER = ORACLES["manual_overlay"]
_d.put(
    "occurrence_count",
    lambda s, d: s.sql("select cell, value, entity_type, count(*) as doc_count, count(distinct page) as page_count, count(case when discovery = 'lib' then 1 end) as n_lib, count(case when discovery = 'search_only' then 1 end) as n_search_only, count(case when discovery = 'manual_only' then 1 end) as n_manual_only, count(case when discovery = 'both' then 1 end) as n_both from {o} group by 1, 2, 3", o=QUERIES["manual_overlay"](s, d)),
    f"select cell, value, entity_type, count(*)::bigint as doc_count, count(distinct page)::bigint as page_count, count(*) filter (where discovery = 'lib')::bigint as n_lib, 0::bigint as n_search_only, count(*) filter (where discovery = 'manual_only')::bigint as n_manual_only, count(*) filter (where discovery = 'both')::bigint as n_both from ({_OVER}) group by 1, 2, 3",
)
# promoted marks: the dictionary without repeats; marks of document and run scope together
_d.add("dictionary_promotion", "detections", f"select entity_type, trim(value) as value, {{count}} as n_marks, min(mark_id) as first_mark from ({_MARKS}) m where length(trim(value)) > 0 group by 1, 2")
_d.add("annotations_for_run", "detections", "select mark_id, scope, document, run, value from (select detection_id as mark_id, 'doc' as scope, {doc} as document, cast(null as string) as run, entity_text as value from {detections} where lower(trim(detector)) = 'manual_a' union all select detection_id, 'run', {doc}, pii_run_id, entity_text from {detections} where lower(trim(detector)) = 'manual_b') t")
