"""Geometry of pages: confidence and format, lines and words, grids and cells, tables rebuilt from bare boxes."""

from __future__ import annotations

from sheafwork.plans.declare import Declared, values

_d = Declared()
QUERIES, ORACLES = _d.queries, _d.oracles

#: Region types, those of tables, and those that hold text (fixed values).
TYPES = ("logo", "normal_text", "table", "table_header", "table_row", "table_cell", "image", "handwriting_signature", "seal", "watermark", "kv_pair", "unknown")
TABLE_TYPES = ("table", "table_header", "table_row", "table_cell")
TEXT_TYPES = ("normal_text", "kv_pair", "table_cell", "table_row", "table_header", "unknown")
#: Rebuilt tables (fixed values): regions in a row, rows in a table, pairs in a key-value table, regions on a page, and
#: tolerances in median heights and widths.
ROW, ROWS, PAIRS, LEAST, Y_TOL, X_TOL, GAP = 3, 2, 3, 4, 0.5, 0.6, 1.6

# one row per region; a re-delivered region counts once, a type off the list is unknown
_R = f"(select distinct region_uid, page_row_id, case when lower(trim(region_type)) in {values(TYPES)} then lower(trim(region_type)) else 'unknown' end as kind, bbox.x as x, bbox.y as y, bbox.w as w, bbox.h as h, text, confidence, source_tool from {{regions}})"
_P = "(select page_row_id, {doc} as document, min(page_index) as page_index, max(coalesce(n_tables, 0)) as n_tables from {page_results} where page_row_id is not null group by 1, 2)"
_AREA = "greatest(cast(1.0 as double), w * h)"

_d.add(
    "page_confidence",
    "regions page_results",
    f"""select p.page_row_id, round(coalesce(c, 0) * case when table_like > 0 and p.n_tables = 0 then 0.7 else 1.0 end, 6) as confidence from {_P} p left join
 (select page_row_id, sum(coalesce(confidence, 0) * {_AREA}) / sum({_AREA}) as c, sum(case when kind in ('table', 'table_row', 'table_cell') then 1 else 0 end) as table_like from {_R} r where w is not null and h is not null group by 1) a on a.page_row_id = p.page_row_id""",
)
_d.add("length_confidence", "regions", f"select page_row_id, round(sum(coalesce(confidence, 0) * greatest(1, length(coalesce(text, '')))) / sum(greatest(1, length(coalesce(text, '')))), 6) as confidence, {{count}} as n from {_R} r group by 1")
# headings and lists are told by a layout label where a tool gives one; key-value pairs with a colon stand for headings here
_BUCKET = f"case when kind in {values(TABLE_TYPES)} then 'tables' when kind = 'image' then 'figures' when kind = 'normal_text' and {{m}}(coalesce(text, ''), '^ *([-*] |[0-9]+[.] )') then 'lists' when kind = 'normal_text' then 'text' when kind = 'kv_pair' and coalesce(text, '') not like '%:%' then 'headings' else 'other' end"
_d.add(
    "doc_format",
    "regions page_results",
    f"""with b as (select page_row_id, w * h as area, {_BUCKET} as bucket from {_R} r where w > 0 and h > 0),
a as (select page_row_id, sum(area) as total, {', '.join(f"sum(case when bucket = '{b}' then area else 0 end) / sum(area) as {b}" for b in ('tables', 'figures', 'text', 'headings', 'lists', 'other'))}, sum(case when bucket = 'headings' then 1 else 0 end) as n from b group by 1)
select p.page_row_id, case when total is null or total <= 0 then 'unknown' when tables >= 0.35 then 'tabular-heavy' when figures >= 0.35 then 'image-heavy' when n >= 5 and tables < 0.20 then 'form-like' when a.text >= 0.70 then 'narrative' else 'mixed' end as doc_format,
 {', '.join(f"round(coalesce(a.{b}, 0), 6) as {b}" for b in ('tables', 'figures', 'text', 'headings', 'lists', 'other'))} from {_P} p left join a on a.page_row_id = p.page_row_id""",
    m=("regexp_like", "regexp_matches"),
)
_d.add("full_text", "regions", f"select page_row_id, {{join}} as full_text from {_R} r where length(trim(text)) > 0 group by 1", join=("array_join(transform(array_sort(collect_list(struct(region_uid, text))), s -> s.text), '\\n')", "string_agg(text, chr(10) order by region_uid, text)"))
_d.add(
    "suggest_type",
    "regions",
    f"""select region_uid, case when text is null or text = '' then 'OTHER' when {{m}}(t, '\\\\b[A-Za-z0-9._%+\\\\-]+@[A-Za-z0-9.\\\\-]+\\\\.[A-Za-z]{{two}}\\\\b') then 'EMAIL_ADDRESS' when {{m}}(t, 'https?://[^\\\\s]+') then 'URL' when {{m}}(t, '\\\\b[A-Z]{{one}}[0-9][A-Z0-9]?\\\\s?[0-9][A-Z][A-Z]\\\\b') then 'UK_POSTCODE' when {{m}}(t, '\\\\+?[0-9][0-9\\\\s\\\\-()]{{seven}}[0-9]') then 'UK_PHONE_NUMBER' when {{m}}(t, '\\\\pL') then 'PERSON' else 'OTHER' end as suggested from (select region_uid, text, trim(text) as t from {_R} r0) r""",
    f"""select region_uid, case when text is null or text = '' then 'OTHER' when regexp_matches(t, '\\b[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{{two}}\\b') then 'EMAIL_ADDRESS' when regexp_matches(t, 'https?://[^\\s]+') then 'URL' when regexp_matches(t, '\\b[A-Z]{{one}}[0-9][A-Z0-9]?\\s?[0-9][A-Z][A-Z]\\b') then 'UK_POSTCODE' when regexp_matches(t, '\\+?[0-9][0-9\\s\\-()]{{seven}}[0-9]') then 'UK_PHONE_NUMBER' when regexp_matches(t, '\\pL') then 'PERSON' else 'OTHER' end as suggested from (select region_uid, text, trim(text) as t from {_R} r0) r""",
    m=("regexp_like", "regexp_matches"), two=("{2,}", "{2,}"), one=("{1,2}", "{1,2}"), seven=("{7,}", "{7,}"),
)
# scalar helpers
_d.add("bbox_union", "regions", f"select page_row_id, round(min(x), 4) as x, round(min(y), 4) as y, round(max(x + w) - min(x), 4) as w, round(max(y + h) - min(y), 4) as h from {_R} r where w > 0 and h > 0 group by 1")
_d.add("bbox_to_pixels", "rescan_regions", "select rescan_uid, round(least(x, x + w) * s, 4) as x, round(least(y, y + h) * s, 4) as y, round(abs(w) * s, 4) as w, round(abs(h) * s, 4) as h, round((842 - y - h) * s, 4) as y_flipped from (select rescan_uid, bbox.x as x, bbox.y as y, bbox.w as w, bbox.h as h, case when bbox.coord_space = 'pdf_pt' then 300 / cast(72 as double) else 300 / {dpi} end as s from {rescan_regions} where bbox is not null and bbox.coord_space is not null) t", dpi=("try_cast(split_part(bbox.coord_space, '@', 2) as double)", "try_cast(split_part(bbox.coord_space, '@', 2) as double)"))
_d.add("bbox_text", "regions", f"select region_uid, concat('(', cast(cast(round(x) as bigint) as string), ', ', cast(cast(round(y) as bigint) as string), ') ', cast(cast(round(w) as bigint) as string), ' x ', cast(cast(round(h) as bigint) as string)) as box from {_R} r where x is not null and y is not null and w is not null and h is not null")
_d.add("safe_ids", "runs", "select snapshot_id, {re} as safe_id, split_part({doc}, '-', 1) as scheme, split_part({doc}, '-', 2) as rest from {runs} where document_id is not null", re=("regexp_replace(document_id, '[^A-Za-z0-9._-]', '_')", "regexp_replace(document_id, '[^A-Za-z0-9._-]', '_', 'g')"))
_d.add("scale_confidences", "page_results", "select page_row_id, case when confidence is null or confidence < 0 then 0.0 else greatest(0.0, least(1.0, confidence / 100)) end as word_scale, greatest(0.0, least(1.0, coalesce(confidence, 0.0))) as unit_scale, greatest(0.0, least(1.0, coalesce(confidence, 0.0) / 100)) * (1 - cast(0.5 as double) * least(cast(1.0 as double), coalesce(n_tables, 0) / cast(100 as double))) as accuracy_scale from (select distinct page_row_id, cast(confidence as double) as confidence, n_tables from {page_results}) p")
_d.add("label_types", "rescan_regions", "select label, case when label like '%title%' or label like '%header%' or label like '%section%' then 'kv_pair' when label like '%table%' then 'table' when label like '%picture%' or label like '%figure%' or label like '%image%' then 'image' else 'normal_text' end as kind_a, case when label like '%table%' and label not like '%caption%' then 'table' when label like '%figure%' and label not like '%caption%' then 'image' when label like '%title%' or label like '%header%' then 'kv_pair' else 'normal_text' end as kind_b, case when label in ('title', 'doc_title', 'paragraph_title', 'table_title') then 'kv_pair' when label = 'table' then 'table' when label in ('figure', 'image', 'chart') then 'image' when label in ('seal', 'stamp') then 'seal' when label = 'watermark' then 'watermark' else 'normal_text' end as kind_c, {count} as n from (select lower(coalesce(region_label, '')) as label from {rescan_regions}) t group by 1")
_d.add("feature_buckets", "regions", f"select page_row_id, case kind when 'image' then 'images' when 'logo' then 'logos' when 'handwriting_signature' then 'signatures' when 'seal' then 'seals' when 'watermark' then 'watermarks' else case when text like '%://%' or text like '%@%' then 'hyperlinks' else 'kv_pairs' end end as bucket, {{count}} as n from {_R} r where kind in ('image', 'logo', 'handwriting_signature', 'seal', 'watermark', 'kv_pair') group by 1, 2")
_d.add("postcode_forms", "detections", "select detection_id, upper({blank}) as bare, case when length({blank}) < 5 then upper({blank}) else concat(left(upper({blank}), cast(length({blank}) - 3 as int)), ' ', right(upper({blank}), 3)) end as postcode, {strip} as stripped from {detections} where entity_text is not null and {label} = 'UK_POSTCODE'", blank=("regexp_replace(entity_text, '\\\\s', '')", "regexp_replace(entity_text, '\\s', '', 'g')"), strip=("regexp_replace(entity_text, '[\\\\s-]', '')", "regexp_replace(entity_text, '[\\s-]', '', 'g')"))
_d.add("payload_json", "pii_run_raw", "select record_id, {ok} as is_json, coalesce({ok2}, false) as is_json_repaired, length({inner}) as inner_length from {pii_run_raw} where payload is not null", ok=("try_parse_json(payload) is not null", "json_valid(payload)"), ok2=("try_parse_json({inner}) is not null", "json_valid({inner})"), inner=("regexp_extract(regexp_replace(payload, '```(json)?', ''), '(?s)[\\\\x7b].*[\\\\x7d]', 0)", "regexp_extract(regexp_replace(payload, '```(json)?', '', 'g'), '(?s)[\\x7b].*[\\x7d]')"))

# words, lines and words joined to lines again, on real boxes
_WORDS = (
    "select page_row_id, region_uid, line_no, word_no, word, x + w * (wpos - 1) / greatest(1, length(line)) as x0, x + w * (wpos - 1 + length(word)) / greatest(1, length(line)) as x1, y + h * line_no / n_lines as y0, y + h * (line_no + 1) / n_lines as y1, coalesce(confidence, 0) as conf from (select *, cast(coalesce(sum(length(word) + 1) over (partition by region_uid, line_no order by word_no rows between unbounded preceding and 1 preceding), 0) + 1 as int) as wpos from (select page_row_id, region_uid, x, y, w, h, confidence, size(split(text, '\\n')) as n_lines, line_no, line, word_no, word from "
    + _R
    + " r lateral view posexplode(split(text, '\\n')) l as line_no, line lateral view posexplode(split(line, ' ')) k as word_no, word where text is not null and w > 0 and h > 0) a) b where word <> ''",
    "select page_row_id, region_uid, line_no, word_no, word, x + w * (wpos - 1) / greatest(1, length(line)) as x0, x + w * (wpos - 1 + length(word)) / greatest(1, length(line)) as x1, y + h * line_no / n_lines as y0, y + h * (line_no + 1) / n_lines as y1, coalesce(confidence, 0) as conf from (select *, coalesce(sum(length(word) + 1) over (partition by region_uid, line_no order by word_no rows between unbounded preceding and 1 preceding), 0) + 1 as wpos from (select *, unnest(string_split(line, ' ')) as word, generate_subscripts(string_split(line, ' '), 1) - 1 as word_no from (select page_row_id, region_uid, x, y, w, h, confidence, len(string_split(text, chr(10))) as n_lines, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from "
    + _R
    + " r where text is not null and w > 0 and h > 0) a) c) b where word <> ''",
)
_d.add("words_to_lines", "regions", "with k as ({words}) select page_row_id, region_uid, cast(line_no as int) as line_no, {join} as line, round(min(x0), 3) as x, round(min(y0), 3) as y, round(max(x1) - min(x0), 3) as w, round(max(y1) - min(y0), 3) as h, round(sum(conf * greatest(1, length(word))) / sum(greatest(1, length(word))), 6) as confidence from k group by 1, 2, 3", words=_WORDS, join=("array_join(transform(array_sort(collect_list(struct(x0, word_no, word))), s -> s.word), ' ')", "string_agg(word, ' ' order by x0, word_no)"))
# lines from tops within 2.0 of the first word of the line: one fold that carries the anchor
_d.add(
    "lines_by_gap",
    "regions",
    f"""with a as (select page_row_id, transform(array_sort(collect_list(struct(round(y, 1) as r, x, region_uid, y))), s -> named_struct('u', s.region_uid, 'y', s.y, 'x', s.x)) as l from {_R} r where y is not null and x is not null group by 1),
f as (select page_row_id, inline(aggregate(l, named_struct('k', -1, 't', cast(0 as double), 'out', cast(array() as array<struct<u:bigint,k:int,x:double>>)), (s, e) -> if(s.k >= 0 and abs(e.y - s.t) <= 2.0, named_struct('k', s.k, 't', s.t, 'out', concat(s.out, array(named_struct('u', e.u, 'k', s.k, 'x', e.x)))), named_struct('k', s.k + 1, 't', e.y, 'out', concat(s.out, array(named_struct('u', e.u, 'k', s.k + 1, 'x', e.x))))), s -> s.out)) from a)
select page_row_id, k as line_no, u as region_uid, row_number() over (partition by page_row_id, k order by x, u) as place from f""",
    f"""with recursive o as (select page_row_id, region_uid, y, x, row_number() over (partition by page_row_id order by round(y, 1), x, region_uid) as i from {_R} r where y is not null and x is not null),
w as (select page_row_id, region_uid, x, i, 0 as k, y as t from o where i = 1 union all select o.page_row_id, o.region_uid, o.x, o.i, case when abs(o.y - w.t) <= 2.0 then w.k else w.k + 1 end, case when abs(o.y - w.t) <= 2.0 then w.t else o.y end from w join o on o.page_row_id = w.page_row_id and o.i = w.i + 1)
select page_row_id, k as line_no, region_uid, row_number() over (partition by page_row_id, k order by x, region_uid)::integer as place from w""",
)

# cells of ruled tables: the table that holds the centre of a cell, rows and columns by the edges of its cells
_CELLS = f"""select t.region_uid as table_uid, c.page_row_id, c.region_uid as cell_uid, c.x, c.y, c.w, c.h, coalesce(c.text, '') as text, t.x as tx, t.y as ty, dense_rank() over (partition by t.region_uid order by round(c.y / 12)) as r, dense_rank() over (partition by t.region_uid order by round(c.x / 12)) as k
 from (select * from {_R} r1 where kind = 'table' and w > 0 and h > 0) t join (select * from {_R} r2 where kind in ('table_cell', 'table_header') and w > 0 and h > 0) c on c.page_row_id = t.page_row_id and c.x + c.w / 2 between t.x and t.x + t.w and c.y + c.h / 2 between t.y and t.y + t.h"""
_d.add("table_fill", "regions", f"with c as ({_CELLS}) select table_uid, {{count}} as n_cells, count(case when length(trim(text)) > 0 then 1 end) as n_filled, round(1 - sum(case when length(trim(text)) > 0 then 0 else 1 end) / cast(count(*) as double), 6) as fill, round(greatest(0.4, least(1.0, sum(case when length(trim(text)) > 0 then 1 else 0 end) / cast(count(*) as double))), 6) as confidence from c group by 1")
_d.add("table_crops", "regions", f"select region_uid as table_uid, page_row_id, row_number() over (partition by page_row_id order by y, x, region_uid) as place, round(x, 2) as x, round(y, 2) as y, round(w, 2) as w, round(h, 2) as h from {_R} r where kind = 'table' and w >= 4 and h >= 4")
_d.add("cells_in_crop", "regions", f"with c as ({_CELLS}) select table_uid, cell_uid, round(x - tx, 3) as x, round(y - ty, 3) as y, round(w, 3) as w, round(h, 3) as h from c")
_d.add("tables_round_robin", "regions page_results", f"with p as (select page_row_id, document, count(*) over (partition by document) as n, row_number() over (partition by document order by page_index, page_row_id) - 1 as i from {_P} p0), t as (select p.document, p.n, r.region_uid, (row_number() over (partition by p.document order by p.i, r.y, r.x, r.region_uid) - 1) % p.n as i from {_R} r join p on p.page_row_id = r.page_row_id where r.kind = 'table') select t.document, t.region_uid, p.page_row_id as assigned_page from t join p on p.document = t.document and p.i = t.i")
_IX, _IY = "least(c.x + c.w, t.x + t.w) - greatest(c.x, t.x)", "least(c.y + c.h, t.y + t.h) - greatest(c.y, t.y)"
_d.add(
    "ruled_cells",
    "regions",
    f"""with c as (select * from {_R} a where kind in ('table_cell', 'table_header') and w > 0 and h > 0), t as (select * from {_R} b where kind in ('normal_text', 'kv_pair', 'table_cell') and w > 0 and h > 0 and length(trim(text)) > 0),
m as (select c.region_uid as cell_uid, t.y, t.x, t.region_uid, trim(t.text) as text, ({_IX}) * ({_IY}) / (c.w * c.h + t.w * t.h - ({_IX}) * ({_IY})) as iou from c join t on t.page_row_id = c.page_row_id and {_IX} > 0 and {_IY} > 0)
select cell_uid, {{join}} as text, {{count}} > 1 as multiline from m where iou > 0.05 group by 1""",
    join=("array_join(transform(array_sort(collect_list(struct(y, x, region_uid, text))), s -> s.text), ' ')", "string_agg(text, ' ' order by y, x, region_uid)"),
)
_d.add(
    "region_background",
    "regions",
    f"""with c as (select * from {_R} a where kind in {values(TEXT_TYPES)} and w > 0 and h > 0), t as (select * from {_R} b where kind in ('table', 'image', 'seal', 'watermark', 'logo') and w > 0 and h > 0),
m as (select c.region_uid, t.region_uid as behind_uid, ({_IX}) * ({_IY}) / (c.w * c.h) as part from c join t on t.page_row_id = c.page_row_id and {_IX} > 0 and {_IY} > 0 and c.region_uid <> t.region_uid)
select region_uid, behind_uid, round(part, 6) as part from (select *, row_number() over (partition by region_uid order by part desc, behind_uid) as n from m where part >= 0.5) q where n = 1""",
)
# lines of a grid: neighbouring distinct edges, crossed per table
_d.add(
    "line_grid",
    "regions",
    f"""with c as ({_CELLS}), ys as (select table_uid, y0, lead(y0) over (partition by table_uid order by y0) as y1 from (select distinct table_uid, round(y / 12) * 12 as y0 from c) a), xs as (select table_uid, x0, lead(x0) over (partition by table_uid order by x0) as x1 from (select distinct table_uid, round(x / 12) * 12 as x0 from c) b)
select ys.table_uid, xs.x0 as x, ys.y0 as y, xs.x1 - xs.x0 as w, ys.y1 - ys.y0 as h from ys join xs on xs.table_uid = ys.table_uid where ys.y1 is not null and xs.x1 is not null""",
)
# row and column bands make cells; a piece of text goes to the containing cell with the nearest centre
_d.add(
    "band_cells",
    "regions",
    f"""with c as ({_CELLS}), rb as (select table_uid, r, min(y) as y0, max(y + h) as y1 from c group by 1, 2), cb as (select table_uid, k, min(x) as x0, max(x + w) as x1 from c group by 1, 2),
g as (select rb.table_uid, r, k, x0, x1, y0, y1 from rb join cb on cb.table_uid = rb.table_uid where x1 > x0 and y1 > y0),
m as (select g.table_uid, g.r, g.k, c.cell_uid, c.x, trim(c.text) as text, row_number() over (partition by c.cell_uid, g.table_uid order by power((g.x0 + g.x1) / 2 - (c.x + c.w / 2), 2) + power((g.y0 + g.y1) / 2 - (c.y + c.h / 2), 2), g.r, g.k) as n from c join g on g.table_uid = c.table_uid and c.x + c.w / 2 between g.x0 and g.x1 and c.y + c.h / 2 between g.y0 and g.y1 where length(trim(c.text)) > 0)
select g.table_uid, cast(g.r as int) as row_no, cast(g.k as int) as col_no, coalesce(max(t.text), '') as text from g left join (select table_uid, r, k, {{join}} as text from m where n = 1 group by 1, 2, 3) t on t.table_uid = g.table_uid and t.r = g.r and t.k = g.k group by 1, 2, 3""",
    join=("array_join(transform(array_sort(collect_list(struct(x, cell_uid, text))), s -> s.text), ' ')", "string_agg(text, ' ' order by x, cell_uid)"),
)
_d.add(
    "densify_grid",
    "regions",
    f"""with c as ({_CELLS}), f as (select table_uid, r, k, text from (select *, row_number() over (partition by table_uid, r, k order by cell_uid) as n from c) q where n = 1), s as (select table_uid, max(r) as nr, max(k) as nk from c group by 1),
d as (select table_uid, nk, {{rows}} as r from s), e as (select table_uid, r, {{cols}} as k from d)
select e.table_uid, cast(e.r as int) as row_no, cast(e.k as int) as col_no, coalesce(f.text, '') as text from e left join f on f.table_uid = e.table_uid and f.r = e.r and f.k = e.k""",
    rows=("explode(sequence(1, nr))", "unnest(range(1, nr + 1))"), cols=("explode(sequence(1, nk))", "unnest(range(1, nk + 1))"),
)
# rows that hold several printed rows are split by the least number of line ends in their cells
_d.add(
    "split_merged_rows",
    "regions",
    f"""with c as ({_CELLS}), n as (select *, length(text) - length(replace(text, '\\n', '')) as nl from c), rk as (select table_uid, r, coalesce(min(case when nl > 0 and length(trim(text)) > 0 then nl end), 0) as s from n group by 1, 2),
o as (select table_uid, r, s, coalesce(sum(s) over (partition by table_uid order by r rows between unbounded preceding and 1 preceding), 0) as off from rk),
e as (select n.table_uid, n.cell_uid, n.k, n.text, cast(n.r - 1 + o.off as int) as base, cast(o.s as int) as s, case when length(trim(n.text)) = 0 then array('') else split(n.text, '\\n') end as parts from n join o on o.table_uid = n.table_uid and o.r = n.r),
x as (select *, explode(sequence(0, s)) as sub from e)
select table_uid, cell_uid, base + sub as row_no, cast(k as int) as col_no, case when s = 0 then trim(replace(text, '\\n', ' ')) when size(parts) <= 1 then case when sub = 0 then trim(parts[0]) else '' end when size(parts) = s + 1 then trim(parts[sub]) else array_join(filter(transform(slice(parts, sub * cast(ceil(size(parts) / (s + 1)) as int) + 1, cast(ceil(size(parts) / (s + 1)) as int)), p -> trim(p)), p -> p <> ''), ' ') end as text from x""",
    f"""with c as ({_CELLS}), n as (select *, length(text) - length(replace(text, chr(10), '')) as nl from c), rk as (select table_uid, r, coalesce(min(nl) filter (where nl > 0 and length(trim(text)) > 0), 0) as s from n group by 1, 2),
o as (select table_uid, r, s, coalesce(sum(s) over (partition by table_uid order by r rows between unbounded preceding and 1 preceding), 0) as off from rk),
e as (select n.table_uid, n.cell_uid, n.k, n.text, (n.r - 1 + o.off)::integer as base, o.s, case when length(trim(n.text)) = 0 then [''] else string_split(n.text, chr(10)) end as parts from n join o using (table_uid, r)),
x as (select *, unnest(range(0, s + 1)) as sub, ceil(len(parts) / (s + 1))::integer as chunk from e)
select table_uid, cell_uid, (base + sub)::integer as row_no, k::integer as col_no, case when s = 0 then trim(replace(text, chr(10), ' ')) when len(parts) <= 1 then case when sub = 0 then trim(parts[1]) else '' end when len(parts) = s + 1 then trim(parts[sub + 1]) else array_to_string(list_filter(list_transform(parts[sub * chunk + 1:(sub + 1) * chunk], lambda p: trim(p)), lambda p: p <> ''), ' ') end as text from x""",
)

# tables rebuilt from boxes alone
_C = f"c as (select page_row_id, region_uid, x, y, w, h, x + w / 2 as cx, y + h / 2 as cy, trim(text) as text from {_R} r where kind in {values(TEXT_TYPES)} and length(trim(text)) > 0 and w > 0 and h > 0), m as (select page_row_id, greatest(cast(1.0 as double), {Y_TOL} * median(h)) as yt, greatest(cast(1.0 as double), {X_TOL} * median(w)) as xt, {GAP} * median(h) as gap from c group by 1 having count(*) >= {LEAST})"
# rows: a region joins the last row while its centre is near the mean centre of that row
_ROWS = (
    "l as (select c.page_row_id, m.yt, array_sort(collect_list(struct(c.cy, c.region_uid))) as l from c join m on m.page_row_id = c.page_row_id group by 1, 2), rw as (select page_row_id, inline(aggregate(l, named_struct('t', cast(0 as double), 'n', 0, 'k', -1, 'out', cast(array() as array<struct<u:bigint,k:int>>)), (s, e) -> if(s.n > 0 and abs(s.t / s.n - e.cy) <= yt, named_struct('t', s.t + e.cy, 'n', s.n + 1, 'k', s.k, 'out', concat(s.out, array(named_struct('u', e.region_uid, 'k', s.k)))), named_struct('t', e.cy, 'n', 1, 'k', s.k + 1, 'out', concat(s.out, array(named_struct('u', e.region_uid, 'k', s.k + 1))))), s -> s.out)) from l)",
    "o as (select c.page_row_id, m.yt, c.cy, c.region_uid, row_number() over (partition by c.page_row_id order by c.cy, c.region_uid) as i from c join m using (page_row_id)), rc as (select page_row_id, region_uid as u, i, 0 as k, cy as t, 1 as n from o where i = 1 union all select o.page_row_id, o.region_uid, o.i, case when abs(rc.t / rc.n - o.cy) <= o.yt then rc.k else rc.k + 1 end, case when abs(rc.t / rc.n - o.cy) <= o.yt then rc.t + o.cy else o.cy end, case when abs(rc.t / rc.n - o.cy) <= o.yt then rc.n + 1 else 1 end from rc join o on o.page_row_id = rc.page_row_id and o.i = rc.i + 1), rw as (select page_row_id, u, k from rc)",
)
_TABLES = f"""q as (select rw.page_row_id, rw.k, count(*) as n, avg(c.cy) as my from rw join c on c.region_uid = rw.u and c.page_row_id = rw.page_row_id group by 1, 2 having count(*) >= {ROW}),
i as (select q.*, sum(case when abs(my - pm) <= gap then 0 else 1 end) over (partition by page_row_id order by k rows between unbounded preceding and current row) as tb from (select q.page_row_id, q.k, q.n, q.my, m.gap, lag(q.my) over (partition by q.page_row_id order by q.k) as pm from q join m on m.page_row_id = q.page_row_id) q),
tt as (select page_row_id, tb, count(*) as n_rows from i group by 1, 2 having count(*) >= {ROWS}),
ir as (select i.*, tt.n_rows, row_number() over (partition by i.page_row_id, i.tb order by i.my, i.k) - 1 as row_no, row_number() over (partition by i.page_row_id, i.tb order by i.n desc, i.k) as big from i join tt on tt.page_row_id = i.page_row_id and tt.tb = i.tb),
cc as (select ir.page_row_id, ir.tb, c.cx, row_number() over (partition by ir.page_row_id, ir.tb order by c.cx, c.region_uid) - 1 as col_no, ir.n as n_cols from ir join rw on rw.page_row_id = ir.page_row_id and rw.k = ir.k join c on c.region_uid = rw.u and c.page_row_id = rw.page_row_id where ir.big = 1),
ce as (select ir.page_row_id, ir.tb, ir.row_no, ir.n_rows, cc.n_cols, cc.col_no, c.region_uid, c.text, abs(cc.cx - c.cx) as dist, m.xt, row_number() over (partition by ir.page_row_id, c.region_uid order by abs(cc.cx - c.cx), cc.col_no) as near from ir join rw on rw.page_row_id = ir.page_row_id and rw.k = ir.k join c on c.region_uid = rw.u and c.page_row_id = rw.page_row_id join cc on cc.page_row_id = ir.page_row_id and cc.tb = ir.tb join m on m.page_row_id = ir.page_row_id)
select page_row_id, cast(tb as int) as table_no, cast(row_no as int) as row_no, cast(col_no as int) as col_no, cast(n_rows as int) as n_rows, cast(n_cols as int) as n_cols, region_uid, text from ce where near = 1 and dist <= 2 * xt"""
_d.add("custom_table_rows", "regions", f"with recursive {_C}, {{rows}}, {_TABLES}", rows=_ROWS)
_d.add("row_clusters", "regions", f"with recursive {_C}, {{rows}} select page_row_id, cast(k as int) as row_no, u as region_uid from rw", rows=_ROWS)
# pairs of a key and the nearest value to its right on the line; a key or value already taken is no key again
_KV = (
    f"l as (select c.page_row_id, m.xt, m.yt, array_sort(collect_list(struct(c.cy, c.region_uid, c.x, c.w, c.cx))) as l from c join m on m.page_row_id = c.page_row_id group by 1, 2, 3), b as (select page_row_id, transform(l, (e, i) -> named_struct('u', e.region_uid, 'v', array_min(transform(filter(slice(l, i + 2, size(l)), g -> abs(g.cy - e.cy) <= yt and g.x > e.x + e.w + xt * 0.2D), g -> named_struct('x', g.x, 'cy', g.cy, 'u', g.region_uid))).u)) as l from l), pr as (select page_row_id, inline(aggregate(l, named_struct('used', cast(array() as array<bigint>), 'out', cast(array() as array<struct<kk:bigint,vv:bigint>>)), (s, e) -> if(e.v is null or array_contains(s.used, e.u), s, named_struct('used', concat(s.used, array(e.u, e.v)), 'out', concat(s.out, array(named_struct('kk', e.u, 'vv', e.v))))), s -> s.out)) from b)",
    "o as (select c.page_row_id, m.yt, m.xt, c.cy, c.region_uid, c.x, c.w, row_number() over (partition by c.page_row_id order by c.cy, c.region_uid) as i from c join m using (page_row_id)), bb as (select a.page_row_id, a.i, a.region_uid as u, arg_min(g.region_uid, (g.x, g.cy, g.region_uid)) as v from o a left join o g on g.page_row_id = a.page_row_id and g.i > a.i and abs(g.cy - a.cy) <= a.yt and g.x > a.x + a.w + a.xt * 0.2 group by 1, 2, 3), pc as (select page_row_id, i, case when v is null then []::bigint[] else [u, v] end as used, case when v is not null then u end as kk, v as vv from bb where i = 1 union all select bb.page_row_id, bb.i, case when bb.v is null or list_contains(pc.used, bb.u) then pc.used else list_concat(pc.used, [bb.u, bb.v]) end, case when bb.v is null or list_contains(pc.used, bb.u) then null else bb.u end, bb.v from pc join bb on bb.page_row_id = pc.page_row_id and bb.i = pc.i + 1), pr as (select page_row_id, kk, vv from pc where kk is not null)",
)
_KV_TABLE = f"""pp as (select pr.page_row_id, pr.kk, pr.vv, a.cx as kx, b.cx as vx, a.cy as ky, a.text as kt, b.text as vt from pr join c a on a.page_row_id = pr.page_row_id and a.region_uid = pr.kk join c b on b.page_row_id = pr.page_row_id and b.region_uid = pr.vv),
pm as (select page_row_id, median(kx) as km, median(vx) as vm from pp group by 1 having count(*) >= {PAIRS}),
ok as (select pp.* from pp join pm on pm.page_row_id = pp.page_row_id join m on m.page_row_id = pp.page_row_id where abs(kx - km) <= xt * 1.5 and abs(vx - vm) <= xt * 3), en as (select page_row_id from ok group by 1 having count(*) >= {PAIRS})
select ok.page_row_id, cast(row_number() over (partition by ok.page_row_id order by ky, kk) - 1 as int) as row_no, kk as key_uid, vv as value_uid, kt as key_text, vt as value_text from ok join en on en.page_row_id = ok.page_row_id"""
_d.add("custom_table_pairs", "regions", f"with recursive {_C}, {{pairs}}, {_KV_TABLE}", pairs=_KV)
_d.add(
    "custom_table_status",
    "regions page_results",
    f"with recursive {_C}, {{rows}}, {{pairs}}, ho as (select distinct page_row_id from ({_TABLES.replace('select page_row_id, cast(tb as int)', 'select page_row_id, cast(tb as int)')}) z), ve as (select distinct page_row_id from ({_KV_TABLE}) z)".replace("ho as (select distinct page_row_id from (q as", "ho as (select distinct page_row_id from (with q as").replace("ve as (select distinct page_row_id from (pp as", "ve as (select distinct page_row_id from (with pp as")
    + f" select p.page_row_id, case when n.n is null then 'na_missing_bbox' when n.n < {LEAST} or (ho.page_row_id is null and ve.page_row_id is null) then 'not_found' else 'ok' end as status from {_P} p left join (select page_row_id, count(*) as n from c group by 1) n on n.page_row_id = p.page_row_id left join ho on ho.page_row_id = p.page_row_id left join ve on ve.page_row_id = p.page_row_id",
    rows=_ROWS, pairs=(_KV[0].replace("l as (", "l2 as (", 1).replace("as l from l)", "as l from l2)"), _KV[1].replace("o as (", "o2 as (", 1).replace("from o a left join o g", "from o2 a left join o2 g")),
)
