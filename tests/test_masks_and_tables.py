"""Masks, stand-ins, scoring, search and rebuilt tables on small fixtures with known answers."""

import duckdb
from pyspark.sql import functions as F

from sheafwork.operators import evaluate, masking, search, span_algebra
from sheafwork.plans import layout_plans

SPANS = "doc_id long, start_pos int, end_pos int, entity_type string, score double"


def test_masks_in_a_text(spark):
    text = "Ann Lee, a.b@c.org, 12-34-56 é😀"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    spans = spark.createDataFrame([(1, 0, 7, "PERSON", 0.9), (1, 9, 18, "EMAIL_ADDRESS", 0.9), (1, 12, 18, "URL", 0.5), (1, 20, 28, "UK_SORT_CODE", 0.7)], SPANS)
    rows = masking.replaced(docs, spans, "doc_id", masking.default_sql())
    out = {r["doc_id"]: r for r in masking.applied(docs, rows, "doc_id").collect()}
    assert out[1]["new_text"] == "<PERSON>, a**@c.org, 12****56 é😀" and out[1]["n"] == 3
    assert out[2]["new_text"] is None and out[3]["new_text"] == ""
    for s in out[1]["spans"]:
        new = out[1]["new_text"][s["new_start"] : s["new_end"]]
        assert len(new) == s["new_end"] - s["new_start"] and (new.startswith("<") or "*" in new)


def test_edge_masks(spark):
    rows = spark.createDataFrame([("X", "@host.org"), ("X", "abcd"), ("X", ""), ("X", "abcdefghij")], "entity_type string, value string")
    assert [r[0] for r in rows.select(F.expr(masking.mask_sql("partial"))).collect()] == ["*@host.org", "****", "", "ab******ij"]


def test_stand_ins_keep_length_and_class(spark):
    values = [("UK_NATIONAL_INSURANCE_NUMBER", "AB 12 34 56 C"), ("UK_IBAN", "GB82 WEST 1234"), ("URL", "https://a.b/x9"), ("EMAIL_ADDRESS", "Ab.c@X.uk"), ("PERSON", "Zoë O'Neil"), ("DATE", "01/02/2003")]
    df = spark.createDataFrame(values, "entity_type string, value string")
    got = [tuple(r) for r in df.select("entity_type", "value", F.expr(masking.mock_sql("r"))).collect()]
    con = duckdb.connect()
    for kind, value, mock in got:
        assert len(mock) == len(value)
        assert all((a.isdigit() == b.isdigit()) and (a.isalpha() == b.isalpha()) for a, b in zip(value, mock))
        assert con.execute(f"select {masking.mock_sql('r', 1)} from (select ? as entity_type, ? as value)", [kind, value]).fetchone()[0] == mock
    by = {k: m for k, _, m in got}
    assert by["UK_IBAN"].startswith("GB") and by["URL"].startswith("https://") and "@" == by["EMAIL_ADDRESS"][4]
    nino = by["UK_NATIONAL_INSURANCE_NUMBER"]
    assert nino[:2] not in ("BG", "GB", "KN", "NK", "NT", "TN", "ZZ") and nino[-1] in "ABCD"


def test_merge_is_the_same_in_sql(spark):
    kinds = ["PERSON", "UK_POSTCODE", "UK_ADDRESS", "EMAIL_ADDRESS", "HEALTH_INFORMATION"]
    rows = [(d, (d * 7 + i * 3) % 15, (d * 7 + i * 3) % 15 + 1 + (d + i * i) % 7, kinds[(d + i) % 5], [0.5, 0.7, 0.9][(d * i) % 3], i) for d in range(60) for i in range(d % 7)]
    df = spark.createDataFrame(rows, SPANS + ", place int")
    got = sorted(tuple(r) for r in span_algebra.merged(df, "doc_id").collect())
    con = duckdb.connect()
    con.register("found", df.toPandas())
    want = sorted(con.execute(span_algebra.merged_sql("select * from found", "doc_id")).fetchall())
    assert got == [(r[0], *r[1:]) for r in want]


def test_partial_scoring_takes_the_first_free(spark):
    assert evaluate.paired([(0, 5, "A"), (3, 9, "A"), (3, 9, "B")], [(4, 6, "A"), (0, 1, "A")]) == [0, -1, -1]
    schema = "item long, place int, start_pos int, end_pos int, entity_type string"
    pred = spark.createDataFrame([(1, 0, 0, 5, "A"), (3, 0, 0, 2, "A")], schema)
    gold = spark.createDataFrame([(1, 0, 4, 9, "A"), (2, 0, 0, 1, "A")], schema)
    got = {(r["item"], r["side"]) for r in evaluate.partial(pred, gold, "item").collect()}
    assert got == {(1, "tp"), (2, "fn"), (3, "fp")}
    empty = spark.createDataFrame([], schema)
    assert evaluate.partial(empty, empty, "item").count() == 0


def test_search_over_pages(spark):
    pages = spark.createDataFrame([("d", 1, "Ann Smith wrote. Smith, not Smithson."), ("d", 2, "ann smith again; C++ (x)"), ("e", 3, "Ann Smith"), ("d", 4, None)], "document string, page long, text string")
    ents = spark.createDataFrame([("d/x", "d", 1, 1, "PERSON", "Ann Smith", 0, 9, 0.8), ("d/x", "d", 1, 2, "CODE", "C++", -1, -1, 0.5)], "cell string, document string, page long, rank long, entity_type string, value string, start_pos int, end_pos int, score double")
    got = {(r["page"], r["start_pos"], r["value"], r["score"]) for r in search.parts(ents, pages).collect()}
    assert got == {(1, 17, "Smith", 0.64)}
    got = {(r["page"], r["start_pos"], r["value"]) for r in search.repeats(ents, pages).collect()}
    assert (2, 0, "ann smith") in got and all(page != 3 for page, *_ in got)
    marks = spark.createDataFrame([("d", 1, "PERSON", "ANN SMITH", 7), ("d", 2, "PERSON", "Bo", 8), ("d", 2, "PERSON", " ", 9)], "document string, page long, entity_type string, value string, mark_id long")
    got = sorted((r["value"], r["discovery"]) for r in search.overlay(ents, marks).collect())
    assert got == [("Ann Smith", "both"), ("Bo", "manual_only"), ("C++", "lib")]


def _regions(spark, tmp_path, rows):
    box = "struct<x:double,y:double,w:double,h:double,page_index:int,coord_space:string>"
    df = spark.createDataFrame([(u, p, k, (x, y, w, h, 0, "image_px@300"), t, 0.9, "t") for u, p, k, x, y, w, h, t in rows], f"region_uid long, page_row_id long, region_type string, bbox {box}, text string, confidence double, source_tool string")
    df.write.mode("overwrite").parquet(str(tmp_path / "regions.parquet"))
    con = duckdb.connect()
    con.execute(f"create view regions as select * from read_parquet('{tmp_path}/regions.parquet/*.parquet')")
    return con


def _agree(spark, con, tmp_path, name):
    got = sorted(tuple(map(str, r.asDict().values())) for r in layout_plans.QUERIES[name](spark, str(tmp_path)).collect())
    assert got == sorted(tuple(map(str, r)) for r in con.execute(layout_plans.ORACLES[name]).fetchall())
    return layout_plans.QUERIES[name](spark, str(tmp_path)).collect()


def test_a_table_from_boxes_alone(spark, tmp_path):
    rows = [(r * 10 + c, 1, "normal_text", 100.0 + 200 * c + r, 100.0 + 30 * r, 80.0, 20.0, f"r{r}c{c}") for r in range(3) for c in range(3)]
    con = _regions(spark, tmp_path, rows + [(99, 2, "image", 0.0, 0.0, 5.0, 5.0, None)])
    cells = _agree(spark, con, tmp_path, "custom_table_rows")
    assert {(c["row_no"], c["col_no"], c["text"]) for c in cells} == {(r, c, f"r{r}c{c}") for r in range(3) for c in range(3)}


def test_pairs_of_keys_and_values(spark, tmp_path):
    rows = [(r * 10 + c, 1, "kv_pair", 100.0 + 300 * c, 100.0 + 60 * r, 90.0, 20.0, f"{'kv'[c]}{r}") for r in range(4) for c in range(2)]
    con = _regions(spark, tmp_path, rows)
    pairs = _agree(spark, con, tmp_path, "custom_table_pairs")
    assert [(p["row_no"], p["key_text"], p["value_text"]) for p in sorted(pairs, key=lambda p: p["row_no"])] == [(r, f"k{r}", f"v{r}") for r in range(4)]


def test_merged_rows_are_split(spark, tmp_path):
    rows = [(1, 1, "table", 0.0, 0.0, 400.0, 200.0, None), (2, 1, "table_cell", 10.0, 10.0, 50.0, 20.0, "a\nb"), (3, 1, "table_cell", 110.0, 10.0, 50.0, 20.0, "16\nJun\n17\nJul"), (4, 1, "table_cell", 210.0, 10.0, 50.0, 20.0, "one"), (5, 1, "table_cell", 10.0, 60.0, 50.0, 20.0, "c")]
    con = _regions(spark, tmp_path, rows)
    got = {(r["row_no"], r["col_no"], r["text"]) for r in _agree(spark, con, tmp_path, "split_merged_rows")}
    assert got == {(0, 1, "a"), (1, 1, "b"), (0, 2, "16 Jun"), (1, 2, "17 Jul"), (0, 3, "one"), (1, 3, ""), (2, 1, "c")}


def test_lines_by_gap_anchor_on_the_first_word(spark, tmp_path):
    rows = [(i, 1, "normal_text", 10.0 * i, y, 5.0, 5.0, "w") for i, y in enumerate((10.0, 11.5, 12.5, 13.9))]
    con = _regions(spark, tmp_path, rows)
    assert {(r["region_uid"], r["line_no"]) for r in _agree(spark, con, tmp_path, "lines_by_gap")} == {(0, 0), (1, 0), (2, 1), (3, 1)}
