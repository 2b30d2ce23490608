"""Cases that a table query left out once."""

import duckdb

from sheafwork.plans import table_plans


def _both(spark, folder, name, *tables):
    """Rows of the query, which its SQL gives as well."""
    got = sorted(map(tuple, table_plans.QUERIES[name](spark, str(folder)).collect()), key=str)
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    assert got == sorted(con.execute(table_plans.ORACLES[name]).fetchall(), key=str)
    return got


def test_boxes_of_spans_anywhere_on_the_page(spark, tmp_path):
    box = "bbox struct<x double, y double, w double, h double>"
    rows = [(1, 7, "text", (0.0, 0.0, 100.0, 10.0), "x" * 100, 0.9), (2, 7, "text", (0.0, 20.0, 200.0, 10.0), "to ann@post.example now", 0.9), (2, 7, "text", (0.0, 20.0, 200.0, 10.0), "to ann@post.example now", 0.9)]
    spark.createDataFrame(rows, f"region_uid long, page_row_id long, region_type string, {box}, text string, confidence double").write.parquet(f"{tmp_path}/regions.parquet")
    got = _both(spark, tmp_path, "char_to_bbox_spans", "regions")
    # 16 of 23 characters from the fourth on
    assert got == [(7, "email", 104, 120, 26.087, 20.0, 139.1304, 10.0)]


def test_all_runs_are_compared(spark, tmp_path):
    rows = [(1, "r3", "A", 0.5, 1, "2024-01-01"), (2, "r1", "A", 0.75, 3, "2024-01-02"), (3, "r1", "B", 0.5, 1, "2024-01-02"), (4, "r2", "B", 0.25, 1, "2024-01-03"), (4, "r2", "B", 0.25, 1, "2024-01-03"), (5, "r9", "C", None, None, "2024-01-04")]
    d = spark.createDataFrame(rows, "page_row_id long, run_id string, solution string, confidence double, n_tables int, t string").selectExpr("*", "' uploads/D.pdf' as document_id", "timestamp(t) as created_at")
    d.write.parquet(f"{tmp_path}/page_results.parquet")
    got = _both(spark, tmp_path, "run_diff_all", "page_results")
    assert got == sorted([("d", "r3", "r1", "A", "both", 0.25, 2.0), ("d", "r3", "r1", "B", "b", None, None), ("d", "r1", "r2", "A", "a", None, None), ("d", "r1", "r2", "B", "both", -0.25, 0.0), ("d", "r2", "r9", "B", "a", None, None), ("d", "r2", "r9", "C", "b", None, None)], key=str)
