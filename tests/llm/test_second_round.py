"""List levels, linkage without products, shards filled to their quotas, long groups."""

import datetime

from pyspark.sql import functions as F

from sheafwork.llm import linkage, mixing, sentences, survivors


def _units(text):
    return [text[a:b] for a, b in sentences.sentences(text)]


def test_nested_lists():
    assert _units("1. First item. More.\n   - sub one\n   - sub two\n2. Second item.") == ["1. First item.", "More.", "- sub one", "- sub two", "2. Second item."]
    assert _units("- a\n  1. b\n  2. c\n- d") == ["- a", "1. b", "2. c", "- d"]
    assert _units("To do:\n* one\n* two") == ["To do:", "* one", "* two"]
    assert _units("a) x\n  - y\nb) z\n7) stray") == ["a) x", "- y", "b) z\n7) stray"]
    assert _units("Text goes on\n- not an item") == ["Text goes on\n- not an item"]


BOX = "struct<x:double,y:double,w:double,h:double,page_index:int,coord_space:string>"


def _sides(spark, pages, sheets):
    regions = spark.createDataFrame(pages, f"region_uid long, page_row_id long, region_type string, bbox {BOX}, text string")
    rescans = spark.createDataFrame(sheets, f"rescan_uid long, sheet_ref string, region_label string, bbox {BOX}, text string, batch_id string")
    return regions, rescans


def _page(i, text, y=500.0, uid=0):
    return (i * 10 + uid, i, "normal_text", (200.0, y, 900.0, 40.0, 0, "image_px@300"), text)


def _sheet(i, text, y=500.0, uid=0, name=None):
    return (10**6 + i * 10 + uid, name or f"s{i}", "text", (100.0, y / 2 + 4, 450.0, 20.0, 0, "image_px@150"), text, "b")


LETTERHEAD = "Registered office 118290 and licence 447120 of the bank"


def test_a_shared_letterhead_makes_no_product(spark):
    n = 60
    pages = [_page(i, LETTERHEAD, 100.0, 1) for i in range(n)] + [_page(i, f"Account {70000000 + i * 7919} closed", 500.0, 2) for i in range(n)]
    sheets = [_sheet(i, LETTERHEAD, 100.0, 1) for i in range(n)] + [_sheet(i, f"Account {70000000 + i * 7919} closed", 500.0, 2) for i in range(n)]
    regions, rescans = _sides(spark, pages, sheets)
    edges = linkage.candidate_edges(linkage.page_elements(regions), linkage.in_pixels(linkage.sheet_elements(rescans)))
    assert edges.count() == n
    got = {(r["region_uid"], r["rescan_uid"]) for r in linkage.linked(regions, rescans).collect()}
    assert got == {(i * 10 + u, 10**6 + i * 10 + u) for i in range(n) for u in (1, 2)}


def test_only_a_letterhead_makes_no_product(spark):
    regions, rescans = _sides(spark, [_page(i, LETTERHEAD, 100.0) for i in range(40)], [_sheet(i, LETTERHEAD, 100.0) for i in range(40)])
    assert linkage.candidate_edges(linkage.page_elements(regions), linkage.in_pixels(linkage.sheet_elements(rescans))).count() == 0


def test_a_sheet_of_two_pages_keeps_both(spark):
    pages = [_page(1, "Policy 90817263 of the claim", 300.0), _page(2, "Payment 55443322 was returned", 1800.0)]
    sheets = [_sheet(1, "Policy 90817263 of the claim", 300.0, 1, "s"), _sheet(1, "Payment 55443322 was returned", 1800.0, 2, "s")]
    got = {(r["region_uid"], r["rescan_uid"]) for r in linkage.linked(*_sides(spark, pages, sheets)).collect()}
    assert got == {(10, 10**6 + 11), (20, 10**6 + 12)}


def test_neighbours_settle_a_tie(spark):
    rows = [("s1", "p1", 5.0, 1, 1, "d"), ("s2", "p2", 3.0, 2, 2, "d"), ("s2", "q2", 3.0, 2, 7, "e"), ("s3", "p3", 5.0, 3, 3, "d")]
    df = spark.createDataFrame(rows, "sheet string, page string, total double, at int, no int, doc string").withColumn("batch", F.lit("b"))
    share = {(r["sheet"], r["page"]): r["share"] for r in linkage.settled(df).collect()}
    assert share["s2", "p2"] > 0.6 and abs(share["s2", "p2"] + share["s2", "q2"] - 1) < 1e-9 and share["s1", "p1"] == share["s3", "p3"] == 1.0


def test_shards_hold_their_quotas(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 5 == 0, "a").otherwise("b").alias("source"), F.lit("some words of text here").alias("text"))
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    kw = {"block": 60, "shards": 8}
    drawn = mixing.mixed(docs, targets, **kw)
    want = {(r["shard"], r["source"]): r["blocks"] for r in mixing.quotas(docs, targets, **kw).collect()}
    got = {(r["shard"], r["source"]): r["t"] / 60 for r in drawn.groupBy("shard", "source").agg(F.sum("n_tokens").alias("t")).collect()}
    assert all(abs(got.get(k, 0) - n) <= 1.5 for k, n in want.items() if n)
    assert drawn.groupBy("doc_id").count().agg(F.max("count")).head()[0] <= 2
    assert drawn.groupBy("doc_id", "copy").count().where("count > 1").count() == 0


def test_a_field_that_none_has_peels_nothing(spark):
    day = datetime.datetime(2024, 1, 1)
    rows = [(i, "k", i / 10, day + datetime.timedelta(days=i), None, "v" if i == 3 else None) for i in range(9)]
    df = spark.createDataFrame(rows, "id long, k string, t double, at timestamp, never string, rare string")
    policy = survivors.Policy(F.lit(1), F.col("t"), F.col("at"), F.col("at"), "id")
    small = survivors.survivors(df, ["k"], policy, ["never", "rare"]).collect()
    large = survivors.survivors(df, ["k"], policy, ["never", "rare"], in_row=2).collect()
    assert [tuple(r) for r in small] == [tuple(r) for r in large] and small[0]["rare"] == "v" and small[0]["never"] is None
