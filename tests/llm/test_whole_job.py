"""Cases that an operator left out once."""

from sheafwork.llm import linkage, scans


def test_misreadings_of_any_kind(spark):
    often = ["amount", "corner", "vehicle", "décembre", "prüfung", "office", "to"]
    texts = [" ".join(often)] * 60 + ["emount comer vehide d6cembre priifung ofﬁce"] + ["do"] * 6
    counts = scans.word_counts(spark.createDataFrame([(t,) for t in texts], "full_text string"))
    got = {r["word"]: r["candidates"][0]["word"] for r in scans.misreadings(counts, next(scans.vocabulary(counts))).collect()}
    for limit in (2, 300):  # several small tries find what one finds
        trusted, wrong = scans._lexicon(spark.createDataFrame([(t,) for t in texts], "full_text string"), limit)
        assert {r["word"]: r["candidates"][0]["word"] for r in wrong.collect()} == got
    assert got == {"emount": "amount", "comer": "corner", "vehide": "vehicle", "d6cembre": "décembre", "priifung": "prüfung", "ofﬁce": "office"}


BOX = "x double, y double, w double, h double, page_index int, coord_space string"


def _linked(spark, regions, sheets):
    r = spark.createDataFrame(regions, f"region_uid long, page_row_id long, region_type string, bbox struct<{BOX}>, text string")
    q = spark.createDataFrame(sheets, f"rescan_uid long, sheet_ref string, region_label string, bbox struct<{BOX}>, text string")
    return {(x["region_uid"], x["rescan_uid"]) for x in linkage.linked(r, q).collect()}


def test_linkage_by_frequent_attributes_and_words(spark):
    def page(uid, page, y, text):
        return (uid, page, "text", (200.0, y, 900.0, 50.0, 0, "image_px@300"), text)

    def sheet(uid, ref, y, text):
        return (uid, ref, "text", (200.0, y, 900.0, 50.0, 0, "image_px@300"), text)

    regions = [page(p * 10 + 1, p, 300.0, f"Case HZ-640-95{p % 3}") for p in range(1, 10)] + [page(p * 10 + 2, p, 500.0, f"Form QK-120-77{p // 3}") for p in range(1, 10)]
    regions += [page(501, 50, 300.0, "the kestrel lamp over harbour gate")]
    # 's' meets page 4 by two numbers that three pages each have, 't' meets page 50 by words alone
    sheets = [sheet(1001, "s", 300.0, "Case HZ-640-951"), sheet(1002, "s", 500.0, "Form QK-120-771"), sheet(1003, "t", 300.0, "the kestrel lamp over harbour gate")]
    assert _linked(spark, regions, sheets) >= {(41, 1001), (42, 1002), (501, 1003)}


def test_regions_are_repaired_too(spark):
    body = "the records team kept every letter of the matter"
    pages = [(p, "doc", p, f"Harbour Desk\n{body}\nthe rec-\nords team\n7\n{p + 1}") for p in range(6)]
    regions = [(10 * p + k, p, (0.0, 10.0 * k, 9.0, 9.0), t) for p in range(6) for k, t in enumerate(["Harbour Desk", body, "the rec-\nords team", "7", f"{p + 1}"])] + [(99, 0, (0.0, 15.0, 9.0, 9.0), None)]
    p = spark.createDataFrame(pages, "page_row_id long, document_id string, page_index int, full_text string")
    r = spark.createDataFrame(regions + regions[:1], "region_uid long, page_row_id long, bbox struct<x double, y double, w double, h double>, text string")
    got = {x["region_uid"]: x["text"] for x in scans.repaired_regions(p, r).collect()}
    assert len(got) == 31 and got[99] is None
    assert [got[k] for k in (10, 11, 12, 14)] == ["", body, "the records team", ""]


def test_linkage_takes_the_units_of_the_sheet(spark):
    regions = [(1, 10, "text", (200.0, 300.0, 900.0, 50.0, 0, "image_px@300"), "Our ref.: HZ-640-950"), (2, 10, "text", (200.0, 2600.0, 900.0, 50.0, 0, "image_px@300"), "Closing words")]
    # the attribute is on a row without unit, another row of the sheet tells it
    sheet = [(91, "s", "text", (48.0, 72.0, 216.0, 12.0, 4, None), "Our ref.: HZ-640-950"), (92, "s", "text", (48.0, 624.0, 216.0, 12.0, 4, "pdf_pt"), "Closing words")]
    assert _linked(spark, regions, sheet) == {(1, 91), (2, 92)}
    # no row tells it: the boxes fit the smallest page of 595 by 842 points
    assert _linked(spark, regions, [(91, "s", "text", (48.0, 72.0, 216.0, 12.0, 4, None), "Our ref.: HZ-640-950"), (92, "s", "text", (48.0, 624.0, 216.0, 12.0, 4, None), "Closing words")]) == {(1, 91), (2, 92)}
