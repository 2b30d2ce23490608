"""Sources, sinks, detectors and streams on small made folders."""

import json

import pytest
from pyspark.sql import functions as F

from sheafwork.operators import detectors, dictionary, recognise
from sheafwork.sources import readers
from sheafwork.streaming import progress

TEXTS = [(1, "call 12345678 or a@b.co"), (2, ""), (3, None)]


def test_records_and_damaged_lines(spark, tmp_path):
    p = tmp_path / "g.jsonl"
    p.write_text(json.dumps({"id": "a", "text": "x", "entities": [{"entity_type": "PERSON", "start": 0, "end": 1, "text": "x"}]}) + "\n\n{broken\n")
    assert [r["id"] for r in readers.gold_jsonl(spark, str(p)).collect() if r["id"]] == ["a"]
    assert readers.line_count(spark, str(p)) == 2


def test_listing_and_states(spark, tmp_path):
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "x.pdf").write_bytes(b"12345")
    row = readers.list_documents(spark, {"upload": str(tmp_path / "up")}).head()
    assert (row["document_id"], row["size_bytes"], row["source"]) == ("upload:x.pdf", 5, "upload")
    (tmp_path / "runs" / "r1").mkdir(parents=True)
    (tmp_path / "runs" / "r1" / "run.json").write_text('{"run_id": "r1",\n "status": "done"}')
    row = readers.run_states(spark, str(tmp_path / "runs"), "run_id string, status string").head()
    assert row["run_id"] == "r1" and row["path"].endswith("run.json")


def test_sinks(spark, tmp_path):
    spans = spark.createDataFrame([("a", 0, 1, "PERSON", 0.5)], "record_id string, start_pos int, end_pos int, entity_type string, score double")
    readers.write_predictions(spans, str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p")).head()["predictions"][0]["entity_type"] == "PERSON"
    readers.write_errors(spans, str(tmp_path / "e"))
    assert spark.read.option("header", True).csv(str(tmp_path / "e")).columns == list(readers.ERROR_COLUMNS)
    mapping = spark.createDataFrame([("PERSON", "Abc", "Ann")], "entity_type string, mock string, original string")
    with pytest.raises(ValueError):
        readers.write_mapping(mapping, str(tmp_path / "m"), "")
    readers.write_mapping(mapping, str(tmp_path / "m"), "0123456789abcdef")
    assert spark.read.parquet(str(tmp_path / "m")).head()["original"] != "Ann"
    assert readers.read_mapping(spark, str(tmp_path / "m"), "0123456789abcdef").head()["original"] == "Ann"
    rows = readers.producer_rows(spark.range(2).withColumnRenamed("id", "page_row_id"))
    assert rows.count() == 2 * len(readers.PRODUCERS) and rows.where("status = 'skipped' and reason = ''").count() == 0


def test_detectors(spark):
    texts = spark.createDataFrame(TEXTS, "doc_id long, text string")
    assert {r["entity_type"] for r in detectors.detect("presidio_regex", texts, "doc_id").collect()} == {"UK_BANK_ACCOUNT_NUMBER", "EMAIL_ADDRESS"}
    assert {r["status"] for r in detectors.detect("gliner", texts, "doc_id").collect()} == {"fallback"}
    with pytest.raises(ValueError):
        detectors.detect("nobody", texts, "doc_id")

    def predict(t):
        if "call" in t:
            return [("PERSON", 0, 4, 0.9)]
        raise RuntimeError("no")

    got = detectors.guarded(texts.union(spark.createDataFrame([(4, "zz")], "doc_id long, text string")), "doc_id", predict).collect()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["entity_type"] == "PERSON" and by[2]["entity_type"] is None and by[3]["error"] is None and by[4]["error"].startswith("RuntimeError")
    model = spark.createDataFrame([(1, "PERSON", 0, 4, 0.9), (1, "EMAIL_ADDRESS", 17, 23, 0.5)], "doc_id long, entity_type string, start_pos int, end_pos int, score double")
    assert {(r["entity_type"], r["start_pos"]) for r in detectors.hybrid(texts, "doc_id", [model]).collect()} == {("PERSON", 0), ("UK_BANK_ACCOUNT_NUMBER", 5), ("EMAIL_ADDRESS", 17)}


def test_streams(spark, tmp_path):
    schema = "document_id string, page_index int, run_id string, page_row_id long, text string"
    spark.createDataFrame([("d", 0, "r", 1, "Ann Lee"), ("d", 1, "r", 2, "nobody"), ("d", 2, "q", 3, "ann lee")], schema).write.parquet(str(tmp_path / "in"))
    pages = progress.page_stream(spark, str(tmp_path / "in"), schema)
    done = spark.createDataFrame([("d", 1)], "document_id string, page_index int")
    runs = spark.createDataFrame([("r", "partial"), ("q", "running")], "run_id string, status string")
    wanted = progress.ready(progress.unfinished(pages, done), runs)
    entries = spark.createDataFrame([("PERSON", "Ann Lee")], "entity_type string, value string")
    find = lambda batch, known: dictionary.spans(batch, "page_row_id", known)
    writer = progress.detected(wanted, lambda: entries, find, str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c1"))
    writer.trigger(availableNow=True).start().awaitTermination(90)
    assert [(r["page_row_id"], r["value"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, "Ann Lee")]
    writer = progress.snapshots(pages, str(tmp_path / "snap"), "run_id").option("checkpointLocation", str(tmp_path / "c2"))
    writer.trigger(availableNow=True).start().awaitTermination(90)
    assert spark.read.parquet(str(tmp_path / "snap")).count() == 3


def test_score_window_is_around_the_start(spark):
    far = "account" + " " * 54 + "12345678"
    df = spark.createDataFrame([(1, far), (2, "account" + " " * 61 + "12345678")], "doc_id long, text string")
    one = (next(r for r in recognise.RECOGNISERS if r.name == "account"),)
    assert {r["doc_id"]: r["score"] for r in recognise.spans(df, "doc_id", recognisers=one).collect()} == {1: 0.4, 2: 0.4}
    near = spark.createDataFrame([(1, "account 12345678")], "doc_id long, text string")
    assert recognise.spans(near, "doc_id", recognisers=one).select(F.round("score", 6)).head()[0] == 0.75


def test_one_form_of_a_text(spark):
    from sheafwork.functions import normalise

    df = spark.createDataFrame([("ﬁne  \t x²",), (None,), ("Straße",)], "t string")
    assert [r[0] for r in df.select(normalise.normalised(F.col("t"))).collect()] == ["fine x2", None, "Straße"]
    assert [r[0] for r in df.select(normalise.casefolded(F.col("t"))).collect()][2] == "strasse"
