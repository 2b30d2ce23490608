from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from sheafwork.functions import validators as V
from sheafwork.operators import recognise, span_algebra


def test_offsets_cut_the_value(spark):
    texts = [(1, "a@b.uk é9 4111 1111 1111 1111, call 12345678"), (2, ""), (3, None), (4, "😀 x.y@z.com x.y@z.com")]
    found = recognise.spans(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id").collect()
    by = dict(texts)
    assert {r["entity_type"] for r in found} >= {"EMAIL_ADDRESS", "CREDIT_CARD_NUMBER", "UK_BANK_ACCOUNT_NUMBER"}
    assert all(by[r["doc_id"]][r["start_pos"] : r["end_pos"]] == r["value"] for r in found)
    assert sum(r["doc_id"] == 4 and r["entity_type"] == "EMAIL_ADDRESS" for r in found) == 2


def test_validators(spark):
    rows = spark.createDataFrame([("4111111111111111", "GB82WEST12345698765432", "AB123456C", "9434765919", "51.5, -0.1"), ("4111111111111112", "GB83WEST12345698765432", "GB123456C", "9434765918", "91, 0"), (None,) * 5], "a string, b string, c string, d string, e string")
    got = rows.select(V.luhn(F.col("a")), V.iban(F.col("b")), V.nino(F.col("c")), V.nhs(F.col("d")), V.lat_long(F.col("e"))).collect()
    assert list(got[0]) == [True] * 5 and list(got[1]) == [False] * 5 and list(got[2]) == [None] * 5


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(1, 8), st.sampled_from(["PERSON", "UK_POSTCODE", "UK_ADDRESS", "EMAIL_ADDRESS"]), st.sampled_from([0.5, 0.7, 0.9])), max_size=8))
def test_merge_keeps_given_spans(spans):
    given_ = [(a, a + n, k, s) for a, n, k, s in spans]
    kept = span_algebra.merge_list(given_)
    assert set(kept) <= set(given_) and len(kept) <= len(given_) and (bool(kept) == bool(given_))


def test_placeholders(spark):
    df = spark.createDataFrame([(1, "call a@b.uk or c@d.uk!")], "doc_id long, text string")
    s = recognise.spans(df, "doc_id").groupBy("doc_id").agg(span_algebra.resolve(F.collect_list(F.struct("start_pos", "end_pos", "score", "entity_type"))).alias("s"))
    assert df.join(s, "doc_id").select(span_algebra.placeholders(F.col("text"), F.col("s"))).head()[0] == "call <EMAIL_ADDRESS> or <EMAIL_ADDRESS>!"


def test_stage_windows(spark, tmp_path):
    from sheafwork.streaming import progress

    spark.sql("select 1L as event_id, timestamp'2024-01-01 00:01:00' as ts, 1L as user_id, 'a' as event_type, 2.0D as value, '' as props").write.parquet(str(tmp_path / "in"))
    query = progress.stage_windows(progress.event_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [r["n"] for r in spark.table("w").collect()] == [1]
