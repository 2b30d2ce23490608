"""Recognisers against the plain meaning of their patterns: every match in order, checked by the same validators."""

import re

import pandas as pd
import pytest

from sheafwork.operators import dictionary, recognise
from sheafwork.plans import spans_plans

DATA = "/root/testdata/sf0.001"
EDGES = ["", None, "nothing here", "john_smith@bank.co.uk", "x a.b@c.org", "äjohn@x.com äb.c@d.com", "\U0001f600 12-34-56", "12 34 56", "12-34-56 12-34-56", "ที่12345678", "é12345678", "٣٤-١٢-٥٦", "account no. 12345678", "a@b.co\u0002c@d.org", "ñ 12345678"]


def _plain(r, text):
    for m in re.finditer(r.pattern, text, re.IGNORECASE if r.ignore_case else 0):
        yield m.start(r.group), m.end(r.group)


@pytest.fixture(scope="module")
def texts(spark):
    made = spans_plans.texts(spark, DATA).toPandas()
    edges = pd.DataFrame({"doc_id": [10**6 + i for i in range(len(EDGES))], "text": EDGES})
    return pd.concat([made, edges])


def test_every_span_is_the_pattern_s(spark, texts):
    free = tuple(r for r in recognise.RECOGNISERS + recognise.LEGACY if r.validator is None)
    got = recognise.spans(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", recognisers=free).toPandas()
    have = {name: set(zip(g["doc_id"], g["start_pos"], g["end_pos"])) for name, g in got.groupby("recogniser")}
    for r in free:
        want = {(d, *at) for d, t in zip(texts["doc_id"], texts["text"]) if t for at in _plain(r, t)}
        assert have.get(r.name, set()) == want, r.name
    cut = texts.set_index("doc_id")["text"]
    assert all(cut[d][a:b] == v for d, a, b, v in zip(got["doc_id"], got["start_pos"], got["end_pos"], got["value"]))


def test_checked_spans_are_among_the_pattern_s(spark, texts):
    checked = tuple(r for r in recognise.RECOGNISERS if r.validator)
    got = recognise.spans(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", recognisers=checked).toPandas()
    for r in checked:
        want = {(d, *at) for d, t in zip(texts["doc_id"], texts["text"]) if t for at in _plain(r, t)}
        mine = got[got["recogniser"] == r.name]
        assert len(mine) and set(zip(mine["doc_id"], mine["start_pos"], mine["end_pos"])) <= want, r.name


def test_dictionary_of_marked_values(spark):
    texts = spark.createDataFrame([(1, "Ask Ann Lee. ann lee, Ann Leer; +44 20"), (2, None), (3, ""), (4, "c++ and C++x .. "), (5, "Ann Lee Ann Lee")], "doc_id long, text string")
    entries = spark.createDataFrame([("PERSON", "Ann Lee"), ("PERSON", " Ann Lee "), (None, "Lee"), ("X", None), ("X", " "), ("CODE", "+44 20"), ("CODE", "C++")], "entity_type string, value string")
    rows = {tuple(r) for r in dictionary.spans(texts, "doc_id", entries).select("doc_id", "entity_type", "start_pos", "value").collect()}
    assert rows == {(1, "PERSON", 4, "Ann Lee"), (1, "PERSON", 13, "ann lee"), (4, "CODE", 8, "C++"), (5, "PERSON", 0, "Ann Lee"), (5, "PERSON", 8, "Ann Lee")}
