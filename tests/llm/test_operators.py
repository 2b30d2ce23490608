import itertools
import random

from sheafwork.llm import consensus, leaks, linkage, mixing, pii, scans, sentences, survivors


def test_seed_mask_covers_every_three_changes():
    mask = [i for i, c in enumerate(leaks.MASKS[0]) if c == "1"]
    starts = range(28 - len(leaks.MASKS[0]) + 1)
    assert all(any(not any(s + o in bad for o in mask) for s in starts) for bad in map(set, itertools.combinations(range(28), 3)))


def _words(rng, n):
    return [f"w{rng.randrange(400)}" for _ in range(n)]


def test_leaks_against_brute_force(spark):
    rng = random.Random(3)
    item = _words(rng, 60)
    near = [w if i % 9 else "other" for i, w in enumerate(item[10:50])]
    docs = [(1, " ".join(_words(rng, 30) + item[5:40]), "x"), (2, " ".join(near).upper(), "x"), (3, " ".join(item[:27]), "x"), (4, None, "x"), (5, "", "x"), (1, " ".join(_words(rng, 30) + item[5:40]), "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    i = spark.createDataFrame([(7, " ".join(item)), (8, None)], "item_id long, text string")
    sent = {tuple(r) for r in leaks.leaks(d, i).select("doc_id", "item_id").collect()}
    joined = {tuple(r) for r in leaks.leaks(d, i, index_chars=0).select("doc_id", "item_id").distinct().collect()}
    assert sent == joined == {(1, 7), (2, 7)}
    assert {r["item_id"]: r["leaked"] for r in leaks.leaked_items(leaks.leaks(d, i), i).collect()} == {7: True, 8: False}


def test_sentences():
    cut = lambda t: [t[a:b] for a, b in sentences.sentences(t)]
    assert cut("Dr. A. Holt paid 3.5% at 5 p.m. on Friday. He said: \"Wait. Stop.\" It ended!") == ["Dr. A. Holt paid 3.5% at 5 p.m. on Friday.", "He said: \"Wait. Stop.\"", "It ended!"]
    assert cut("他说：“好。请来。”我走了。为什么？") == ["他说：“好。请来。”", "我走了。", "为什么？"]
    assert cut("- one\n- two. Three.\n\nHead\n\n") == ["- one", "- two.", "Three.", "Head"]
    assert cut("Am 3. Mai ist das z. B. nicht so. Und die Akte?") == ["Am 3. Mai ist das z. B. nicht so.", "Und die Akte?"]
    assert cut("") == [] and cut(None) == [] and cut(" \n ") == []
    assert len(cut("Word word. " * 20000)) == 20000


def test_pii_model_on_held_out_sentences():
    from sheafwork.llm.pii_training import Maker

    model = pii.fit([], generated=240)
    right = wrong = missed = 0
    for text, spans in Maker([], [], seed=99).texts(60):
        got = set(model.spans(text))
        right, wrong, missed = right + len(got & set(spans)), wrong + len(got - set(spans)), missed + len(set(spans) - got)
    assert right / (right + wrong) > 0.9 and right / (right + missed) > 0.9
    assert model.spans(None) == [] and model.spans("") == []


def test_consensus(spark):
    rng = random.Random(1)
    rows, truth, n = [], {}, 0
    for i in range(300):
        t = truth[i] = rng.choice(["A", "B", "NONE"])
        for d, p in (("good", 0.95), ("fair", 0.75), ("bad", 0.4)):
            n += 1
            rows.append((n, i, d, t if rng.random() < p else rng.choice(["A", "B", "NONE"]), 0.5, "2024-01-01", "x"))
    rows += [(n + 1, 999, "good", None, None, "2024-01-01", "x"), rows[0]]
    d = spark.createDataFrame(rows, "detection_id long, item_id long, detector string, entity_type string, score double, t string, confidence string").selectExpr("*", "timestamp(t) as detected_at", "timestamp(t) as ingested_at")
    got = {r["item_id"]: r["entity_type"] for r in consensus.consensus(d).collect()}
    assert sum(got[i] == t for i, t in truth.items()) > 275 and got[999] == "NONE" and len(got) == 301
    rel = {r["detector"]: r["accuracy"] for r in consensus.reliability(d).collect()}
    assert rel["good"] > rel["fair"] > rel["bad"]
    assert consensus.consensus(d.limit(0)).count() == 0


def test_survivors_small_and_large_agree(spark):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    rows = [(k % 5, i, rng.choice([0, 1]), rng.choice([None, 0.1, 0.5, 0.9]), f"2024-01-{rng.randrange(1, 9):02d}", rng.choice([None, "a", "b"]), None) for i, k in enumerate(rng.choices(range(9), k=120))]
    d = spark.createDataFrame(rows, "k long, id long, c int, t double, d string, v string, w string")
    policy = survivors.Policy(F.col("c"), F.col("t"), F.to_timestamp("d"), F.lit(None).cast("timestamp"), "id")
    small = sorted(map(str, survivors.survivors(d, ["k"], policy, ["v", "w"]).collect()))
    large = sorted(map(str, survivors.survivors(d, ["k"], policy, ["v", "w"], in_row=1).collect()))
    assert small == large and len(small) == 5


def test_apportionment():
    w, caps = {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 100, "b": 100, "c": 3}
    assert mixing.apportion(w, caps, 40) == mixing.apportion_fast(w, caps, 40)
    assert sum(mixing.apportion_fast(w, caps, 40).values()) == 40 and mixing.apportion_fast(w, caps, 999)["c"] == 3
    parts = mixing.shard_quotas({"a": 7, "b": 4}, 3)
    assert {s: sum(p[s] for p in parts) for s in "ab"} == {"a": 7, "b": 4}


def test_trie_and_page_numbers():
    trie = scans.Trie({"never": 50, "forms": 40, "clear": 9})
    assert [w for _, _, w in trie.near("ncver", edits=False)] == ["never"] and [w for _, _, w in trie.near("f0rrns", edits=False)] == ["forms"]
    assert [w for _, _, w in trie.near("nevr")] == ["never"]
    assert scans.page_number("- 3 -")[1] == 3 and scans.page_number("Page 5 of 11")[1] == 5 and scans.page_number("iv")[1] == 4 and scans.page_number("Date: 3") is None


def test_linkage(spark):
    box = "x double, y double, w double, h double, page_index int, coord_space string"
    regions = [(1, 10, "normal_text", (200.0, 300.0, 900.0, 50.0, 0, "image_px@300"), "Our ref.: HZ-640-950"), (2, 10, None, (200.0, 500.0, 900.0, 50.0, 0, "image_px@300"), "Closing words of the page"), (3, 10, "table", None, "x")]
    sheets = [(91, "s", "text", (140.0, 210.0, 600.0, 33.0, 4, "image_px@200"), "Our ref.: HZ-640-950"), (92, "s", None, (140.0, 343.0, 600.0, 33.0, 4, None), "Closing words of"), (93, "s", "figure", (900.0, 900.0, 9.0, 9.0, 4, "image_px@200"), None)]
    r = spark.createDataFrame(regions, f"region_uid long, page_row_id long, region_type string, bbox struct<{box}>, text string")
    q = spark.createDataFrame(sheets, f"rescan_uid long, sheet_ref string, region_label string, bbox struct<{box}>, text string")
    got = {(x["region_uid"], x["rescan_uid"]) for x in linkage.linked(r.union(r), q).collect()}
    assert got == {(1, 91), (2, 92)} and linkage.linked(r.limit(0), q).count() == 0
