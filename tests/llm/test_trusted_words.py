"""Words that don't travel to the workers vouch for lines and split words all the same."""

from sheafwork.llm import scans

OFTEN = {"the": 40, "of": 30, "to": 25, "records": 12, "welling": 9, "wel-ling": 8, "self": 8, "made": 8, "self-made": 7, "selfmade": 6, "north": 6, "east": 6, "pa": 7, "per": 7, "co": 6, "op": 6, "co-op": 6, "coop": 6, "as": 6}


def _texts(split, more):
    lines = [w for w, n in OFTEN.items() for _ in range(n)]
    return [(1, "a", 0, "\n".join(lines)), *((10 + i, "b", i, f"first line {i}\n{a}\n{b} end\nlast {i}") for i, (a, b) in enumerate(split)), *((50 + i, "c", i, x) for i, x in enumerate(more))]


def test_split_words_are_judged_by_all_trusted_words(spark):
    # joined only; kept more often; both halves are words; neither is known; as often either way; joined beside a travelling kept word
    split = [("rec-", "ords"), ("self-", "made"), ("north-", "east"), ("foo-", "barley"), ("co-", "op"), ("wel-", "ling"), ("pa-", "per")]
    # page 50 holds nothing but a trusted word
    pages = spark.createDataFrame(_texts(split, ["as", "An edge of a page", "An edge of a page"]), "page_row_id long, document_id string, page_index int, full_text string")
    every = {}
    for limit in (1, 2, 5, 10, 300):
        trusted, wrong = scans._lexicon(pages, limit)
        found = scans.findings(pages, trusted)
        every[limit] = {tuple(r) for r in found.select("doc", "page_index", "page_row_id", "line_no", "tag", "a", "n").collect()}
        noise, _ = scans._noise(found, wrong, *scans._furniture(found))
        every[limit] = every[limit], {tuple(r) for r in noise.collect()}
    assert all(v == every[300] for v in every.values())
    assert {r[0] for r in every[300][1] if r[2] == "hyphen_split"} == {10, 13, 14, 15}
