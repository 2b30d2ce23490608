"""Ordered span operations: merging, overlap resolution, redaction, and scoring against gold spans."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
STRUCTURED = frozenset(("UK_SORT_CODE", "UK_BANK_ACCOUNT_NUMBER", "CREDIT_CARD_NUMBER", "UK_IBAN", "IBAN", "UK_NATIONAL_INSURANCE_NUMBER", "UK_POSTCODE", "UK_PHONE_NUMBER", "EMAIL_ADDRESS", "UK_NHS_NUMBER"))
KEPT_ALWAYS = frozenset(("VULNERABLE_CUSTOMER_INDICATOR", "HEALTH_INFORMATION", "CRIMINAL_OFFENCE_INFORMATION"))


def _winner(old: tuple, new: tuple) -> tuple | None:
    """Of two overlapping (start, end, type, score): the one that stays, or None where both may stay."""
    o_in, n_in = old[0] <= new[0] and new[1] <= old[1], new[0] <= old[0] and old[1] <= new[1]
    if o_in and n_in:
        return new if new[3] > old[3] else old
    structured = old[2] in STRUCTURED, new[2] in STRUCTURED
    if o_in or n_in:
        if {old[2], new[2]} == {"UK_ADDRESS", "UK_POSTCODE"}:
            return None
        outer, inner = (old, new) if o_in else (new, old)
        if all(structured):
            return inner if inner[3] > outer[3] else outer
        return inner if inner[2] in STRUCTURED else outer
    if structured[0] != structured[1]:
        return old if structured[0] else new
    return new if new[3] > old[3] else old


def merge_list(spans: list[tuple]) -> list[tuple]:
    """The spans of one text after merging; ``spans`` are (start, end, type, score) in their original order."""
    held: list[tuple] = []
    for span in sorted(spans, key=lambda s: (s[0], -s[1], -s[3])):
        if span[2] not in KEPT_ALWAYS:
            for i, old in enumerate(held):
                if old[1] > span[0] and span[1] > old[0]:
                    stays = _winner(old, span)
                    if stays is None:
                        continue
                    held[i] = stays
                    break
            else:
                held.append(span)
        else:
            held.append(span)
    return sorted(held, key=lambda s: (s[0], s[1]))


def merged(spans: DataFrame, key: str) -> DataFrame:
    """``spans`` (key, start_pos, end_pos, entity_type, score[, place]) merged per text; rows with nulls are left out.

    Equal (start, end, score) are taken in the order of ``place``. The spans of a text go to Python as arrays, many
    texts in a batch.
    """
    order = "place" if "place" in spans.columns else "entity_type"
    rows = spans.select(key, "start_pos", "end_pos", "entity_type", "score", F.col(order).alias("_o")).dropna()
    s = F.array_sort(F.collect_list(F.struct("_o", "start_pos", "end_pos", "entity_type", "score"))).alias("s")
    lists = rows.groupBy(key).agg(s).select(key, *(F.col("s")[c].alias(c) for c in ("start_pos", "end_pos", "entity_type", "score")))
    schema = f"{key} {spans.schema[key].dataType.simpleString()}, start_pos int, end_pos int, entity_type string, score double"

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *x) for k, *cols in zip(b[key], b["start_pos"], b["end_pos"], b["entity_type"], b["score"]) for x in merge_list(list(zip(*cols)))]
            yield pd.DataFrame(rows, columns=[key, "start_pos", "end_pos", "entity_type", "score"])

    return lists.mapInPandas(run, schema)


#: SQL for the same fold over one text's spans; ``found`` is a query giving the key, place, start_pos, end_pos, entity_type, score.
def merged_sql(found: str, key: str) -> str:
    structured, always = _quoted(STRUCTURED), _quoted(KEPT_ALWAYS)
    k_in, x_in = "(x[1].s <= k.s and x[1].e >= k.e)", "(k.s <= x[1].s and k.e >= x[1].e)"
    exempt = f"(({k_in} or {x_in}) and not ({k_in} and {x_in}) and ((k.t = 'UK_ADDRESS' and x[1].t = 'UK_POSTCODE') or (k.t = 'UK_POSTCODE' and x[1].t = 'UK_ADDRESS')))"
    meets = f"lambda k: k.e > x[1].s and x[1].e > k.s and not {exempt}"
    at = f"list_position(list_transform(acc, {meets}), true)"
    old = f"acc[{at}]"
    o_in, n_in = f"({old}.s <= x[1].s and x[1].e <= {old}.e)", f"(x[1].s <= {old}.s and {old}.e <= x[1].e)"
    so, sn = f"({old}.t in {structured})", f"(x[1].t in {structured})"
    wins = f"""case when {o_in} and {n_in} then x[1].c > {old}.c
 when {o_in} then case when {so} and {sn} then x[1].c > {old}.c else {sn} end
 when {n_in} then case when {so} and {sn} then not {old}.c > x[1].c else not {so} end
 when {so} <> {sn} then {sn} else x[1].c > {old}.c end"""
    step = f"""case when x[1].t in {always} or coalesce({at}, 0) = 0 then list_concat(acc, x)
 when {wins} then list_concat(acc[1:{at} - 1], x, acc[{at} + 1:]) else acc end"""
    return f"""select {key}, u.s as start_pos, u.e as end_pos, u.t as entity_type, u.c as score from (
 select {key}, unnest(list_reduce(list([{{'s': start_pos, 'e': end_pos, 't': entity_type, 'c': score}}] order by start_pos, end_pos desc, score desc, place), lambda acc, x: {step})) as u from ({found}) group by {key})"""


def _quoted(names: Iterable[str]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in sorted(names)) + ")"


def resolve(spans: Column) -> Column:
    """An array of spans (start_pos, end_pos, score, ...) without overlaps: by start, then higher score; the first stays."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start_pos"] != b["start_pos"], a["start_pos"] - b["start_pos"]).when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(a["end_pos"] - b["end_pos"]))
    none = F.filter(ordered, lambda _: F.lit(False))
    return F.aggregate(ordered, none, lambda kept, s: F.when(F.coalesce(F.array_max(F.transform(kept, lambda k: k["end_pos"])), F.lit(0)) <= s["start_pos"], F.concat(kept, F.array(s))).otherwise(kept))


def placeholders(text: Column, spans: Column) -> Column:
    """``text`` with each of the (resolved) spans replaced by ``<TYPE>``; no Python, one expression."""
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end_pos"]))
    starts = F.concat(F.transform(spans, lambda s: s["start_pos"]), F.array(F.length(text)))
    tags = F.concat(F.transform(spans, lambda s: F.concat(F.lit("<"), s["entity_type"], F.lit(">"))), F.array(F.lit("")))
    plain = F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda p: F.substring(text, p["a"] + 1, p["b"] - p["a"]))
    return F.array_join(F.zip_with(plain, tags, lambda p, t: F.concat(p, t)), "")


def exact_score(pred: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """(entity_type, tp, fp, fn): equal (type, start, end) as multisets, per text; no row by row work."""
    cols = [key, "entity_type", "start_pos", "end_pos"]
    count = lambda df, name: df.groupBy(*cols).agg(F.count(F.lit(1)).alias(name))
    both = count(pred, "p").join(count(gold, "g"), cols, "full_outer").fillna(0, ["p", "g"])
    hit = F.least("p", "g")
    return both.groupBy("entity_type").agg(F.sum(hit).alias("tp"), F.sum(F.col("p") - hit).alias("fp"), F.sum(F.col("g") - hit).alias("fn"))
