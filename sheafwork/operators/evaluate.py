"""Predicted spans scored against marked ones: exact as multisets, partial by greedy pairing in the order given."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rates(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall and f1; nothing divided by nothing is 0."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    p, r = zero(F.try_divide(tp, tp + fp)), zero(F.try_divide(tp, tp + fn))
    return [F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(zero(F.try_divide(2 * p * r, p + r)), 4).alias("f1")]


def paired(pred: list[tuple], gold: list[tuple]) -> list[int]:
    """For each predicted (start, end, type) the place of the first free overlapping marked one of its type, or -1."""
    free = [True] * len(gold)
    out = []
    for a, b, kind in pred:
        hit = next((i for i, (x, y, k) in enumerate(gold) if free[i] and k == kind and b > x and y > a), -1)
        if hit >= 0:
            free[hit] = False
        out.append(hit)
    return out


def partial(pred: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """(key, entity_type, side, start_pos, end_pos): side ``tp``, ``fp`` (predicted, unpaired) or ``fn`` (marked, unpaired).

    Both sides carry ``place``, the order in which pairs are sought within a text. The spans of a text meet as arrays.
    """
    lists = lambda df, name: df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "start_pos", "end_pos", "entity_type"))).alias(name))
    both = lists(pred, "p").join(lists(gold, "g"), key, "full_outer")
    cols = [F.coalesce(F.col(s)[c], F.array().cast("array<string>" if c == "entity_type" else "array<int>")).alias(f"{s}_{c}") for s in "pg" for c in ("start_pos", "end_pos", "entity_type")]
    schema = f"{key} {both.schema[key].dataType.simpleString()}, entity_type string, side string, start_pos int, end_pos int"

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, *c in b.itertuples(index=False):
                p, g = list(zip(*c[:3])), list(zip(*c[3:]))
                hits = paired(p, g)
                rows += [(k, s[2], "tp" if h >= 0 else "fp", s[0], s[1]) for s, h in zip(p, hits)]
                taken = set(hits)
                rows += [(k, s[2], "fn", s[0], s[1]) for i, s in enumerate(g) if i not in taken]
            yield pd.DataFrame(rows, columns=[key, "entity_type", "side", "start_pos", "end_pos"])

    return both.select(key, *cols).mapInPandas(run, schema)
