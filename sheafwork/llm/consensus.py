"""Consensus of several annotators' labels: confusion matrices and item posteriors by expectation-maximisation.

The answer of annotator d with label l and score band b to an item of class c has the likelihood
``confusion[d][c][l] * band[d][l == c][b]``: scores count by what they are worth in each annotator's own hands.
Annotators who repeat another's mistakes are found from how often both are wrong alike; of two like answers of such a
pair the dependent one counts only as far as it is no copy. All counts are smoothed. Items stay distributed; only the
parameters, whose size is annotators x classes x classes, come to the driver and go out again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafwork.session import cut

BANDS = 11  # tenths of the score from 0 to 1, and one band for no score
#: More distinct classes or annotators than these mean that the columns are no labels or names at all.
MAX_CLASSES, MAX_ANNOTATORS = 400, 2000
NO_CLASS = "NONE"


def label_key(column: str) -> Column:
    """One spelling of a label: upper case, words joined by underscores, without a begin or inside mark."""
    joined = F.regexp_replace(F.upper(F.trim(column)), r"[\s\-]+", "_")
    bare = F.regexp_replace(joined, r"^[BI]_(?=.)", "")
    return F.when(F.trim(column) == "", None).otherwise(bare)


def annotator_key(column: str) -> Column:
    return F.regexp_replace(F.lower(F.trim(column)), r"[\s\-]+", "_")


def latest_answers(detections: DataFrame) -> DataFrame:
    """(item_id, detector, label, score): the latest answer of each annotator to each item.

    Null labels are no answers, answers without annotator don't count; the latest is by ``detected_at``, then
    ``ingested_at``, then ``detection_id``, null times first. Repeated rows change nothing.
    """
    order = F.struct("detected_at", "ingested_at", "detection_id")
    rows = detections.select("item_id", annotator_key("detector").alias("detector"), label_key("entity_type").alias("label"), "score", "detected_at", "ingested_at", "detection_id")
    rows = rows.where("item_id is not null and detector is not null and detector <> '' and label is not null")
    last = rows.groupBy("item_id", "detector").agg(F.max_by(F.struct("label", "score"), order).alias("a"))
    return last.select("item_id", "detector", "a.label", "a.score")


@dataclass
class Parameters:
    classes: list[str]
    annotators: list[str]
    prior: np.ndarray  # [c]
    confusion: np.ndarray  # [d, c, l]
    band: np.ndarray  # [d, right, b]
    copies: np.ndarray  # [d, e]: chance that d's answer, being like e's, was copied from e


def _sheets(answers: DataFrame, classes: list[str], annotators: list[str]) -> DataFrame:
    """(item_id, d, l, b): per item its answers as codes, ordered by annotator; at most one entry an annotator."""
    code = lambda names, c: F.array_position(F.array(*(F.lit(x) for x in names)), F.col(c)).cast("int") - 1
    band = F.when(F.col("score").isNull() | F.isnan("score"), BANDS - 1).otherwise(F.least(F.lit(BANDS - 2), F.greatest(F.lit(0), F.floor(F.col("score") * 10)))).cast("int")
    rows = answers.select("item_id", F.struct(code(annotators, "detector").alias("d"), code(classes, "label").alias("l"), band.alias("b")).alias("v"))
    sheet = rows.groupBy("item_id").agg(F.sort_array(F.collect_list("v")).alias("v"))
    return sheet.select("item_id", *(F.col(f"v.{k}").alias(k) for k in ("d", "l", "b")))


def _flat(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.fromiter((len(x) for x in batch["d"]), dtype=np.int64, count=len(batch))
    d, l, b = (np.concatenate([np.asarray(x, dtype=np.int64) for x in batch[k]]) if len(batch) else np.zeros(0, np.int64) for k in ("d", "l", "b"))
    return np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64), d, l, b


def _posterior(p: Parameters, starts: np.ndarray, d: np.ndarray, l: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(item posteriors [n, c], weight of each answer)."""
    n, k = len(starts), len(p.classes)
    item = np.repeat(np.arange(n), np.diff(np.append(starts, len(d))))
    weight = np.ones(len(d))
    sources = np.argwhere(p.copies > 0)
    if len(sources):
        label_of = np.full((n, len(p.annotators)), -1)
        label_of[item, d] = l
        for dep, src in sources:
            mine = (d == dep) & (label_of[item, src] == l)
            weight[mine] *= 1 - p.copies[dep, src]
    log = np.log(p.confusion)[d, :, l]
    bands = np.log(p.band)
    log = log + bands[d, 0, b][:, None]
    log[np.arange(len(d)), l] += bands[d, 1, b] - bands[d, 0, b]
    total = np.log(p.prior)[None, :] + np.add.reduceat(log * weight[:, None], starts, axis=0) if len(d) else np.zeros((n, k))
    total -= total.max(axis=1, keepdims=True)
    post = np.exp(total)
    return post / post.sum(axis=1, keepdims=True), weight


def _start(starts: np.ndarray, d: np.ndarray, l: np.ndarray, k: int) -> np.ndarray:
    """Shares of votes, as first posteriors."""
    n = len(starts)
    item = np.repeat(np.arange(n), np.diff(np.append(starts, len(d))))
    post = np.full((n, k), 0.01)
    np.add.at(post, (item, l), 1.0)
    return post / post.sum(axis=1, keepdims=True)


def _expect(sheets: DataFrame, p: Parameters | None, shape: tuple[int, int]) -> dict[str, np.ndarray]:
    """Expected counts of one pass, summed over all items: one small row per batch, summed by Spark."""
    n_a, k = shape

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {"prior": np.zeros(k), "confusion": np.zeros((n_a, k, k)), "band": np.zeros((n_a, 2, BANDS)), "wrong": np.zeros((n_a, n_a)), "alike": np.zeros((n_a, n_a)), "both": np.zeros((n_a, n_a)), "gain": np.zeros(1)}
        for batch in batches:
            if not len(batch):
                continue
            starts, d, l, b = _flat(batch)
            if p is None:
                post, weight = _start(starts, d, l, k), np.ones(len(d))
            else:
                post, weight = _posterior(p, starts, d, l, b)
            item = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(d))))
            mine = post[item]
            sums["prior"] += post.sum(axis=0)
            for c in range(k):
                np.add.at(sums["confusion"], (d, c, l), mine[:, c] * weight)
            right = mine[np.arange(len(d)), l]
            np.add.at(sums["band"], (d, 1, b), right * weight)
            np.add.at(sums["band"], (d, 0, b), (1 - right) * weight)
            label_of = np.full((len(starts), n_a), -1)
            label_of[item, d] = l
            miss = np.zeros((len(starts), n_a))
            miss[item, d] = 1 - right
            for a in range(n_a):
                has = (label_of[:, [a]] >= 0) & (label_of >= 0)
                same = has & (label_of[:, [a]] == label_of)
                sums["alike"][a] += (same * np.minimum(miss[:, [a]], miss)).sum(axis=0)
                sums["wrong"][a] += (has * miss[:, [a]]).sum(axis=0)
                sums["both"][a] += has.sum(axis=0)
        flat = np.concatenate([v.ravel() for v in sums.values()])
        at = np.flatnonzero(flat)
        yield pd.DataFrame({"at": at, "x": flat[at]})

    got = sheets.select("d", "l", "b").mapInPandas(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    sizes = {"prior": (k,), "confusion": (n_a, k, k), "band": (n_a, 2, BANDS), "wrong": (n_a, n_a), "alike": (n_a, n_a), "both": (n_a, n_a), "gain": (1,)}
    flat = np.zeros(sum(int(np.prod(s)) for s in sizes.values()))
    for r in got:
        flat[r["at"]] = r["x"]
    out, at = {}, 0
    for name, s in sizes.items():
        m = int(np.prod(s))
        out[name] = flat[at : at + m].reshape(s)
        at += m
    return out


def _copy_rates(e: dict[str, np.ndarray], classes: int) -> np.ndarray:
    """Chance that an answer of d, like one of s, is a copy: the surplus of common mistakes over what chance gives.

    A pair depends on each other where half of the mistakes of one, on common items, are the other's too, and the
    common items are enough to tell; of the pair, the one with fewer common-item mistakes of its own is the source.
    """
    n = len(e["both"])
    copies = np.zeros((n, n))
    for a in range(n):
        for b in range(a):
            if e["both"][a, b] < 30:
                continue
            wa, wb, alike = e["wrong"][a, b], e["wrong"][b, a], e["alike"][a, b]
            rate = alike / max(1e-9, min(wa, wb))
            chance = 1.0 / max(2, classes - 1) + wb / max(1, e["both"][a, b]) * 0.2
            surplus = (rate - chance) / (1 - chance) if chance < 1 else 0.0
            if rate >= 0.5 and surplus > 0:
                dep, src = (a, b) if wa >= wb else (b, a)
                copies[dep, src] = min(0.98, surplus)
    return copies


def fit(answers: DataFrame, iterations: int = 12, smooth: float = 1.0, tolerance: float = 1e-3) -> tuple[Parameters | None, DataFrame]:
    """The parameters and the checkpointed answer sheets; ``None`` without any answer.

    Confusion rows are smoothed towards each annotator's pooled rate of right answers, so that rare classes don't
    decide by accident; it ends after ``iterations`` passes or when no parameter moves by ``tolerance``.
    """
    classes = [r[0] for r in answers.select("label").distinct().orderBy("label").limit(MAX_CLASSES + 1).collect()]
    annotators = [r[0] for r in answers.select("detector").distinct().orderBy("detector").limit(MAX_ANNOTATORS + 1).collect()]
    if len(classes) > MAX_CLASSES or len(annotators) > MAX_ANNOTATORS:
        raise ValueError("too many distinct labels or annotators")
    if not classes:
        return None, answers.select("item_id", F.lit(None).cast("array<int>").alias("d"), F.lit(None).cast("array<int>").alias("l"), F.lit(None).cast("array<int>").alias("b"))
    sheets = cut(_sheets(answers, classes, annotators))
    n_a, k = len(annotators), len(classes)
    p: Parameters | None = None
    for step in range(iterations + 1):
        e = _expect(sheets, p, (n_a, k))
        right = np.trace(e["confusion"], axis1=1, axis2=2)
        rate = (right + 1) / (e["confusion"].sum(axis=(1, 2)) + 2)
        pooled = np.where(np.eye(k, dtype=bool)[None], rate[:, None, None], ((1 - rate) / max(1, k - 1))[:, None, None])
        confusion = e["confusion"] + smooth * k * pooled
        confusion /= confusion.sum(axis=2, keepdims=True)
        band = e["band"] + smooth
        band /= band.sum(axis=2, keepdims=True)
        prior = (e["prior"] + smooth) / (e["prior"].sum() + smooth * k)
        new = Parameters(classes, annotators, prior, confusion, band, _copy_rates(e, k) if step else np.zeros((n_a, n_a)))
        moved = 1.0 if p is None else max(np.abs(new.confusion - p.confusion).max(), np.abs(new.prior - p.prior).max())
        p = new
        if moved < tolerance:
            break
    return p, sheets


def consensus(detections: DataFrame, iterations: int = 12) -> DataFrame:
    """(item_id, entity_type, confidence, n_answers, agreement): one row per item of ``detections``.

    ``agreement`` is the share of pairs of answers that are alike (null with fewer than two). Items without any answer
    get ``NONE``, confidence null and no answers; rows without ``item_id`` are ignored. Ties go to the class that comes
    first in the alphabet. An empty input has no rows.
    """
    answers = latest_answers(detections)
    p, sheets = fit(answers, iterations)
    every = detections.where("item_id is not null").select("item_id").distinct()
    if p is None:
        return every.select("item_id", F.lit(NO_CLASS).alias("entity_type"), F.lit(None).cast("double").alias("confidence"), F.lit(0).alias("n_answers"), F.lit(None).cast("double").alias("agreement"))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            starts, d, l, b = _flat(batch)
            post, _ = _posterior(p, starts, d, l, b)
            best = post.argmax(axis=1)
            n = np.diff(np.append(starts, len(d)))
            counts = np.zeros(post.shape)
            np.add.at(counts, (np.repeat(np.arange(len(starts)), n), l), 1)
            pairs = (counts * (counts - 1)).sum(axis=1)
            agree = [float(x / (m * (m - 1))) if m > 1 else None for x, m in zip(pairs, n)]
            yield pd.DataFrame({"item_id": batch["item_id"], "entity_type": [p.classes[c] for c in best], "confidence": post[np.arange(len(best)), best], "n_answers": n.astype(np.int32), "agreement": pd.Series(agree, dtype="float64")})

    found = sheets.mapInPandas(run, "item_id long, entity_type string, confidence double, n_answers int, agreement double")
    joined = every.join(found, "item_id", "left")
    return joined.select("item_id", F.coalesce("entity_type", F.lit(NO_CLASS)).alias("entity_type"), "confidence", F.coalesce("n_answers", F.lit(0)).alias("n_answers"), F.when(F.col("agreement") == F.col("agreement"), F.col("agreement")).alias("agreement"))


def reliability(detections: DataFrame, iterations: int = 12) -> DataFrame:
    """(detector, n_answers, accuracy, kappa, depends_on, copy_rate): one row per annotator, by the fitted parameters.

    ``accuracy`` is the expected share of right answers over all classes; ``kappa`` corrects it for what the annotator's
    own label shares would hit by chance.
    """
    answers = latest_answers(detections)
    p, sheets = fit(answers, iterations)
    spark = detections.sparkSession
    kind = "detector string, n_answers long, accuracy double, kappa double, depends_on string, copy_rate double"
    if p is None:
        return spark.createDataFrame([], kind)
    counts = dict(answers.groupBy("detector").count().collect())
    rows = []
    for i, name in enumerate(p.annotators):
        right = float((p.prior * np.diag(p.confusion[i])).sum())
        chance = float((p.prior * (p.prior @ p.confusion[i])).sum())
        src = int(p.copies[i].argmax())
        rate = float(p.copies[i, src])
        rows.append((name, int(counts.get(name, 0)), right, (right - chance) / (1 - chance) if chance < 1 else None, p.annotators[src] if rate > 0 else None, rate if rate > 0 else None))
    return spark.createDataFrame(rows, kind)


def agreement(detections: DataFrame) -> DataFrame:
    """(measure, value, n_items, n_answers): Fleiss' kappa in its form for unequal numbers of answers, and
    Krippendorff's alpha, over items with at least two answers. Null where chance agreement is complete or nothing is
    there to compare. Two aggregations; no item is ever expanded into pairs."""
    answers = latest_answers(detections)
    per = answers.groupBy("item_id", "label").agg(F.count(F.lit(1)).alias("k"))
    sizes = per.groupBy("item_id").agg(F.sum("k").alias("n"), F.sum(F.col("k") * (F.col("k") - 1)).alias("same")).where("n > 1")
    total = sizes.agg(F.count(F.lit(1)).alias("items"), F.sum("n").alias("answers"), F.avg(F.col("same") / (F.col("n") * (F.col("n") - 1))).alias("p_item"), (F.sum(F.col("same") / (F.col("n") - 1)) / F.sum("n")).alias("p_answer"))
    shares = per.join(sizes.select("item_id"), "item_id").groupBy("label").agg(F.sum("k").alias("k"))
    chance = shares.agg(F.sum("k").alias("all"), F.sum(F.col("k") * F.col("k")).alias("sq"), F.sum(F.col("k") * (F.col("k") - 1)).alias("sq1"))
    both = total.unionByName(chance, allowMissingColumns=True)  # one row each, brought into one
    both = both.agg(*(F.max(c).alias(c) for c in both.columns))
    fleiss = F.try_divide(F.col("p_item") - F.col("sq") / (F.col("all") * F.col("all")), 1 - F.col("sq") / (F.col("all") * F.col("all")))
    alpha = 1 - F.try_divide(1 - F.col("p_answer"), 1 - F.col("sq1") / (F.col("all") * (F.col("all") - 1)))
    return both.select(F.explode(F.array(F.struct(F.lit("fleiss_kappa").alias("measure"), fleiss.alias("value")), F.struct(F.lit("krippendorff_alpha").alias("measure"), alpha.alias("value")))).alias("m"), "items", "answers").select("m.measure", "m.value", F.col("items").alias("n_items"), F.coalesce("answers", F.lit(0)).alias("n_answers"))
