"""Detectors by name: functions from texts to spans. Those that need a model library fall back when it is missing.

A detector takes (texts, key, text) and gives (key, place, entity_type, start_pos, end_pos, score, source). Rule
detectors are native plans; a model detector is given as a function over Arrow batches of texts and runs in Python
workers, where an exception in one text becomes no spans and an error for that text, never a failed job.
"""

from __future__ import annotations

import importlib.util
import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafwork.operators import recognise, span_algebra

Detector = Callable[[DataFrame, str, str], DataFrame]
_COLUMNS = ("place", "entity_type", "start_pos", "end_pos", "score", "source")
REGISTRY: dict[str, Detector] = {}
#: Model detectors and the library that each needs; labels that mean the same (fixed values).
LIBRARIES = {"presidio_spacy": "spacy", "gliner": "gliner", "piiranha": "transformers"}
NER_LABELS = {"PERSON": "PERSON", "ORG": "ORGANISATION", "NORP": "ORGANISATION", "GPE": "LOCATION", "LOC": "LOCATION", "FAC": "LOCATION", "DATE": "DATE"}
NER_SCORE = 0.7


def register(name: str) -> Callable[[Detector], Detector]:
    def put(f: Detector) -> Detector:
        REGISTRY[name] = f
        return f

    return put


@register("presidio_regex")
def regex(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """All recognisers, merged."""
    return span_algebra.merged(recognise.spans(texts, key, text), key).select(key, F.lit(0).alias("place"), "entity_type", "start_pos", "end_pos", "score", F.lit("regex").alias("source"))


@register("presidio_legacy")
def legacy(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The older recognisers; of equal spans of a type the best score."""
    found = recognise.spans(texts, key, text, recognise.LEGACY)
    return found.groupBy(key, "entity_type", "start_pos", "end_pos").agg(F.max("score").alias("score")).select(key, F.lit(0).alias("place"), "entity_type", "start_pos", "end_pos", "score", F.lit("legacy").alias("source"))


def available(name: str) -> bool:
    """Whether the detector's library is here; asked once, on the driver."""
    return name not in LIBRARIES or importlib.util.find_spec(LIBRARIES[name]) is not None


def guarded(texts: DataFrame, key: str, predict: Callable[[str], list[tuple[str, int, int, float]]], text: str = "text") -> DataFrame:
    """(key, entity_type, start_pos, end_pos, score, latency_ms, error): ``predict`` on every text, in Arrow batches.

    A text without spans has one row with nulls, and so has a text on which ``predict`` fails, with its error.
    """
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b[key], b["_t"]):
                began, error, found = time.perf_counter(), None, []
                try:
                    found = predict(t) if t else []
                except Exception as e:  # one text must not end the job
                    error = f"{type(e).__name__}: {e}"[:300]
                took = (time.perf_counter() - began) * 1000
                rows += [(k, *s, took, error) for s in found] or [(k, None, None, None, None, took, error)]
            yield pd.DataFrame(rows, columns=[key, "entity_type", "start_pos", "end_pos", "score", "latency_ms", "error"]).astype({"start_pos": "Int32", "end_pos": "Int32"})

    return texts.select(key, F.col(text).alias("_t")).mapInPandas(run, f"{key} {kind}, entity_type string, start_pos int, end_pos int, score double, latency_ms double, error string")


def with_model(texts: DataFrame, key: str, model: DataFrame, text: str = "text") -> DataFrame:
    """Spans of a model beside those of the recognisers, merged again: the recognisers come first among equals."""
    rules = regex(texts, key, text)
    both = rules.unionByName(model.where("entity_type is not null").select(key, F.lit(1).alias("place"), "entity_type", "start_pos", "end_pos", "score", F.lit("model").alias("source")))
    return span_algebra.merged(both.drop("source"), key).select(key, F.lit(0).alias("place"), "entity_type", "start_pos", "end_pos", "score", F.lit("merged").alias("source"))


def detect(name: str, texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """A detector by name with ``status``: ``ok``, or ``fallback`` where its library is missing and the recognisers answer alone."""
    if name in REGISTRY and available(name):
        return REGISTRY[name](texts, key, text).withColumn("status", F.lit("ok"))
    if name in LIBRARIES or name == "hybrid":
        return regex(texts, key, text).withColumn("status", F.lit("fallback"))
    raise ValueError(f"unknown detector: {name}")


def hybrid(texts: DataFrame, key: str, models: list[DataFrame], text: str = "text") -> DataFrame:
    """Recognisers and the first model that answered at all, less what the recognisers have already."""
    rules = regex(texts, key, text)
    for model in models:
        fresh = model.where("entity_type is not null").join(rules.select(key, "entity_type", "start_pos", "end_pos"), [key, "entity_type", "start_pos", "end_pos"], "left_anti")
        if fresh.take(1):
            return with_model(texts, key, fresh, text)
    return rules
