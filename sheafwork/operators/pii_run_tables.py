"""Saved PII runs (JSON whose shape changed over the years) as linked flat tables."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafwork.operators.shred import Node, flatten, pruned, shred

_BBOX = Node("bbox", (Node("x"), Node("y"), Node("w"), Node("h")))
_COUNT = (Node("name"), Node("n"))
RUN = Node(
    "run",
    (
        Node("pii_run_id"),
        Node("status"),
        Node("updated_at"),
        Node(
            "documents",
            (
                Node("document_id"),
                Node("filename"),
                Node("status"),
                Node("pdf_kind"),
                Node("n_pages"),
                Node("started_at"),
                Node(
                    "pages",
                    (
                        Node("page_index"),
                        Node(
                            "results",
                            (
                                Node("ocr"),
                                Node("detector"),
                                Node("status"),
                                Node("error"),
                                Node("entity_count"),
                                Node("latency_ms"),
                                Node("entity_types", _COUNT, True),
                                Node("category_counts", _COUNT, True),
                            ),
                            True,
                        ),
                        Node(
                            "tables",
                            (
                                Node("region_id"),
                                Node("n_rows"),
                                Node("n_cols"),
                                Node("border_mode"),
                                Node("cells", (Node("row"), Node("col"), Node("rowspan"), Node("colspan"), Node("text"), _BBOX), True),
                            ),
                            True,
                        ),
                    ),
                    True,
                ),
            ),
            True,
        ),
    ),
)
TABLES = {
    "document": ("documents",),
    "page": ("documents", "pages"),
    "result": ("documents", "pages", "results"),
    "entity_type": ("documents", "pages", "results", "entity_types"),
    "category": ("documents", "pages", "results", "category_counts"),
    "table": ("documents", "pages", "tables"),
    "cell": ("documents", "pages", "tables", "cells"),
}


def _whole(value: object) -> object:
    """A whole number however it was written (1, "1", 1.0, " 1 "); anything else as it is."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return int(value) if value == int(value) else value
    if isinstance(value, str):
        try:
            number = float(value.strip())
        except ValueError:
            return value.strip()
        return int(number) if number == int(number) else value.strip()
    return value


def _listed(value: object, key: str) -> list[dict]:
    """A list of objects, whether it was saved as a list or as an object keyed by ``key``; null is empty."""
    if isinstance(value, dict):
        return [{key: k, **(v if isinstance(v, dict) else {})} for k, v in value.items()]
    return [v for v in value if isinstance(v, dict)] if isinstance(value, list) else []


def _counts(value: object) -> list[dict]:
    return [{"name": k, "n": _whole(n)} for k, n in value.items()] if isinstance(value, dict) else []


def decode(payload: str | None) -> dict | None:
    """The run object inside a payload: byte-order mark, JSON inside a JSON string and a ``pii_run`` wrapper are
    undone. ``None`` for null, empty or damaged payloads and for payloads that hold no run."""
    value: object = payload
    for _ in range(4):
        if isinstance(value, str):
            try:
                value = json.loads(value.lstrip("﻿").strip())
            except (ValueError, RecursionError):
                return None
        elif isinstance(value, dict) and isinstance(value.get("pii_run"), (dict, str)):
            value = value["pii_run"]
        else:
            break
    if not isinstance(value, dict) or not isinstance(value.get("pii_run_id"), str) or not value["pii_run_id"].strip():
        return None
    return value


def read_run(payload: str | None) -> dict | None:
    """A payload in the one shape of ``RUN``, whichever shape it was saved in."""
    run = decode(payload)
    if run is None:
        return None
    documents = []
    for d in _listed(run.get("documents"), "document_id"):
        pages = []
        for p in _listed(d.get("pages"), "page_index"):
            if isinstance(p.get("results"), list):
                results = [{**r, **(r.get("summary") if isinstance(r.get("summary"), dict) else {})} for r in p["results"] if isinstance(r, dict)]
            else:
                known = ("page_index", "tables", "results")
                held = p["results"] if isinstance(p.get("results"), dict) else {k: v for k, v in p.items() if k not in known}
                results = [{"ocr": o, "detector": n, **(s if isinstance(s, dict) else {})} for o, by in held.items() if isinstance(by, dict) for n, s in by.items()]
            for r in results:
                r["entity_count"] = _whole(r.get("entity_count"))
                r["entity_types"], r["category_counts"] = _counts(r.get("entity_types")), _counts(r.get("category_counts"))
            tables = []
            for t in _listed(p.get("tables"), "region_id"):
                cells = [
                    {**c, "row": _whole(c.get("row", c.get("r"))), "col": _whole(c.get("col", c.get("c"))), "rowspan": _whole(c.get("rowspan")), "colspan": _whole(c.get("colspan"))}
                    for c in _listed(t.get("cells"), "row")
                ]
                tables.append({**t, "n_rows": _whole(t.get("n_rows")), "n_cols": _whole(t.get("n_cols")), "cells": cells})
            pages.append({"page_index": _whole(p.get("page_index")), "results": results, "tables": tables})
        documents.append({**d, "n_pages": _whole(d.get("n_pages")), "pages": pages})
    return {"pii_run_id": run["pii_run_id"].strip(), "status": run.get("status"), "updated_at": run.get("updated_at"), "documents": documents}


def latest_states(raw: DataFrame) -> DataFrame:
    """(pii_run_id, record_id, payload): of each run the readable state with the latest ``updated_at``.

    The run is the one that the payload names; the column may be null. States without ``updated_at`` come last,
    ties go to the record received last, then to the larger ``record_id``. Only ids and times are shuffled to pick.
    """

    def heads(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for record_id, payload in zip(batch["record_id"], batch["payload"]):
                run = decode(payload)
                if run is not None:
                    out.append((record_id, run["pii_run_id"].strip(), run.get("updated_at") if isinstance(run.get("updated_at"), str) else None))
            yield pd.DataFrame(out, columns=["record_id", "pii_run_id", "updated_at"])

    seen = raw.select("record_id", "payload").mapInPandas(heads, "record_id long, pii_run_id string, updated_at string")
    order = F.struct(F.coalesce(F.try_to_timestamp("updated_at"), F.timestamp_seconds(F.lit(0))), F.col("record_id"))
    chosen = seen.groupBy("pii_run_id").agg(F.max_by("record_id", order).alias("record_id"))
    return chosen.join(raw.select("record_id", "payload").dropDuplicates(["record_id"]), "record_id")


#: The natural key of an element inside its parent.
PARTS = {
    "document": ("document_id",),
    "page": ("page_index",),
    "result": ("ocr", "detector"),
    "entity_type": ("name",),
    "category": ("name",),
    "table": ("region_id",),
    "cell": ("row", "col"),
}


def run_columns(raw: DataFrame) -> DataFrame:
    """The latest states as striped columns: ``pii_run_id``, ``columns`` (path, rep, dfn, val); for storage."""
    return shred(latest_states(raw), ["pii_run_id"], "payload", RUN, read_run)


def run_tables(raw: DataFrame, tables: list[str] | None = None, fields: bool = True) -> DataFrame:
    """Every element of the latest states: ``pii_run_id``, ``table``, ``ord``, ``parent``, ``key``, ``parent_key``, ``fields``.

    ``tables`` keeps the named tables and those around them; without ``fields`` only the key columns are striped.
    """
    kept = {k: v for k, v in TABLES.items() if tables is None or any(v == TABLES[t][: len(v)] for t in tables)}
    schema = RUN if fields else pruned(RUN, {(*path, part) for name, path in kept.items() for part in PARTS[name]})
    return flatten(latest_states(raw), ["pii_run_id"], "payload", schema, read_run, kept, PARTS, "pii_run_id", fields)


def run_nodes(raw: DataFrame) -> DataFrame:
    """(pii_run_id, node_kind, node_key, parent_key): the distinct nodes of each run's latest state, each with its parent.

    Elements without their own key part (a page without index, say) use an empty part; an empty input has no rows.
    """
    nodes = run_tables(raw, ["document", "page", "result", "table", "cell"], fields=False)
    return nodes.select("pii_run_id", F.col("table").alias("node_kind"), F.col("key").alias("node_key"), "parent_key").distinct()


def _flat(raw: DataFrame, name: str, columns: dict[str, str]) -> DataFrame:
    kept = run_tables(raw, [name]).where(F.col("table") == name)
    return kept.select("pii_run_id", F.col("key").alias("row_key"), "parent_key", "ord", *(F.expr(f"try_cast(try_element_at(fields, '{path}') as {kind})").alias(path.replace(".", "_")) for path, kind in columns.items()))


def document_table(raw: DataFrame) -> DataFrame:
    return _flat(raw, "document", {"document_id": "string", "filename": "string", "status": "string", "pdf_kind": "string", "n_pages": "int", "started_at": "string"})


def page_table(raw: DataFrame) -> DataFrame:
    return _flat(raw, "page", {"page_index": "int"})


def result_table(raw: DataFrame) -> DataFrame:
    return _flat(raw, "result", {"ocr": "string", "detector": "string", "status": "string", "error": "string", "entity_count": "int", "latency_ms": "double"})


def entity_type_table(raw: DataFrame) -> DataFrame:
    return _flat(raw, "entity_type", {"name": "string", "n": "int"})


def table_table(raw: DataFrame) -> DataFrame:
    return _flat(raw, "table", {"region_id": "string", "n_rows": "int", "n_cols": "int", "border_mode": "string"})


def cell_table(raw: DataFrame) -> DataFrame:
    return _flat(raw, "cell", {"row": "int", "col": "int", "rowspan": "int", "colspan": "int", "text": "string", "bbox.x": "double", "bbox.y": "double", "bbox.w": "double", "bbox.h": "double"})
