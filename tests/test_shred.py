import json

from sheafwork.operators import pii_run_tables as P
from sheafwork.operators.shred import Node, assemble, shred, stripe, unshred

TREE = Node("r", (Node("id"), Node("a", (Node("x"), Node("b", (Node("y"),), True)), True)))


def test_levels_round_trip():
    record = {"id": 1, "a": [{"x": 1, "b": [{"y": 1}, {"y": None}]}, {"x": None, "b": []}, {"b": [{"y": 3}]}]}
    columns = stripe(record, TREE)
    assert [r["x"] for r in assemble(columns, TREE, ("a",))] == ["1", None, None]
    assert [(r["_ord"], r["y"]) for r in assemble(columns, TREE, ("a", "b"))] == [((0, 0), "1"), ((0, 1), None), ((2, 0), "3")]
    assert assemble(stripe({"id": 1}, TREE), TREE, ("a",)) == []


def test_damaged_and_wrapped_payloads():
    run = {"pii_run_id": "r", "documents": []}
    assert P.decode(None) is None and P.decode("") is None and P.decode("not json") is None and P.decode("[]") is None and P.decode("{}") is None
    for text in (json.dumps(run), "﻿" + json.dumps(run), json.dumps(json.dumps(run)), json.dumps({"pii_run": run})):
        assert P.decode(text)["pii_run_id"] == "r"


def _raw(spark, rows):
    return spark.createDataFrame(rows, "record_id long, pii_run_id string, payload string, table string")


def test_latest_state_and_both_shapes(spark):
    old = {"pii_run_id": "r", "updated_at": "2024-01-01T00:00:00+00:00", "documents": [{"document_id": "gone"}]}
    new = {"pii_run_id": "r", "updated_at": "2024-01-02T00:00:00+00:00", "documents": {"d": {"pages": {"0": {"o": {"det": {}}, "tables": [{"region_id": "t", "cells": [{"r": "1", "c": 0}, {"r": 1, "c": 0}]}]}}}}}
    rows = [(1, None, json.dumps(old), "x"), (2, None, json.dumps(new), "x"), (2, None, json.dumps(new), "x"), (3, "r", None, "x"), (4, "r", "{", "x")]
    got = {tuple(r) for r in P.run_nodes(_raw(spark, rows)).collect()}
    assert got == {("r", "document", "d", "r"), ("r", "page", "d/0", "d"), ("r", "result", "d/0/o/det", "d/0"), ("r", "table", "d/0/t", "d/0"), ("r", "cell", "d/0/t/1/0", "d/0/t")}
    assert P.run_nodes(_raw(spark, [])).count() == 0
    assert P.cell_table(_raw(spark, rows)).count() == 2


def test_stored_columns_give_the_same_tables(spark):
    rows = _raw(spark, [(1, "r", json.dumps({"id": 7, "a": [{"x": 1, "b": [{"y": 2}]}]}), "")])
    stored = shred(rows, ["pii_run_id"], "payload", TREE, json.loads)
    out = unshred(stored, ["pii_run_id"], TREE, {"a": ("a",), "b": ("a", "b")}, {"a": ("x",), "b": ("y",)}, "pii_run_id").collect()
    assert {(r["table"], r["key"], r["parent_key"]) for r in out} == {("a", "1", "r"), ("b", "1/2", "1")}


def test_keys_alone_need_only_their_columns():
    from sheafwork.operators import pii_run_tables as P
    from sheafwork.operators.shred import assemble, leaves, pruned, stripe

    run = {"pii_run_id": "r", "documents": [{"document_id": "d", "pages": [{"page_index": 0, "tables": [{"region_id": "t", "cells": [{"row": 1, "col": 2}, {"row": None}]}], "results": []}, {"tables": []}]}, {}]}
    keep = {(*path, part) for name, path in P.TABLES.items() for part in P.PARTS[name]}
    small = pruned(P.RUN, keep)
    assert set(leaves(small)) == keep and len(keep) < len(set(leaves(P.RUN)))
    for path in P.TABLES.values():
        whole = assemble(stripe(run, P.RUN), P.RUN, path)
        slim = assemble(stripe(run, small), small, path)
        assert [r["_ord"] for r in whole] == [r["_ord"] for r in slim]
        assert all(w[k] == v for w, s in zip(whole, slim) for k, v in s.items())
