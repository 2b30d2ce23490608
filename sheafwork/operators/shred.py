"""Nested records as columns with levels, and flat tables from them.

A record of any depth is striped into one column per leaf path. Each entry of a column is (repetition level,
definition level, value): the repetition level tells at which repeated ancestor a new element begins, the
definition level how much of the path is there. Tables are put together again, one per repeated ancestor, from
the levels alone; ``NULL`` values, absent fields, empty and absent lists therefore stay apart.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Node:
    """A field of the nested schema. ``repeated`` marks an array of objects; a node without children is a leaf."""

    name: str
    children: tuple["Node", ...] = ()
    repeated: bool = False


@dataclass
class Stripe:
    """The column of one leaf path."""

    path: tuple[str, ...]
    rep: list[int] = field(default_factory=list)
    dfn: list[int] = field(default_factory=list)
    val: list[str | None] = field(default_factory=list)


def _text(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


def leaves(node: Node, path: tuple[str, ...] = ()) -> Iterator[tuple[str, ...]]:
    """Leaf paths below ``node`` in schema order."""
    for child in node.children:
        here = (*path, child.name)
        if child.children:
            yield from leaves(child, here)
        else:
            yield here


def pruned(node: Node, keep: set[tuple[str, ...]], path: tuple[str, ...] = ()) -> Node:
    """``node`` with the leaf paths in ``keep`` alone, so that no other column is striped."""
    children = []
    for child in node.children:
        here = (*path, child.name)
        if child.children:
            below = pruned(child, keep, here)
            if below.children:
                children.append(below)
        elif here in keep:
            children.append(child)
    return Node(node.name, tuple(children), node.repeated)


def stripe(record: dict, schema: Node) -> dict[tuple[str, ...], Stripe]:
    """The columns of one record.

    Every node on a path counts one definition level where it is present, every repeated node one repetition level.
    """
    out = {path: Stripe(path) for path in leaves(schema)}

    def absent(node: Node, path: tuple[str, ...], rep: int, dfn: int) -> None:
        if not node.children:
            column = out[path]
            column.rep.append(rep)
            column.dfn.append(dfn)
            column.val.append(None)
        for child in node.children:
            absent(child, (*path, child.name), rep, dfn)

    def present(value: object, node: Node, path: tuple[str, ...], rep: int, dfn: int, depth: int) -> None:
        if not node.children:
            column = out[path]
            column.rep.append(rep)
            column.dfn.append(dfn + (value is not None))
            column.val.append(_text(value))
            return
        source = value if isinstance(value, dict) else {}
        for child in node.children:
            below, inner = (*path, child.name), source.get(child.name)
            if child.repeated:
                if not isinstance(inner, list) or not inner:
                    absent(child, below, rep, dfn)
                    continue
                for i, element in enumerate(inner):
                    present(element, child, below, depth + 1 if i else rep, dfn + 1, depth + 1)
            elif child.children:
                if isinstance(inner, dict):
                    present(inner, child, below, rep, dfn + 1, depth)
                else:
                    absent(child, below, rep, dfn)
            else:
                present(inner, child, below, rep, dfn, depth)

    present(record, schema, (), 0, 0, 0)
    return out


def _chain(schema: Node, ancestor: tuple[str, ...]) -> list[Node]:
    node, found = schema, []
    for name in ancestor:
        node = next(c for c in node.children if c.name == name)
        found.append(node)
    return found


def assemble(columns: dict[tuple[str, ...], Stripe], schema: Node, ancestor: tuple[str, ...]) -> list[dict]:
    """The table of one repeated ancestor, from levels only.

    A row has ``_ord`` (the ordinals of the element and of all repeated elements around it) and one value per leaf
    that is not inside a deeper repeated node, named by its path below the ancestor with dots.
    """
    chain = _chain(schema, ancestor)
    depth = sum(n.repeated for n in chain)
    need = len(chain)  # definition level at which the ancestor's element is there

    def own(node: Node, path: tuple[str, ...]) -> Iterator[tuple[str, ...]]:
        for child in node.children:
            if child.repeated:
                continue
            here = (*path, child.name)
            if child.children:
                yield from own(child, here)
            else:
                yield here

    rows: list[dict] = []
    for i, path in enumerate(own(chain[-1] if chain else schema, ancestor)):
        column, at, n = columns[path], [-1] * depth, 0
        for rep, dfn, val in zip(column.rep, column.dfn, column.val):
            if depth:
                at[max(rep, 1) - 1 if rep else 0] += 1
                if rep == 0:
                    at[1:] = [0] * (depth - 1)
                else:
                    at[rep:] = [0] * (depth - rep)
            if dfn < need:
                continue
            if i == 0:
                rows.append({"_ord": tuple(at)})
            rows[n][".".join(path[len(ancestor):])] = val
            n += 1
    return rows


LEVELS = T.ArrayType(
    T.StructType(
        [
            T.StructField("path", T.StringType()),
            T.StructField("rep", T.ArrayType(T.ByteType())),
            T.StructField("dfn", T.ArrayType(T.ByteType())),
            T.StructField("val", T.ArrayType(T.StringType())),
        ]
    )
)


def shred(records: DataFrame, keys: list[str], payload: str, schema: Node, read: Callable[[str | None], dict | None]) -> DataFrame:
    """``records`` as striped columns: ``keys`` and ``columns``, an array of (path, rep, dfn, val).

    ``read`` turns a payload into a record of the schema's shape; rows for which it gives ``None`` (null, empty or
    damaged payloads) have no output. Extra columns of ``records`` are ignored.
    """
    fields = [records.schema[k] for k in keys]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.itertuples(index=False):
                record = read(row[-1])
                if record is not None:
                    made = stripe(record, schema)
                    out.append((*row[:-1], [(".".join(c.path), c.rep, c.dfn, c.val) for c in made.values()]))
            yield pd.DataFrame(out, columns=[*keys, "columns"])

    return records.select(*keys, F.col(payload).alias("_payload")).mapInPandas(run, T.StructType([*fields, T.StructField("columns", LEVELS)]))


def _element_type(keys: list[T.StructField]) -> T.StructType:
    ordinals = T.ArrayType(T.IntegerType())
    return T.StructType(
        [
            *keys,
            T.StructField("table", T.StringType()),
            T.StructField("ord", ordinals),
            T.StructField("parent", ordinals),
            T.StructField("key", T.StringType()),
            T.StructField("parent_key", T.StringType()),
            T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
        ]
    )


def _elements(columns: dict[tuple[str, ...], Stripe], schema: Node, tables: list[tuple[str, tuple[str, ...]]], parts: dict[str, tuple[str, ...]], root: str | None, fields: bool) -> Iterator[tuple]:
    held: dict[tuple, str] = {}
    for name, ancestor in tables:
        for r in assemble(columns, schema, ancestor):
            at = r.pop("_ord")
            above = held.get((ancestor[:-1], at[:-1]))
            own = "/".join(r.get(p) or "" for p in parts.get(name, ()))
            key = own if above is None else f"{above}/{own}"
            held[ancestor, at] = key
            yield name, list(at), list(at[:-1]), key, root if above is None else above, r if fields else None


def unshred(shredded: DataFrame, keys: list[str], schema: Node, tables: dict[str, tuple[str, ...]], parts: dict[str, tuple[str, ...]] | None = None, root: str | None = None) -> DataFrame:
    """Rows of the named tables from striped columns: ``keys``, ``table``, ``ord`` (ordinals of the element and of the
    repeated elements around it), ``parent`` (``ord`` of the enclosing element), ``key``, ``parent_key`` and ``fields``
    (path → value).

    ``key`` is the path of natural keys: the fields that ``parts`` names for the table, after the key of the enclosing
    element; a null part is empty. A top element's ``parent_key`` is the column ``root``. Enclosing elements are found
    by their ordinals. One record is put together inside one row's work; records never meet, so nothing is shuffled.
    """
    out_type = _element_type([shredded.schema[k] for k in keys])
    names = [f.name for f in out_type]
    top = keys.index(root) if root else None
    ordered = sorted(tables.items(), key=lambda x: len(x[1]))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for batch in batches:
            for row in batch.itertuples(index=False):
                columns = {}
                for c in row[-1]:
                    path = tuple(c["path"].split("."))
                    columns[path] = Stripe(path, c["rep"], c["dfn"], c["val"])
                out += ((*row[:-1], *e) for e in _elements(columns, schema, ordered, parts or {}, None if top is None else row[top], True))
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    return shredded.select(*keys, "columns").mapInPandas(run, out_type)


def flatten(records: DataFrame, keys: list[str], payload: str, schema: Node, read: Callable[[str | None], dict | None], tables: dict[str, tuple[str, ...]], parts: dict[str, tuple[str, ...]] | None = None, root: str | None = None, fields: bool = True) -> DataFrame:
    """``unshred(shred(...))`` in one pass, for results that need the tables but not the stored columns.

    ``fields=False`` leaves ``fields`` null where only keys are wanted.
    """
    out_type = _element_type([records.schema[k] for k in keys])
    names = [f.name for f in out_type]
    top = keys.index(root) if root else None
    ordered = sorted(tables.items(), key=lambda x: len(x[1]))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for batch in batches:
            for row in batch.itertuples(index=False):
                record = read(row[-1])
                if record is None:
                    continue
                out += ((*row[:-1], *e) for e in _elements(stripe(record, schema), schema, ordered, parts or {}, None if top is None else row[top], fields))
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    return records.select(*keys, F.col(payload).alias("_payload")).mapInPandas(run, out_type)
