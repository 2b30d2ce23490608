"""Queries declared as one statement, with the few pieces that the engines write differently."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sheafwork.session import table

Query = Callable[[SparkSession, str], DataFrame]


class Declared:
    """Named queries and their SQL, gathered as they are declared."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, tables: str, text: str, duck: str | None = None, **alike: tuple[str, str]) -> None:
        """``{name}`` in the text stands for a piece that the engines write differently: (Spark, DuckDB).

        ``duck`` is a statement of its own for the second engine, written from the meaning and not from the first.
        """
        pieces = {**COMMON, **alike}
        spark_text, duck_text = text, duck or text
        for _ in range(2):  # pieces may hold pieces
            for k, (a, b) in pieces.items():
                spark_text, duck_text = spark_text.replace("{" + k + "}", a), duck_text.replace("{" + k + "}", b)
        names = set(tables.split())
        spark_text = re.sub(r"\{(\w*,?\w*)\}", lambda m: m[0] if m[1] in names else "{" + m[0] + "}", spark_text)  # braces of patterns
        for t in tables.split():
            duck_text = duck_text.replace("{" + t + "}", t)

        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return spark.sql(spark_text, **{t: table(spark, sf_dir, t) for t in tables.split()})

        self.queries[name], self.oracles[name] = query, duck_text

    def put(self, name: str, query: Query, oracle: str | None = None) -> None:
        self.queries[name] = query
        if oracle:
            self.oracles[name] = oracle


#: A document is written in several ways; a type may carry a prefix or other case.
DOC = "regexp_replace(regexp_replace(lower(trim(document_id)), '^uploads/', ''), '[.]pdf$', '')"
COMMON = {
    "doc": (DOC, DOC),
    "label": ("regexp_replace(regexp_replace(upper(trim(entity_type)), '[ \\\\-]+', '_'), '^[BI]_', '')", "regexp_replace(regexp_replace(upper(trim(entity_type)), '[ \\-]+', '_', 'g'), '^[BI]_', '')"),
    "count": ("count(*)", "count(*)::bigint"),
    "long": ("bigint", "bigint"),
    "explode": ("explode", "unnest"),
}


def values(names: tuple[str, ...] | frozenset[str]) -> str:
    """A list for ``in``."""
    return "(" + ", ".join(f"'{n}'" for n in sorted(names)) + ")"
