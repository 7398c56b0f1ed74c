"""Queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from textmill.session import ship


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


#: Tokens at white space, as a table expression: t(doc_id, lang, source, token, pos).
TOKENS = "tok AS (SELECT doc_id, lang, source, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents), t AS (SELECT doc_id, lang, source, unnest(w) AS token, unnest(range(len(w))) AS pos FROM tok)"

REGISTRY: dict[str, Query] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame under its name."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        assert f.__name__ not in REGISTRY, f.__name__
        REGISTRY[f.__name__] = Query(f, sql)
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load() -> dict[str, Query]:
    from textmill.queries import analysis, corpus, text, tokens  # noqa: F401

    return REGISTRY
