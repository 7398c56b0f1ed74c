"""A corpus as tables: records, filters, search, statistics, fingerprints, results."""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions.tokens import whitespace_tokens
from textmill.operators import arrays
from textmill.operators.rows import each


def dedupe(docs: DataFrame, subset: Iterable[str], order: str = "doc_id") -> DataFrame:
    """First row, by ``order`` (null before all), of those equal on ``subset``.

    Partial minima come before the shuffle, so a text that a third of all rows share
    costs no task more than others.
    """
    # In a struct, so that a null is an order like any other.
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct(F.col(f"`{order}`").isNotNull(), F.col(f"`{order}`")))
    return docs.groupBy(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(subset)]).agg(first.alias("__row")).select("__row.*")


def show_duplicates(docs: DataFrame, subset: Iterable[str], order: str = "doc_id") -> DataFrame:
    """All rows but the first of those equal on ``subset``."""
    w = Window.partitionBy(*subset).orderBy(order)
    return docs.withColumn("__rank", F.row_number().over(w)).where("__rank > 1").drop("__rank")


def append(docs: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of several loads, columns by name; what a load lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), others, docs)


def records(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", active: Column | None = None) -> DataFrame:
    """Documents as records: counts, density, preview and content hash of each text."""
    out = docs.withColumn("__s", arrays.term_statistics(whitespace_tokens(F.col(text_col))))
    n, terms = (F.when(F.col(text_col).isNotNull(), F.col(f"__s.{c}")) for c in ("total_tokens", "total_terms"))
    return out.select(
        *docs.columns,
        (active if active is not None else F.lit(True)).alias("is_active"),
        n.alias("num_tokens"),
        terms.alias("num_terms"),
        F.when(n > 0, terms / n).otherwise(F.lit(0.0)).alias("vocab_density"),
        F.when(F.length(text_col) > 50, F.concat(F.substring(text_col, 1, 50), F.lit("..."))).otherwise(F.col(text_col)).alias("preview"),
        F.sha2(F.col(text_col).cast("binary"), 256).alias("content_hash"),
    )


def filter_records(rows: DataFrame, *, min_tokens: int | None = None, max_tokens: int | None = None, limit: int | None = None, **equal) -> DataFrame:
    """Rows that satisfy all given bounds and equalities; what is a column of the source reaches its scan."""
    for name, value in equal.items():
        rows = rows.where(F.col(name).isin(list(value)) if isinstance(value, list | tuple | set) else F.col(name) == value)
    if min_tokens is not None:
        rows = rows.where(F.col("num_tokens") >= min_tokens)
    if max_tokens is not None:
        rows = rows.where(F.col("num_tokens") <= max_tokens)
    return rows if limit is None else rows.limit(limit)


def lookup(rows: DataFrame, *, ids: Iterable | None = None, names: Iterable[str] | None = None, id_col: str = "doc_id", name_col: str = "name") -> DataFrame:
    """Records by id or by name."""
    if ids is not None:
        return rows.where(F.col(id_col).isin(list(ids)))
    return rows.where(F.col(name_col).isin(list(names or [])))


def remove(rows: DataFrame, gone: DataFrame, on: str = "doc_id") -> DataFrame:
    return rows.join(gone.select(on).distinct(), on, "left_anti")


def update(rows: DataFrame, changes: DataFrame, on: str = "doc_id") -> DataFrame:
    """Rows with the columns of ``changes`` where it has the id, and its rows that are new (upsert)."""
    new = changes.select(F.col(on), *[F.col(c).alias(f"__{c}") for c in changes.columns if c != on], F.lit(True).alias("__there"))
    joined = rows.join(new, on, "full")
    return joined.select(on, *[F.when(F.col("__there"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in changes.columns else F.col(c) for c in rows.columns if c != on])


def insert_missing(rows: DataFrame, new: DataFrame, on: str = "doc_id") -> DataFrame:
    return rows.unionByName(new.join(rows.select(on), on, "left_anti"), allowMissingColumns=True)


def unique_names(rows: DataFrame, name_col: str = "name", order: str = "doc_id") -> DataFrame:
    """Names made unique: second and later ones get ``-001``, ``-002`` and so on."""
    w = Window.partitionBy(name_col).orderBy(order)
    n = F.row_number().over(w) - 1
    return rows.withColumn(name_col, F.when(n > 0, F.concat(F.col(name_col), F.format_string("-%03d", n))).otherwise(F.col(name_col)))


def stats(rows: DataFrame) -> DataFrame:
    """One row: records, active records, tokens and terms of active ones, their mean density."""
    active = F.col("is_active")
    return rows.agg(
        F.count("*").alias("total_records"),
        F.count_if(active).alias("active_records"),
        F.coalesce(F.sum(F.when(active, F.col("num_tokens"))), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.sum(F.when(active, F.col("num_terms"))), F.lit(0)).alias("total_terms"),
        F.avg(F.when(active & (F.col("num_tokens") > 0), F.col("vocab_density"))).alias("average_vocab_density"),
        F.max(F.when(active, F.col("num_tokens"))).alias("max_tokens"),
    )


def inverted_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """term, doc_id: which documents hold which lower-case words; write it partitioned or bucketed by term for search."""
    words = F.regexp_extract_all(F.lower(text_col), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return each(docs, F.array_distinct(words), "__i", "term", F.col(id_col).alias("doc_id")).select("term", "doc_id")


def search(index: DataFrame, query: str) -> DataFrame:
    """Ids of documents that hold all words of the query (``OR`` between words: any)."""
    words = [w.lower() for w in query.split()]
    either = "or" in words
    words = sorted({w for w in words if w not in ("or", "and")})
    hits = index.where(F.col("term").isin(words)).groupBy("doc_id").agg(F.count_distinct("term").alias("__n"))
    return hits.where(F.col("__n") >= (1 if either else len(words))).select("doc_id")


def fingerprint(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row that changes with ids, activity and counts, whatever the order of rows.

    Row hashes are added up, so no sorted list of ids has to exist in one place.
    """
    own = F.conv(F.substring(F.sha2(F.concat_ws("|", F.col(id_col).cast("string"), F.col("is_active").cast("string"), F.col("num_tokens").cast("string")), 256), 1, 8), 16, 10).cast("long")
    return rows.agg(F.count("*").alias("num_docs"), F.count_if("is_active").alias("num_active_docs"), F.coalesce(F.sum(own), F.lit(0)).alias("content_sum")).withColumn(
        "fingerprint", F.substring(F.sha2(F.concat_ws("|", F.col("num_docs").cast("string"), F.col("num_active_docs").cast("string"), F.col("content_sum").cast("string")), 256), 1, 16)
    )


def flatten_metadata(rows: DataFrame, meta_col: str, keys: Iterable[str]) -> DataFrame:
    """Keys of a map column as columns; a name that is taken gets ``metadata_`` before it."""
    taken = set(rows.columns)
    return rows.select("*", *[F.col(meta_col)[k].alias(f"metadata_{k}" if k in taken else k) for k in keys]).drop(meta_col)


class Results:
    """Versioned results of analyses, each with the fingerprint of the corpus that it came from."""

    def __init__(self) -> None:
        self.stored: dict[str, dict] = {}

    def put(self, module: str, data: dict, mark: str, *, version: str = "1.0.0", overwrite: bool = False) -> None:
        if module in self.stored and not overwrite:
            raise ValueError(f"results of {module} exist; pass overwrite")
        self.stored[module] = {"version": version, "fingerprint": mark, "results": json.loads(json.dumps(data, default=str))}

    def get(self, module: str | None = None) -> dict:
        return dict(self.stored) if module is None else self.stored[module]

    def compatible(self, module: str, mark: str) -> bool:
        return self.stored[module]["fingerprint"] == mark
