"""Document-term matrices in long form: a row for each document and term that occurs in it."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions import tokens as ft
from textmill.functions.tokens import natural_key
from textmill.operators import arrays
from textmill.operators.rows import each


def dtm(tokens: DataFrame, *, min_df: int | None = None, max_df: float | int | None = None, max_terms: int | None = None, vocabulary: Iterable[str] | None = None, n_docs: int | None = None) -> DataFrame:
    """doc_id, term, n; vocabulary limits are semi joins with the terms that pass."""
    return _limited(tokens.groupBy("doc_id", F.col("token").alias("term")).agg(F.count("*").alias("n")), min_df, max_df, max_terms, vocabulary, n_docs)


def of_texts(docs: DataFrame, tokenizer: Callable[[Column], Column] = ft.whitespace_tokens, *, id_col: str = "doc_id", text_col: str = "text", keep: Iterable[str] = (), min_df: int | None = None, max_df: float | int | None = None, max_terms: int | None = None, vocabulary: Iterable[str] | None = None, n_docs: int | None = None) -> DataFrame:
    """The same from the texts, each counted within its row, with no shuffle; columns ``keep`` stay unless limits are set.

    A row is a document: rows that share an id are not added up.
    """
    rows = each(docs, arrays.term_counts()(tokenizer(F.col(text_col))), "__i", "__c", F.col(id_col).alias("doc_id"), *keep)
    return _limited(rows.select("doc_id", *keep, F.col("__c.term").alias("term"), F.col("__c.n").alias("n")), min_df, max_df, max_terms, vocabulary, n_docs)


def _limited(counts: DataFrame, min_df: int | None, max_df: float | int | None, max_terms: int | None, vocabulary: Iterable[str] | None, n_docs: int | None) -> DataFrame:
    if vocabulary is not None:
        counts = counts.where(F.col("term").isin(list(vocabulary)))
    if min_df is None and max_df is None and max_terms is None:
        return counts
    df = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("total"))
    if min_df is not None:
        df = df.where(F.col("df") >= min_df)
    if max_df is not None:
        if isinstance(max_df, float):
            df = df.where(F.col("df") <= max_df * (n_docs if n_docs is not None else counts.select("doc_id").distinct().count()))
        else:
            df = df.where(F.col("df") <= max_df)
    if max_terms is not None:
        df = df.orderBy(F.desc("total"), "term").limit(max_terms)
    return counts.join(df.select("term"), "term", "left_semi").select("doc_id", "term", "n")


def weighted(counts: DataFrame, *, tf: str = "linear", idf: bool = False, norm: str | None = None, n_docs: int | None = None) -> DataFrame:
    """doc_id, term, weight: tf linear, sqrt, log or binary; idf ``ln((1 + N) / (1 + df)) + 1``; norm l1 or l2."""
    n = F.col("n").cast("double")
    weight = {"linear": n, "sqrt": F.sqrt(n), "log": 1 + F.log(n), "binary": F.lit(1.0)}[tf]
    out = counts.withColumn("weight", weight)
    if idf:
        df = counts.groupBy("term").agg(F.count("*").alias("df"))
        total = F.lit(n_docs) if n_docs is not None else F.col("__docs")
        if n_docs is None:
            df = df.crossJoin(F.broadcast(counts.agg(F.count_distinct("doc_id").alias("__docs"))))
        out = out.join(df.select("term", (F.log((1 + total) / (1 + F.col("df"))) + 1).alias("__idf")), "term").withColumn("weight", F.col("weight") * F.col("__idf"))
    if norm:
        w = Window.partitionBy("doc_id")
        size = F.sum(F.abs("weight")).over(w) if norm == "l1" else F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(w))
        out = out.withColumn("weight", F.col("weight") / size)
    return out.select("doc_id", "term", "weight")


def sorted_term_counts(counts: DataFrame) -> DataFrame:
    """term, total in natural order."""
    return counts.groupBy("term").agg(F.sum("n").alias("total")).orderBy(natural_key(F.col("term")), "term")


def percentages(counts: DataFrame, *, per: str = "total", rounding: int = 3) -> DataFrame:
    """Counts as shares of the grand total, or with ``per="doc"`` of their document."""
    if per == "doc":
        whole = F.sum("n").over(Window.partitionBy("doc_id"))
        return counts.withColumn("percent", F.round(100 * F.col("n") / whole, rounding))
    total = counts.agg(F.sum("n").alias("__total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("percent", F.round(100 * F.col("n") / F.col("__total"), rounding)).drop("__total")


def pivot(counts: DataFrame, by: str, values: list[str], *, total: bool = False) -> DataFrame:
    """Terms by a few given labels; absent cells are 0."""
    out = counts.groupBy("term").pivot(by, values).agg(F.sum("n")).na.fill(0, values)
    return out.withColumn("Total", sum((F.col(f"`{v}`") for v in values), F.lit(0).cast("long"))) if total else out


def margins(counts: DataFrame, n_docs: int) -> DataFrame:
    """term, total, mean, median over all documents, absent cells as zeros without making them."""
    half = (n_docs + 1) / 2
    w = Window.partitionBy("term").orderBy("n", "doc_id")
    ranked = counts.withColumn("r", F.row_number().over(w) + n_docs - F.count("*").over(Window.partitionBy("term")))
    low, high = int(half), int(half + 0.5)
    agg = ranked.groupBy("term").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("r") == low, F.col("n"))).alias("a"), F.sum(F.when(F.col("r") == high, F.col("n"))).alias("b"))
    return agg.select("term", "total", (F.col("total") / n_docs).alias("mean"), ((F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0))) / 2).alias("median"))


def unpivot(wide: DataFrame, keys: list[str], values: list[str], names: str = "variable", value: str = "value") -> DataFrame:
    return wide.unpivot(keys, values, names, value)
