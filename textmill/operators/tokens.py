"""The long token table and what follows from it: terms, n-grams, sentences."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions import tokens as ft
from textmill.operators.rows import each


def tokens(docs: DataFrame, tokenizer: Callable[[Column], Column] = ft.whitespace_tokens, *, id_col: str = "doc_id", text_col: str = "text", keep: Iterable[str] = ()) -> DataFrame:
    """doc_id, pos, token (and the columns ``keep``): a row for each token, places from 0.  No shuffle."""
    return each(docs, tokenizer(F.col(text_col)), "pos", "token", F.col(id_col).alias("doc_id"), *keep)


def sentences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sent_no, sentence: cut after ``.``, ``!`` or ``?`` before white space."""
    return each(docs, ft.sentences(F.col(text_col)), "sent_no", "sentence", F.col(id_col).alias("doc_id"))


def sentence_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n for every row: 0 for a text without sentences, null for a null one.  What is no more than its mark isn't counted."""
    parts = F.filter(F.split(F.col(text_col), r"[.!?][\t\n\f\r ]+"), lambda s: s != "")
    return docs.select(F.col(id_col).alias("doc_id"), F.when(F.col(text_col).isNotNull(), F.size(parts)).cast("long").alias("n"))


def term_counts(tokens: DataFrame, *by: str) -> DataFrame:
    """Counts of terms, per ``by``; summed within partitions before the shuffle."""
    return tokens.groupBy(*by, F.col("token").alias("term")).agg(F.count("*").alias("n"))


def most_common(counts: DataFrame, n: int, *, ascending: bool = False) -> DataFrame:
    """The n terms with the highest (or lowest) counts, ties by term."""
    return counts.orderBy(F.col("n").asc() if ascending else F.col("n").desc(), "term").limit(n)


def top_per_group(counts: DataFrame, n: int, by: str, *, ascending: bool = False) -> DataFrame:
    """The n terms of each group; the ranking limit is pushed below the shuffle by the planner."""
    w = Window.partitionBy(by).orderBy(F.col("n").asc() if ascending else F.col("n").desc(), "term")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def without_stopwords(tokens: DataFrame, stopwords: Iterable[str] | DataFrame = ft.STOPWORDS) -> DataFrame:
    """An anti join with a list of stop words, or with a table of them."""
    if isinstance(stopwords, DataFrame):
        return tokens.join(stopwords.select(F.col(stopwords.columns[0]).alias("__stop")), F.lower("token") == F.col("__stop"), "left_anti")
    return tokens.where(~F.lower("token").isin(list(stopwords)))


def ngrams(docs: DataFrame, n: int = 2, *, tokenizer: Callable[[Column], Column] = ft.whitespace_tokens, min_freq: int = 1, lower: bool = True, id_col: str = "doc_id", text_col: str = "text", keep: Iterable[str] = (), **filters) -> DataFrame:
    """doc_id, pos, ngram (and the columns ``keep``); ``filters`` go to the token filter, ``min_freq`` drops rarer grams of the whole corpus."""
    words = tokenizer(F.lower(text_col) if lower else F.col(text_col))
    words = ft.filter_tokens(words, **filters) if filters else words
    grams = each(docs, ft.ngrams(words, n), "pos", "ngram", F.col(id_col).alias("doc_id"), *keep)
    if min_freq <= 1:
        return grams
    common = grams.groupBy("ngram").agg(F.count("*").alias("__n")).where(F.col("__n") >= min_freq).select("ngram")
    return grams.join(common, "ngram", "left_semi").select("doc_id", *keep, "pos", "ngram")
