"""Structural stylometry: relative frequencies of the commonest features, z-scores, distances."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions import tokens as ft
from textmill.operators import arrays, blocks
from textmill.operators import tokens as T
from textmill.operators.rows import each
from textmill.shared import materialize

#: Words, white space that carries structure, and marks.
STRUCTURE = r"(?U)([\p{L}\p{N}_]+|\n{2,}| {2,}|[^\p{L}\p{N}_\s])"


def structural_tokens(docs: DataFrame, *, mode: str = "all", lowercase: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, pos, token: words, marks and white-space markers; ``mode`` is all, words, punctuation or whitespace."""
    text = F.regexp_replace(F.lower(text_col) if lowercase else F.col(text_col), r"[ \t]+(?=\n)", "\x01")
    raw = F.regexp_extract_all(text, F.lit(STRUCTURE), F.lit(1))
    names = {"\n": "[WS_MULTIPLE_NEWLINE]", "\x01": "[WS_TRAILING_SPACE]", " ": "[WS_DOUBLE_SPACE]"}
    marker = lambda t: F.when(t.startswith("\n"), names["\n"]).when(t == "\x01", names["\x01"]).when(t.startswith(" "), names[" "]).otherwise(t)
    found = F.transform(raw, marker)
    rows = each(docs, found, "pos", "token", F.col(id_col).alias("doc_id"))
    kinds = {"words": F.col("token").rlike(r"^[\p{L}\p{N}_]"), "whitespace": F.col("token").startswith("[WS_"), "punctuation": ~F.col("token").rlike(r"^[\p{L}\p{N}_]") & ~F.col("token").startswith("[WS_")}
    return rows.where(kinds[mode]) if mode in kinds else rows


def features(counts: DataFrame, most: int = 100) -> DataFrame:
    """doc_id, term, freq for the ``most`` commonest terms: relative frequency, zeros included.

    The result has ``most`` rows a document, whatever the vocabulary.
    """
    sizes = counts.groupBy("doc_id").agg(F.sum("n").alias("size"))
    top = counts.groupBy("term").agg(F.sum("n").alias("t")).orderBy(F.desc("t"), "term").limit(most).select("term")
    grid = sizes.crossJoin(F.broadcast(top))
    return grid.join(counts, ["doc_id", "term"], "left").select("doc_id", "term", (F.coalesce("n", F.lit(0)) / F.col("size")).alias("freq"))


def profiles(docs: DataFrame, most: int = 100, tokenizer: Callable[[Column], Column] = ft.whitespace_tokens, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """The same as arrays: doc_id and values (the frequency of each of the commonest terms), and these terms in order.

    One pass counts the corpus for the terms (``most`` strings come to the driver), one
    makes the arrays row by row, without a shuffle, and writes them to the shared folder,
    as all that is done with them reads them several times.  Texts without tokens get none.
    """
    counts = T.term_counts(T.tokens(docs, tokenizer, id_col=id_col, text_col=text_col))
    terms = sorted(r.term for r in T.most_common(counts, most).collect())
    own = docs.select(F.col(id_col).alias("doc_id"), arrays.shares(terms)(tokenizer(F.col(text_col))).alias("values")).where("values is not null")
    return materialize(own, "profiles"), terms


def long(values: DataFrame, terms: list[str], value: str = "freq") -> DataFrame:
    """doc_id, term and value of arrays in the order of ``terms``."""
    names = F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")
    return each(values, F.col("values"), "__i", value, "doc_id").select("doc_id", F.element_at(names, F.col("__i") + 1).alias("term"), value)


def burrows_values(values: DataFrame) -> DataFrame:
    """doc_id, values: the z-scores of arrays over documents, by the population deviation (1e-6 where it is 0)."""
    by = each(values, F.col("values"), "i", "x").groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("i").collect()
    mean, spread = (F.array(*[F.lit(float(x)) for x in xs]).cast("array<double>") for xs in ([r.m for r in by], [r.s or 1e-6 for r in by]))
    return values.select("doc_id", F.zip_with(F.zip_with("values", mean, lambda a, b: a - b), spread, lambda a, b: a / b).alias("values"))


def burrows_z(feats: DataFrame) -> DataFrame:
    """doc_id, term, z over documents, by the population deviation (1e-6 where it is 0)."""
    by = feats.groupBy("term").agg(F.avg("freq").alias("m"), F.stddev_pop("freq").alias("s"))
    return feats.join(F.broadcast(by), "term").select("doc_id", "term", ((F.col("freq") - F.col("m")) / F.when(F.col("s") == 0, 1e-6).otherwise(F.col("s"))).alias("z"))


def tfidf(feats: DataFrame, n_docs: int) -> DataFrame:
    df = feats.where("freq > 0").groupBy("term").agg(F.count("*").alias("df"))
    return feats.join(F.broadcast(df), "term").select("doc_id", "term", (F.col("freq") * (F.log(F.lit(1 + n_docs) / (1 + F.col("df"))) + 1)).alias("weight"))


def delta(values: DataFrame, queries: DataFrame, *, kind: str = "classic") -> DataFrame:
    """query_id, doc_id, delta: Burrows' Delta of the stated query documents (doc_id) to all others.

    z-scores come as arrays (doc_id, values) or as a long table (doc_id, term, z).
    """
    if "values" not in values.columns:
        values = values.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("term", "z"))), lambda x: x["z"]).alias("values"))
    score = (lambda v, x: np.abs(x - v).mean(1)) if kind == "classic" else (lambda v, x: np.sqrt(((x - v) ** 2).sum(1)))
    v = values.select("doc_id", F.col("values").alias("v"))
    return blocks.against(v, v.join(queries.select("doc_id").distinct(), "doc_id", "left_semi"), score, "delta")


def scale(feats: DataFrame, by: str, value: str, kind: str = "z") -> DataFrame:
    """Values of each row or column (``by``) as z-scores or between 0 and 1."""
    # Partial sums and a join with one row for each group, so that no group has to fit into a task.
    about = feats.groupBy(F.col(by).alias("__by")).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"), F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    joined, x = feats.join(about, F.col(by).eqNullSafe(F.col("__by"))), F.col(value)
    if kind == "z":
        scaled = F.when(F.col("__s") == 0, 0.0).otherwise((x - F.col("__m")) / F.col("__s"))
    else:
        scaled = F.when(F.col("__hi") == F.col("__lo"), 0.0).otherwise((x - F.col("__lo")) / (F.col("__hi") - F.col("__lo")))
    return joined.withColumn(value, scaled).select(*[F.col(f"`{c}`") for c in feats.columns])
