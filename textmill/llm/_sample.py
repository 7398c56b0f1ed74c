"""Bounded samples of labelled texts for fitting."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm._common import text_of

#: Bytes of text that come to the driver, at most.
MOST_BYTES = 96 << 20


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, most: int, *, most_bytes: int = MOST_BYTES, among: Column | None = None, seed: int = 5, id_col: str = "doc_id", text_col: str = "text") -> pd.DataFrame:
    """At most ``most`` labelled documents of ``most_bytes`` together, with their whole texts: doc_id, text, label.

    The documents are those with the smallest seeded hash of their id, so the
    sample is the same on every run; in that order a text that would go beyond
    ``most_bytes`` is left out.  ``among`` may restrict the ids.  Rows with a null id
    or label are no labels; of several labels the smallest holds; of several texts of
    one id the smallest.
    """
    own = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("label")).where("doc_id is not null and label is not null")
    if among is not None:
        own = own.where(among)
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    chosen = own.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(order, "doc_id").limit(most)
    texts = text_of(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    # The broadcast side has at most ``most`` rows of two numbers, and so have the sizes.
    sizes = texts.select("doc_id", F.octet_length("text").alias("size")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("size").alias("size"), F.first("label").alias("label"))
    left, rows = most_bytes, []
    for r in sizes.orderBy(order, "doc_id").collect():
        if r.size <= left:
            left -= r.size
            rows.append((r.doc_id, r.label))
    kept = docs.sparkSession.createDataFrame(rows, "doc_id long, label int")
    found = texts.join(F.broadcast(kept), "doc_id").groupBy("doc_id").agg(F.first("label").alias("label"), F.min("text").alias("text"))
    return found.orderBy("doc_id").toArrow().to_pandas(split_blocks=True, self_destruct=True)
