"""Token tables with annotations: a tokenizer with attributes, stop words and components, models from outside, CoNLL-U text."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions import tokens as ft
from textmill.operators import tokens as T
from textmill.session import ship


class Tokenizer:
    """Texts to a token table with attributes.

    ``split`` makes tokens of a text column.  Attributes are column expressions over
    ``token`` and earlier attributes, computed in the order in which they were added;
    components map the finished table to another one and can be switched off.
    """

    def __init__(self, split: Callable[[Column], Column] = ft.whitespace_tokens, stopwords: Iterable[str] = ()):
        self.split, self.stopwords = split, set(stopwords)
        self.attributes: dict[str, Callable[[Column], Column]] = {}
        self.components: dict[str, Callable[[DataFrame], DataFrame]] = {}
        self.disabled: set[str] = set()

    @property
    def pipeline(self) -> list[str]:
        """Names of the components that run, in order."""
        return [name for name in self.components if name not in self.disabled]

    def add_stopwords(self, words: str | Iterable[str]) -> None:
        self.stopwords |= {words} if isinstance(words, str) else set(words)

    def remove_stopwords(self, words: str | Iterable[str]) -> None:
        self.stopwords -= {words} if isinstance(words, str) else set(words)

    def add_extension(self, name: str, value: Callable[[Column], Column] | object) -> None:
        """An attribute: a function of the token column, or the same value for all tokens."""
        if name in ("doc_id", "pos", "token", "is_stop"):
            raise ValueError(f"{name} is a column of every token table")
        self.attributes[name] = value if callable(value) else lambda token: F.lit(value)

    def remove_extension(self, name: str) -> None:
        if name not in self.attributes:
            raise KeyError(name)
        del self.attributes[name]

    def add_component(self, name: str, run: Callable[[DataFrame], DataFrame]) -> None:
        self.components[name] = run

    def make_docs(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: Iterable[str] = ()) -> DataFrame:
        """doc_id, pos, token, is_stop and the attributes, after all components; no shuffle by itself."""
        rows = T.tokens(docs, self.split, id_col=id_col, text_col=text_col, keep=keep)
        rows = rows.withColumn("is_stop", F.lower("token").isin(sorted(self.stopwords)) if self.stopwords else F.lit(False))
        for name, value in self.attributes.items():
            rows = rows.withColumn(name, value(F.col("token")))
        for name in self.pipeline:
            rows = self.components[name](rows)
        return rows

    __call__ = make_docs


def annotated(docs: DataFrame, model: Callable[[list[str]], Iterable[list[dict]]], fields: dict[str, str], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, pos, token and ``fields`` (name to SQL type) from a model of the caller's own.

    ``model`` takes a batch of texts and gives for each a list of tokens as dicts with
    ``token`` and any of the fields (lemma, tag, entity and so on); it is loaded where
    it runs, once a task if it builds itself at its first call.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, k, t["token"], *(t.get(f) for f in fields)) for i, own in zip(batch["doc_id"], model(batch["text"].fillna("").tolist()), strict=True) for k, t in enumerate(own)]
            yield pd.DataFrame(rows, columns=["doc_id", "pos", "token", *fields])

    schema = "doc_id long, pos int, token string" + "".join(f", `{f}` {kind}" for f, kind in fields.items())
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, schema)


def conllu(tokens: DataFrame, *, sentence: str | None = None, columns: Iterable[str | None] = (None,) * 8) -> DataFrame:
    """doc_id, text: the token table in ten tab-separated columns, a blank line after each sentence.

    ``columns`` names what stands after the number and the token (lemma, upos, xpos,
    feats, head, deprel, deps, misc); what is not there is an underscore.
    """
    sent = F.col(sentence) if sentence else F.lit(0)
    rest = [F.coalesce(F.col(c).cast("string"), F.lit("_")) if c else F.lit("_") for c in columns]
    line = F.struct(F.col("pos").alias("pos"), F.array_join(F.array(F.col("token"), *rest), "\t").alias("line"))
    by_sentence = tokens.groupBy("doc_id", sent.alias("s")).agg(F.array_sort(F.collect_list(line)).alias("x"))
    block = F.array_join(F.transform("x", lambda t, i: F.concat((i + 1).cast("string"), F.lit("\t"), t["line"])), "\n")
    by_doc = by_sentence.select("doc_id", F.struct(F.col("x")[0]["pos"].alias("at"), F.concat(block, F.lit("\n")).alias("block")).alias("b")).groupBy("doc_id").agg(F.array_sort(F.collect_list("b")).alias("b"))
    return by_doc.select("doc_id", F.concat(F.array_join(F.transform("b", lambda b: b["block"]), "\n"), F.lit("\n")).alias("text"))
