"""A corpus as one object: a DataFrame of documents with the operators as methods."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions.tokens import whitespace_tokens
from textmill.operators import corpus as C
from textmill.operators import distinct, dtm, kwic, stats, windows
from textmill.operators import tokens as T
from textmill.plans.scrubber import make_pipeline
from textmill.session import ship
from textmill.sources import readers, sinks


class Corpus:
    """Documents (doc_id, text and any metadata).  Every method is lazy unless it says that it writes or fetches."""

    def __init__(self, docs: DataFrame, tokenizer: Callable[[Column], Column] = whitespace_tokens):
        ship(docs.sparkSession)
        self.docs, self.tokenizer = docs, tokenizer

    @classmethod
    def from_files(cls, spark: SparkSession, paths: str | Iterable[str], **how) -> Corpus:
        rows = readers.good(readers.files(spark, paths, **how))
        return cls(rows.select(F.xxhash64("path", "name").alias("doc_id"), "*"))

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Corpus:
        return cls(sinks.load_corpus(spark, folder)[0])

    def save(self, folder: str, metadata: dict | None = None) -> None:
        sinks.save_corpus(self.docs, folder, metadata)

    def _with(self, docs: DataFrame) -> Corpus:
        return Corpus(docs, self.tokenizer)

    def add(self, other: Corpus | DataFrame) -> Corpus:
        return self._with(C.append(self.docs, other.docs if isinstance(other, Corpus) else other))

    def filter(self, **how) -> Corpus:
        return self._with(C.filter_records(self.docs, **how))

    def get(self, ids: Iterable | None = None, names: Iterable[str] | None = None) -> DataFrame:
        return C.lookup(self.docs, ids=ids, names=names)

    def remove(self, ids: Iterable) -> Corpus:
        return self._with(self.docs.where(~F.col("doc_id").isin(list(ids))))

    def dedupe(self, subset: Iterable[str] = ("text",)) -> Corpus:
        return self._with(C.dedupe(self.docs, subset))

    def scrub(self, *items) -> Corpus:
        return self._with(self.docs.withColumn("text", make_pipeline(*items)(F.col("text"))))

    def tokens(self, keep: Iterable[str] = ()) -> DataFrame:
        return T.tokens(self.docs, self.tokenizer, keep=keep)

    def term_counts(self, n: int = 10, *, most_common: bool = True) -> DataFrame:
        return T.most_common(T.term_counts(self.tokens()), n, ascending=not most_common)

    def dtm(self, **how) -> DataFrame:
        return dtm.of_texts(self.docs, self.tokenizer, **how)

    def doc_stats(self) -> DataFrame:
        return stats.doc_stats_of(self.docs, self.tokenizer)

    def records(self, active: Column | None = None) -> DataFrame:
        return C.records(self.docs, active=active)

    def fingerprint(self) -> str:
        """Fetches one row."""
        return C.fingerprint(self.records()).first().fingerprint

    def search(self, query: str) -> DataFrame:
        hits = C.search(C.inverted_index(self.docs), query)
        return self.docs.join(hits, "doc_id", "left_semi")

    def kwic(self, patterns: str | Iterable[str], **how) -> DataFrame:
        return kwic.characters(self.docs, patterns, **how)

    def rolling(self, patterns: str | Iterable[str], n: int, **how) -> DataFrame:
        return windows.text_counts(self.docs, patterns, n, tokenizer=self.tokenizer, **how)

    def compare(self, by: str, topn: int | None = None) -> DataFrame:
        """Distinctive terms of each value of a metadata column against all others."""
        return distinct.compare_with_rest(T.term_counts(self.tokens([by]), by), by, topn)
