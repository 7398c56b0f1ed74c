"""Keyword in context: every occurrence of a pattern with what stands around it."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.functions.tokens import natural_key
from textmill.operators.rows import each

_HITS = "array<struct<start: int, end: int, before: string, keyword: string, after: string>>"


def characters(docs: DataFrame, patterns: str | Iterable[str], *, window: int = 50, case_sensitive: bool = False, regex: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, pattern, start, before, keyword, after: non-overlapping matches with ``window`` characters at each side."""
    patterns = [patterns] if isinstance(patterns, str) else list(patterns)
    compiled = [(p, re.compile(p if regex else re.escape(p), 0 if case_sensitive else re.IGNORECASE)) for p in patterns]
    kind = pa.list_(pa.struct([("pattern", pa.string()), ("start", pa.int32()), ("before", pa.string()), ("keyword", pa.string()), ("after", pa.string())]))

    @F.arrow_udf("array<struct<pattern: string, start: int, before: string, keyword: string, after: string>>")
    def hits(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            out.append([{"pattern": p, "start": m.start(), "before": t[max(0, m.start() - window) : m.start()], "keyword": m[0], "after": t[m.end() : m.end() + window]} for p, r in compiled for m in r.finditer(t or "")])
        return pa.array(out, kind)

    return each(docs, hits(F.col(text_col)), "__i", "h", F.col(id_col).alias("doc_id")).select("doc_id", "h.*")


def token_context(docs: DataFrame, keyword: str, *, window: int = 5, case_sensitive: bool = False, regex: bool = False, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """doc_id, pos, before, keyword, after over an array of tokens: one pass, no join of neighbours."""
    t = F.col("__t")
    want = lambda x: (x.rlike(keyword if case_sensitive else f"(?iu){keyword}") if regex else x == keyword if case_sensitive else F.lower(x) == keyword.lower())
    places = F.filter(F.transform(t, lambda x, i: F.when(want(x), i)), lambda i: i.isNotNull())
    # The tokens have a name before they are used several times, so that they are made once.
    hit = each(docs.select(F.col(id_col).alias("doc_id"), F.col(tokens_col).alias("__t")), places, "__i", "pos", "doc_id", "__t")
    begin = F.greatest(F.lit(0), F.col("pos") - window)
    return hit.select(
        "doc_id",
        "pos",
        F.array_join(F.slice("__t", begin + 1, F.col("pos") - begin), " ").alias("before"),
        F.element_at("__t", F.col("pos") + 1).alias("keyword"),
        F.array_join(F.slice("__t", F.col("pos") + 2, F.lit(window)), " ").alias("after"),
    )


def phrase_context(docs: DataFrame, phrase: list[str], *, window: int = 5, case_sensitive: bool = False, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """As ``token_context`` for a run of tokens."""
    k = len(phrase)
    t = F.col("__t") if case_sensitive else F.transform("__t", lambda x: F.lower(x))
    want = F.array(*[F.lit(w if case_sensitive else w.lower()) for w in phrase])
    size = F.size("__t")
    starts = F.when(size >= k, F.sequence(F.lit(0), size - k)).otherwise(F.array().cast("array<int>"))
    places = F.transform(F.array(t), lambda low: F.filter(starts, lambda i: F.slice(low, i + 1, k) == want))[0]
    hit = each(docs.select(F.col(id_col).alias("doc_id"), F.col(tokens_col).alias("__t")), places, "__i", "pos", "doc_id", "__t")
    begin = F.greatest(F.lit(0), F.col("pos") - window)
    return hit.select(
        "doc_id", "pos", F.array_join(F.slice("__t", begin + 1, F.col("pos") - begin), " ").alias("before"), F.array_join(F.slice("__t", F.col("pos") + 1, F.lit(k)), " ").alias("keyword"), F.array_join(F.slice("__t", F.col("pos") + k + 1, F.lit(window)), " ").alias("after")
    )


def sort_hits(hits: DataFrame, by: str = "keyword", *, ascending: bool = True) -> DataFrame:
    """Hits in natural order of a column."""
    key = natural_key(F.col(by))
    return hits.orderBy(key.asc() if ascending else key.desc(), "doc_id")
