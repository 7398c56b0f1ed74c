"""Milestones: matches of patterns, lines, sentences and given spans, as intervals and as IOB tags."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmill.operators.rows import each


def string_matches(docs: DataFrame, patterns: str | Iterable[str], *, case_sensitive: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, end, text: all matches of all patterns as character spans, in order of start."""
    patterns = [patterns] if isinstance(patterns, str) else list(patterns)
    flags = re.DOTALL | re.MULTILINE | (0 if case_sensitive else re.IGNORECASE)
    compiled = [re.compile(p, flags) for p in patterns]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))

    @F.arrow_udf("array<struct<start: int, end: int, text: string>>")
    def spans(texts: pa.Array) -> pa.Array:
        return pa.array([sorted(({"start": m.start(), "end": m.end(), "text": m[0]} for r in compiled for m in r.finditer(t or "")), key=lambda s: (s["start"], s["end"])) for t in texts.to_pylist()], kind)

    return each(docs, spans(F.col(text_col)), "__i", "s", F.col(id_col).alias("doc_id")).select("doc_id", "s.*")


def tokens_with_offsets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, pos, token, start, end of white-space tokens, with character offsets."""
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("token", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    @F.arrow_udf("array<struct<pos: int, token: string, start: int, end: int>>")
    def placed(texts: pa.Array) -> pa.Array:
        return pa.array([[{"pos": i, "token": m[0], "start": m.start(), "end": m.end()} for i, m in enumerate(re.finditer(r"\S+", t or ""))] for t in texts.to_pylist()], kind)

    return each(docs, placed(F.col(text_col)), "__i", "t", F.col(id_col).alias("doc_id")).select("doc_id", "t.*")


def spans_to_tokens(spans: DataFrame, tokens: DataFrame) -> DataFrame:
    """First and last token that each character span touches: a range join within each document."""
    s, t = spans.alias("s"), tokens.alias("t")
    hit = s.join(t, (F.col("s.doc_id") == F.col("t.doc_id")) & (F.col("t.start") < F.col("s.end")) & (F.col("t.end") > F.col("s.start")))
    return hit.groupBy(F.col("s.doc_id").alias("doc_id"), F.col("s.start").alias("start"), F.col("s.end").alias("end")).agg(F.min("t.pos").alias("first_token"), F.max("t.pos").alias("last_token"))


def token_matches(tokens: DataFrame, pattern: str, *, case_sensitive: bool = True) -> DataFrame:
    return tokens.where(F.col("token").rlike(pattern if case_sensitive else f"(?iu){pattern}"))


def lines(docs: DataFrame, *, step: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, milestone, text: groups of ``step`` non-empty lines."""
    parts = F.filter(F.split(text_col, "\n"), lambda x: F.trim(x) != "")
    return _groups(docs, parts, step, "\n", id_col)


def _groups(docs: DataFrame, parts, step: int, sep: str, id_col: str) -> DataFrame:
    """``step`` parts of a text at a time."""
    own = docs.select(F.col(id_col).alias("doc_id"), parts.alias("__p"))
    if step == 1:
        return each(own, F.col("__p"), "milestone", "text", "doc_id")
    starts = F.when(F.size("__p") > 0, F.sequence(F.lit(1), F.size("__p"), F.lit(step))).otherwise(F.array().cast("array<int>"))
    return each(own, F.transform(starts, lambda a: F.array_join(F.slice("__p", a, F.lit(step)), sep)), "milestone", "text", "doc_id")


def sentence_groups(docs: DataFrame, *, step: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, milestone, text: groups of ``step`` sentences."""
    parts = F.filter(F.split(text_col, r"(?<=[.!?])\s+"), lambda x: x != "")
    return _groups(docs, parts, step, " ", id_col)


def iob(tokens: DataFrame, is_milestone: str, *, most: int = 20) -> DataFrame:
    """Tags of tokens: B where a milestone begins, I inside a run of them, O elsewhere; label cut to ``most`` characters."""
    hit = F.col("token").rlike(is_milestone)
    before = F.coalesce(F.lag(hit).over(Window.partitionBy("doc_id").orderBy("pos")), F.lit(False))
    label = F.when(F.length("token") > most, F.concat(F.substring("token", 1, most), F.lit("..."))).otherwise(F.col("token"))
    return tokens.select("doc_id", "pos", "token", F.when(hit & before, "I").when(hit, "B").otherwise("O").alias("iob"), F.when(hit, label).otherwise("").alias("label"))


def segments(tokens: DataFrame, milestone: str) -> DataFrame:
    """Tokens with the number of milestones at or before them: 0 before the first."""
    upto = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return tokens.withColumn("segment", F.sum((F.col("token") == milestone).cast("long")).over(upto))


def without_milestones(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """Tokens outside of spans (doc_id, first_token, last_token)."""
    t, s = tokens.alias("t"), spans.alias("s")
    return t.join(s, (F.col("t.doc_id") == F.col("s.doc_id")) & F.col("t.pos").between(F.col("s.first_token"), F.col("s.last_token")), "left_anti")


def move(spans: DataFrame, n_tokens: DataFrame, where: str) -> DataFrame:
    """Spans shifted to the token before or after; those at an edge go.  ``n_tokens`` has doc_id, n."""
    if where == "before":
        return spans.where("first_token > 0").withColumns({"first_token": F.col("first_token") - 1, "last_token": F.col("first_token") - 1})
    at = spans.join(n_tokens, "doc_id").where(F.col("last_token") + 1 < F.col("n")).drop("n")
    return at.withColumns({"first_token": F.col("last_token") + 1, "last_token": F.col("last_token") + 1})
