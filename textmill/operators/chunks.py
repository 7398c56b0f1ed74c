"""Cutting of texts and token lists into chunks; one row in, many rows out."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions import tokens as ft
from textmill.operators.rows import each

_NONE = "array<int>"


def _merged_starts(size: Column, chunk: int, threshold: float, merge_final: bool) -> Column:
    """Starts (from 0) of chunks; a last one shorter than ``threshold`` of a chunk goes with the one before."""
    n = F.ceil(size / chunk).cast("int")
    short = (size % chunk != 0) & (size % chunk < chunk * threshold)
    n = n - F.when((n > 1) & (F.lit(True) if merge_final else short), 1).otherwise(0)
    return F.when(size > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * chunk)).otherwise(F.array().cast(_NONE))


def _explode(docs: DataFrame, pieces: Column, chunk_type: str, id_col: str) -> DataFrame:
    """One row per piece.  Only the pieces are repeated, never what they are cut from."""
    return each(docs, pieces, "chunk_no", chunk_type, F.col(id_col).alias("doc_id"))


def _slices(starts: Column, size: Column, piece) -> Column:
    """``piece(a, b)`` for each start up to the next one."""
    return F.transform(starts, lambda s, i: piece(s, F.coalesce(F.get(starts, i + 1), size).cast("int")))


def by_characters(docs: DataFrame, chunk: int, *, merge_threshold: float = 0.5, merge_final: bool = False, overlap: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, chunk_no, chunk; ``overlap`` puts the end of the chunk before in front.

    One pass of a pattern cuts the text, so the time grows with its length and not
    with length times chunks.
    """
    own = docs.select(F.col(id_col).alias(id_col), F.regexp_extract_all(text_col, F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0)).alias("__c"))
    n = F.size("__c")
    last = F.get("__c", n - 1)
    short = F.lit(True) if merge_final else (F.length(last) < chunk) & (F.length(last) < chunk * merge_threshold)
    merged = F.concat(F.slice("__c", F.lit(1), F.greatest(n - 2, F.lit(0))), F.array(F.concat(F.get("__c", n - 2), last)))
    own = own.select(id_col, F.when((n > 1) & short, merged).otherwise(F.col("__c")).alias("__m"))
    if not overlap:
        return _explode(own, F.col("__m"), "chunk", id_col)
    # What lies before a chunk may be longer than the chunk before it.
    back = -(-overlap // chunk)
    front = lambda i: F.right(F.array_join(F.slice("__m", F.greatest(i - back, F.lit(0)) + 1, F.least(i, F.lit(back))), ""), F.lit(overlap))
    return _explode(own, F.transform("__m", lambda c, i: F.when(i > 0, F.concat(front(i), c)).otherwise(c)), "chunk", id_col)


def by_tokens(docs: DataFrame, chunk: int, *, merge_threshold: float = 0.5, merge_final: bool = False, overlap: int = 0, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """doc_id, chunk_no, tokens; ``overlap`` adds the first tokens of the next chunk."""
    size = F.size(tokens_col)
    starts = _merged_starts(size, chunk, merge_threshold, merge_final)
    own = docs.select(F.col(id_col).alias(id_col), F.col(tokens_col).alias("__t"), starts.alias("__s"))
    return _explode(own, _slices(F.col("__s"), F.size("__t"), lambda a, b: F.slice("__t", a + 1, b - a + overlap)), "tokens", id_col)


def into_parts(docs: DataFrame, n: int, *, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """``n`` near-equal parts; the first ``size % n`` have one token more."""
    size = F.size(tokens_col)
    base, more = F.floor(size / n).cast("int"), size % n
    starts = F.filter(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i * base + F.least(i, more)), lambda s: s < size)
    own = docs.select(F.col(id_col).alias(id_col), F.col(tokens_col).alias("__t"), starts.alias("__s"))
    return _explode(own, _slices(F.col("__s"), F.size("__t"), lambda a, b: F.slice("__t", a + 1, b - a)), "tokens", id_col)


def by_lines(docs: DataFrame, n: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks of ``n`` lines."""
    return by_pieces(docs, F.split(text_col, "\n"), n, "\n", id_col=id_col)


def by_sentences(docs: DataFrame, n: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return by_pieces(docs, F.filter(F.split(text_col, r"(?<=[.!?])\s+"), lambda s: s != ""), n, " ", id_col=id_col)


def by_pieces(docs: DataFrame, pieces: Column, n: int, sep: str, *, id_col: str = "doc_id") -> DataFrame:
    own = docs.select(F.col(id_col).alias("doc_id"), pieces.alias("p"))
    size = F.size("p")
    starts = F.when(size > 0, F.sequence(F.lit(1), size, F.lit(n))).otherwise(F.array().cast(_NONE))
    return _explode(own, F.transform(starts, lambda a: F.array_join(F.slice("p", a, F.lit(n)), sep)), "chunk", "doc_id")


def on_milestones(tokens: DataFrame, milestone: str, *, keep: str | None = None) -> DataFrame:
    """doc_id, chunk_no, chunk: tokens between milestones; ``keep`` puts a milestone with what follows or precedes it."""
    hit = F.col("token") == milestone
    order = Window.partitionBy("doc_id").orderBy("pos")
    frame = order.rowsBetween(Window.unboundedPreceding, -1 if keep == "preceding" else Window.currentRow)
    own = tokens.withColumn("chunk_no", F.coalesce(F.sum(hit.cast("int")).over(frame), F.lit(0)).cast("int"))
    if keep is None:
        own = own.where(~hit)
    return own.groupBy("doc_id", "chunk_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), " ").alias("chunk"))


def texts_on_milestones(docs: DataFrame, milestone: str, *, keep: str | None = None, tokenizer: Callable[[Column], Column] = ft.whitespace_tokens, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same from the texts, cut within their rows, with no shuffle."""
    kind = pa.list_(pa.struct([("chunk_no", pa.int32()), ("chunk", pa.string())]))

    def cut(words: list[str]) -> list[dict]:
        hits = [i for i, w in enumerate(words) if w == milestone]
        # A milestone ends its chunk if it belongs to what precedes it, else it starts one.
        ends = [i + (keep == "preceding") for i in hits]
        out = []
        for no, (a, b) in enumerate(zip([0, *ends], [*ends, len(words)], strict=True)):
            if keep is None and no:
                a += 1
            if a < b:
                out.append({"chunk_no": no, "chunk": " ".join(words[a:b])})
        return out

    @F.arrow_udf("array<struct<chunk_no: int, chunk: string>>")
    def chunks(tokens: pa.Array) -> pa.Array:
        return pa.array([cut(t or []) for t in tokens.to_pylist()], kind)

    return each(docs, chunks(tokenizer(F.col(text_col))), "__i", "c", F.col(id_col).alias("doc_id")).select("doc_id", "c.*")


def merge(chunks: DataFrame, sep: str = " ", *, order: str = "chunk_no", text_col: str = "chunk") -> DataFrame:
    """Chunks of each document joined in order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text_col).alias("t"))))
    return chunks.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda x: x["t"]), sep).alias("text"))


def names(chunks: DataFrame, stem: str = "doc", *, delimiter: str = "_", pad: int = 3) -> DataFrame:
    """A file name for each chunk, numbered from 1."""
    return chunks.withColumn("name", F.concat(F.lit(stem), F.col("doc_id").cast("string"), F.lit(delimiter), F.lpad((F.col("chunk_no") + 1).cast("string"), pad, "0")))
