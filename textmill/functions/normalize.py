"""Normalising of text; every function maps a string column to a string column."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word characters in all engines: Java's own class is ASCII only.
WORD = r"[\p{L}\p{N}_]"
_BULLETS = "•‣⁃⁌⁍∙▪●◦⦾⦿・"
_CURLY, _STRAIGHT = "ʼ‘’´`“”", "'''''\"\""


def lower_case(text: Column) -> Column:
    return F.lower(text)


def bullet_points(text: Column) -> Column:
    """A bullet that is the first visible character of a line becomes ``-``."""
    return F.regexp_replace(text, rf"((?:^|\n)\s*?)[{_BULLETS}]", "$1-")


def hyphenated_words(text: Column) -> Column:
    """Joins a word that a hyphen and white space split; no digit may touch the hyphen."""
    return F.regexp_replace(text, rf"(?U)({WORD}{{1,}}[\p{{L}}_])-\s+([\p{{L}}_]{WORD}{{1,}})", "$1$2")


def quotation_marks(text: Column) -> Column:
    return F.translate(text, _CURLY, _STRAIGHT)


def repeating_chars(text: Column, *, chars: str, maxn: int = 1) -> Column:
    """Runs of the string ``chars`` longer than ``maxn`` become ``maxn`` of it."""
    if not chars:
        return text
    return F.regexp_replace(text, f"(?:{re.escape(chars)}){{{maxn + 1},}}", (chars * maxn).replace("\\", "\\\\").replace("$", "\\$"))


def unicode(text: Column, *, form: str = "NFC") -> Column:
    """Unicode normal form; Spark has no function for it, so batches go through Arrow."""
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(f"no normal form {form!r}")

    @F.arrow_udf("string")
    def normal(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else unicodedata.normalize(form, t) for t in texts.to_pylist()], pa.string())

    return normal(text)


def strip(text: Column) -> Column:
    """Without white space at both ends, of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def whitespace(text: Column) -> Column:
    """No zero-width characters, one line break for a run, one space for other runs, none at the ends."""
    out = F.regexp_replace(text, "[​⁠﻿]+", "")
    out = F.regexp_replace(out, r"(?:\r\n|[\n\x0B])+", "\n")
    return strip(F.regexp_replace(out, r"(?U)[\s&&[^\n\x0B]]+", " "))
