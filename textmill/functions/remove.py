"""Removal of parts of a text; every function maps a string column to a string column."""

from __future__ import annotations

import html
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textmill.functions.normalize import strip

_BRACKETS = {"curly": r"\{[^{}]*\}", "square": r"\[[^\[\]]*\]", "round": r"\([^()]*\)"}


def accents(text: Column, *, fast: bool = False, accents: str | list[str] | None = None) -> Column:
    """Combining marks dropped after decomposition; ``fast`` keeps ASCII only, ``accents`` names the marks to drop."""
    marks = set(accents) if accents is not None else None

    @F.arrow_udf("string")
    def bare(texts: pa.Array) -> pa.Array:
        def one(t: str) -> str:
            if t.isascii():
                return t
            if fast:
                return unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode("ascii")
            if marks is not None:
                return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", t) if c not in marks))
            return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))

        return pa.array([None if t is None else one(t) for t in texts.to_pylist()], pa.string())

    return bare(text)


def brackets(text: Column, *, only: str | list[str] | None = None) -> Column:
    """Drops brackets with what they hold, one kind after another, innermost only."""
    for kind in [only] if isinstance(only, str) else only or list(_BRACKETS):
        text = F.regexp_replace(text, _BRACKETS[kind], "")
    return text


def digits(text: Column, *, only: str | list[str] | None = None) -> Column:
    """Drops numbers with a sign; a list restricts the digits, a string is a pattern."""
    if only is None:
        return F.regexp_replace(text, r"[+-]?\p{N}+", "")
    return F.regexp_replace(text, only if isinstance(only, str) else "[" + "".join(map(re.escape, only)) + "]", "")


def new_lines(text: Column) -> Column:
    """Drops runs of line breaks; words at both sides join."""
    return strip(F.regexp_replace(text, r"(?:\r\n|[\n\x0B])+", ""))


def tabs(text: Column) -> Column:
    return F.regexp_replace(text, r"[\t\x0B]+", "")


def pattern(text: Column, *, pattern: str | list[str]) -> Column:
    return F.regexp_replace(text, pattern if isinstance(pattern, str) else "|".join(pattern), "")


def _marks(exclude: str | list[str] | None, only: str | list[str] | None) -> str:
    """The character class of punctuation that is meant."""
    escaped = lambda x: "".join("\\" + c if not c.isalnum() else c for c in x)
    if only:
        return f"[{escaped(only)}]"
    return rf"[\p{{P}}&&[^{escaped(exclude)}]]" if exclude else r"\p{P}"


def punctuation(text: Column, *, exclude: str | list[str] | None = None, only: str | list[str] | None = None) -> Column:
    return F.regexp_replace(text, _marks(exclude, only) + ("+" if only else ""), "")


_STAR = r"\*{2,4}\s*"
_BOOK_START = re.compile(rf"{_STAR}(?:START|BEGIN) OF (?:THE|THIS) PROJECT GUTENBERG|{_STAR}START\*|END\W*THE SMALL PRINT|This etext was prepared by|E-?text prepared by|Produced by |Distributed Proofreading Team", re.IGNORECASE)
_BOOK_END = re.compile(rf"{_STAR}END OF (?:THE|THIS) PROJECT GUTENBERG|End of (?:The |This )?Project Gutenberg|Ende dieses Project Gutenberg|Fin de Project Gutenberg", re.IGNORECASE)
_LEGAL_START, _LEGAL_END = re.compile(r"<<THIS ELECTRONIC VERSION OF", re.IGNORECASE), re.compile(r"SERVICE THAT CHARGES FOR DOWNLOAD", re.IGNORECASE)


def strip_book(text: str) -> str:
    """A public-domain e-book without the header, licence and footer that its archive adds."""
    kept: list[str] = []
    legal = False
    for line in text.splitlines():
        if len(kept) <= 600 and _BOOK_START.match(line):
            kept = []
            continue
        if len(kept) >= 100 and _BOOK_END.match(line):
            break
        if _LEGAL_START.match(line):
            legal = True
        elif _LEGAL_END.match(line):
            legal = False
        elif not legal:
            kept.append(line)
    return "\n".join(kept).strip()


def project_gutenberg_headers(text: Column) -> Column:
    @F.arrow_udf("string")
    def stripped(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else strip_book(t) for t in texts.to_pylist()], pa.string())

    return stripped(text)


def tags(text: Column, *, sep: str = " ", remove_whitespace: bool = True) -> Column:
    """Text between tags, joined by ``sep``; comments, declarations, scripts and styles go with their content."""
    out = F.regexp_replace(text, r"(?is)<!--.*?-->|<!\[CDATA\[|\]\]>|<(script|style)\b.*?</\1\s*>|<[!?][^>]*>", sep)
    out = F.regexp_replace(out, r"</?[A-Za-z][^>]*>", sep)
    out = html_unescape(out)
    return strip(F.regexp_replace(out, r"(?U)\s+", sep if sep else " ")) if remove_whitespace else out


@F.arrow_udf(StringType())
def _unescaped(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else html.unescape(t) if "&" in t else t for t in texts.to_pylist()], pa.string())


def html_unescape(text: Column) -> Column:
    """All named, decimal and hexadecimal character references, each decoded once."""
    return _unescaped(text)
