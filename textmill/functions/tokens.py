"""Tokens, n-grams and token predicates as array columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

ROMAN = "^(?=[MDCLXVI])M*(?:C[MD]|D?C{0,3})(?:X[CL]|L?X{0,3})(?:I[XV]|V?I{0,3})$"
#: A short English list; other languages and longer lists come as parameters.
STOPWORDS = tuple(
    "a about after all also an and any are as at be because been before but by can could did do does for from had has have he her him his how i if in into is it its just me more most my no not of on one only or "
    "other our out over she so some than that the their them then there these they this to up was we were what when which who will with would you your".split()
)


def whitespace_tokens(text: Column) -> Column:
    """What a split at white space gives, without empty tokens."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")


def word_tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores."""
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def word_and_mark_tokens(text: Column) -> Column:
    """Runs of word characters, and every other visible character by itself."""
    return F.regexp_extract_all(text, F.lit(r"(?U)([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])"), F.lit(1))


def sentences(text: Column) -> Column:
    """Cut after ``.``, ``!`` or ``?`` before white space."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s != "")


def slice_tokens(text: Column, n: int, *, drop_ws: bool = True) -> Column:
    """Slices of ``n`` characters; ``drop_ws`` takes spaces out first."""
    text = F.replace(text, F.lit(" "), F.lit("")) if drop_ws else text
    return F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{n}}})"), F.lit(1))


def space_widths(text: Column) -> Column:
    """Words, line breaks and runs of spaces, as structs with the width of the run."""
    found = F.regexp_extract_all(text, F.lit(r"(\n| +|[^\s]+)"), F.lit(1))
    return F.transform(found, lambda t: F.struct(t.alias("token"), F.when(t.startswith(" "), F.length(t)).otherwise(F.lit(0)).alias("width")))


def ngrams(tokens: Column, n: int, sep: str = " ") -> Column:
    """Runs of ``n`` tokens; none for shorter arrays."""

    def runs(t: Column) -> Column:
        starts = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(t, i, n), sep))

    # Bound to a variable, or else the tokens would be made again for every run.
    return F.transform(F.array(tokens), runs)[0]


def filter_tokens(tokens: Column, *, stops: Iterable[str] = (), drop_ws: bool = True, filter_digits: bool = False, filter_punct: bool = True) -> Column:
    """Drops tokens before n-grams are formed, so that these bridge what is gone."""
    tokens = F.transform(tokens, lambda t: F.trim(t)) if drop_ws else tokens
    stops = list(stops)

    def keep(t: Column) -> Column:
        ok = t != ""
        if stops:
            ok = ok & ~F.lower(t).isin(stops)
        if filter_punct:
            ok = ok & t.rlike(r"^[\p{L}\p{N}_]")
        if filter_digits:
            ok = ok & ~t.rlike(r"^\p{N}")
        return ok

    return F.filter(tokens, keep)


def is_roman(token: Column) -> Column:
    """Whether a token is an upper-case Roman numeral."""
    return token.rlike(ROMAN)


def is_word(token: Column, *, exclude: str | list[str] | None = None, exclude_digits: bool = False, exclude_roman: bool = False) -> Column:
    """Whether a token is all letters or all digits."""
    ok = token.rlike(r"^\p{L}+$") if exclude_digits else token.rlike(r"^(?:\p{L}+|\p{N}+)$")
    if exclude_roman:
        ok = ok & ~is_roman(token)
    if exclude:
        ok = ok & ~token.rlike(exclude if isinstance(exclude, str) else "|".join(f"(?:{x})" for x in exclude))
    return ok


def matched(tokens: Column, test: Callable[[Column], Column]) -> Column:
    """Places of the tokens that pass a test."""
    return F.filter(F.transform(tokens, lambda t, i: F.when(test(t), i)), lambda i: i.isNotNull())


def unmatched(tokens: Column, test: Callable[[Column], Column]) -> Column:
    """Places of all other tokens."""
    return F.filter(F.transform(tokens, lambda t, i: F.when(~F.coalesce(test(t), F.lit(False)), i)), lambda i: i.isNotNull())


def natural_key(term: Column) -> Column:
    """A key that sorts numbers within terms by value and letters without case."""
    parts = F.regexp_extract_all(term, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(F.lower(p))), "")
