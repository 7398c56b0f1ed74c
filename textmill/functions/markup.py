"""Editing of HTML and XML text.

What a pattern can say without a parser is a column expression.  Operations on
selected elements go through a tolerant tokeniser in Arrow batches; markup that
is not touched is kept byte for byte.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

VOID = set("area base br col embed hr img input link meta source track wbr".split())
_TOKEN = re.compile(r"<!--.*?-->|<(/?)([A-Za-z][\w:.-]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*?)(/?)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")


def remove_comments(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<!--.*?-->", "")


def remove_doctype(text: Column) -> Column:
    """Drops the document type and the XML declaration."""
    return F.regexp_replace(text, r"(?i)<!DOCTYPE[^>]*>|<\?xml[^>]*>", "")


def tag_names(text: Column) -> Column:
    """Names of all opening tags, in order and lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"<([A-Za-z][A-Za-z0-9]*)"), F.lit(1)), lambda t: F.lower(t))


def unwrap_tag(text: Column, tag: str) -> Column:
    """Drops the tags of one name and keeps what they enclose."""
    return F.regexp_replace(text, rf"(?i)</?{tag}(?:\s[^>]*)?/?>", "")


def rename_tag(text: Column, tag: str, replacement: str) -> Column:
    return F.regexp_replace(text, rf"(?i)<(/?){tag}(?=[\s>/])", f"<$1{replacement}")


def _value(raw: str | None) -> str | None:
    return raw[1:-1] if raw and raw[0] in "\"'" else raw


def matches_value(value: str | None, pattern: str, matcher: str = "exact") -> bool:
    """Whether an attribute's value is, holds as a word, or has a match of ``pattern``."""
    if value is None:
        return False
    if matcher == "exact":
        return value == pattern
    return pattern in value.split() if matcher == "contains" else re.search(pattern, value) is not None


class _Select:
    """Elements by tag, ``.class`` or ``#id``, and by an attribute."""

    def __init__(self, selector: str, matcher: str, attribute: str | None, value: str | None):
        self.selector, self.matcher, self.attribute, self.value = selector, matcher, attribute, value

    def __call__(self, name: str, attributes: dict[str, str | None]) -> bool:
        s = self.selector
        if s.startswith("."):
            fits = s[1:] in (attributes.get("class") or "").split()
        elif s.startswith("#"):
            fits = attributes.get("id") == s[1:]
        else:
            fits = s == "*" or name.lower() == s.lower()
        if fits and self.attribute is not None:
            fits = self.attribute in attributes and (self.value is None or matches_value(attributes[self.attribute], self.value, self.matcher))
        return fits


def _attributes(raw: str) -> list[tuple[str, str | None, str]]:
    return [(m[1], _value(m[2]), m[0]) for m in _ATTRIBUTE.finditer(raw)]


def edit(text: str, select: Callable[[str, dict], bool], opening: Callable[[str, list, str], str | None], *, close: Callable[[str], str | None] | None = None, subtree: bool = False) -> str:
    """Rewrite matching elements.

    ``opening`` maps (name, attributes, whole tag) to new markup; ``close`` does so for
    the end tag that belongs to it; with ``subtree``, the content goes as well.
    """
    out: list[str] = []
    stack: list[tuple[str, bool]] = []
    at, hidden = 0, 0
    for m in _TOKEN.finditer(text):
        if not hidden:
            out.append(text[at : m.start()])
        at = m.end()
        if m[2] is None:
            if not hidden:
                out.append(m[0])
            continue
        name = m[2].lower()
        if m[1]:
            place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            chosen = False
            if place is not None:
                for n, c in stack[place:]:
                    hidden -= c and subtree
                chosen = stack[place][1]
                del stack[place:]
            if chosen and subtree:
                continue
            if not hidden:
                out.append((close(m[0]) or "") if chosen and close else m[0])
            continue
        listed = _attributes(m[3])
        chosen = select(name, {k: v for k, v, _ in listed})
        void = bool(m[4]) or name in VOID
        if not hidden and not (chosen and subtree):
            out.append((opening(m[2], listed, m[0]) or "") if chosen else m[0])
        if not void:
            stack.append((name, chosen))
            hidden += chosen and subtree
    if not hidden:
        out.append(text[at:])
    return "".join(out)


def _tag(name: str, attributes: list[tuple[str, str | None]], whole: str) -> str:
    inner = "".join(f" {k}" if v is None else f' {k}="{v}"' for k, v in attributes)
    return f"<{name}{inner}{'/' if whole.endswith('/>') else ''}>"


def _edited(text: Column, change: Callable[[str], str]) -> Column:
    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else change(t) for t in texts.to_pylist()], pa.string())

    return run(text)


def remove_element(text: Column, selector: str, *, matcher: str = "exact", attribute: str | None = None, value: str | None = None) -> Column:
    """Deletes elements with all they hold."""
    select = _Select(selector, matcher, attribute, value)
    return _edited(text, lambda t: edit(t, select, lambda *_: "", subtree=True))


def remove_tag(text: Column, selector: str, *, matcher: str = "exact", attribute: str | None = None, value: str | None = None) -> Column:
    """Unwraps elements: their content stays."""
    select = _Select(selector, matcher, attribute, value)
    return _edited(text, lambda t: edit(t, select, lambda *_: "", close=lambda _: ""))


def remove_attribute(text: Column, selector: str, name: str | None = None, *, matcher: str = "exact", attribute: str | None = None, value: str | None = None) -> Column:
    """Drops one attribute, or all, of elements."""
    select = _Select(selector, matcher, attribute, value)
    return _edited(text, lambda t: edit(t, select, lambda n, a, w: _tag(n, [(k, v) for k, v, _ in a if name is not None and k != name], w), close=lambda w: w))


def replace_attribute(text: Column, selector: str, old: str, new: str, *, find: str | None = None, repl: str | None = None, matcher: str = "exact", attribute: str | None = None, value: str | None = None) -> Column:
    """Renames an attribute and, with ``find``, replaces in its value."""
    select = _Select(selector, matcher, attribute, value)
    changed = lambda v: re.sub(find, repl or "", v) if find is not None and v is not None else v
    return _edited(text, lambda t: edit(t, select, lambda n, a, w: _tag(n, [(new, changed(v)) if k == old else (k, v) for k, v, _ in a], w), close=lambda w: w))


def replace_tag(text: Column, selector: str, replacement: str, *, keep_attributes: bool = True, matcher: str = "exact", attribute: str | None = None, value: str | None = None) -> Column:
    """Renames elements."""
    select = _Select(selector, matcher, attribute, value)
    return _edited(text, lambda t: edit(t, select, lambda n, a, w: _tag(replacement, [(k, v) for k, v, _ in a if keep_attributes], w), close=lambda _: f"</{replacement}>"))
