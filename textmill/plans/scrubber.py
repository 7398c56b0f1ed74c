"""Scrubbing pipelines: named components, composed into one column expression.

All stages of a pipeline become one projection, so the planner fuses them; stages
that need Python become Arrow UDFs in the same plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions import markup, normalize, remove, replace

Function = Callable[..., Column]

COMPONENTS: dict[str, Function] = {
    **{n: getattr(normalize, n) for n in ("bullet_points", "hyphenated_words", "lower_case", "quotation_marks", "repeating_chars", "unicode", "whitespace")},
    **{n: getattr(remove, n) for n in ("accents", "brackets", "new_lines", "project_gutenberg_headers", "tabs", "tags")},
    "digits": remove.digits,
    "punctuation": remove.punctuation,
    "pattern": remove.pattern,
    **{n: getattr(replace, n) for n in ("currency_symbols", "emails", "emojis", "hashtags", "phone_numbers", "special_characters", "urls", "user_handles")},
    "re_digits": replace.digits,
    "re_pattern": replace.pattern,
    "re_punctuation": replace.punctuation,
    **{n: getattr(markup, n) for n in ("remove_attribute", "remove_comments", "remove_doctype", "remove_element", "remove_tag", "replace_attribute", "replace_tag")},
}


def register(name: str, function: Function) -> None:
    COMPONENTS[name] = function


def get_component(name: str) -> Function:
    try:
        return COMPONENTS[name]
    except KeyError:
        raise KeyError(f"no component {name!r}; there are {', '.join(sorted(COMPONENTS))}") from None


def get_components(names: Iterable[str]) -> list[Function]:
    return [get_component(n) for n in names]


@dataclass
class Pipe:
    """One stage: a component's name, its options, or a function of one's own."""

    name: str
    options: dict = field(default_factory=dict)
    function: Function | None = None

    def __call__(self, text: Column) -> Column:
        return (self.function or get_component(self.name))(text, **self.options)


def _pipe(item: str | tuple | Pipe | Function) -> Pipe:
    if isinstance(item, Pipe):
        return item
    if isinstance(item, str):
        return Pipe(item)
    if isinstance(item, tuple):
        head, options = item
        return Pipe(head, dict(options)) if isinstance(head, str) else Pipe(getattr(head, "__name__", "custom"), dict(options), head)
    if isinstance(item, partial):
        return Pipe(item.func.__name__, dict(item.keywords), item.func)
    return Pipe(getattr(item, "__name__", "custom"), {}, item)


def make_pipeline(*items: str | tuple | Pipe | Function) -> Callable[[Column], Column]:
    """Stages from left to right as one function of a column."""
    stages = [_pipe(i) for i in items]
    return lambda text: reduce(lambda c, stage: stage(c), stages, text)


def scrub(docs: DataFrame, items: Iterable, text_col: str = "text") -> DataFrame:
    return docs.withColumn(text_col, make_pipeline(*items)(F.col(text_col)))


class Scrubber:
    """A pipeline that can be changed by name and place."""

    def __init__(self, items: Iterable = ()):
        self.stages: list[Pipe] = []
        self.add_pipe(list(items))

    @property
    def pipes(self) -> list[str]:
        return [s.name for s in self.stages]

    def _place(self, before: str | int | None, after: str | int | None, first: bool | None, last: bool | None) -> int:
        if sum(x is not None and x is not False for x in (before, after, first, last)) > 1:
            raise ValueError("give one of before, after, first, last")
        at = lambda x: x if isinstance(x, int) else self.pipes.index(x)
        if first:
            return 0
        if before is not None:
            return at(before)
        return at(after) + 1 if after is not None else len(self.stages)

    def add_pipe(self, items, *, before=None, after=None, first=None, last=None) -> None:
        """Insert stages; a name that is there already lends its options to the new one."""
        at = self._place(before, after, first, last)
        for item in items if isinstance(items, list) else [items]:
            stage = _pipe(item)
            for old in self.stages:
                if old.name == stage.name:
                    old.options = stage.options = {**old.options, **stage.options}
            self.stages.insert(at, stage)
            at += 1

    def remove_pipe(self, names: str | Iterable[str]) -> None:
        gone = {names} if isinstance(names, str) else set(names)
        self.stages = [s for s in self.stages if s.name not in gone]

    def reset(self) -> None:
        self.stages = []

    def column(self, text: Column, *, disable: Iterable[str] = (), options: dict[str, dict] | None = None) -> Column:
        off, new = set(disable), options or {}
        for s in self.stages:
            if s.name not in off:
                text = Pipe(s.name, new.get(s.name, s.options), s.function)(text)
        return text

    def scrub(self, docs: DataFrame, text_col: str = "text", **how) -> DataFrame:
        return docs.withColumn(text_col, self.column(F.col(text_col), **how))
