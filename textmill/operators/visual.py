"""Data of figures, and figures as plain HTML and SVG: word clouds, bubble charts, rolling lines, dendrograms, boxes."""

from __future__ import annotations

import html
import math
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Marks in one figure.
MOST_MARKS = 5000


def cloud_counts(counts: DataFrame, *, docs: Iterable | None = None, limit: int | None = None) -> DataFrame:
    """term, n over all documents of a term matrix, or over some of them; the highest ``limit``."""
    own = counts if docs is None else counts.where(F.col("doc_id").isin(list(docs)))
    out = own.groupBy("term").agg(F.sum("n").alias("n")).where("n > 0")
    return out if limit is None else out.orderBy(F.desc("n"), "term").limit(limit)


def multicloud_counts(counts: DataFrame, *, docs: Iterable | None = None, limit: int = 50) -> DataFrame:
    """doc_id, term, n: the highest ``limit`` of each document."""
    own = counts if docs is None else counts.where(F.col("doc_id").isin(list(docs)))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "term"))
    return own.where("n > 0").withColumn("rank", rank).where(F.col("rank") <= limit).drop("rank")


def rows_of(items: list, n: int) -> list[list]:
    return [items[i : i + n] for i in range(0, len(items), n)]


def _few(df: DataFrame, *cols: str) -> list[tuple]:
    rows = df.select(*cols).limit(MOST_MARKS + 1).collect()
    if len(rows) > MOST_MARKS:
        raise ValueError(f"a figure has at most {MOST_MARKS} marks; limit the counts first")
    return [tuple(r) for r in rows]


def bubbles(terms: list[tuple[str, float]], *, space: float = 1.0, rounds: int = 200) -> list[tuple[str, float, float, float]]:
    """term, x, y, radius: circles of areas by count, drawn to the middle without overlap."""
    placed: list[tuple[str, float, float, float]] = []
    for term, n in sorted(terms, key=lambda t: (-t[1], t[0])):
        r = math.sqrt(n / math.pi)
        best = None
        for k in range(rounds if placed else 1):
            angle, far = 2.399963 * k, 0.5 * math.sqrt(k) * r
            x, y = far * math.cos(angle), far * math.sin(angle)
            while any(math.hypot(x - a, y - b) < r + q + space for _, a, b, q in placed):
                far += r / 4
                x, y = far * math.cos(angle), far * math.sin(angle)
            if best is None or far < best[0]:
                best = (far, x, y)
        placed.append((term, best[1], best[2], r))
    return placed


def bubble_svg(counts: DataFrame) -> str:
    at = bubbles([(t, float(n)) for t, n in _few(counts, "term", "n")])
    size = max((math.hypot(x, y) + r for _, x, y, r in at), default=1)
    marks = "".join(f'<g><circle cx="{x:.1f}" cy="{y:.1f}" r="{r:.1f}" fill="#9ecae1"/><text x="{x:.1f}" y="{y:.1f}" text-anchor="middle" font-size="{max(r / 2.5, 1):.1f}">{html.escape(t)}</text></g>' for t, x, y, r in at)
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="{-size:.1f} {-size:.1f} {2 * size:.1f} {2 * size:.1f}">{marks}</svg>'


def cloud_html(counts: DataFrame, *, smallest: int = 10, largest: int = 60) -> str:
    """Words with sizes by the root of their counts."""
    terms = _few(counts, "term", "n")
    top = math.sqrt(max((n for _, n in terms), default=1))
    words = " ".join(f'<span style="font-size:{smallest + (largest - smallest) * math.sqrt(n) / top:.0f}px">{html.escape(t)}</span>' for t, n in sorted(terms))
    return f'<!DOCTYPE html><html><meta charset="utf-8"><body style="text-align:center">{words}</body></html>'


def multicloud_html(counts: DataFrame) -> str:
    by: dict = {}
    for d, t, n in _few(counts, "doc_id", "term", "n"):
        by.setdefault(d, []).append((t, n))
    cells = "".join(f"<section><h2>{html.escape(str(d))}</h2>" + " ".join(f'<span style="font-size:{10 + 5 * math.sqrt(n):.0f}px">{html.escape(t)}</span>' for t, n in sorted(ts)) + "</section>" for d, ts in sorted(by.items()))
    return f'<!DOCTYPE html><html><meta charset="utf-8"><body>{cells}</body></html>'


def line_svg(series: dict[str, list[tuple[float, float]]], milestones: Iterable[float] = (), *, width: int = 800, height: int = 300) -> str:
    """Lines of rolling values with milestones as upright marks."""
    every = [p for s in series.values() for p in s] or [(0, 0)]
    x0, x1, y0, y1 = min(x for x, _ in every), max(x for x, _ in every), min(y for _, y in every), max(y for _, y in every)
    sx, sy = lambda x: (x - x0) / (x1 - x0 or 1) * width, lambda y: height - (y - y0) / (y1 - y0 or 1) * height
    colours = ["#1f77b4", "#ff7f0e", "#2ca02c", "#d62728", "#9467bd", "#8c564b"]
    lines = "".join(f'<polyline fill="none" stroke="{colours[i % 6]}" points="{" ".join(f"{sx(x):.1f},{sy(y):.1f}" for x, y in s)}"><title>{html.escape(n)}</title></polyline>' for i, (n, s) in enumerate(series.items()))
    marks = "".join(f'<line x1="{sx(m):.1f}" x2="{sx(m):.1f}" y1="0" y2="{height}" stroke="#999" stroke-dasharray="4"/>' for m in milestones)
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}">{lines}{marks}</svg>'


def dendrogram_svg(merges: list[tuple[int, int, float, int]], labels: list[str], *, width: int = 700, row: int = 18) -> str:
    """The tree of merges with leaves in an order without crossings."""
    n = len(labels)

    def leaves(i: int) -> list[int]:
        stack, out = [i], []
        while stack:
            k = stack.pop()
            if k < n:
                out.append(k)
            else:
                stack += [merges[k - n][1], merges[k - n][0]]
        return out

    order = leaves(n + len(merges) - 1) if merges else list(range(n))
    top = max((m[2] for m in merges), default=1) or 1
    at = {leaf: (0.0, (i + 0.5) * row) for i, leaf in enumerate(order)}
    x = lambda h: 150 + (width - 170) * h / top
    out = [f'<text x="145" y="{at[i][1] + 4:.1f}" text-anchor="end" font-size="11">{html.escape(str(labels[i]))}</text>' for i in range(n)]
    for k, (a, b, h, _) in enumerate(merges):
        (ha, ya), (hb, yb) = at[a], at[b]
        out.append(f'<path fill="none" stroke="#333" d="M{x(ha):.1f},{ya:.1f} H{x(h):.1f} V{yb:.1f} H{x(hb):.1f}"/>')
        at[n + k] = (h, (ya + yb) / 2)
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {n * row}">{"".join(out)}</svg>'


def box_values(stats: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """Quartiles and ends of the whiskers, for box plots."""
    q = F.percentile(column, [0.25, 0.5, 0.75])
    grouped = stats.groupBy(*([by] if by else [])).agg(q.alias("q"), F.min(column).alias("lo"), F.max(column).alias("hi"))
    a, c = F.col("q")[0], F.col("q")[2]
    return grouped.select(*([by] if by else []), a.alias("q1"), F.col("q")[1].alias("median"), c.alias("q3"), F.greatest("lo", a - 1.5 * (c - a)).alias("low"), F.least("hi", c + 1.5 * (c - a)).alias("high"))
