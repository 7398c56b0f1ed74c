"""Spreadsheets (.xlsx): the first sheet as rows, and small tables as one sheet."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.sources.sinks import _bounded

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _column(ref: str) -> int:
    """Number of the column of a cell such as AB12, from 0."""
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def sheet_rows(raw: bytes, sheet: int = 1) -> list[list[str | None]]:
    """Cells of a sheet as text, row by row; empty ones are None."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{_NS}t")))
        out = []
        for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml")).iter(f"{_NS}row"):
            cells: dict[int, str | None] = {}
            for k, c in enumerate(row.iter(f"{_NS}c")):
                value, kind = c.find(f"{_NS}v"), c.get("t")
                if kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                elif value is None:
                    text = None
                else:
                    text = shared[int(value.text)] if kind == "s" else {"1": "true", "0": "false"}[value.text] if kind == "b" else value.text
                cells[_column(c.get("r")) if c.get("r") else k] = text
            out.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
    return out


def read_sheet(spark: SparkSession, path: str, columns: list[str], *, header: bool = True) -> DataFrame:
    """path, row and the stated columns as strings: by the names in the first row, or by place without a header.

    The executors read the files, one file a row; a name that a file lacks is null.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, raw in zip(batch["path"], batch["content"], strict=True):
                cells = sheet_rows(raw)
                names = cells[0] if header and cells else columns
                place = {n: i for i, n in enumerate(names) if n is not None}
                body = cells[1:] if header else cells
                get = lambda r, c: r[place[c]] if c in place and place[c] < len(r) else None  # noqa: B023, E731
                yield pd.DataFrame({"path": at, "row": range(len(body)), **{c: pd.Series([get(r, c) for r in body], dtype=object) for c in columns}})

    schema = "path string, row int, " + ", ".join(f"`{c}` string" for c in columns)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, schema)


def write_sheet(df: DataFrame, path: str) -> None:
    """A small table as one sheet: numbers as numbers, all else as text; too many rows are an error."""
    number = {name for name, kind in df.dtypes if kind in ("int", "bigint", "smallint", "tinyint", "float", "double")}
    cell = lambda v, c: "<c/>" if v is None else f"<c><v>{v}</v></c>" if c in number else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_legal(str(v)))}</t></is></c>'
    flat = df.select(*[F.col(f"`{c}`") if c in number else F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{_NS[1:-1]}" xmlns:r="{rel}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        with z.open("xl/worksheets/sheet1.xml", "w") as out:
            out.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_NS[1:-1]}"><sheetData>'.encode())
            out.write(("<row>" + "".join(f'<c t="inlineStr"><is><t>{escape(c)}</t></is></c>' for c in df.columns) + "</row>").encode())
            for r in _bounded(flat):
                out.write(("<row>" + "".join(cell(v, c) for v, c in zip(r, df.columns, strict=True)) + "</row>").encode())
            out.write(b"</sheetData></worksheet>")


def _legal(text: str) -> str:
    """Without the control characters that XML can't hold."""
    return re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", text)
