"""Loading of documents: every reader gives name, path, mime_type, text and error.

Files are read by the executors; a file that can't be read is a row with an error,
never a failure of the job.
"""

from __future__ import annotations

import csv
import gzip
import io
import json
import os
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "name string, path string, mime_type string, text string, error string"
_BY_SUFFIX = {"txt": "text/plain", "md": "text/plain", "csv": "text/csv", "tsv": "text/csv", "json": "application/json", "html": "text/html", "htm": "text/html", "xml": "text/xml"}
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"


def mime_type(path: str, start: bytes) -> str | None:
    """Type by the first bytes, then by the suffix; None for pickles and unknown binaries."""
    suffix = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    if suffix in ("pickle", "pkl"):
        return None
    if start.startswith(b"%PDF"):
        return "application/pdf"
    if start.startswith(b"PK\x03\x04"):
        return DOCX if suffix == "docx" else "application/zip"
    if suffix in _BY_SUFFIX:
        return _BY_SUFFIX[suffix]
    return None if b"\x00" in start[:1024] else "text/plain"


#: Single-byte encodings by the letters that texts in them are made of, beside ASCII.
_LETTERS = {"cp1252": "àâäáãåæçéèêëíìîïñóòôöõøœúùûüýÿßÀÂÄÁÃÅÆÇÉÈÊËÍÌÎÏÑÓÒÔÖÕØŒÚÙÛÜÝ«»‹›“”‘’„‚–—…€£§°·¡¿©®", "cp1251": "абвгдежзийклмнопрстуфхцчшщъыьэюяё«»–—“”„№", "koi8_r": "абвгдежзийклмнопрстуфхцчшщъыьэюяё", "iso8859_2": "ąćęłńóśźżáčďéěíňřšťúůýžőűäöüăâîșț", "iso8859_7": "αβγδεζηθικλμνξοπρστυφχψωςάέήίόύώ"}
#: Encodings of several bytes by the ranges of their common characters.
_RANGES = {"shift_jis": "\u3000-\u30ff\u4e00-\u9fff", "euc_jp": "\u3000-\u30ff\u4e00-\u9fff", "gb18030": "\u3000-\u3011\u4e00-\u9fff\uff01-\uff1f", "big5": "\u3000-\u3011\u4e00-\u9fff\uff01-\uff1f", "euc_kr": "\uac00-\ud7a3\u3000-\u3011"}
#: Bytes that are looked at.
_SNIFFED = 1 << 16


def encoding_of(raw: bytes) -> str:
    """Name of the encoding: by its mark, UTF-8 if it is that, else the one whose usual characters cover most of what is not ASCII.

    A character of several bytes counts for each of them, so that the longer
    explanation of the same bytes wins; Windows Latin wins ties.
    """
    if raw.startswith((b"\xff\xfe", b"\xfe\xff")):
        return "utf-16"
    try:
        raw.decode("utf-8")
        return "utf-8-sig"
    except UnicodeDecodeError:
        pass
    some = raw[:_SNIFFED]
    strange = sum(b >= 128 for b in some)
    best, name = 0.0, "cp1252"
    for code, letters in _LETTERS.items():
        # Where letters stand alone between ASCII ones, as in Latin scripts, whole words in capitals don't.
        usual = set(letters)
        score = sum(c in usual for c in some.decode(code, "replace") if c > "\x7f") / max(strange, 1)
        if score > best:
            best, name = score, code
    for code, ranges in _RANGES.items():
        try:
            text = some[: len(some) - len(some) % 2].decode(code, "strict" if len(some) < _SNIFFED else "ignore")
        except UnicodeDecodeError:
            continue
        found = re.findall(f"[{ranges}]", text)
        kana = sum("\u3040" <= c <= "\u30ff" for c in found)
        # Japanese has syllables between its characters; without any it is rather Chinese.
        if code in ("shift_jis", "euc_jp") and 10 * kana < len(found):
            continue
        odd = sum(c > "\x7f" for c in text) - len(found)
        score = (len(found) - odd) / max(len(found) + odd, 1) * 1.05
        # Other scripts' bytes make Chinese characters too, but hardly the commonest ones.
        if code in ("gb18030", "big5") and not set("的一是在不了有和人這这").intersection(found):
            score *= 0.9
        if found and score > best:
            best, name = score, code
    return name


def decode(raw: bytes) -> str:
    """Text in the encoding that ``encoding_of`` finds; line breaks become ``\\n``."""
    text = raw.decode(encoding_of(raw), "replace")
    return text.replace("\r\n", "\n").replace("\r", "\n")


def normalize_files(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Text files as UTF-8 with ``\\n``, written by the executors under their names into a mounted folder: path, written, encoding."""
    os.makedirs(folder, exist_ok=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for at, raw in zip(batch["path"], batch["content"], strict=True):
                to = os.path.join(folder, os.path.basename(at))
                with open(to, "w", encoding="utf-8", newline="") as f:
                    f.write(decode(raw))
                rows.append((at, to, encoding_of(raw)))
            yield pd.DataFrame(rows, columns=["path", "written", "encoding"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, written string, encoding string")


def docx_text(raw: bytes) -> str:
    """Paragraphs of a word-processor document, one per line."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p"))


def pdf_pages(raw: bytes) -> list[str]:
    """Text of each page; needs the pypdf package."""
    from pypdf import PdfReader

    return [page.extract_text() or "" for page in PdfReader(io.BytesIO(raw)).pages]


def safe_entry(name: str) -> str:
    """An archive entry's name without parts that lead elsewhere."""
    return "/".join(p for p in name.replace("\\", "/").split("/") if p not in ("", ".", ".."))


def _stem(path: str) -> str:
    return re.sub(r"\.[^.]*$", "", path.rstrip("/").rsplit("/", 1)[-1])


def parse(path: str, raw: bytes) -> Iterator[tuple]:
    """Rows of one file; archives give one for each entry, PDFs one for each page."""
    kind = mime_type(path, raw[:1024])
    try:
        if kind is None:
            yield _stem(path), path, None, None, "unsupported file type"
        elif kind == "application/zip":
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                for entry in z.infolist():
                    if not entry.is_dir() and not entry.filename.startswith("__MACOSX"):
                        yield from parse(f"{path}/{safe_entry(entry.filename)}", z.read(entry))
        elif kind == DOCX:
            yield _stem(path), path, kind, docx_text(raw), None
        elif kind == "application/pdf":
            for i, page in enumerate(pdf_pages(raw), 1):
                yield f"{_stem(path)}_{i:03d}", path, kind, page, None
        else:
            yield _stem(path), path, kind, decode(raw), None
    except Exception as e:
        yield _stem(path), path, kind, None, f"{type(e).__name__}: {e}"


def files(spark: SparkSession, paths: str | Iterable[str], *, recursive: bool = True, pattern: str | None = None) -> DataFrame:
    """Text, markup, DOCX, PDF and ZIP files and folders of them."""
    source = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        source = source.option("pathGlobFilter", pattern)
    found = source.load([paths] if isinstance(paths, str) else list(paths))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [r for path, raw in zip(batch["path"], batch["content"], strict=True) for r in parse(path, bytes(raw))]
            yield pd.DataFrame(out, columns=["name", "path", "mime_type", "text", "error"], dtype=object)

    return found.select("path", "content").mapInPandas(rows, SCHEMA)


def good(rows: DataFrame) -> DataFrame:
    return rows.where("error is null").drop("error")


def load_errors(rows: DataFrame) -> DataFrame:
    return rows.where("error is not null").select("path", "error")


def _checked(df: DataFrame, name_col: str, text_col: str) -> DataFrame:
    lacking = {name_col, text_col} - set(df.columns)
    if lacking:
        raise ValueError(f"no column {', '.join(sorted(lacking))} in {df.columns}")
    return df.select(F.col(name_col).cast("string").alias("name"), F.col("_metadata.file_path").alias("path"), F.lit("text/plain").alias("mime_type"), F.col(text_col).cast("string").alias("text"))


def read_csv(spark: SparkSession, path: str, *, name_col: str = "name", text_col: str = "text", sep: str = ",", **options) -> DataFrame:
    return _checked(spark.read.options(header=True, multiLine=True, escape='"', sep=sep, **options).csv(path), name_col, text_col)


def read_json(spark: SparkSession, path: str, *, name_field: str = "name", text_field: str = "text", lines: bool = False) -> DataFrame:
    return _checked(spark.read.option("multiLine", not lines).json(path), name_field, text_field)


def read_parquet(spark: SparkSession, path: str, *, name_col: str = "name", text_col: str = "text") -> DataFrame:
    return _checked(spark.read.parquet(path), name_col, text_col)


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, i, text: the lines of each file, numbered from 0 whatever splits a scan has."""
    whole = spark.read.text(path, wholetext=True).where("value <> ''")
    return whole.select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n")).alias("i", "text"))


def read_lines(spark: SparkSession, path: str, *, start: int = 1, pad: int = 3) -> DataFrame:
    """A document for each line of a file, named text001 and so on in the order of lines."""
    lines = _numbered_lines(spark, path)
    return lines.select(F.concat(F.lit("text"), F.lpad((F.col("i") + start).cast("string"), pad, "0")).alias("name"), "path", F.lit("text/plain").alias("mime_type"), "text")


def from_texts(spark: SparkSession, texts: Iterable[str], names: Iterable[str] | None = None, *, start: int = 1, pad: int = 3) -> DataFrame:
    texts = list(texts)
    names = list(names) if names is not None else [f"text{i:0{pad}d}" for i in range(start, start + len(texts))]
    if len(names) != len(texts):
        raise ValueError("as many names as texts are needed")
    return spark.createDataFrame([(n, None, "text/plain", t) for n, t in zip(names, texts, strict=True)], "name string, path string, mime_type string, text string")


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """id, label, text of a tab-separated file with one to three columns or more; what is over belongs to the text."""
    parts = F.split("text", "\t")
    n = F.size(parts)
    # Lines are numbered within their file, whatever splits a scan has.
    return _numbered_lines(spark, path).select(
        F.when(n >= 3, parts[0]).otherwise(F.col("i").cast("string")).alias("id"),
        F.when(n >= 3, parts[1]).when(n == 2, parts[0]).otherwise("no_label").alias("label"),
        F.when(n >= 3, F.array_join(F.slice(parts, 3, F.greatest(n - 2, F.lit(1))), " ")).when(n == 2, parts[1]).otherwise(parts[0]).alias("text"),
    )


def read_doc_topics(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, name, topic, p of a topic model's file, dense or as ``topic:p`` pairs."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select(parts[0].cast("long").alias("doc_id"), parts[1].alias("name"), F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))).alias("v"))
    cells = rows.select("doc_id", "name", F.posexplode("v").alias("i", "x"))
    pair = F.col("x").contains(":")
    return cells.select("doc_id", "name", F.when(pair, F.split_part("x", F.lit(":"), F.lit(1)).cast("int")).otherwise(F.col("i")).alias("topic"), F.when(pair, F.split_part("x", F.lit(":"), F.lit(2))).otherwise(F.col("x")).cast("double").alias("p"))


def read_topic_keys(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split("value", "\t")
    return spark.read.text(path).select(parts[0].cast("int").alias("topic"), F.get(parts, F.lit(1)).cast("double").alias("weight"), F.coalesce(F.get(parts, F.lit(2)), F.lit("")).alias("keywords"))


def read_topic_weights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").schema("topic int, term string, w double").csv(path)


def read_topic_state(spark: SparkSession, path: str) -> DataFrame:
    """doc, source, pos, typeindex, type, topic of a Gibbs state (plain or gzip)."""
    p = F.split("value", " ")
    return spark.read.text(path).where(~F.col("value").startswith("#")).select(p[0].cast("int").alias("doc"), p[1].alias("source"), p[2].cast("int").alias("pos"), p[3].cast("int").alias("typeindex"), p[4].alias("type"), p[5].cast("int").alias("topic"))


def state_alpha(path: str) -> list[float]:
    """The topic weights in the head of a state file."""
    with (gzip.open if path.endswith(".gz") else open)(path, "rt", encoding="utf-8") as f:
        for line in f:
            if line.startswith("#alpha"):
                return [float(x) for x in line.split(":", 1)[1].split()]
            if not line.startswith("#"):
                break
    return []


def split_conllu(text: str, *, train: float = 0.8, dev: float = 0.1, seed: int = 42) -> dict[str, list[str]]:
    """Sentences (between empty lines) dealt to train, dev and test."""
    import random

    sents = [s for s in re.split(r"\n\s*\n", text.strip()) if s]
    random.Random(seed).shuffle(sents)
    a, b = int(len(sents) * train), int(len(sents) * dev)
    return {"train": sents[:a], "dev": sents[a : a + b], "test": sents[a + b :]}


def combine_conllu(texts: Iterable[str]) -> str:
    return "".join(t.rstrip("\n") + "\n\n" for t in texts if t.strip())


def sniff_csv(sample: str) -> str:
    return csv.Sniffer().sniff(sample, delimiters=",;\t|").delimiter


def read_metadata_json(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)
