"""Writing of documents, chunks, records, topic tables and reports."""

from __future__ import annotations

import hashlib
import html
import json
import sqlite3
import zipfile
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Rows that a single-file format takes; larger tables are written by Spark.
MOST_SINGLE_FILE = 1_000_000


def to_csv(df: DataFrame, path: str, *, sep: str = ",") -> None:
    df.write.mode("overwrite").options(header=True, escape='"', sep=sep).csv(path)


def to_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def to_parquet(df: DataFrame, path: str, partition_by: Iterable[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def save_corpus(records: DataFrame, folder: str, metadata: dict | None = None) -> None:
    """Records as Parquet with a file of metadata beside them."""
    records.write.mode("overwrite").parquet(f"{folder}/records")
    meta = json.dumps(metadata or {}, default=str)
    records.sparkSession.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/metadata")


def load_corpus(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{folder}/records"), json.loads(spark.read.text(f"{folder}/metadata", wholetext=True).first()[0])


def record_bytes(record: dict) -> bytes:
    """A record with a hash over its fields."""
    core = json.dumps(record, sort_keys=True, default=str, ensure_ascii=False).encode("utf-8")
    return hashlib.sha256(core).hexdigest().encode() + b"\n" + core


def record_from_bytes(raw: bytes, *, verify: bool = True) -> dict:
    mark, core = raw.split(b"\n", 1)
    if verify and hashlib.sha256(core).hexdigest().encode() != mark:
        raise ValueError("the record does not match its hash")
    return json.loads(core)


def record_to_disk(record: dict, path: str) -> None:
    Path(path).write_bytes(record_bytes(record))


def record_from_disk(path: str, *, verify: bool = True) -> dict:
    return record_from_bytes(Path(path).read_bytes(), verify=verify)


def pack_corpus(folder: str, to: str) -> str:
    """A saved corpus in a mounted folder as one ZIP file."""
    with zipfile.ZipFile(to, "w", zipfile.ZIP_STORED) as z:
        for at in sorted(p for p in Path(folder).rglob("*") if p.is_file()):
            z.write(at, at.relative_to(folder))
    return to


def unpack_corpus(path: str, folder: str) -> str:
    """The folder that a packed corpus came from; names that lead out of it are refused."""
    with zipfile.ZipFile(path) as z:
        root = Path(folder).resolve()
        if any(not (root / name).resolve().is_relative_to(root) for name in z.namelist()):
            raise ValueError("the file has names outside its folder")
        z.extractall(root)
    return folder


def chunk_files(chunks: DataFrame, folder: str, *, name_col: str = "name", text_col: str = "chunk", strip: bool = True) -> None:
    """One text file for each chunk, written by the executors into a mounted folder."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    text = F.trim(text_col) if strip else F.col(text_col)

    def write(rows) -> None:
        for r in rows:
            Path(folder, f"{r[0]}.txt").write_text(r[1] or "", encoding="utf-8")

    chunks.select(name_col, text).foreachPartition(write)


def _bounded(df: DataFrame) -> Iterator[Row]:
    """The rows one after another, a partition at a time, if they are few enough for one file."""
    if df.limit(MOST_SINGLE_FILE + 1).count() > MOST_SINGLE_FILE:
        raise ValueError("too many rows for one file; write Parquet, CSV or JSON")
    return df.toLocalIterator()


def to_sqlite(records: DataFrame, path: str, table: str = "records") -> None:
    """A small collection as a SQLite table with a full-text index."""
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "boolean": "INTEGER"}
    names = records.columns
    with sqlite3.connect(path) as db:
        db.execute(f'DROP TABLE IF EXISTS "{table}"')
        db.execute(f'CREATE TABLE "{table}" ({", ".join(f"{chr(34)}{c}{chr(34)} {kinds.get(t, "TEXT")}" for c, t in records.dtypes)})')
        db.executemany(f'INSERT INTO "{table}" VALUES ({", ".join("?" * len(names))})', map(tuple, _bounded(records)))
        if "text" in names:
            db.execute(f'DROP TABLE IF EXISTS "{table}_fts"')
            db.execute(f'CREATE VIRTUAL TABLE "{table}_fts" USING fts5(text)')
            db.execute(f'INSERT INTO "{table}_fts"(rowid, text) SELECT rowid, text FROM "{table}"')


def search_sqlite(path: str, query: str, *, table: str = "records", limit: int = 100) -> list[tuple]:
    with sqlite3.connect(path) as db:
        return db.execute(f'SELECT * FROM "{table}" WHERE rowid IN (SELECT rowid FROM "{table}_fts" WHERE "{table}_fts" MATCH ?) LIMIT ?', (query, limit)).fetchall()


def topic_browser_files(doc_topic: DataFrame, topic_term: DataFrame, folder: str, *, words: int = 50, counts: DataFrame | None = None) -> None:
    """Files of a topic model for a browser of topics.

    tw.json and topic-keys.txt: words and weights; topic_coords.csv: topics in a plane
    by their divergences; dt.json.zip, doc-topic.txt and, with ``counts`` (doc_id, topic,
    n), doc-topic-counts.csv: documents; metadata.csv, unless it is there.
    """
    to = Path(folder)
    to.mkdir(parents=True, exist_ok=True)
    tops: dict[int, list] = {}
    from textmill.operators.topics import divergences, rank_weights, scale_distances, term_probabilities

    for r in term_probabilities(topic_term, words).orderBy("topic", "rank").collect():
        tops.setdefault(r.topic, []).append((r.term, r.p))
    k = max(tops, default=-1) + 1
    (to / "tw.json").write_text(json.dumps({"alpha": [1.0] * k, "tw": [{"words": [w for w, _ in tops.get(t, [])], "weights": [p for _, p in tops.get(t, [])]} for t in range(k)]}), encoding="utf-8")
    (to / "topic-keys.txt").write_text("".join(f"{t}\t1.0\t{' '.join(w for w, _ in tops.get(t, [])[:15])}\n" for t in range(k)), encoding="utf-8")
    cells = sorted((r.topic, r.doc_id, r.p) for r in _bounded(doc_topic.where("p > 0").select("topic", "doc_id", "p")))
    starts = [bisect_left(cells, (t,)) for t in range(k + 1)]
    far = np.zeros((k, k))
    for r in divergences(rank_weights(topic_term)).collect():
        far[r.a, r.b] = far[r.b, r.a] = r.jsd
    places = scale_distances(far) if k > 1 else np.zeros((k, 2))
    (to / "topic_coords.csv").write_text("topic,x,y\n" + "".join(f"{t},{x},{y}\n" for t, (x, y) in enumerate(np.pad(places, ((0, 0), (0, 2 - places.shape[1]))))), encoding="utf-8")
    shares: dict[int, list[float]] = {}
    for t, d, p in cells:
        shares.setdefault(d, [0.0] * k)[t] = p
    ids = sorted(shares)
    (to / "doc-topic.txt").write_text("".join(f"{i}\tdoc{i + 1}\t" + "\t".join(f"{p:.10f}" for p in shares[d]) + "\n" for i, d in enumerate(ids)), encoding="utf-8")
    if counts is not None:
        number, table = {d: i for i, d in enumerate(ids)}, [[0] * k for _ in ids]
        for r in _bounded(counts.select("doc_id", "topic", "n")):
            table[number[r.doc_id]][r.topic] = r.n
        (to / "doc-topic-counts.csv").write_text(",".join(["docNum", *(f"topic{t}" for t in range(k))]) + "\n" + "".join(f"{i},{','.join(map(str, row))}\n" for i, row in enumerate(table)), encoding="utf-8")
    if not (to / "metadata.csv").exists():
        (to / "metadata.csv").write_text("docNum,docName,title\n" + "".join(f"{i},doc{i + 1},{d}\n" for i, d in enumerate(ids)), encoding="utf-8")
    with zipfile.ZipFile(to / "dt.json.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("dt.json", json.dumps({"i": [c[1] for c in cells], "p": starts, "x": [c[2] for c in cells]}))


def report(folder: str, overview: dict, doc_stats: DataFrame, results: dict | None = None, *, as_html: bool = False) -> str:
    """Overview, statistics of documents and results of modules, as CSV, JSON and a page of text."""
    to = Path(folder)
    to.mkdir(parents=True, exist_ok=True)
    (to / "corpus_overview.csv").write_text("metric,value\n" + "".join(f"{k},{v}\n" for k, v in overview.items()), encoding="utf-8")
    to_csv(doc_stats, str(to / "document_statistics"))
    (to / "module_analysis_results.json").write_text(json.dumps(results or {}, default=str, indent=1), encoding="utf-8")
    lines = ["# Corpus report", "", *(f"- {k}: {v}" for k, v in overview.items())]
    text = "\n".join(lines) if not as_html else "<html><body><h1>Corpus report</h1><ul>" + "".join(f"<li>{html.escape(str(k))}: {html.escape(str(v))}</li>" for k, v in overview.items()) + "</ul></body></html>"
    at = to / ("report.html" if as_html else "report.md")
    at.write_text(text, encoding="utf-8")
    return str(at)
