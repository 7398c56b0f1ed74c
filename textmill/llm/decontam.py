"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case.
The windows of an item are its runs of ``n`` consecutive words; an item with fewer
words, but not none, is one window.  Every training text is scanned once: its
words become codes of the benchmark's vocabulary, all windows are hashed at once,
hashes found in the broadcast set are verified word by word, and the words inside
any occurrence are hit.

The set is broadcast only in blocks of at most ``block_windows`` windows.  A larger
benchmark takes one pass over the texts per block: each pass is written to the
shared folder with the hits found so far, and its broadcast is destroyed and the
pass before it deleted then, so that one block is held at a time, by the driver and
by every worker, and nothing is left out at any size.

Defined results: null and empty texts have no words and no hits; items without
words never occur; repeated items are each found; items with a null id are found
too and count together as one item, which the digest of ids leaves out; repeated rows each give a row;
an empty benchmark or table hits nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm._common import discard, fresh, materialize, mix64, slices, text_of

#: Windows in a broadcast block: about 80 bytes each on the way, and 300 in a worker.
BLOCK_WINDOWS = 1_000_000
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_P = np.uint64(0x9E3779B97F4A7C15)
_HIT = "n_words long, spans array<struct<a: long, b: long>>, items array<string>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


class _Windows:
    """Windows of one length: rows of word codes in order of their hashes, and the numbers of each one's items."""

    def __init__(self, codes: np.ndarray, items: list[list[int]]):
        self.m = codes.shape[1]
        h = window_hashes(codes.ravel(), self.m)[:: self.m]
        order = np.argsort(h, kind="stable")
        self.hashes, self.codes = h[order], codes[order]
        self.items = [items[i] for i in order.tolist()]
        # Windows that share a hash by chance lie side by side.
        self.most = int(np.unique(self.hashes, return_counts=True)[1].max())
        # A small table of bits on the low part of the hash spares most searches.
        size = 1 << max(16, int(np.ceil(np.log2(16 * len(h)))))
        self.filled = np.zeros(size, bool)
        self.filled[self.hashes & np.uint64(size - 1)] = True

    def find(self, codes: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """Places of verified occurrences, with the numbers of the items."""
        h = window_hashes(codes, self.m)
        at = np.flatnonzero(self.filled[h & np.uint64(len(self.filled) - 1)])
        near = np.searchsorted(self.hashes, h[at])
        for _ in range(self.most):
            inside = near < len(self.hashes)
            at, near = at[inside], near[inside]
            same = self.hashes[near] == h[at]
            at, near = at[same], near[same]
            equal = (codes[at[:, None] + np.arange(self.m)] == self.codes[near]).all(1)
            for i, k in zip(at[equal].tolist(), near[equal].tolist(), strict=True):
                yield i, self.items[k]
            near = near + 1


class WindowSet:
    """The windows of a block: (key, item_id) rows, a key being a window's words with a space between."""

    def __init__(self, keys: list[str], item_ids: list[str | None]):
        numbers: dict[str | None, int] = {}
        by_key: dict[str, list[int]] = {}
        for key, i in zip(keys, item_ids, strict=True):
            by_key.setdefault(key, []).append(numbers.setdefault(i, len(numbers)))
        self.items = list(numbers)
        self.code: dict[bytes, int] = {}
        rows: dict[int, tuple[list[list[int]], list[list[int]]]] = {}
        for key, own in by_key.items():
            codes = [self.code.setdefault(w, len(self.code) + 1) for w in key.encode("utf-8").split(b" ")]
            of_length = rows.setdefault(len(codes), ([], []))
            of_length[0].append(codes)
            of_length[1].append(own)
        self.by_length = [_Windows(np.array(codes, np.int64), own) for _, (codes, own) in sorted(rows.items())]

    def find(self, codes: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
        """Verified occurrences: place, length, numbers of the items."""
        for windows in self.by_length:
            if len(codes) >= windows.m:
                for i, found in windows.find(codes):
                    yield i, windows.m, found


def window_hashes(codes: np.ndarray, m: int) -> np.ndarray:
    n = len(codes) - m + 1
    c = codes.astype(np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(m):
            h = h * _P + c[j : j + n] + np.uint64(1)
    return mix64(h)


def _items(bench: DataFrame, item_col: str, text_col: str, n: int) -> DataFrame:
    """A row per window of the benchmark: item_id, key (its words, one space between)."""

    @F.arrow_udf("array<string>")
    def windows(texts: pa.Array) -> pa.Array:
        out = []
        for _, part in slices(texts):
            for t in part:
                w = words_of(t)
                out.append([b" ".join(w[i : i + n]).decode("utf-8") for i in range(max(1, len(w) - n + 1))] if w else [])
        return pa.array(out, pa.list_(pa.string()))

    own = bench.select(F.col(f"`{item_col}`").cast("string").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return own.select("item_id", F.explode(windows("text")).alias("key")).distinct()


def _blocks(windows: DataFrame, block_windows: int) -> Iterator[pa.Table]:
    """The windows (item_id, key) in tables of at most ``block_windows`` rows; the driver holds one hash class of about as many."""
    parts = -(-windows.count() // block_windows)
    for k in range(parts):
        own = (windows if parts == 1 else windows.where(F.pmod(F.xxhash64("key", "item_id"), F.lit(parts)) == k)).select("item_id", "key").toArrow()
        for at in range(0, own.num_rows, block_windows):
            yield own.slice(at, block_windows).combine_chunks()


def _scan(spark: SparkSession, block: pa.Table):
    """UDFs that give the words, hit spans and items of each text for one block, and the broadcast that they use.

    The second one also takes what earlier blocks gave.
    """
    sent = spark.sparkContext.broadcast(block)
    built: list[WindowSet] = []

    def search(texts: pa.Array, before: pa.Array | None) -> pa.Array:
        if not built:
            built.append(WindowSet(sent.value.column("key").to_pylist(), sent.value.column("item_id").to_pylist()))
        wins = built[0]
        code, name = wins.code.get, wins.items.__getitem__
        counts, spans, items = [], [], []
        for first, part in slices(texts, 1 << 19):
            split = [words_of(t) for t in part]
            # A zero after each text keeps windows inside it.
            codes = np.fromiter((code(w, 0) for ws in split for w in (*ws, None)), np.int64, sum(map(len, split)) + len(split))
            ends = np.cumsum([len(ws) + 1 for ws in split])
            own_spans: list[list[tuple[int, int]]] = [[] for _ in split]
            own_items: list[set[str | None]] = [set() for _ in split]
            if before is not None:
                for row, done in enumerate(before.slice(first, len(part)).to_pylist()):
                    own_spans[row] += [(s["a"], s["b"]) for s in done["spans"]]
                    own_items[row].update(done["items"])
            for i, m, found in wins.find(codes):
                row = int(np.searchsorted(ends, i, side="right"))
                start = i - (int(ends[row - 1]) if row else 0)
                own_spans[row].append((start, start + m))
                own_items[row].update(map(name, found))
            counts += map(len, split)
            spans += [merge_spans(s) for s in own_spans]
            items += [sorted(s, key=lambda x: (x is None, x or "")) for s in own_items]
        pair = pa.struct([("a", pa.int64()), ("b", pa.int64())])
        return pa.StructArray.from_arrays(
            [pa.array(counts, pa.int64()), pa.array([[{"a": a, "b": b} for a, b in s] for s in spans], pa.list_(pair)), pa.array(items, pa.list_(pa.string()))], names=["n_words", "spans", "items"]
        )

    @F.arrow_udf(_HIT)
    def scan(texts: pa.Array) -> pa.Array:
        return search(texts, None)

    @F.arrow_udf(_HIT)
    def scan_on(texts: pa.Array, before: pa.Array) -> pa.Array:
        return search(texts, before)

    return scan, scan_on, sent


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open spans, in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def find_contamination(docs: DataFrame, bench: DataFrame, *, n: int = 8, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_windows: int = BLOCK_WINDOWS, into: str = "hits") -> DataFrame:
    """``docs`` with one more column: a struct of n_words, spans (of word places) and items.

    No shuffle: the texts stay where they are.  With one block nothing runs until
    the result is read; with more, all passes but the last are written first.
    """
    spark = docs.sparkSession
    windows = materialize(_items(bench, item_col, item_text_col, n), "windows")
    text, name = F.col(f"`{text_col}`").cast("string"), fresh(docs, "__hits")
    now, waiting = docs, None
    for block in _blocks(windows, block_windows):
        if waiting is not None:
            now = _pass(now, text, name, waiting, keep=docs)
        waiting = block
    empty = pa.table({"item_id": pa.array([], pa.string()), "key": pa.array([], pa.string())})
    scan, scan_on, _ = _scan(spark, empty if waiting is None else waiting)
    discard(windows)
    out = now.withColumn(name, scan(text) if now is docs else scan_on(text, F.col(name)))
    return out.withColumnRenamed(name, into)


def _pass(now: DataFrame, text, name: str, block: pa.Table, *, keep: DataFrame) -> DataFrame:
    """The rows with the hits of one more block, written; the block and the pass before are given up."""
    scan, scan_on, sent = _scan(now.sparkSession, block)
    done = materialize(now.withColumn(name, scan(text) if now is keep else scan_on(text, F.col(name))), "hits")
    sent.destroy()
    if now is not keep:
        discard(now)
    return done


def digest(docs: DataFrame, bench: DataFrame, *, min_items: int = 2, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row."""
    found = find_contamination(text_of(docs, id_col, text_col), bench, **how)
    hits = F.aggregate("hits.spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return found.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        hits.alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits.items") >= min_items).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, bench: DataFrame, *, min_items: int = 1, text_col: str = "text", **how) -> DataFrame:
    """Documents with fewer than ``min_items`` occurring items, with their own columns."""
    own = fresh(docs, "__hits")
    return find_contamination(docs, bench, text_col=text_col, into=own, **how).where(F.size(f"{own}.items") < min_items).drop(own)


def remove_spans(docs: DataFrame, bench: DataFrame, *, text_col: str = "text", **how) -> DataFrame:
    """All documents, with the hit words cut out of their texts.

    A cut runs from the first byte of a span's first word to the last byte of its
    last; white space and marks around it stay.
    """

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out, all_spans = [], spans.to_pylist()
        for first, part in slices(texts):
            for i, t in enumerate(part):
                out.append(cut_words(t, [(s["a"], s["b"]) for s in all_spans[first + i] or []]).decode("utf-8"))
        return pa.array(out, pa.string())

    own = fresh(docs, "__hits")
    found = find_contamination(docs, bench, text_col=text_col, into=own, **how)
    text = F.col(f"`{text_col}`")
    return found.withColumn(text_col, F.when(F.size(f"{own}.spans") > 0, cut(text, F.col(f"{own}.spans"))).otherwise(text)).drop(own)


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the bytes from each span's first word to its last."""
    if not spans:
        return text
    flat = np.frombuffer(text.translate(_TO_WORDS), np.uint8) != 32
    edge = np.diff(np.concatenate([[0], flat.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*kept, text[at:]])


def sha256_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode("utf-8")).hexdigest()
