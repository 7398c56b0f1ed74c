"""Substring dedup by sliding sentence spans.

A text is cut into sentences at line breaks and after ``.``, ``!`` or ``?`` before white
space.  A run is at least ``run`` consecutive sentences that hold at least ``words``
words.  Every run is compared over all texts, by its sentences' words with A-Z in
lower case; the first occurrence, by document id and place, stays, and all sentences
covered by any other occurrence of any run are removed.

Not every run needs a row.  From each sentence on, and back from each, only the
shortest run is hashed: within an occurrence of a longer run these lie end to end
and cover it, and each of them occurs wherever the longer one does.  So the same
sentences are covered as if all runs, of any length, were listed (a test does
list them).

Runs shorter than ``words`` recur by chance, like headings and set phrases, and
stay.  30 is what remains whole of a passage of 50 words that is set inside a
paragraph, where the sentences at both its edges are cut.

A run is known by two independent 64-bit hashes of its sentences' own 128-bit
hashes, so that among 10^13 runs two different ones agree with probability 10^-13.
Hashes that occur once are dropped after partial counts.  A run that a third of all
documents share is one row of counts; joining it back to its many places needs
no shuffle, as the ``MOST_HOT`` commonest hashes go by broadcast.  Each of the
others has at most a ``MOST_HOT``-th of all places.  Places and texts that can't
have part in a join are dropped by a filter of fixed size before any shuffle.

Defined results: null and empty texts have no sentences and lose nothing; rows equal
in id and text are one document and get the same result; rows with one id but
different texts are ordered by text hash; rows with a null id come last; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from textmill.llm._common import materialize, maybe_in, mix64, slices
from textmill.session import ship

#: Hashes broadcast at most: about 60 bytes of hashes and place each.
MOST_HOT = 100_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_CUT = re.compile(rb"(?<=[.!?])[ \t]+|\s*\n\s*")
# Odd bases of the two run hashes, and their inverses modulo 2^64.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)


def sentences(text: bytes) -> list[tuple[int, int]]:
    """Byte spans of the sentences; the cuts between them hold white space only."""
    out, at = [], 0
    for m in _CUT.finditer(text):
        if text[at : m.start()].strip():
            out.append((at, m.start()))
        at = m.end()
    if text[at:].strip():
        out.append((at, len(text)))
    return out


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


def runs(texts: list[bytes], run: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The shortest runs of some texts: two hashes, first sentence, number of sentences; and how many runs each text has."""
    own, sizes, counts = [], [], []
    for t in texts:
        low, before = t.translate(_LOWER), len(own)
        for a, b in sentences(t):
            w = low[a:b].split()
            own.append(xxhash.xxh3_128_digest(b" ".join(w)))
            sizes.append(len(w))
        counts.append(len(own) - before)
    n = len(own)
    each = np.array(counts, np.int64)
    last = np.repeat(np.cumsum(each), each)
    first = last - np.repeat(each, each)
    at, total = np.arange(n), np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])
    ends = np.maximum(np.searchsorted(total, total[:-1] + words), at + run)
    starts = np.minimum(np.searchsorted(total, total[1:] - words, side="right") - 1, at + 1 - run)
    on, back = ends <= last, starts >= first
    # One number for a run, so that each is listed once, in order of its start.
    found = np.unique(np.concatenate([at[on] * (n + 1) + ends[on], starts[back] * (n + 1) + at[back] + 1]))
    a, b = found // (n + 1), found % (n + 1)
    hashes = []
    halves = np.frombuffer(b"".join(own), np.uint64).reshape(n, 2)
    with np.errstate(over="ignore"):
        for half, base, inverse in zip(halves.T, _BASES, _INVERSES, strict=True):
            # A polynomial of the run's sentence hashes, as a difference of sums, moved back to power 0.
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(half * _powers(base, n), dtype=np.uint64)])
            h = (sums[b] - sums[a]) * _powers(inverse, n)[a]
            hashes.append(mix64(h + (b - a).astype(np.uint64)).view(np.int64))
    row = np.searchsorted(np.cumsum(each), a, side="right")
    return hashes[0], hashes[1], (a - first[a]).astype(np.int32), (b - a).astype(np.int32), np.bincount(row, minlength=len(texts))


def _runs(run: int, words: int):
    kind = pa.struct([("h", pa.int64()), ("g", pa.int64()), ("at", pa.int32()), ("m", pa.int32())])

    @F.arrow_udf("array<struct<h: long, g: long, at: int, m: int>>")
    def listed(texts: pa.Array) -> pa.Array:
        parts = [runs(part, run, words) for _, part in slices(texts)]
        if not parts:
            return pa.array([], pa.list_(kind))
        flat = pa.StructArray.from_arrays([pa.array(np.concatenate([p[i] for p in parts])) for i in range(4)], fields=list(kind))
        ends = np.concatenate([[0], np.cumsum(np.concatenate([p[4] for p in parts]))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)

    return listed


def drop_sentences(text: bytes, gone: list[int]) -> tuple[bytes, list[tuple[int, int]]]:
    """The text without the sentences numbered ``gone`` and the white space after each; the byte spans cut."""
    spans = sentences(text)
    cut: list[tuple[int, int]] = []
    for i in gone:
        a, b = spans[i][0], spans[i + 1][0] if i + 1 < len(spans) else len(text)
        if cut and cut[-1][1] == a:
            cut[-1] = (cut[-1][0], b)
        else:
            cut.append((a, b))
    kept, at = [], 0
    for a, b in cut:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]]), cut


_CLEAN = "n_sentences long, n_removed long, clean string, cuts array<struct<a: long, b: long>>, n_words_removed long"


def _clean():
    pair = pa.struct([("a", pa.int64()), ("b", pa.int64())])

    @F.arrow_udf(_CLEAN)
    def clean(texts: pa.Array, starts: pa.Array) -> pa.Array:
        n, removed, out, cuts, lost = [], [], [], [], []
        starts = starts.to_pylist()
        for first, part in slices(texts):
            for i, t in enumerate(part):
                n.append(len(sentences(t)))
                gone = sorted({s["at"] + j for s in starts[first + i] or [] for j in range(s["m"])})
                removed.append(len(gone))
                text, cut = drop_sentences(t, gone) if gone else (t, [])
                out.append(text.decode("utf-8"))
                cuts.append([{"a": a, "b": b} for a, b in cut])
                lost.append(sum(len(t[a:b].split()) for a, b in cut))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string()), pa.array(cuts, pa.list_(pair)), pa.array(lost, pa.int64())], names=["n_sentences", "n_removed", "clean", "cuts", "n_words_removed"])

    return clean


@F.arrow_udf(LongType())
def crc32_of(texts: pa.Array) -> pa.Array:
    return pa.array([zlib.crc32(t) for _, part in slices(texts) for t in part], pa.int64())


def dedup_spans(docs: DataFrame, *, run: int = 2, words: int = 30, hot: int = 5000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n_sentences, n_removed, cuts (byte spans), n_words_removed for every row.

    Hashes with more than ``hot`` places may go by broadcast; that changes no result.
    """
    ship(docs.sparkSession)
    text = F.col(f"`{text_col}`").cast("string")
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
    # An order of all rows: the id, then the text's hash.
    keyed = own.withColumn("key", F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("tie")))
    places = keyed.select("key", F.explode(_runs(run, words)("text")).alias("r")).select("r.h", "r.g", "key", "r.at", "r.m")
    places = materialize(places, "runs")
    repeated = materialize(places.groupBy("h", "g").agg(F.count("*").alias("n"), F.min(F.struct("key", "at")).alias("first")).where("n > 1"), "repeated")
    some = maybe_in(repeated.select("h"))
    hots = F.broadcast(repeated.where(F.col("n") > hot).orderBy(F.desc("n"), "h", "g").limit(MOST_HOT).select("h", "g", "first"))
    tagged = places.where(some(F.col("h"))).join(hots, ["h", "g"], "left")
    rest = tagged.where("first is null").drop("first").join(repeated.select("h", "g", "first"), ["h", "g"])
    most = tagged.where("first is not null").unionByName(rest)
    later = most.where(F.struct("key", "at") > F.col("first")).groupBy("key").agg(F.collect_set(F.struct("at", "m")).alias("starts"))
    later = materialize(later, "later")
    # Only texts that may lose something are shuffled.
    mark = F.xxhash64("key.no_id", "key.id", "key.tie")
    doubtful = maybe_in(later.select(mark.alias("mark")))(mark)
    starts = F.lit(None).cast(later.schema["starts"].dataType)
    found = keyed.where(~doubtful).withColumn("starts", starts).unionByName(keyed.where(doubtful).join(later, "key", "left"))
    found = found.withColumn("c", _clean()("text", "starts"))
    return found.select("doc_id", F.col("c.clean").alias("text"), *[F.col(f"c.{x}").alias(x) for x in ("n_sentences", "n_removed", "cuts", "n_words_removed")])
