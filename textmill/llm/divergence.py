"""Quality rules by distribution divergence.

Each text gives two histograms: its characters by class, and its words by the
common words of a language (the lists below, with one class for all others).  The
references are the same histograms summed over all documents of each language, so
they grow with the corpus.  A text is compared with the reference of its own
language by Jensen-Shannon distance, the
square root of the divergence with logarithms to base 2, from 0 to 1.  Texts of
fewer than ``min_chars`` characters in words or ``min_words`` words are too short
for the histogram in question and are not rejected by it.

Before the method come base rules: too few words, or too large a share of words in
repeated windows.  Words are ``[^\\x20\\x09-\\x0D]+``.

Defined results: a null or empty text has no words and fails the base rules; a null
language is a language of its own; repeated rows each give a row and each count
in the references; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from textmill.llm._common import materialize, slices
from textmill.session import ship

#: Character classes: lower, upper, digit, stop and comma, other punctuation, symbol, space, line break.
CLASSES = 8
_SYMBOLS = set(b"#*$%&|<>+=@^_~\\/{}[]`")
_CLASS = bytes(
    0 if 97 <= b <= 122 or b >= 128 else 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 if b in b".," else 7 if b in b"\n\r" else 6 if b in b" \t\x0b\x0c" else 5 if b in _SYMBOLS else 4 for b in range(256)
)
#: Function words of four languages; a text's own language decides which list is used.
COMMON = {
    "en": "the of and to in a is that for it as was with be by on not he i this are or his from at which but have an had they you were their one all we can her has there been if more when will would who so no",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec son aux d mais comme ou si leur y dont elle deux ces être fait sans nous tout ont cette",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy hasta",
}
_INDEX = {lang: {w.encode("utf-8"): i for i, w in enumerate(dict.fromkeys(words.split()))} for lang, words in COMMON.items()}
#: For texts of any other language: the first words of each list.
_ALL = {w: i for i, w in enumerate(dict.fromkeys(w for words in zip(*_INDEX.values(), strict=False) for w in words[:4]))}
#: Word classes of every text, so that counts are rows of one width: the longest list, and all other words in the last.
WORDS = max(map(len, [*_INDEX.values(), dict(list(_ALL.items())[:64])])) + 1
_ALL = dict(list(_ALL.items())[: WORDS - 1])
_EDGE = b".,;:!?\"'()[]{}*$%#&|<>-"
_SYMBOL_CHARS = "#*$%&|<>"


def repeated_words(words: list[bytes], window: int = 8) -> int:
    """Words inside windows that are found twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    # Ranks of runs of 1, 2, 4, ... words: equal ranks are equal runs, without hashing.
    rank, have, many = ids, 1, len(seen)
    while have < window:
        step = min(have, window - have)
        both = rank[: len(rank) - step] * (many + 1) + rank[step:]
        uniq, rank = np.unique(both, return_inverse=True)
        have, many = have + step, len(uniq)
        if many == len(rank):
            return 0  # longer runs are distinct as well
    hit = np.bincount(rank)[rank] > 1
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def _words_by_list(words: list[bytes], lang: str | None) -> list[int]:
    """Counts of a language's common words, then of all others."""
    index = _INDEX.get(lang or "", _ALL)
    out, others = [0] * WORDS, 0
    for w, n in Counter(words).items():
        i = index.get(w)
        if i is None:
            i = index.get(w.strip(_EDGE).lower())
        if i is None:
            others += n
        else:
            out[i] += n
    out[-1] = others
    return out


_FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars array<long>, common array<long>"


def _features(window: int):
    @F.arrow_udf(_FEATURES)
    def features(texts: pa.Array, langs: pa.Array) -> pa.Array:
        cols: list[list] = [[] for _ in range(7)]
        langs = langs.to_pylist()
        for first, part in slices(texts):
            for i, t in enumerate(part):
                words = t.split()
                lines = [x for x in t.split(b"\n") if x.strip()]
                classes = np.bincount(np.frombuffer(t.translate(_CLASS), np.uint8), minlength=CLASSES)
                # Bytes after the first of a character count as none.
                follow = len(t) - len(t.decode("utf-8"))
                classes[0] -= follow
                for col, x in zip(
                    cols,
                    (
                        len(words),
                        len(t) - follow - sum(map(t.count, (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c"))),
                        sum(map(t.count, (c.encode() for c in _SYMBOL_CHARS))),
                        len(lines) - len(set(lines)),
                        repeated_words(words, window),
                        classes,
                        _words_by_list(words, langs[first + i]),
                    ),
                    strict=True,
                ):
                    col.append(x)
        kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _FEATURES.split(", ")])

    return features


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distance of each row of ``p`` from ``q``, counts in both; rows without counts have distance 0."""
    n = p.sum(1, keepdims=True)
    p, q = p / np.maximum(n, 1), q / np.maximum(q.sum(-1, keepdims=True), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda x: np.where(x > 0, x * np.log2(x / m), 0).sum(1)
        return np.where(n[:, 0] > 0, np.sqrt(np.clip((part(p) + part(np.broadcast_to(q, p.shape))) / 2, 0, 1)), 0.0)


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


@F.arrow_udf(DoubleType())
def _distance(own: pa.Array, ref: pa.Array) -> pa.Array:
    out = np.zeros(len(own))
    for at in range(0, len(own), 4096):
        p, q = _matrix(own.slice(at, 4096)), _matrix(ref.slice(at, 4096))
        out[at : at + len(p)] = jensen_shannon(p, q)
    return pa.array(out)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums of a partition: key, class, count."""
    own: dict[str, np.ndarray] = {}

    def flush() -> pa.RecordBatch:
        keys = [k for k in own for _ in range(CLASSES + WORDS)]
        at = np.tile(np.arange(CLASSES + WORDS, dtype=np.int32), len(own))
        n = np.concatenate([*own.values()]) if own else np.empty(0, np.int64)
        out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(at), pa.array(n)], names=["key", "at", "n"])
        own.clear()
        return out

    for batch in batches:
        if not batch.num_rows:
            continue
        counts = np.concatenate([_matrix(batch.column(1)), _matrix(batch.column(2))], 1).astype(np.int64)
        codes = batch.column(0).dictionary_encode()
        which = codes.indices.to_numpy(zero_copy_only=False)
        for i, key in enumerate(codes.dictionary.to_pylist()):
            part = counts[which == i].sum(0)
            own[key] = own[key] + part if key in own else part
        if len(own) > 1000:
            yield flush()
    yield flush()


def references(counted: DataFrame) -> DataFrame:
    """key, ref_chars, ref_common: the sums over all rows of each language."""
    sums = counted.select("key", "chars", "common").mapInArrow(_sums, "key string, at int, n long").groupBy("key", "at").agg(F.sum("n").alias("n"))
    every = sums.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("all"))
    counts = F.transform("all", lambda x: x["n"])
    return every.select("key", F.slice(counts, 1, CLASSES).alias("ref_chars"), F.slice(counts, CLASSES + 1, WORDS).alias("ref_common"))


def counted(docs: DataFrame, *, window: int = 8, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, key (of the language), the base counts and both histograms of every row, in one pass over the texts."""
    ship(docs.sparkSession)
    text, lang = F.col(f"`{text_col}`").cast("string"), F.col(f"`{lang_col}`").cast("string")
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), lang.alias("lang"), F.coalesce(F.concat(F.lit("="), lang), F.lit("")).alias("key"))
    return own.select("doc_id", "key", _features(window)("text", "lang").alias("f")).select("doc_id", "key", "f.*")


NAMES = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "chars_distance", "common_distance")


def divergence(
    docs: DataFrame,
    *,
    chars_limit: tuple[float, float] = (0.12, 1.1),
    words_limit: tuple[float, float] = (0.12, 2.3),
    min_chars: int = 150,
    min_words: int = 40,
    refits: int = 2,
    min_base_words: int = 20,
    max_repeat_percent: int = 30,
    window: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    min_reference_words: int = 1000,
    given: DataFrame | None = None,
) -> DataFrame:
    """Counts, base verdict, verdict and both distances for every row.

    A limit ``(a, b)`` is ``a + b / sqrt(words)``: a short text's histogram is that much
    noisier.  References are summed over all texts that pass the base rules, and
    ``refits`` times again over those that the verdict so far keeps, so that junk
    doesn't shape what it is compared with.

    A language whose reference has fewer than ``min_reference_words`` words can't judge
    its own few texts: their character classes are compared with the sum over all
    languages, their words with nothing.  ``given`` references (key, ref_chars,
    ref_common, as ``references`` makes them of other texts) are taken as they are.

    The texts are read once; what follows works on counts.  References have one
    row a language, joined by language; the sums are made within partitions
    before any shuffle, so a language that most rows share costs no more.
    """
    found = counted(docs, window=window, id_col=id_col, text_col=text_col, lang_col=lang_col)
    failed = (F.col("n_words") < min_base_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    rows = materialize(found.withColumn("base_failed", failed), "features")
    root = F.sqrt(F.greatest(F.col("n_words"), F.lit(1)).cast("double"))
    over = lambda col, limit: F.col(col) > F.lit(float(limit[0])) + F.lit(float(limit[1])) / root
    odd = ((F.col("word_chars") >= min_chars) & over("chars_distance", chars_limit)) | ((F.col("n_words") >= min_words) & over("common_distance", words_limit))

    def compared(refs: DataFrame) -> DataFrame:
        size = F.aggregate("ref_common", F.lit(0).cast("long"), lambda n, x: n + x)
        # Sums of the classes over all languages: one row.
        pooled = refs.agg(*[F.sum(F.get("ref_chars", F.lit(i))).alias(f"p{i}") for i in range(CLASSES)]).select(F.array(*[f"p{i}" for i in range(CLASSES)]).alias("pooled"))
        joined = rows.join(refs.withColumn("few", size < min_reference_words), "key", "left").crossJoin(F.broadcast(pooled))
        joined = joined.withColumns({"ref_chars": F.when(F.col("few"), F.col("pooled")).otherwise(F.col("ref_chars")), "ref_common": F.when(~F.col("few"), F.col("ref_common"))})
        # A language without a reference (all its texts fail the base rules) is at no distance.
        return joined.withColumns({f"{c}_distance": _distance(c, F.coalesce(f"ref_{c}", c)) for c in ("chars", "common")}).withColumn("kept", ~F.col("base_failed") & ~odd)

    if given is not None:
        return compared(given).select(*NAMES)
    refs = materialize(references(rows.where(~F.col("base_failed"))), "references")
    for _ in range(refits):
        refs = materialize(references(compared(refs).where("kept")), "references")
    return compared(refs).select(*NAMES)
