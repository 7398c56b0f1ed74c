"""Token ids as flat unsigned integer files with 64-bit document offsets.

A corpus is a folder of shards.  Shard ``k`` has three flat little-endian files

``shard-k.bin``
    the token ids of its documents one after another, uint16 if the vocabulary
    fits, else uint32;
``shard-k.idx``
    int64, one more than documents: document ``i`` is ids ``idx[i]:idx[i + 1]``;
``shard-k.doc``
    int64, the document ids (``NULL_ID`` for null)

and ``manifest.parquet`` lists shard, n_docs, n_tokens and width.  Shards follow
one another in ascending document id, so the place of a document in the whole
corpus is the prefix sum of the shards before it plus its own offset.  All files
are read by memory mapping.

Defined results: a null or empty text is only the end id; repeated ids are all
written, ordered by id and then text; null ids come first; an empty table gives
no shards; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.llm._common import byte_symbols, local_path, shuffle_partitions, slices, text_of

NULL_ID = np.iinfo(np.int64).min
#: Bytes of text for each shard, on average.
SHARD_BYTES = 256 << 20
#: Pieces and words that a worker remembers; beyond it the memory starts afresh.
REMEMBERED = 450_000
MANIFEST = "shard int, n_docs long, n_tokens long, width int"
#: Splitters that drop white space, so that no token spans it: such tokenizers may be asked word by word.
_WORDWISE = {r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
_WORDWISE_NORMALIZERS = {"NFC", "Lowercase", "Replace"}
# Texts of these characters are their own normal form but for case, and fall into the pieces that the splitter gives.
_ODD = re.compile("[^\\t-\\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]").search
_PIECES = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^a-z0-9\\t-\\r \u00df-\u00f6\u00f8-\u00ff]+").findall

_encoders: dict[str, WordEncoder] = {}


def _is_wordwise(config: dict) -> bool:
    norm, pre = config.get("normalizer") or {}, config.get("pre_tokenizer") or {}
    kinds = norm.get("normalizers", [norm] if norm else [])
    first = (pre.get("pretokenizers") or [pre])[0]
    return (
        all(k["type"] in _WORDWISE_NORMALIZERS and (k["type"] != "Replace" or k["pattern"] == {"Regex": r"\s+"}) for k in kinds)
        and first.get("type") == "Split"
        and first.get("behavior") == "Removed"
        and first.get("invert") is True
        and first.get("pattern", {}).get("Regex") in _WORDWISE
        and config.get("post_processor") is None
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in config["added_tokens"])
    )


class WordEncoder:
    """Ids of whole texts by the ``tokenizers`` library.

    Where the tokenizer's own rules drop white space before anything else can
    see across it, each distinct piece that its splitter makes is given to the
    library's model once and its ids are remembered.  Texts whose pieces are not
    plain (other scripts, special strings) go to the library word by word, and
    with any other tokenizer whole texts do.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.batch = getattr(self.lib, "encode_batch_fast", self.lib.encode_batch)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.wordwise = _is_wordwise(config)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in config["added_tokens"]) or "(?!)").search
        self.model, self.symbols = self.lib.model, byte_symbols()
        self.vocabulary = self.lib.get_vocab_size(with_added_tokens=True)
        self._forget()

    def _forget(self) -> None:
        # Pieces are strings, whole words bytes, so that the two can't be confused.
        self.known: dict[str | bytes, int] = {}
        self.flat, self.used = np.empty(1 << 20, np.uint32), 0
        self.starts, self.lens = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64)

    def _split(self, text: bytes) -> list[str] | list[bytes]:
        plain = text.decode("utf-8")
        return text.split() if _ODD(plain) or self.special(plain) else _PIECES(plain.lower())

    def _ids(self, piece: str | bytes) -> list[int]:
        """Ids of a piece by the library's model alone, as the pre-tokenizer would hand it over; of a word by the whole library."""
        if isinstance(piece, bytes):
            return self.lib.encode(piece.decode("utf-8"), add_special_tokens=False).ids
        return [t.id for t in self.model.tokenize(piece if piece.isascii() else "".join(map(self.symbols.__getitem__, piece.encode("utf-8"))))]

    def _learn(self, words: list[str | bytes]) -> None:
        found = list(map(self._ids, words))
        lens = np.fromiter(map(len, found), np.int64, len(found))
        total, n = int(lens.sum()), len(self.known)
        while self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        while n + len(words) > len(self.lens):
            self.starts, self.lens = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lens, 2 * len(self.lens))
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(found), np.uint32, total)
        self.lens[n : n + len(words)] = lens
        self.starts[n : n + len(words)] = self.used + np.cumsum(lens) - lens
        self.used += total
        self.known.update(zip(words, range(n, n + len(words)), strict=True))

    def encode(self, texts: list[bytes], end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has."""
        if not self.wordwise:
            found = [e.ids + ([end] if end is not None else []) for e in self.batch([t.decode("utf-8") for t in texts], add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter((i for ids in found for i in ids), np.uint32, int(sizes.sum())), sizes
        split = list(map(self._split, texts))
        if len(self.known) > REMEMBERED:
            self._forget()
        new = set().union(*split).difference(self.known)
        if new:
            self._learn(list(new))
        counts = np.fromiter(map(len, split), np.int64, len(split))
        codes = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        per_word = self.lens[codes]
        ends = np.cumsum(per_word)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.starts[codes] - ends + per_word, per_word) + np.arange(total)]
        upto = np.concatenate([[0], ends])[np.cumsum(counts)]
        sizes = np.diff(upto, prepend=0)
        if end is not None:
            ids = np.insert(ids, upto, end)
            sizes = sizes + 1
        return ids, sizes


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _posix(folder: str) -> str:
    local = local_path(folder)
    if local is None:
        raise ValueError(f"memory-mapped files need a mounted folder, not {folder}")
    return str(local)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, *, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Encode every whole text and write the shards; returns the manifest.

    One range shuffle orders the texts by id; each task then streams its range
    through the tokenizer into one shard, holding about a megabyte at a time.  A
    task writes under a name of its own and renames when done, so a retried or
    doubled attempt leaves the same files.  ``shards`` follows from the texts' bytes,
    ``SHARD_BYTES`` each, and is at least the session's shuffle partitions.  ``folder``
    must be mounted on every executor.
    """
    spark, to = docs.sparkSession, _posix(folder)
    os.makedirs(to, exist_ok=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer)
        if end_id is not None and not 0 <= end_id < 1 << 32:
            raise ValueError("end_id must be an unsigned 32-bit integer")
        kind = np.dtype("<u2") if max(enc.vocabulary, (end_id or 0) + 1) <= 1 << 16 else np.dtype("<u4")
        shard = TaskContext.get().partitionId()
        own, name = f"{to}/.part-{uuid.uuid4().hex}", f"{to}/shard-{shard:06d}"
        at = n = 0
        with open(own + ".bin", "wb") as ids_to, open(own + ".idx", "wb") as idx_to, open(own + ".doc", "wb") as doc_to:
            idx_to.write(np.zeros(1, "<i8").tobytes())
            for batch in batches:
                keys = batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype("<i8")
                for first, texts in slices(batch.column(1)):
                    ids, sizes = enc.encode(texts, end_id)
                    ids_to.write(ids.astype(kind).tobytes())
                    idx_to.write((at + np.cumsum(sizes)).astype("<i8").tobytes())
                    doc_to.write(keys[first : first + len(texts)].tobytes())
                    at, n = at + len(ids), n + len(texts)
        for kind_of in (".bin", ".idx", ".doc"):
            if n:
                os.replace(own + kind_of, name + kind_of)
            else:
                os.remove(own + kind_of)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([n], pa.int64()), pa.array([at], pa.int64()), pa.array([kind.itemsize], pa.int32())], names=["shard", "n_docs", "n_tokens", "width"])

    own = text_of(docs, id_col, text_col)
    if shards is None:
        size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(shuffle_partitions(spark), -(-size // SHARD_BYTES))
    ordered = own.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(write, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest.parquet")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest.parquet")


def open_shard(folder: str, shard: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Memory maps of a shard: ids, offsets, document ids."""
    name = f"{_posix(folder)}/shard-{shard:06d}"
    idx = np.memmap(name + ".idx", "<i8", "r")
    ids = np.memmap(name + ".bin", f"<u{width}", "r") if idx[-1] else np.empty(0, f"<u{width}")
    return ids, idx, np.memmap(name + ".doc", "<i8", "r")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it in the corpus.  The
    prefix sum runs over the manifest, which has a row per shard.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest.parquet")
    based = shards.select("shard", "width", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long").alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, idx, docs = open_shard(folder, row["shard"], row["width"])
                for at in range(0, len(docs), 4096):
                    own, bounds = np.array(docs[at : at + 4096]), np.array(idx[at : at + 4097])
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own, mask=own == NULL_ID), pa.array(row["base"] + bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                    )

    return based.repartition(max(shuffle_partitions(spark), shards.count()), "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
