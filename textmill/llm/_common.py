"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.session import ship
from textmill.shared import discard, local_path, materialize, shared_dir, shared_path

__all__ = ["discard", "local_path", "materialize", "shared_dir", "shared_path"]

#: Words of the digests that split on ASCII white space only; ``bytes.split()`` does the same.
ASCII_SPACE = " \t\n\r\x0b\x0c"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(texts: pa.Array, target: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Cut an Arrow string array into runs of about ``target`` bytes.

    Yields the index of the first row and the UTF-8 bytes of each row (null:
    empty).  A row is never split, so a longer text is a run of its own.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    raw = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
    at = 0
    while at < len(ends):
        base = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + target, side="right")))
        yield at, [x or b"" for x in raw.slice(at, to - at).to_pylist()]
        at = to


def text_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under names of our own: other columns can't clash."""
    ship(df.sparkSession)
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


#: Bits of a filter that ``maybe_in`` broadcasts: 4 MB, whatever the number of ids.
FILTER_BITS = 1 << 25


def _filter_places(h: np.ndarray) -> np.ndarray:
    """Three places in the filter for each 64-bit hash."""
    h = h.view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([(h + np.uint64(i) * step) % np.uint64(FILTER_BITS) for i in range(3)])


def maybe_in(ids: DataFrame) -> Callable[[Column], Column]:
    """A test of an id that is true for every id in ``ids`` (one long column) and false for most others.

    It is a Bloom filter of a fixed size, so it can be broadcast at any scale; with
    very many ids it lets more through, never less.  Rows that it drops needn't be
    shuffled to a join with ``ids``.
    """
    spark = ids.sparkSession
    ship(spark)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_filter_places(batch.column(0).to_numpy()))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], names=["w", "b"])

    found = ids.select(F.xxhash64(F.col(ids.columns[0]).cast("long"))).mapInArrow(words, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(FILTER_BITS >> 6, np.uint64)
    bits[found.column("w").to_numpy()] = found.column("b").to_numpy().view(np.uint64)
    sent = spark.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def test(hashes: pa.Array) -> pa.Array:
        at = _filter_places(hashes.to_numpy())
        return pa.array(((sent.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(0))

    return lambda column: test(F.xxhash64(column.cast("long")))


def give_back() -> None:
    """Return freed memory to the system, after a fit in the driver: the session goes on with other work beside it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def n_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over uint64, in place."""
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256)]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def safe_name(name: str) -> str:
    return re.sub(r"\W+", "_", name)
