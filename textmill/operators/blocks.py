"""Stated query rows against all rows, block by block.

The queries' vectors go to the tasks in blocks of a bounded size, and every batch of
rows meets each of them as a matrix where it is read: no row is copied or shuffled,
and a task holds one block, one batch and a bounded number of results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that meet a block at a time, bytes of vectors in a block of queries, and results that a task makes at a time.
PART, BLOCK_BYTES, RESULTS = 4096, 1 << 25, 1 << 19


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def against(rows: DataFrame, queries: DataFrame, score: Callable[[np.ndarray, np.ndarray], np.ndarray], name: str, *, part: int = PART, block: int | None = None) -> DataFrame:
    """query_id, doc_id and a score for each query and each row with another id.

    Both tables have doc_id (long) and v (array of doubles, all of one length); ``score``
    takes a query's vector and a matrix of rows.  Rows without a vector are left out.
    A block of queries (as many as ``block``, or as its bytes allow) costs one reading of
    the rows, so these should be a written table.
    """
    spark = rows.sparkSession
    rows, queries = (d.select(F.col("doc_id").cast("long"), "v").where("v is not null and doc_id is not null") for d in (rows, queries))
    n, width = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = max(-(-n // (block or max(BLOCK_BYTES // (8 * (width or 1)), 1))), 1)
    kind = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), (name, pa.float64())])

    def met(block: DataFrame) -> DataFrame:
        own = block.toArrow()
        sent = spark.sparkContext.broadcast((own.column("doc_id").to_numpy(), _matrix(own.column("v"))))

        def meet(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            ids_q, q = sent.value
            for batch in (b.slice(a, part) for b in batches for a in range(0, b.num_rows, part)):
                ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
                step = max(RESULTS // len(ids), 1)
                for a in range(0, len(ids_q), step):
                    some = ids_q[a : a + step]
                    who, other = np.repeat(some, len(ids)), np.tile(ids, len(some))
                    found = np.concatenate([score(v, x) for v in q[a : a + step]])
                    keep = who != other
                    yield pa.RecordBatch.from_arrays([pa.array(who[keep]), pa.array(other[keep]), pa.array(found[keep])], schema=kind)

        return rows.mapInArrow(meet, f"query_id long, doc_id long, {name} double")

    number = F.pmod(F.xxhash64("doc_id", "v"), F.lit(blocks))
    return reduce(DataFrame.unionByName, [met(queries if blocks == 1 else queries.where(number == b)) for b in range(blocks)])
