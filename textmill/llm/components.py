"""Connected components by alternating large-star and small-star.

Each round maps the edges of every node to the smallest id near it.  Only minima
are aggregated (with partial sums before the shuffle) and joined back, so that a
node with very many neighbours is never gathered in one task; adaptive skew
joins split its edges.  Rounds end when the edges no longer change; each round's
edges are written to the shared folder, which also ends their lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm._common import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Joins each node's larger neighbours to the smallest of its neighbours and itself."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Joins each node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31))).alias("h")).first()
    return r.n, r.h or 0


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """id, component_id (the smallest id reachable) for each node of an edge.

    ``edges`` has two long columns u and v, in any order, repeats and loops
    allowed.  Nodes that occur only in loops, and nulls, get no row.  The result is
    written; what the rounds wrote is deleted.
    """
    now = materialize(edges.select(F.col(edges.columns[0]).alias("u"), F.col(edges.columns[1]).alias("v")).where("u <> v").distinct(), "edges")
    state = _state(now)
    for _ in range(most_rounds):
        if not state[0]:
            break
        before, now = now, materialize(_small_star(_large_star(now)), "edges")
        discard(before)
        if (new := _state(now)) == state:
            break
        state = new
    else:
        raise RuntimeError("components did not settle")
    pairs = now.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    out = materialize(pairs.unionAll(now.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()), "components")
    discard(now)
    return out
