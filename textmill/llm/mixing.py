"""Mixing sources to target weights by subset-sum budget fitting.

Each source gets a target of words: all sources share ``share`` times all words by
weight, no target exceeds ``most`` times its source, and what is cut off is shared
again by weight among the others until none is above.  A source gives its
documents ``floor(target / words)`` times whole and fits the rest of the budget
as a subset sum over exact document lengths:

1. documents are counted by (source, length);
2. of every length the same fraction is taken, rounded down;
3. longest lengths first, single documents are added while they fit, until the
   open budget is at most the bound of the next step;
4. a bounded-knapsack dynamic program over the remaining counts finds the sum
   closest to the open budget, on either side, as bits of one integer, and the
   count per length;
5. of each (source, length), that many documents are selected by the smallest
   seeded hash of their id.

Steps 2 to 4 see only counts, one row for each distinct length of a source.  Step 5
ranks within slots of the hash, so that a length shared by a third of all rows is
no single task: the quota of a slot follows from the counts of the slots before.

Defined results: null and empty texts have size 0 and take 0; the null source is
the last source; copies of a row are taken separately; ties of the hash fall by
id and then by text hash; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm._common import fresh, materialize, n_words

#: Bits of the dynamic program: budgets above it are first brought down by single documents.
DP_BITS = 1 << 16
#: Hash slots by which the selection within one (source, length) is spread.
SLOTS = 4096


def fit_counts(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length to take so that their sum is as near the budget as the bits tell.

    Proportional counts, then single documents from the longest, then the
    bounded knapsack.  Zero lengths are never taken.
    """
    order = sorted((l, i) for i, l in enumerate(lengths) if l > 0 and counts[i] > 0)
    total = sum(lengths[i] * counts[i] for _, i in order)
    take = [0] * len(lengths)
    if not order or budget <= 0:
        return take
    if budget >= total:
        return [c if l > 0 else 0 for l, c in zip(lengths, counts, strict=True)]
    for l, i in order:
        take[i] = counts[i] * budget // total
    rest = budget - sum(l * take[i] for l, i in order)
    for l, i in reversed(order):
        if rest <= DP_BITS:
            break
        k = min(counts[i] - take[i], (rest - DP_BITS + l - 1) // l, rest // l)
        take[i] += k
        rest -= k * l
    # Sums up to one longest document beyond the budget: the closest may lie on either side.
    most = rest + order[-1][0]
    mask = (1 << (most + 1)) - 1
    reach, steps = 1, []
    for l, i in order:
        left, power = counts[i] - take[i], 1
        while left > 0 and not reach >> rest & 1:
            k = min(power, left, most // l)
            if k == 0:
                break
            steps.append((reach, l * k, i, k))
            reach |= reach << (l * k) & mask
            left, power = left - k, 2 * power
        if reach >> rest & 1:
            break
    low = (reach & ((1 << (rest + 1)) - 1)).bit_length() - 1
    above = reach >> (rest + 1)
    high = rest + (above & -above).bit_length() if above else None
    at = low if high is None or rest - low <= high - rest else high
    for before, size, i, k in reversed(steps):
        if not before >> at & 1:
            take[i] += k
            at -= size
    return take


def targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """key, source, source_size, weight, target; ``sizes`` has one row per source.

    Sharing the excess again until none is above ends where every source has
    ``min(most * size, level * weight)``.  The level follows from one ordering
    by ``size / weight``: the table has one row per source, never per document.
    """
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int")))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    cap = F.lit(float(most)) * F.col("source_size")
    levels = (
        ranked.withColumn("budget", F.least(F.lit(float(share)), F.lit(float(most))) * F.sum("source_size").over(every))
        .withColumn("capped", F.coalesce(F.sum("source_size").over(upto), F.lit(0)) * F.lit(float(most)))
        .withColumn("level", (F.col("budget") - F.col("capped")) / F.sum("weight").over(rest))
        # The first source, in order, whose cap is not below the level sets it for all that follow.
        .withColumn("level", F.min(F.when(cap >= F.col("level") * F.col("weight"), F.struct(F.col("source_size") / F.col("weight"), F.col("level").alias("at")))).over(every)["at"])
    )
    target = F.when(F.col("level").isNull(), cap).otherwise(F.least(cap, F.col("level") * F.col("weight")))
    return levels.select("key", "source", "source_size", "weight", target.alias("target"))


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("size")
    words, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
    whole = int(target // words) if words else 0
    chosen = fit_counts(rows["size"].astype(int).tolist(), rows["n"].astype(int).tolist(), round(target - whole * words))
    return pd.DataFrame({"key": rows["key"], "size": rows["size"], "whole": whole, "quota": chosen, "source_size": words, "target": target})


def mix(docs: DataFrame, *, weights: list[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17, size: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep_tie: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, times, taken for every row.

    ``times`` says how often the mix repeats the document, ``taken`` the words
    that makes.  The texts are read once; what is shuffled after that has an id,
    a source and a size.
    """
    text = F.col(f"`{text_col}`").cast("string")
    source = F.col(f"`{source_col}`").cast("string")
    narrow = materialize(
        docs.select(
            F.col(f"`{id_col}`").cast("long").alias("doc_id"),
            source.alias("source"),
            F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("key"),  # never null, so that joins and windows share one partitioning
            (n_words(text) if size is None else F.coalesce(size.cast("long"), F.lit(0))).alias("size"),
            F.xxhash64(F.lit(seed), F.col(f"`{id_col}`")).alias("h"),
            F.xxhash64(text).alias("tie"),
        ).withColumn("slot", F.pmod(F.shiftrightunsigned("h", 40), F.lit(SLOTS)).cast("int")),
        "sizes",
    )
    slots = materialize(narrow.groupBy("key", "source", "size", "slot").agg(F.count("*").alias("n")), "slots")
    lengths = slots.groupBy("key", "source", "size").agg(F.sum("n").alias("n"))
    wanted = materialize(targets(lengths.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), list(weights), share, most), "targets")
    fitted = lengths.drop("source").join(wanted, "key").groupBy("key").applyInPandas(_fit, "key string, size long, whole long, quota long, source_size long, target double")
    before = Window.partitionBy("key", "size").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    quota = (
        slots.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .join(materialize(fitted, "quotas"), ["key", "size"])
        .select("key", "size", "slot", "whole", F.greatest(F.lit(0), F.least("n", F.col("quota") - F.col("before"))).alias("quota"), "source_size", "target")
    )
    rank = F.row_number().over(Window.partitionBy("key", "size", "slot").orderBy("h", F.col("doc_id").asc_nulls_first(), "tie"))
    return (
        narrow.join(quota, ["key", "size", "slot"])
        .withColumn("times", (F.col("whole") + (rank <= F.col("quota")).cast("long")).cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"), *(["tie"] if keep_tie else []))
    )


def repeat(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their own columns.

    Rows equal in id and text share what the mix takes of them.
    """
    names = docs.columns
    text, own_id = F.col(f"`{text_col}`").cast("string"), F.col(f"`{id_col}`").cast("long")
    taken = mix(docs, id_col=id_col, text_col=text_col, keep_tie=True, **how)
    k, tie, n, t, times, copy = (fresh(docs, x) for x in ("__k", "__tie", "__n", "__t", "__times", "__copy"))
    wanted = taken.groupBy(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(k), F.col("tie").alias(tie)).agg(F.count("*").alias(n), F.sum("times").alias(t))
    keyed = docs.withColumn(k, F.coalesce(own_id.cast("string"), F.lit(""))).withColumn(tie, F.xxhash64(text))
    found = keyed.join(wanted.where(F.col(t) > 0), [k, tie])
    row = F.row_number().over(Window.partitionBy(k, tie).orderBy(k))
    each = F.floor(F.col(t) / F.col(n)) + (row <= F.col(t) % F.col(n)).cast("long")
    numbered = found.withColumn(times, each.cast("int")).where(F.col(times) > 0)
    return numbered.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in names])
