"""From arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def each(docs: DataFrame, array: Column, pos: str, value: str, *keep: Column | str) -> DataFrame:
    """A row for each element of an array, with its place from 0, after the columns ``keep``.

    It is an outer explode whose empty rows are dropped: for a plain one the planner
    adds a filter on the size of the array, for which it is computed a second time.
    """
    return docs.select(*keep, F.posexplode_outer(array).alias(pos, value)).where(F.col(f"`{pos}`").isNotNull())
