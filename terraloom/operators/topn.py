"""The first rows of groups of any size, ranked without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES = 64


def sliced_rank(df: DataFrame, keys: list[str], order: list[Column | str], spread: list[str], limit: str, out: str = "rank") -> DataFrame:
    """Rows whose rank in their group is at most the column ``limit``, with the rank.

    A group is ranked in slices by a hash of ``spread`` first; only the winners of its slices, at most SLICES times the limit, are ranked together.
    """
    own = Window.partitionBy(*keys, F.pmod(F.xxhash64(*spread), F.lit(SLICES))).orderBy(*order)
    winners = df.withColumn(out, F.row_number().over(own)).where(F.col(out) <= F.col(limit))
    return winners.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(out) <= F.col(limit))
