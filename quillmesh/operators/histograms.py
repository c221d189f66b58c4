"""Counts on fixed grids, empty cells kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fixed_range(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): equal bins on [low, high], the last closed; bin -1 holds what is below, bin bins what is above."""
    x = F.col(column)
    place = F.when(x < low, -1).when(x > high, bins).otherwise(F.least(F.floor((x - low) / ((high - low) / bins)), F.lit(bins - 1))).cast("long")
    counts = df.where(x.isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    return dense(df.sparkSession.range(-1, bins + 1).withColumnRenamed("id", "bin"), counts, ["bin"], ["n"])


def dense(grid: DataFrame, counts: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The grid with its counts, 0 where there are none."""
    return grid.join(counts, keys, "left").select(*keys, *[F.coalesce(v, F.lit(0).cast("long")).alias(v) for v in values])
