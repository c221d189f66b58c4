"""Ranks and running sums over a whole table, without a window that puts it in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: monotonically_increasing_id() is the partition times this, plus the row's number within it.
ROWS = 33


def in_order(df: DataFrame, key: Column, hold: Callable[[DataFrame], DataFrame] = DataFrame.persist) -> DataFrame:
    """df dealt into sorted ranges of the key, as many as the session's shuffles have, with rank_at: partition and place within it.

    The key is a struct that no two rows share, of columns that sort ascending; null sorts first. hold keeps the rows where they
    are, so that every later read has the same ranges: persisted on first use (catalog.clearCache() lets go), or written down.
    """
    return hold(df.repartitionByRange(key).sortWithinPartitions(key).withColumn("rank_at", F.monotonically_increasing_id()))


def _part() -> Column:
    return F.shiftright("rank_at", ROWS)


def _before(rows: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """One row for each range, with the totals of all ranges before it and of all ranges. There are as many rows as shuffle partitions."""
    w, every = Window.orderBy("rank_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    each = rows.groupBy(_part().alias("rank_part")).agg(*[c.alias(f"rank_{n}") for n, c in totals.items()])
    return each.select("rank_part", *[F.coalesce(F.sum(f"rank_{n}").over(w), F.lit(0)).alias(f"rank_{n}") for n in totals], *[F.sum(f"rank_{n}").over(every).alias(f"rank_all_{n}") for n in totals])


def place(df: DataFrame, by: list[str], key: Column, hold: Callable[[DataFrame], DataFrame] = DataFrame.persist) -> DataFrame:
    """(by, place): the place of each row, from 1, in ascending order of the key."""
    rows = in_order(df.select(*by, key.alias("rank_key")), F.col("rank_key"), hold)
    start = F.broadcast(_before(rows, {"n": F.count("*")}))  # a row for each shuffle partition
    inside = rows.select(*by, _part().alias("rank_part"), F.col("rank_at").bitwiseAND((1 << ROWS) - 1).alias("rank_in"))
    return inside.join(start, "rank_part").select(*by, (F.col("rank_n") + F.col("rank_in") + 1).alias("place"))


def placed(df: DataFrame, by: str, keys: dict[str, Column]) -> DataFrame:
    """df with the place of each row, from 1, by each of the keys: structs that no two rows share. by: a column without repeats or nulls. A place takes over a column of its name.

    Each order sorts only its key and that column; the places of all orders meet in one aggregation.
    """
    base, at = df.select(by, *[k.alias(n) for n, k in keys.items()]).persist(), None
    for name in keys:
        one = place(base, [by], F.col(name)).withColumn("rank_name", F.lit(name))
        at = one if at is None else at.unionByName(one)
    found = at.groupBy(by).agg(*[F.max(F.when(F.col("rank_name") == n, F.col("place"))).alias(n) for n in keys])
    return df.drop(*keys).join(found, by)


def running(df: DataFrame, key: Column, sums: dict[str, Column], totals: bool = False, hold: Callable[[DataFrame], DataFrame] = DataFrame.persist) -> DataFrame:
    """df with the sums of the given numbers over all rows up to and including the row, in ascending order of the key; with totals also NAME_all, over all rows."""
    rows = in_order(df, key, hold)
    start = F.broadcast(_before(rows, {n: F.sum(c) for n, c in sums.items()}))  # a row for each shuffle partition
    up_to = Window.partitionBy("rank_part").orderBy("rank_at").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumn("rank_part", _part()).withColumns({n: F.sum(c).over(up_to) for n, c in sums.items()})
    out = inside.join(start, "rank_part").withColumns({n: F.col(n) + F.col(f"rank_{n}") for n in sums})
    return out.select(*df.columns, *sums, *([F.col(f"rank_all_{n}").alias(f"{n}_all") for n in sums] if totals else []))


def percentile_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with the rank of a column over the number of rows, ties at their mean rank; nulls rank first, as one value.

    Values are counted first and each gets its rank once, so ties are one row in the ordering.
    """
    n = df.groupBy(F.col(column).alias("rank_value")).agg(F.count("*").alias("rank_count"))
    at = running(n, F.struct("rank_value"), {"rank_up_to": F.col("rank_count")}, totals=True)
    ranked = at.select("rank_value", ((F.col("rank_up_to") - (F.col("rank_count") - 1) / 2) / F.col("rank_up_to_all")).alias(name))
    return df.join(ranked, F.col(column).eqNullSafe(F.col("rank_value"))).drop("rank_value")
