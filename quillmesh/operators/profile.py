"""Data-quality audit: column profiles in one pass, spellings, outliers, composite scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranks import running

# Weights of the dimensions and limits of the states.
WEIGHTS = {"completeness": 0.35, "validity": 0.30, "uniqueness": 0.20, "consistency": 0.15}
PASS_MIN, WARNING_MIN = 90.0, 75.0
NUMBERS = ("int", "bigint", "double", "float", "smallint", "tinyint")


def profile(df: DataFrame, rules: dict[str, Column] | None = None, identifiers: tuple[str, ...] = ()) -> DataFrame:
    """One row a column: rows, distinct, nulls, null_pct, min, max, mean, invalid, outliers.

    rules: what breaks a column's rule; only populated cells count. Outliers lie beyond three
    interquartile ranges, in numeric columns that aren't identifiers. Cells are counted by column and
    value in its own type, once, with sums made on the map side; everything else is derived from these
    counts, the quartiles by running sums over ranges of values.
    """
    rules = rules or {}
    kinds = dict(df.dtypes)
    numeric = [c for c in df.columns if kinds[c] in NUMBERS]
    measured = [c for c in numeric if c not in identifiers]
    broken = lambda c: F.coalesce(F.col(c).isNotNull() & rules[c], F.lit(False)) if c in rules else F.lit(False)
    number, some = F.coalesce("real", F.col("whole").cast("double")), F.coalesce(F.col("text").isNotNull() | F.col("whole").isNotNull() | F.col("real").isNotNull(), F.lit(False))

    def cell(c: str) -> Column:
        kind = "text" if c not in numeric else "real" if kinds[c] in ("double", "float") else "whole"
        value = lambda name, to: (F.col(c) if kind == name else F.lit(None)).cast(to).alias(name)
        return F.struct(F.lit(c).alias("column"), value("text", "string"), value("whole", "long"), value("real", "double"), broken(c).alias("broken"))

    def counts(columns: list[str]) -> DataFrame:
        cells = df.select(F.inline(F.array(*[cell(c) for c in columns])))
        return cells.groupBy("column", "text", "whole", "real").agg(F.count("*").alias("n"), F.count_if("broken").alias("broken"))

    def stats(found: DataFrame) -> DataFrame:
        filled = F.when(number.isNotNull(), F.col("n"))
        return found.groupBy("column").agg(
            F.sum("n").alias("rows"), F.count_if(some).alias("distinct"), F.coalesce(F.sum(F.when(~some, F.col("n"))), F.lit(0)).alias("nulls"),
            F.min("text").alias("first"), F.min(number).alias("least"), (F.sum(number * F.col("n")) / F.sum(filled)).alias("mean"), F.sum("broken").alias("invalid"),
        )

    others = [c for c in df.columns if c not in measured]
    each = [stats(counts(others))] if others else []
    far = df.sparkSession.createDataFrame([], "of string, outliers long")
    if measured:
        at = running(counts(measured), F.struct("column", "whole", "real"), {"up_to": F.when(number.isNotNull(), F.col("n")).otherwise(0)})
        each.append(stats(at))
        bounds = quartiles(at.where(number.isNotNull()).select("column", number.alias("number"), "n", "up_to")).withColumnRenamed("column", "of")
        spread = F.col("high") - F.col("low")
        far = at.join(F.broadcast(bounds), F.col("column") == F.col("of"))  # a row for each column
        far = far.where((spread > 0) & ((number < F.col("low") - 3 * spread) | (number > F.col("high") + 3 * spread))).groupBy("of").agg(F.sum("n").alias("outliers"))
    each = reduce(DataFrame.unionByName, each)
    whole = [c for c in numeric if kinds[c] not in ("double", "float")]
    least = F.when(F.col("column").isin(whole), F.col("least").cast("long").cast("string")).when(F.col("column").isin(numeric), F.col("least").cast("string")).otherwise(F.col("first"))
    out = each.join(F.broadcast(far), F.col("column") == F.col("of"), "left")
    return out.select("column", "rows", "distinct", "nulls", F.round(F.col("nulls") / F.col("rows") * 100, 6).alias("null_pct"), least.alias("min"), F.round("mean", 6).alias("mean"), "invalid", F.coalesce("outliers", F.lit(0)).cast("long").alias("outliers"))


def quartiles(counts: DataFrame) -> DataFrame:
    """(column, low, high): the exact first and third quartiles, between two values by the share of the way; counts: (column, number, n, up_to), with up_to the running sum of n by column and number."""
    up, n = F.col("up_to"), F.col("n")
    span = counts.groupBy("column").agg(F.min(up - n).alias("start"), F.sum("n").alias("filled"))
    rows = counts.join(F.broadcast(span), "column")  # a row for each column
    first, last = up - n - F.col("start"), up - F.col("start")

    def at(place: Column) -> Column:
        return F.max(F.when((first <= place) & (place < last), F.col("number")))

    spots = {"low": 0.25 * (F.col("filled") - 1), "high": 0.75 * (F.col("filled") - 1)}
    ends = rows.groupBy("column", "filled").agg(*[at(f(p)).alias(f"{name}_{i}") for name, p in spots.items() for i, f in enumerate((F.floor, F.ceil))])

    def between(name: str) -> Column:
        a, b, p = F.col(f"{name}_0"), F.col(f"{name}_1"), spots[name]
        return F.when(a == b, a).otherwise((F.ceil(p) - p) * a + (p - F.floor(p)) * b).alias(name)

    return ends.select("column", between("low"), between("high"))


def other_spellings(df: DataFrame, column: str) -> DataFrame:
    """(folded, surface, preferred, n): spellings that differ from the most frequent one of the same folded text (ties: first by text)."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.upper(F.trim(column)).alias("folded"), F.col(column).alias("surface")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("folded").orderBy(F.desc("n"), "surface")
    return counts.withColumn("preferred", F.first("surface").over(order)).where("surface <> preferred").select("folded", "surface", "preferred", "n")


def health(score: Column, null_rate: Column, invalid_rate: Column) -> Column:
    return F.when((null_rate > 0.20) | (invalid_rate > 0.20) | (score < WARNING_MIN), "CRITICAL").when((null_rate > 0.05) | (invalid_rate > 0.05) | (score < PASS_MIN), "WARNING").otherwise("PASS")


def composite(columns: DataFrame, repeated: DataFrame, inconsistent: DataFrame) -> DataFrame:
    """The dataset's scores from its column profile, its repeated rows (one row) and its other spellings (one row: inconsistent)."""
    t = columns.agg(F.sum("rows").alias("cells"), F.max("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.sum("invalid").alias("invalid")).crossJoin(repeated).crossJoin(inconsistent)
    full = F.col("cells") - F.col("nulls")
    parts = {"completeness": (1 - F.col("nulls") / F.col("cells")) * 100, "validity": (1 - F.col("invalid") / full) * 100, "uniqueness": (1 - F.col("repeated") / F.col("rows")) * 100, "consistency": (1 - F.col("inconsistent") / full) * 100}
    t = t.withColumns(parts).withColumn("score", sum((F.col(c) * w for c, w in WEIGHTS.items()), F.lit(0.0)))
    state = health(F.col("score"), 1 - F.col("completeness") / 100, 1 - F.col("validity") / 100)
    return t.select("rows", "repeated", *[F.round(c, 6).alias(c) for c in (*parts, "score")], state.alias("health"))
