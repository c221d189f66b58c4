"""Rule cleaning with a ledger, expectation checks as violation rows, and stable splits and samples."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Rule = tuple[str, str, Column]


def first_failure(rules: list[Rule]) -> Column:
    """The number of the first rule that a row fails; null if it passes all. A null verdict is a failure."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(rules))):
        out = F.when(~F.coalesce(rules[i][2], F.lit(False)), F.lit(i)).otherwise(out)
    return out


def survivors(df: DataFrame, rules: list[Rule]) -> DataFrame:
    return df.where(first_failure(rules).isNull())


def ledger(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """(step, rule, before, removed, after): what each rule removes of the rows that the rules before it left, in one pass."""
    failed = df.groupBy(first_failure(rules).alias("step")).agg(F.count("*").alias("n"))
    counts = failed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), *[F.coalesce(F.sum(F.when(F.col("step") == i, F.col("n"))), F.lit(0)).alias(f"r{i}") for i in range(len(rules))])
    removed = lambda i: F.col(f"r{i}")
    before = lambda i: reduce(lambda a, j: a - removed(j), range(i), F.col("total"))
    rows = [F.struct(F.lit(i).alias("step"), F.lit(r[0]).alias("rule"), before(i).alias("before"), removed(i).alias("removed"), (before(i) - removed(i)).alias("after")) for i, r in enumerate(rules)]
    return counts.select(F.inline(F.array(*rows)))


def violations(df: DataFrame, key: str, checks: list[tuple[str, str, Column]]) -> DataFrame:
    """(key, field, reason) for each check that a row breaks; checks: field, reason, condition that breaks it."""
    found = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(f).alias("field"), F.lit(why).alias("reason"))) for f, why, bad in checks])
    return df.select(key, F.explode(F.array_compact(found)).alias("v")).select(key, "v.field", "v.reason")


def first_violations(found: DataFrame, key: str, n: int = 10) -> DataFrame:
    """(field, reason, rows, shown): how many rows break a check, and the first n of them."""
    ranked = found.withColumn("n", F.row_number().over(Window.partitionBy("field", "reason").orderBy(key)))
    return ranked.groupBy("field", "reason").agg(F.count("*").alias("rows"), F.array_sort(F.collect_list(F.when(F.col("n") <= n, F.col(key)))).alias("shown"))


def outside_domain(df: DataFrame, column: str, allowed: list) -> DataFrame:
    """(value, rows) of values that aren't allowed; null is none."""
    return df.where(~F.coalesce(F.col(column).isin(allowed), F.lit(False))).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("rows"))


def defaulted(df: DataFrame, fields: dict[str, tuple[float, float, float]]) -> tuple[DataFrame, list[tuple[str, str, Column]]]:
    """df with missing numbers set to their default, and the checks (for violations) that they are finite and in range; fields: name -> (low, high, default)."""
    value = {c: F.col(c).cast("double") for c in fields}
    endless = lambda v: F.isnan(v) | v.isin(float("inf"), float("-inf"))
    checks = [(c, "not finite", endless(value[c])) for c in fields]
    checks += [(c, "out of range", ~endless(value[c]) & ~value[c].between(low, high)) for c, (low, high, _) in fields.items()]
    return df.withColumns({c: F.coalesce(value[c], F.lit(float(default))) for c, (_, _, default) in fields.items()}), checks


def stray_marker(df: DataFrame, marker: str, home: str) -> DataFrame:
    """(column, rows) of the text columns other than home that hold the marker; none if it is only where it belongs."""
    names = [n for n, kind in df.dtypes if kind == "string" and n != home]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, rows long")
    one = df.agg(*[F.count_if(F.col(n) == marker).alias(n) for n in names])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("column"), F.col(n).alias("rows")) for n in names]))).where("rows > 0")


def relabelled(df: DataFrame, column: str, marker: str, label: str = "missing") -> DataFrame:
    return df.withColumn(column, F.when(F.col(column) == marker, label).otherwise(F.col(column)))


def constant_columns(df: DataFrame) -> list[str]:
    """Columns with no two different values; null beside a value counts as a second one. One pass: least and greatest of each column."""
    kinds = [F.struct(F.min(c).eqNullSafe(F.max(c)).alias("same"), F.count(c).alias("n")).alias(c) for c in df.columns]
    row = df.agg(F.count("*").alias("all_rows_"), *kinds).first()
    return [c for c in df.columns if row[c]["same"] and row[c]["n"] in (0, row["all_rows_"])]


def preview(df: DataFrame, n: int, key: str, digits: int = 4) -> DataFrame:
    """The first n rows by key as text: null is "missing", fractions are rounded."""
    shown = {c: F.round(c, digits) if kind in ("double", "float") or kind.startswith("decimal") else F.col(c) for c, kind in df.dtypes}
    return df.orderBy(key).limit(n).select(*[F.coalesce(v.cast("string"), F.lit("missing")).alias(c) for c, v in shown.items()])


def derived(df: DataFrame, makers: dict[str, Callable[[DataFrame], Column]]) -> DataFrame:
    """df with columns made by a user's functions from frame to column; each sees those before it."""
    for name, make in makers.items():
        df = df.withColumn(name, make(df))
    return df


def profile_facts(df: DataFrame, label: str, numeric: list[str], pair: tuple[str, str]) -> DataFrame:
    """One row: rows, the positive rate, and of each number its missing rate, median and range; Pearson of a pair."""
    facts = [F.count("*").alias("rows"), F.round(F.avg(label), 6).alias("positive_rate")]
    for c in numeric:
        facts += [F.round(F.avg(F.col(c).isNull().cast("int")), 6).alias(f"{c}_missing"), F.round(F.median(c), 6).alias(f"{c}_median"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return df.agg(*facts, F.round(F.corr(*[F.col(c).cast("double") for c in pair]), 6).alias("pearson"))


def repeated_rows(df: DataFrame) -> Column:
    """How many rows repeat an earlier one: all rows less the distinct ones."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"))


def md5_bucket(key: Column, salt: str, buckets: int = 1000) -> Column:
    """The first four bytes, as a number, of md5(salt|key), modulo buckets."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}|"), key.cast("string"))), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def role(bucket: Column, bounds: list[tuple[str, int, int]]) -> Column:
    out = F.lit(None).cast("string")
    for name, low, high in bounds:
        out = F.when((bucket >= low) & (bucket < high), name).otherwise(out)
    return out


def md5_order(key: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def exact_sample(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows without replacement, whatever they hold, by the order of md5(seed|key)."""
    return df.orderBy(md5_order(F.col(key), seed), key).limit(n)


def stratified(df: DataFrame, label: str, key: str, cuts: list[tuple[str, float]], seed: str) -> DataFrame:
    """df with part: within each label, by md5 order, the first share goes to the first part and so on; sizes by floor."""
    order = Window.partitionBy(label).orderBy(md5_order(F.col(key), seed).asc_nulls_last(), key)
    share = (F.row_number().over(order) - 1) / F.count("*").over(Window.partitionBy(label))
    out, edge = F.lit(cuts[-1][0]), sum(Decimal(str(c)) for _, c in cuts[:-1])  # 0.55 + 0.15 is 0.7, which it isn't in doubles
    for name, width in reversed(cuts[:-1]):
        out = F.when(share < float(edge), name).otherwise(out)
        edge -= Decimal(str(width))
    return df.withColumn("part", out)


def folds(df: DataFrame, label: str, key: str, k: int, seed: str) -> DataFrame:
    """df with fold 0..k-1, dealt in turn within each label by md5 order, null keys last.

    A row's place is its place among the rows of its label whose md5 begins with the same three digits,
    after all rows whose digits are smaller: 4,096 groups and one for null keys, so no label's rows meet in one task.
    """
    order = md5_order(F.col(key), seed)
    bucket = F.coalesce(F.conv(F.substring(order, 1, 3), 16, 10).cast("int"), F.lit(1 << 12))
    up_to = Window.partitionBy("fold_bucket", label).orderBy("fold_order", key).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumns({"fold_bucket": bucket, "fold_order": F.unhex(order)}).withColumn("fold_in", F.count("*").over(up_to)).drop("fold_order").persist()  # kept on first use: catalog.clearCache() lets go
    before = F.sum("n").over(Window.partitionBy("fold_label").orderBy("fold_at").rowsBetween(Window.unboundedPreceding, -1))
    start = rows.groupBy(F.col("fold_bucket").alias("fold_at"), F.col(label).alias("fold_label")).agg(F.count("*").alias("n")).select("fold_at", "fold_label", F.coalesce(before, F.lit(0)).alias("fold_before"))
    at = rows.join(F.broadcast(start), (F.col("fold_bucket") == F.col("fold_at")) & F.col(label).eqNullSafe(F.col("fold_label")))  # up to 4,097 rows for each label
    return at.select(*df.columns, ((F.col("fold_before") + F.col("fold_in") - 1) % k).cast("int").alias("fold"))


def leaked_keys(df: DataFrame, key: str, role_col: str) -> DataFrame:
    """Keys that stand in more than one role."""
    return df.groupBy(key).agg(F.count_distinct(role_col).alias("roles")).where("roles > 1")
