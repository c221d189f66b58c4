"""Retail lines: business events, revenue, cohorts, funnels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arith import normal_cdf, ratio


def flagged(df: DataFrame, adjustments: Column) -> DataFrame:
    """Adds what a line means; drops nothing. adjustments: whether its stock code is no product."""
    return df.withColumns({
        "is_credit_note": F.coalesce(F.startswith(F.upper("invoice"), F.lit("C")), F.lit(False)), "is_adjustment": F.coalesce(adjustments, F.lit(False)),
        "is_return": F.col("quantity") < 0, "is_product_line": ~F.coalesce(adjustments, F.lit(False)), "line_revenue": F.col("quantity") * F.col("price"),
    })


def events(lines: DataFrame) -> DataFrame:
    """One row: lines, credit notes, returns, adjustments, and the value returned."""
    return lines.agg(F.count("*").alias("rows"), F.count_if("is_credit_note").alias("credit_notes"), F.count_if("is_return").alias("return_lines"), F.count_if("is_adjustment").alias("adjustment_lines"), F.round(F.coalesce(F.sum(F.when(F.col("is_return"), F.col("line_revenue"))), F.lit(0.0)), 4).alias("returned_value"))


def population(lines: DataFrame) -> DataFrame:
    """Lines of known customers that sell a product."""
    return lines.where(F.col("customer_id").isNotNull() & F.col("is_product_line") & ~F.col("is_credit_note") & (F.col("quantity") > 0) & (F.col("price") > 0))


def daily_revenue(lines: DataFrame, days: int | None = None) -> DataFrame:
    """(date, net_revenue, gross_sales) of product lines, the last recorded days."""
    day = lines.where("is_product_line").groupBy(F.to_date("invoice_date").alias("date"))
    out = day.agg(F.sum("line_revenue").alias("net_revenue"), F.coalesce(F.sum(F.when(F.col("quantity") > 0, F.col("line_revenue"))), F.lit(0.0)).alias("gross_sales"))
    return out.orderBy(F.desc("date")).limit(days) if days else out


def month_number(t: Column) -> Column:
    return F.year(t) * 12 + F.month(t)


def cohorts(lines: DataFrame, customer: str, date: str) -> DataFrame:
    """(cohort, period, active, size, retention): the share of a first-month cohort that buys again so many months later, percent to one digit.

    Cells after the last recorded month aren't there; observable cells without activity are 0.
    """
    months = lines.select(customer, month_number(F.col(date)).alias("month")).distinct()
    months = months.withColumn("cohort", F.min("month").over(Window.partitionBy(customer)))
    active = months.groupBy("cohort", (F.col("month") - F.col("cohort")).alias("period")).agg(F.count("*").alias("active"))
    size = active.where("period = 0").select("cohort", F.col("active").alias("size"))
    last = months.agg(F.max("month").alias("last"))
    grid = size.crossJoin(F.broadcast(last)).select("cohort", "size", F.explode(F.sequence(F.lit(0), F.col("last") - F.col("cohort"))).alias("period"))  # last is one row
    out = grid.join(active, ["cohort", "period"], "left").withColumn("active", F.coalesce("active", F.lit(0).cast("long")))
    return out.withColumn("retention", F.round(F.col("active") / F.col("size") * 100, 1))


def cohort_matrix(long: DataFrame) -> DataFrame:
    """(cohort, p0, p1, ...): retention by period, a column for every period there is."""
    wide = long.groupBy("cohort").pivot("period").agg(F.max("retention"))
    return wide.select("cohort", *[F.col(f"`{c}`").alias(f"p{c}") for c in sorted((c for c in wide.columns if c != "cohort"), key=int)])


def funnel(df: DataFrame, user: str, stage: str, stages: list[str]) -> DataFrame:
    """(step, stage, users, share_of_top_pct, step_conversion_pct, step_dropoff_pct) over distinct users, in the order of the stages."""
    named = F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(s).alias("stage")) for i, s in enumerate(stages)])).alias("s")
    frame = df.sparkSession.range(1).select(named).select("s.*")
    users = frame.join(df.groupBy(F.col(stage).alias("stage")).agg(F.count_distinct(user).alias("users")), "stage", "left").withColumn("users", F.coalesce("users", F.lit(0).cast("long")))
    order = Window.orderBy("step")
    top, before = F.first("users").over(order), F.lag("users").over(order)
    pct = lambda a, b: F.round(ratio(a * 100.0, b), 6)
    return users.select("step", "stage", "users", pct(F.col("users"), top).alias("share_of_top_pct"), F.when(before.isNull(), 100.0).otherwise(pct(F.col("users"), before)).alias("step_conversion_pct"), F.when(before.isNull(), 0.0).otherwise(pct(before - F.col("users"), before)).alias("step_dropoff_pct"))


Z_95 = 1.959963984540054


def two_proportions(arms: DataFrame, practical_pp: float = 0.5) -> DataFrame:
    """From one row (n0, x0, n1, x1): pooled z-test, Wald interval, lifts, observed power, advice."""
    p0, p1 = F.col("x0") / F.col("n0"), F.col("x1") / F.col("n1")
    pooled = (F.col("x0") + F.col("x1")) / (F.col("n0") + F.col("n1"))
    se = F.sqrt(pooled * (1 - pooled) * (1 / F.col("n0") + 1 / F.col("n1")))
    out = arms.withColumns({"p0": p0, "p1": p1, "se": se, "se_diff": F.sqrt(p0 * (1 - p0) / F.col("n0") + p1 * (1 - p1) / F.col("n1"))})
    out = out.withColumn("z", F.when(F.col("se") == 0, 0.0).otherwise((F.col("p1") - F.col("p0")) / F.col("se")))
    lift = (F.col("p1") - F.col("p0")) * 100
    out = out.withColumns({"p_value": F.when(F.col("se") == 0, 1.0).otherwise(2 * (1 - normal_cdf(F.abs("z")))), "lift_pp": lift, "relative_pct": (F.col("p1") - F.col("p0")) / F.greatest(F.col("p0"), F.lit(1e-12)) * 100, "low_pp": lift - Z_95 * F.col("se_diff") * 100, "high_pp": lift + Z_95 * F.col("se_diff") * 100})
    effect = F.abs(F.col("p1") - F.col("p0")) / F.col("se_diff")
    out = out.withColumn("power", F.when(F.col("se_diff") > 0, normal_cdf(effect - Z_95) + normal_cdf(-effect - Z_95)).otherwise(0.0))
    few = lambda n, x: F.least(F.col(x), F.col(n) - F.col(x)) < 10
    advice = F.when(F.col("p_value") >= 0.05, "no evidence").when(F.col("lift_pp") < 0, "harmful").when(F.col("low_pp") >= practical_pp, "ship").otherwise("small")
    return out.withColumns({"advice": advice, "unreliable": few("n0", "x0") | few("n1", "x1")})


def centred_trend(series: DataFrame, order: str, value: str, period: int = 7) -> DataFrame:
    """Additive decomposition of a gap-free series of odd period: trend, seasonal, residual.

    The trend is the centred mean; where its window isn't whole it goes on along the least-squares
    line of the nearest period of trend values. The seasonal part is the mean detrended value of
    each place in the period, less their mean. A series is a few thousand days, so its one ordered window is small.
    """
    half = period // 2
    w = Window.orderBy(order)
    near = w.rowsBetween(-half, half)
    rows = series.withColumns({"pos": F.row_number().over(w) - 1, "n": F.count("*").over(near)})
    rows = rows.withColumn("mid", F.when(F.col("n") == period, F.avg(value).over(near))).drop("n")
    bounds = rows.agg(F.count("*").alias("total"))
    rows = rows.crossJoin(F.broadcast(bounds))  # one row
    low = (F.col("pos") >= half) & (F.col("pos") < half + period)
    high = (F.col("pos") <= F.col("total") - 1 - half) & (F.col("pos") > F.col("total") - 1 - half - period)
    line = lambda where, n: [F.regr_slope(F.when(where, F.col("mid")), F.when(where, F.col("pos"))).alias(f"{n}_slope"), F.regr_intercept(F.when(where, F.col("mid")), F.when(where, F.col("pos"))).alias(f"{n}_at")]
    rows = rows.crossJoin(F.broadcast(rows.agg(*line(low, "low"), *line(high, "high"))))  # one row
    edge = F.when(F.col("pos") < half, F.col("low_at") + F.col("low_slope") * F.col("pos")).otherwise(F.col("high_at") + F.col("high_slope") * F.col("pos"))
    rows = rows.withColumn("trend", F.coalesce("mid", edge)).withColumn("place", F.col("pos") % period)
    part = rows.groupBy("place").agg(F.avg(F.col(value) - F.col("trend")).alias("part"))
    part = part.withColumn("seasonal", F.col("part") - F.avg("part").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return rows.join(part.select("place", "seasonal"), "place").withColumn("residual", F.col(value) - F.col("trend") - F.col("seasonal")).select(order, value, "trend", "seasonal", "residual")


def calendar(series: DataFrame, date: str, values: list[str]) -> DataFrame:
    """Every day from the first to the last, 0 where the series has none."""
    days = series.agg(F.explode(F.sequence(F.min(date), F.max(date))).alias(date))
    return days.join(series, date, "left").select(date, *[F.coalesce(v, F.lit(0.0)).alias(v) for v in values])


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
