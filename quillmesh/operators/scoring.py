"""Regression and ranking metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arith import ratio
from .ranks import running


def regression_metrics(actual: Column, predicted: Column, digits: int = 6) -> list[Column]:
    """rmsle in log space, rmse, mae, r2 and bias, as aggregate columns."""
    gap = predicted - actual
    log_gap = F.log1p(F.greatest(predicted, F.lit(0.0))) - F.log1p(actual)
    r2 = 1 - F.sum(gap * gap) / F.nullif(F.var_pop(actual) * F.count("*"), F.lit(0.0))
    found = {"rmsle": F.sqrt(F.avg(log_gap * log_gap)), "rmse": F.sqrt(F.avg(gap * gap)), "mae": F.avg(F.abs(gap)), "r2": r2, "bias": F.avg(gap)}
    return [F.round(c, digits).alias(n) for n, c in found.items()]


def shape(gap: Column, actual: Column, digits: int = 6) -> list[Column]:
    """Population skewness and excess kurtosis of the gaps, bias, and mean absolute percentage error."""
    return [F.round(c, digits).alias(n) for n, c in {"skewness": F.skewness(gap), "kurtosis": F.kurtosis(gap), "bias": F.avg(gap), "mape": F.avg(F.abs(gap) / actual) * 100}.items()]


def confusion(label: Column, flagged: Column, rows: str | None = None) -> list[Column]:
    """tn, fp, fn, tp as aggregates. rows: the column that says for how many rows each one stands."""
    count = (lambda x: F.count_if(x)) if rows is None else (lambda x: F.coalesce(F.sum(F.when(x, F.col(rows))), F.lit(0).cast("long")))
    return [count((label == a) & (flagged.cast("int") == b)).alias(n) for n, a, b in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))]


def rates(df: DataFrame, digits: int = 6) -> DataFrame:
    """accuracy, precision, recall and f1 from the four counts; nothing over nothing is 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return df.withColumns({"accuracy": F.round(ratio(tp + tn, tp + tn + fp + fn, 0.0), digits), "precision": F.round(ratio(tp, tp + fp, 0.0), digits), "recall": F.round(ratio(tp, tp + fn, 0.0), digits), "f1": F.round(ratio(2 * tp, 2 * tp + fp + fn, 0.0), digits)})


def cutoffs(df: DataFrame, score: str, label: str, rows: str | None = None) -> DataFrame:
    """One row for each distinct score as cutoff: tp and fp at or above it, with precision, recall, fpr and f1; hit and miss are the rows at the score itself, p and q all rows.

    Scores are grouped first, and the running sums go by ranges of scores, none in one task. rows: the
    column that says for how many rows each one stands.
    """
    n = F.lit(1) if rows is None else F.col(rows)
    each = df.groupBy(score).agg(F.sum(n * F.col(label)).alias("hit"), F.sum(n * (1 - F.col(label))).alias("miss"))
    out = running(each, F.struct(-F.col(score)), {"tp": F.col("hit"), "fp": F.col("miss")}, totals=True).withColumnsRenamed({"tp_all": "p", "fp_all": "q"})
    tp, fp = F.col("tp"), F.col("fp")
    return out.select(score, "tp", "fp", "hit", "miss", "p", "q", ratio(tp, tp + fp, 0.0).alias("precision"), ratio(tp, F.col("p"), 0.0).alias("recall"), ratio(fp, F.col("q"), 0.0).alias("fpr"), ratio(2 * tp, tp + fp + F.col("p"), 0.0).alias("f1"))


def thinned(df: DataFrame, order: Column, points: int) -> DataFrame:
    """At most points rows of a curve, evenly spaced by place in the order, the first and the last among them."""
    at = running(df, order, {"place_": F.lit(1)}, totals=True).withColumnRenamed("place__all", "rows_")
    step = (F.col("rows_") - 1) / F.lit(max(1, points - 1))
    nearest = F.round((F.col("place_") - 1) / step)  # the point that this place is closest to
    mine = F.floor(nearest * step + 0.5) == F.col("place_") - 1
    return at.where((F.col("rows_") <= points) | mine).drop("place_", "rows_")


def roc_auc(df: DataFrame, score: str, label: str, rows: str | None = None) -> DataFrame:
    """Area under the ROC curve, exact with ties, by trapezoids between distinct scores."""
    step = ratio(F.col("miss"), F.col("q"), 0.0)
    return cutoffs(df, score, label, rows).select((step * (F.col("recall") - ratio(F.col("hit"), F.col("p"), 0.0) / 2)).alias("a")).agg(F.round(F.sum("a"), 6).alias("auc"))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """Sum over cutoffs of the gain in recall times the precision."""
    gain = ratio(F.col("hit"), F.col("p"), 0.0) * F.col("precision")
    return cutoffs(df, score, label).select(gain.alias("a")).agg(F.round(F.sum("a"), 6).alias("average_precision"))


def importances(weights: DataFrame, by: str = "model") -> DataFrame:
    """(by, feature, importance, share_pct, place) from (by, feature, weight): absolute weights of a feature's encoded columns summed up, largest first. Models and features are few."""
    g = weights.groupBy(by, "feature").agg(F.sum(F.abs("weight")).alias("importance"))
    whole = F.sum("importance").over(Window.partitionBy(by))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.round("importance", 9)), "feature"))
    return g.select(by, "feature", F.round("importance", 6).alias("importance"), F.round(ratio(F.col("importance"), whole, 0.0) * 100, 4).alias("share_pct"), place.alias("place"))


def agreement(ranked: DataFrame, models: list[str], top: int, by: str = "model") -> DataFrame:
    """(feature, a column for each model, in_top): the places within the top of each model, null outside, and how many models have the feature there."""
    wide = ranked.where(F.col("place") <= top).groupBy("feature").pivot(by, models).agg(F.first("place"))
    return wide.withColumn("in_top", sum(F.col(m).isNotNull().cast("int") for m in models))
