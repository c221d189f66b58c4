"""Fitted models under evaluation, the gated search, and power transforms."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning, scoring
from ..operators import models as ops
from ..operators import trips as trip_ops
from . import customers, labelled, trips
from .registry import query


def prepare(train: DataFrame, *numbers: str):
    """Categories of counted rows, and numbers after them, to places of a vector; a value that the training rows don't hold is all zeros."""
    f = labelled.FEATURES
    index = [StringIndexerModel.from_labels(values, inputCol=c, outputCol=f"{c}_i", handleInvalid="keep") for c, values in zip(f, ops.by_frequency(train, list(f)), strict=True)]
    return Pipeline(stages=[*index, OneHotEncoder(inputCols=[f"{c}_i" for c in f], outputCols=[f"{c}_v" for c in f]), VectorAssembler(inputCols=[*[f"{c}_v" for c in f], *numbers], outputCol="features")]).fit(train)


def fold_models() -> dict:
    return {"logistic": LogisticRegression(maxIter=20), "tree": DecisionTreeClassifier(maxDepth=5, seed=1), "forest": RandomForestClassifier(numTrees=10, maxDepth=5, seed=1)}


@query()
def model_cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation over five stratified folds of five metrics, for three models fitted anew in each fold."""
    df = labelled.categories(spark, sf_dir).select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line"), "label", *labelled.FEATURES)
    return ops.cross_validation(ops.fold_counts(cleaning.folds(df, "label", "line", 5, "fold").drop("line"), "fold", 5, prepare, fold_models()), "rows_")


@query()
def model_tree_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaves of a decision tree as readable rules with support."""
    each = ops.counted(labelled.categories(spark, sf_dir).select("label", *labelled.FEATURES))
    ready = prepare(each)
    train = ready.transform(each)
    places = sorted((x for kind in train.schema["features"].metadata["ml_attr"]["attrs"].values() for x in kind), key=lambda x: x["idx"])
    model = DecisionTreeClassifier(maxDepth=4, seed=1, weightCol="rows_").fit(train)
    return ops.rule_table(spark, ops.tree_rules(model, [x["name"].replace("_v_", " is ") for x in places]))


@query()
def model_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest on all features, and on all but one of them: metrics on held-out orders. The number is cut into the bins that a forest sees of it, so equal rows are counted once, and their count is bounded."""
    forest = RandomForestClassifier(numTrees=10, maxDepth=5, seed=1)
    df = labelled.lines(spark, sf_dir).persist()  # the tables are joined once
    edges = ops.bin_edges(df.where("part > 0"), "qty", forest.getMaxBins())
    each = ops.counted(ops.binned(df.select("label", *labelled.FEATURES, (F.col("part") == 0).alias("held"), "qty"), "qty", edges))
    df.unpersist()
    train, test = each.where("NOT held"), each.where("held")
    ready = prepare(train, "qty")
    a, b = ready.transform(train), ready.transform(test)
    names = labelled.sources(a)
    every = sorted(set(names))
    subsets = {"all": every} | {f"without {f}": [x for x in every if x != f] for f in every}
    return ops.ablations(a, b, names, subsets, forest, counted=True)


def trip_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips.featured(spark, sf_dir).withColumn("y", F.log1p("trip_duration")).select("id", "split", "y", *trip_ops.FEATURES)


def boosted(spark: SparkSession, sf_dir: str):
    df = VectorAssembler(inputCols=trip_ops.FEATURES, outputCol="features").transform(trip_rows(spark, sf_dir)).withColumn("stop", F.col("split") == "calibration").select("features", "y", "split", "stop")
    seen = df.where("split IN ('fit', 'calibration')").persist()
    return GBTRegressor(labelCol="y", maxIter=20, maxDepth=4, stepSize=0.2, validationIndicatorCol="stop", seed=1).fit(seen), seen


@query()
def model_learning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared loss of the boosted trip model after each tree, on the rows that it learns from and on those that stop it."""
    model, seen = boosted(spark, sf_dir)
    as_label = lambda r: seen.where(F.col("split") == r).withColumnRenamed("y", "label")
    out = ops.learning_curve(model.setFeaturesCol("features").copy({model.labelCol: "label"}), {"fit": as_label("fit"), "stop": as_label("calibration")})
    seen.unpersist()
    return out


@query()
def model_trip_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of each trip feature in the boosted model, in percent, largest first."""
    model, seen = boosted(spark, sf_dir)
    seen.unpersist()
    rows = [("boosted", f, float(x)) for f, x in zip(trip_ops.FEATURES, model.featureImportances.toArray(), strict=True)]
    return scoring.importances(spark.createDataFrame(rows, "model string, feature string, weight double"))


@query()
def model_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trials of the gated search on trips: three backbones, six features, three settings, two blends."""
    ridge = lambda p: LinearRegression(solver="normal", **{"regParam": 1e-4, **p})
    tree = lambda depth: lambda p: GBTRegressor(**{"maxIter": 5, "maxDepth": depth, "stepSize": 0.3, "seed": 1, **p})
    overrides = {"less_penalty": {"regParam": 0.0}, "more_penalty": {"regParam": 0.01}, "no_intercept": {"fitIntercept": False}}
    return ops.gated_search(trip_rows(spark, sf_dir), trip_ops.FEATURES, {"ridge": ridge, "boosted": tree(3), "shallow": tree(1)}, "ridge", {}, trips.CANDIDATES, overrides, "boosted", [0.7, 0.5])


@query(f"""{trips.BAND.replace("WHERE split = 'validation')", "WHERE split IN ('validation', 'test'))")}, w AS (SELECT min(pickup_datetime) AS a, max(pickup_datetime) AS b FROM clean WHERE split = 'fit'),
s AS (SELECT *, greatest(60.0::double, predicted) AS seconds, greatest(60.0::double, predicted + low) AS low_s FROM banded), x AS (SELECT *, greatest(low_s, predicted + high) AS high_s, round_even(distance_manhattan_km / 1.609344 * 3.5, 2) AS distance_charge, round_even(seconds / 60.0 * 0.7, 2) AS time_charge, (least(dist_jfk_km, dist_lga_km) <= 2.0)::int * 1.75::double AS airport_fee, round_even(seconds, 0)::bigint AS secs FROM s)
SELECT id, tier, round(seconds, 5) AS seconds, round(low_s, 5)::double AS low_s, round(high_s, 5)::double AS high_s, (secs // 60)::varchar || 'm ' || lpad((secs % 60)::varchar, 2, '0') || 's' AS clock, round(distance_haversine_km, 6) AS distance_haversine_km, round(distance_haversine_km / 1.609344, 6) AS distance_haversine_mi, round(distance_manhattan_km / 1.609344, 6) AS miles, round(bearing_deg, 6) AS bearing_deg,
  round(distance_manhattan_km / (seconds / 3600.0), 6) AS speed_kmh, round(distance_manhattan_km / (seconds / 3600.0) / 1.609344, 6) AS speed_mph, NOT (pickup_datetime BETWEEN a AND b) AS extrapolated, round(distance_charge, 2) AS distance_charge, round(time_charge, 2) AS time_charge, airport_fee, round(3.0 + distance_charge + time_charge + is_rush_hour * 2.5 + is_late_night * 1.0 + 2.5 + airport_fee, 2)::double AS fare FROM x, w""")
def trips_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch scoring of the held-out trips: the prediction with its floor, band, distances, speed, fare and whether it lies outside the times learned from."""
    df = trips.featured(spark, sf_dir).withColumn("residual", F.col("trip_duration") - F.col("predicted"))
    band = trip_ops.residual_band(df.where("split = 'calibration'"), "tier", "residual")
    seen = df.where("split = 'fit'").agg(F.min("pickup_datetime").alias("a"), F.max("pickup_datetime").alias("b"))  # one row
    return trip_ops.scored(df.where("split IN ('validation', 'test')"), band, seen)


COLUMNS, GRID = ("income", "total_spend", "recency_days", "web_visits"), [round(-2 + 0.25 * i, 2) for i in range(17)]


def _power_sql() -> str:
    y = lambda x, p: f"CASE WHEN {x} >= 0 THEN CASE WHEN abs({p}) < 1e-12 THEN ln({x} + 1) ELSE (pow({x} + 1, {p}) - 1) / {p} END ELSE CASE WHEN abs({p} - 2) < 1e-12 THEN -ln(1 - {x}) ELSE -(pow(1 - {x}, 2 - {p}) - 1) / (2 - {p}) END END"
    return f"""WITH {customers.views.CUSTOMERS_SQL}, u AS (UNPIVOT (SELECT customer_id, {', '.join(f'{c}::double AS {c}' for c in COLUMNS)} FROM customers) ON {', '.join(COLUMNS)} INTO NAME col VALUE x),
    g(power) AS (SELECT unnest([{', '.join(map(str, GRID))}])::double), t AS (SELECT customer_id, col, power, x, {y('x', 'power')} AS y FROM u, g),
    l AS (SELECT col, power, CASE WHEN var_pop(y) > 0 THEN round(-count(*) / 2 * ln(var_pop(y)) + (power - 1) * sum(sign(x) * ln(1 + abs(x))), 6) END AS likelihood FROM t GROUP BY col, power),
    b AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY likelihood DESC NULLS LAST, power) = 1 AND likelihood IS NOT NULL AS best FROM l)"""


POWER = _power_sql()


@query(f"{POWER} SELECT col AS \"column\", power, round(likelihood, 2) AS likelihood, best FROM b")
def customers_power_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likelihood of each power of the grid, for four columns."""
    found = ops.power_likelihoods(customers.views.customers(spark, sf_dir), list(COLUMNS), GRID)
    return found.withColumn("likelihood", F.round("likelihood", 2))


@query(f"{POWER} SELECT t.col AS \"column\", t.power, count(*) AS n, round(avg(y) / nullif(stddev_pop(y), 0), 5) AS mean_in_deviations, round(min(y - m) / nullif(stddev_pop(y), 0), 5) AS lowest, round(max(y - m) / nullif(stddev_pop(y), 0), 5) AS highest FROM (SELECT t.*, avg(y) OVER (PARTITION BY t.col, t.power) AS m FROM t) t JOIN b ON b.col = t.col AND b.power = t.power AND best GROUP BY t.col, t.power")
def customers_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns by their best powers: where the transformed values lie, in deviations."""
    c = customers.views.customers(spark, sf_dir)
    best = {r["column"]: r["power"] for r in ops.power_likelihoods(c, list(COLUMNS), GRID).where("best").collect()}  # a number for each column
    long = c.select(*[ops.yeo_johnson(F.col(n).cast("double"), p).alias(n) for n, p in best.items()]).unpivot([], list(best), "column", "y").where("y IS NOT NULL")
    one = long.groupBy("column").agg(F.count("*").alias("n"), F.avg("y").alias("m"), F.stddev_pop("y").alias("s"), F.min("y").alias("a"), F.max("y").alias("b"))
    d = F.nullif("s", F.lit(0.0))
    power = F.create_map(*[F.lit(x) for n, p in best.items() for x in (n, float(p))])[F.col("column")]
    return one.select("column", power.alias("power"), "n", F.round(F.col("m") / d, 5).alias("mean_in_deviations"), F.round((F.col("a") - F.col("m")) / d, 5).alias("lowest"), F.round((F.col("b") - F.col("m")) / d, 5).alias("highest"))
