"""Trips: cleaning, splits, features, fares, bands and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo
from ..functions.arith import normal_cdf, normal_cdf_sql
from ..operators import cleaning, histograms, scoring
from ..operators import trips as ops
from ..plans import views
from .registry import query

SALT = "trips/split-v1"


def _gc(a: str, b: str, c: str, d: str) -> str:
    up, over = f"sin((radians({c}) - radians({a})) / 2)", f"sin((radians({d}) - radians({b})) / 2)"
    return f"(asin(sqrt(least(1.0, greatest(0.0, {up} * {up} + cos(radians({a})) * cos(radians({c})) * {over} * {over})))) * (2 * {geo.EARTH_KM}))"


P, D = ("pickup_latitude", "pickup_longitude"), ("dropoff_latitude", "dropoff_longitude")
GC = _gc(*P, *D)
BLOCK = f"({_gc(*P, P[0], D[1])} + {_gc(*P, D[0], P[1])})"
BEARING = """(((degrees(atan2(sin(radians(dropoff_longitude) - radians(pickup_longitude)) * cos(radians(dropoff_latitude)),
  cos(radians(pickup_latitude)) * sin(radians(dropoff_latitude)) - sin(radians(pickup_latitude)) * cos(radians(dropoff_latitude)) * cos(radians(dropoff_longitude) - radians(pickup_longitude)))) + 360.0) % 360.0))"""
HUBS = {k: f"least({_gc(*P, str(la), str(lo))}, {_gc(*D, str(la), str(lo))})" for k, la, lo in geo.HUBS}
IN = lambda lat, lon: f"({lat} BETWEEN {geo.BOX[0]} AND {geo.BOX[1]} AND {lon} BETWEEN {geo.BOX[2]} AND {geo.BOX[3]})"
FAILED = f"""CASE WHEN NOT (trip_duration BETWEEN 60 AND 10800) THEN 0 WHEN NOT {IN(*P)} THEN 1 WHEN NOT {IN(*D)} THEN 2
  WHEN NOT (passenger_count BETWEEN 1 AND 6) THEN 3 WHEN NOT ({GC} / (trip_duration / 3600.0::double) <= 120.0) THEN 4 END"""
BUCKET = f"(('0x' || substr(md5('{SALT}|' || id::varchar), 1, 8))::bigint % 1000)"
ROLE = f"CASE WHEN {BUCKET} < 650 THEN 'fit' WHEN {BUCKET} < 700 THEN 'calibration' WHEN {BUCKET} < 850 THEN 'validation' ELSE 'test' END"
WITH = "WITH " + views.TRIPS_SQL
CLEAN = f"{WITH}, clean AS (SELECT *, {ROLE} AS split FROM trips WHERE ({FAILED}) IS NULL)"
TIER = f"CASE WHEN least({HUBS['jfk']}, {HUBS['lga']}, {HUBS['ewr']}) <= 2.0 THEN 'airport' WHEN {GC} < 2.0 THEN 'short' WHEN {GC} < 5.0 THEN 'commute' ELSE 'cross_borough' END"
FEATURED = f"""{CLEAN}, feats AS (SELECT *, {GC} AS distance_haversine_km, {BLOCK} AS distance_manhattan_km, {BEARING} AS bearing_deg, hour(pickup_datetime)::int AS hour,
  ((isodow(pickup_datetime) - 1))::int AS day_of_week, month(pickup_datetime)::int AS month, {", ".join(f"{v} AS dist_{k}_km" for k, v in HUBS.items())}, {TIER} AS tier FROM clean),
f AS (SELECT *, (day_of_week >= 5)::int AS is_weekend, (day_of_week < 5 AND hour IN (7, 8, 9, 16, 17, 18, 19))::int AS is_rush_hour, (hour <= 5)::int AS is_late_night,
  600 + 60.0 * distance_manhattan_km AS predicted FROM feats)"""


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = cleaning.survivors(views.trips(spark, sf_dir), ops.rules())
    return kept.withColumn("split", cleaning.role(cleaning.md5_bucket(F.col("id"), SALT), ops.ROLES))


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean trips with features, tier, and a formula's prediction (seconds)."""
    df = ops.with_features(clean(spark, sf_dir))
    return df.withColumns({"tier": ops.tier(), "predicted": 600 + 60.0 * F.col("distance_manhattan_km")})


@query(f"""{WITH}, c AS (SELECT {FAILED} AS step FROM trips), r AS (SELECT * FROM (VALUES (0, 'duration_bounds'), (1, 'pickup_in_box'), (2, 'dropoff_in_box'), (3, 'passenger_count_range'), (4, 'implied_speed')) v(step, rule)),
n AS (SELECT r.step, rule, count(c.step) AS removed FROM r LEFT JOIN c ON r.step = c.step GROUP BY ALL)
SELECT step, rule, before, removed, before - removed AS after FROM (SELECT step, rule, removed, ((SELECT count(*) FROM c) - coalesce(sum(removed) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::bigint AS before FROM n)""")
def trips_cleaning_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.ledger(views.trips(spark, sf_dir), ops.rules())


@query(f"{CLEAN} SELECT id, split, {BUCKET}::int AS bucket FROM clean")
def trips_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(spark, sf_dir).select("id", "split", cleaning.md5_bucket(F.col("id"), SALT).alias("bucket"))


@query(f"{CLEAN} SELECT split, count(*) AS n, min(pickup_datetime) AS first_pickup, max(pickup_datetime) AS last_pickup FROM clean GROUP BY split")
def trips_split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n"), F.min("pickup_datetime").alias("first_pickup"), F.max("pickup_datetime").alias("last_pickup"))


@query(f"{CLEAN} SELECT count(*) AS shared_ids FROM (SELECT id FROM clean GROUP BY id HAVING count(DISTINCT split) > 1)")
def trips_split_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.leaked_keys(clean(spark, sf_dir), "id", "split").agg(F.count("*").alias("shared_ids"))


@query(f"{FEATURED} SELECT id, {', '.join(f'round({c}, 6) AS {c}' if 'km' in c or 'deg' in c or 'tude' in c else c for c in ops.FEATURES)} FROM f")
def trips_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = featured(spark, sf_dir)
    return df.select("id", *[F.round(c, 6).alias(c) if "km" in c or "deg" in c or "tude" in c else F.col(c) for c in ops.FEATURES])


@query(f"{FEATURED} SELECT tier, count(*) AS n, round(avg(distance_haversine_km), 6) AS mean_km, round(avg(predicted), 6) AS mean_predicted FROM f GROUP BY tier")
def trips_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return featured(spark, sf_dir).groupBy("tier").agg(F.count("*").alias("n"), F.round(F.avg("distance_haversine_km"), 6).alias("mean_km"), F.round(F.avg("predicted"), 6).alias("mean_predicted"))


@query(f"""{FEATURED}, x AS (SELECT *, round_even(distance_manhattan_km / 1.609344 * 3.5, 2) AS distance_charge, round_even(predicted / 60.0 * 0.7, 2) AS time_charge,
  (least(dist_jfk_km, dist_lga_km) <= 2.0)::int * 1.75::double AS airport_fee, round_even(predicted, 0)::bigint AS secs FROM f)
SELECT id, round(distance_charge, 2) AS distance_charge, round(time_charge, 2) AS time_charge, airport_fee, round(3.0 + distance_charge + time_charge + is_rush_hour * 2.5 + is_late_night * 1.0 + 2.5 + airport_fee, 2)::double AS fare,
  round(distance_manhattan_km / 1.609344, 6) AS miles, round(distance_manhattan_km / (predicted / 3600.0), 6) AS speed_kmh, (secs // 60)::varchar || 'm ' || lpad((secs % 60)::varchar, 2, '0') || 's' AS clock FROM x""")
def trips_fares(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ops.with_fare(featured(spark, sf_dir), F.col("predicted"))
    return df.select("id", "distance_charge", "time_charge", "airport_fee", "fare", F.round("miles", 6).alias("miles"), F.round("speed_kmh", 6).alias("speed_kmh"), "clock")


BAND = f"""{FEATURED}, cal AS (SELECT *, trip_duration - predicted AS residual FROM f WHERE split = 'calibration'),
own AS (SELECT tier, quantile_cont(residual, 0.05) AS low, quantile_cont(residual, 0.95) AS high FROM cal GROUP BY tier HAVING count(*) >= 200),
overall AS (SELECT quantile_cont(residual, 0.05) AS low, quantile_cont(residual, 0.95) AS high FROM cal),
banded AS (SELECT f.*, coalesce(own.low, overall.low) AS low, coalesce(own.high, overall.high) AS high FROM f LEFT JOIN own USING (tier), overall WHERE split = 'validation')"""


def banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = featured(spark, sf_dir).withColumn("residual", F.col("trip_duration") - F.col("predicted"))
    band = ops.residual_band(df.where("split = 'calibration'"), "tier", "residual")
    return ops.with_band(df.where("split = 'validation'"), band, "tier")


@query(f"{BAND} SELECT id, tier, round(greatest(60, predicted + low), 6)::double AS low_s, round(greatest(60, predicted + high), 6)::double AS high_s FROM banded")
def trips_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge = lambda c: F.round(F.greatest(F.lit(60.0), F.col("predicted") + F.col(c)), 6).alias(f"{c}_s")
    return banded(spark, sf_dir).select("id", "tier", edge("low"), edge("high"))


@query(f"{BAND}, i AS (SELECT tier, (trip_duration - predicted BETWEEN low AND high)::int AS inside FROM banded) SELECT coalesce(tier, 'all') AS tier, count(*) AS n, round(avg(inside), 6) AS coverage FROM i GROUP BY ROLLUP (tier)")
def trips_band_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = banded(spark, sf_dir).withColumn("inside", F.col("residual").between(F.col("low"), F.col("high")).cast("int"))
    return df.rollup("tier").agg(F.count("*").alias("n"), F.round(F.avg("inside"), 6).alias("coverage")).withColumn("tier", F.coalesce("tier", F.lit("all")))


M = "predicted - trip_duration"
METRICS = f"""round(sqrt(avg((ln(1 + greatest(predicted, 0)) - ln(1 + trip_duration)) ^ 2)), 6) AS rmsle, round(sqrt(avg(({M}) ^ 2)), 6) AS rmse, round(avg(abs({M})), 6) AS mae,
  round(1 - sum(({M}) ^ 2) / nullif(var_pop(trip_duration) * count(*), 0), 6) AS r2, round(avg({M}), 6) AS bias"""


@query(f"{FEATURED} SELECT tier, count(*) AS n, {METRICS} FROM f WHERE split = 'validation' GROUP BY tier HAVING count(*) >= 2")
def trips_tier_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = featured(spark, sf_dir).where("split = 'validation'").groupBy("tier")
    return df.agg(F.count("*").alias("n"), *scoring.regression_metrics(F.col("trip_duration"), F.col("predicted"))).where("n >= 2")


@query(f"""{FEATURED}, m AS (SELECT median(trip_duration)::double AS mid FROM f WHERE split = 'fit'), b AS (SELECT trip_duration, mid AS predicted FROM f, m WHERE split = 'validation'),
l AS (SELECT trip_duration, exp(0.7 * ln(1 + f.predicted) + 0.3 * ln(1 + mid)) - 1 AS predicted FROM f, m WHERE split = 'validation')
SELECT 'median' AS model, {METRICS} FROM b UNION ALL SELECT 'blend', {METRICS} FROM l""")
def trips_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = featured(spark, sf_dir)
    mid = df.where("split = 'fit'").agg(F.median("trip_duration").alias("mid"))
    rows = df.where("split = 'validation'").crossJoin(F.broadcast(mid))  # mid is one row
    blend = F.expm1(0.7 * F.log1p("predicted") + 0.3 * F.log1p("mid"))
    metrics = lambda p, name: rows.agg(*scoring.regression_metrics(F.col("trip_duration"), p)).select(F.lit(name).alias("model"), "*")
    return metrics(F.col("mid"), "median").unionByName(metrics(blend, "blend"))


@query(f"""{FEATURED}, g AS (SELECT {M} AS g, trip_duration FROM f WHERE split = 'validation'), m AS (SELECT avg(g) AS m, stddev_pop(g) AS s FROM g)
SELECT round(avg(((g - m) / s) ^ 3), 6) AS skewness, round(avg(((g - m) / s) ^ 4) - 3, 6) AS kurtosis, round(avg(g), 6) AS bias, round(avg(abs(g) / trip_duration) * 100, 6) AS mape FROM g, m""")
def trips_residual_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return featured(spark, sf_dir).where("split = 'validation'").agg(*scoring.shape(F.col("predicted") - F.col("trip_duration"), F.col("trip_duration")))


NUMERIC = ("distance_haversine_km", "distance_manhattan_km", "bearing_deg", "hour", "day_of_week", "month", "is_weekend", "is_rush_hour", "is_late_night", "passenger_count", "vendor_id")
T_Z = "abs(r) * sqrt((n - 2) / nullif(1 - r * r, 0))"


@query(f"""{FEATURED}, c AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, CASE WHEN stddev_pop({c}) > 0 THEN corr({c}, trip_duration) END AS r, count(*) AS n FROM f" for c in NUMERIC)}), z AS (SELECT *, {T_Z} AS z FROM c)
SELECT feature, round(r, 6) AS r, round(2 * (1 - {normal_cdf_sql("z")}), 6) AS p_value, CASE WHEN r IS NULL THEN 'undefined' WHEN abs(r) >= 0.5 THEN 'strong' WHEN abs(r) >= 0.3 THEN 'moderate' WHEN abs(r) >= 0.1 THEN 'weak' ELSE 'negligible' END AS signal FROM z""")
def trips_feature_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = featured(spark, sf_dir)
    one = df.agg(F.count("*").alias("n"), *[F.when(F.stddev_pop(c) > 0, F.corr(F.col(c).cast("double"), F.col("trip_duration").cast("double"))).alias(c) for c in NUMERIC])
    long = one.unpivot(["n"], list(NUMERIC), "feature", "r")
    r, n = F.col("r"), F.col("n")
    z = F.abs(r) * F.sqrt((n - 2) / F.nullif(1 - r * r, F.lit(0.0)))
    band = F.when(r.isNull(), "undefined").when(F.abs(r) >= 0.5, "strong").when(F.abs(r) >= 0.3, "moderate").when(F.abs(r) >= 0.1, "weak").otherwise("negligible")
    return long.select("feature", F.round(r, 6).alias("r"), F.round(2 * (1 - normal_cdf(z)), 6).alias("p_value"), band.alias("signal"))


@query(f"""{FEATURED}, c AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, CASE WHEN stddev_pop({c}) > 0 THEN corr({c}, trip_duration) END AS r FROM f" for c in NUMERIC)}), t AS (SELECT feature, round(r, 6) AS r, sum(abs(r)) OVER () AS whole, abs(r) AS size FROM c WHERE r IS NOT NULL)
SELECT feature, r, round(size / whole * 100, 3) AS share_pct FROM t ORDER BY abs(r) DESC, feature LIMIT 5""")
def trips_top_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five features with the largest correlation by absolute value, and their share of all; a row for each feature is ranked."""
    df = featured(spark, sf_dir)
    one = df.agg(*[F.when(F.stddev_pop(c) > 0, F.corr(F.col(c).cast("double"), F.col("trip_duration").cast("double"))).alias(c) for c in NUMERIC])
    long = one.withColumn("one", F.lit(1)).unpivot(["one"], list(NUMERIC), "feature", "r").where("r IS NOT NULL")
    share = F.abs("r") / F.sum(F.abs("r")).over(Window.partitionBy("one")) * 100
    return long.select("feature", F.round("r", 6).alias("r"), F.round(share, 3).alias("share_pct")).orderBy(F.abs("r").desc(), "feature").limit(5)


@query(f"""{WITH}, h AS (SELECT CASE WHEN trip_duration < 0 THEN -1 WHEN trip_duration > 12000 THEN 40 ELSE least(floor(trip_duration / 300.0), 39) END::bigint AS bin, count(*) AS n FROM trips GROUP BY 1)
SELECT g.bin, coalesce(h.n, 0) AS n FROM (SELECT unnest(range(-1, 41)) AS bin) g LEFT JOIN h USING (bin)""")
def trips_duration_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms.fixed_range(views.trips(spark, sf_dir), "trip_duration", 0.0, 12000.0, 40)


@query(f"""{WITH}, c AS (SELECT hour(pickup_datetime)::bigint AS hour, isodow(pickup_datetime) <= 5 AS weekday, count(*) AS n FROM trips GROUP BY ALL)
SELECT g.hour, w.weekday, coalesce(c.n, 0) AS n FROM (SELECT unnest(range(24)) AS hour) g CROSS JOIN (VALUES (true), (false)) w(weekday) LEFT JOIN c ON c.hour = g.hour AND c.weekday = w.weekday""")
def trips_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = views.trips(spark, sf_dir).groupBy(F.hour("pickup_datetime").cast("long").alias("hour"), (F.weekday("pickup_datetime") < 5).alias("weekday")).agg(F.count("*").alias("n"))
    grid = spark.range(24).select(F.col("id").alias("hour"), F.explode(F.array(F.lit(True), F.lit(False))).alias("weekday"))
    return histograms.dense(grid, counts, ["hour", "weekday"], ["n"])


@query(f"""{WITH}, v AS (SELECT id, 'passenger_count' AS field, 'out of range' AS reason FROM trips WHERE NOT passenger_count BETWEEN 1 AND 6 UNION ALL SELECT id, 'pickup', 'outside the area' FROM trips WHERE NOT {IN(*P)}
UNION ALL SELECT id, 'dropoff', 'outside the area' FROM trips WHERE NOT {IN(*D)}), n AS (SELECT *, row_number() OVER (PARTITION BY field, reason ORDER BY id) AS k FROM v)
SELECT field, reason, count(*) AS rows, list_sort(list(id) FILTER (WHERE k <= 10)) AS shown FROM n GROUP BY field, reason""")
def trips_request_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.first_violations(cleaning.violations(views.trips(spark, sf_dir), "id", ops.request_checks()), "id")


@query(f"""{CLEAN}, r AS (SELECT min(pickup_datetime) AS a, max(pickup_datetime) AS b FROM clean WHERE split = 'fit') SELECT id, NOT (pickup_datetime BETWEEN a AND b) AS extrapolated FROM clean, r WHERE split = 'test'""")
def trips_extrapolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = clean(spark, sf_dir)
    seen = df.where("split = 'fit'").agg(F.min("pickup_datetime").alias("a"), F.max("pickup_datetime").alias("b"))  # one row
    return df.where("split = 'test'").crossJoin(F.broadcast(seen)).select("id", (~F.col("pickup_datetime").between(F.col("a"), F.col("b"))).alias("extrapolated"))


#: Feature expressions as text, as a user would hand them in.
CANDIDATES = {"hour_sin": "round(sin(2 * pi() * hour / 24), 6) + 0.0", "hour_cos": "round(cos(2 * pi() * hour / 24), 6) + 0.0", "tortuosity": "round(distance_manhattan_km / (distance_haversine_km + 0.1), 6)", "log_distance": "round(ln(1 + distance_haversine_km), 6)", "rush_distance": "round(is_rush_hour * distance_haversine_km, 6)", "night_distance": "round(is_late_night * distance_haversine_km, 6)"}


@query(f"{FEATURED} SELECT id, {', '.join(f'{e} AS {n}' for n, e in CANDIDATES.items())} FROM f")
def trips_candidate_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return featured(spark, sf_dir).select("id", *[F.expr(e).alias(n) for n, e in CANDIDATES.items()])


@query(f"{WITH} SELECT id, h.key AS hub FROM trips JOIN (VALUES {', '.join(f'({k!r}, {la}, {lo})' for k, la, lo in geo.HUBS)}) h(key, lat, lon) ON abs(pickup_latitude - lat) <= 0.01 AND abs(pickup_longitude - lon) <= 0.01")
def trips_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    hubs = F.array(*[F.struct(F.lit(k).alias("hub"), F.lit(la).alias("lat"), F.lit(lo).alias("lon")) for k, la, lo in geo.HUBS])
    near = F.filter(hubs, lambda h: (F.abs(F.col("pickup_latitude") - h["lat"]) <= 0.01) & (F.abs(F.col("pickup_longitude") - h["lon"]) <= 0.01))
    return views.trips(spark, sf_dir).select("id", F.explode(F.transform(near, lambda h: h["hub"])).alias("hub"))


@query(f"{WITH}, s AS (SELECT id, pickup_datetime FROM trips ORDER BY md5('head|' || id::varchar), id LIMIT 500) SELECT id, date_trunc('minute', pickup_datetime) AS minute, pickup_datetime::date AS day, (year(pickup_datetime) * 12 + month(pickup_datetime))::int AS month_no FROM s")
def trips_sampled_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample of exactly 500 rows, with times put together again from date and time of day."""
    s = cleaning.exact_sample(views.trips(spark, sf_dir).select("id", "pickup_datetime"), "id", 500, "head")
    t = F.to_timestamp(F.concat_ws(" ", F.date_format("pickup_datetime", "yyyy-MM-dd"), F.date_format("pickup_datetime", "HH:mm")), "yyyy-MM-dd HH:mm")
    return s.select("id", t.alias("minute"), F.to_date("pickup_datetime").alias("day"), (F.year("pickup_datetime") * 12 + F.month("pickup_datetime")).alias("month_no"))
