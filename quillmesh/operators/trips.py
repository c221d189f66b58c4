"""Trip features, fares, prediction bands and tier diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.arith import clock_text
from .cleaning import Rule

# Bounds of the cleaning rules, hours, split and fare card.
DURATION, PASSENGERS, SPEED_KMH = (60, 3 * 3600), (1, 6), 120.0
RUSH, NIGHT = (7, 8, 9, 16, 17, 18, 19), (0, 1, 2, 3, 4, 5)
ROLES = [("fit", 0, 650), ("calibration", 650, 700), ("validation", 700, 850), ("test", 850, 1000)]
BASE_FARE, PER_MILE, PER_MINUTE, RUSH_FEE, NIGHT_FEE, CONGESTION_FEE, AIRPORT_FEE, KM_PER_MILE = 3.0, 3.5, 0.7, 2.5, 1.0, 2.5, 1.75, 1.609344

FLOOR = 60.0  # seconds
PLACES = ("pickup_latitude", "pickup_longitude", "dropoff_latitude", "dropoff_longitude")


def ends() -> list[Column]:
    return [F.col(c) for c in PLACES]


def rules() -> list[Rule]:
    """Duration, both ends in the box, passengers, and no faster than a car."""
    hours = F.col("trip_duration") / 3600.0
    return [
        ("duration_bounds", "between a minute and three hours", F.col("trip_duration").between(*DURATION)),
        ("pickup_in_box", "start in the service area", geo.in_box(*ends()[:2])),
        ("dropoff_in_box", "end in the service area", geo.in_box(*ends()[2:])),
        ("passenger_count_range", "one to six passengers", F.col("passenger_count").between(*PASSENGERS)),
        ("implied_speed", "at most 120 km/h as the crow flies", geo.great_circle(*ends()) / hours <= SPEED_KMH),
    ]


def request_checks() -> list[tuple[str, str, Column]]:
    """What keeps a row from being scored."""
    checks = [(c, "missing", F.col(c).isNull()) for c in ("pickup_datetime", "passenger_count", *PLACES)]
    checks.append(("passenger_count", "out of range", ~F.col("passenger_count").between(*PASSENGERS)))
    checks.append(("pickup", "outside the area", ~geo.in_box(*ends()[:2])))
    return [*checks, ("dropoff", "outside the area", ~geo.in_box(*ends()[2:]))]


def with_features(df: DataFrame) -> DataFrame:
    """The 20 model features, from columns that are known before the trip."""
    hour, day = F.hour("pickup_datetime"), F.weekday("pickup_datetime")
    new = {
        "distance_haversine_km": geo.great_circle(*ends()), "distance_manhattan_km": geo.city_block(*ends()), "bearing_deg": geo.bearing(*ends()),
        "hour": hour, "day_of_week": day, "month": F.month("pickup_datetime"), "is_weekend": (day >= 5).cast("int"),
        "is_rush_hour": ((day < 5) & hour.isin(*RUSH)).cast("int"), "is_late_night": hour.isin(*NIGHT).cast("int"),
    }
    new |= {f"dist_{key}_km": geo.hub_distance(*ends(), (lat, lon)) for key, lat, lon in geo.HUBS}
    return df.withColumns(new)


FEATURES = [*PLACES, "distance_haversine_km", "distance_manhattan_km", "bearing_deg", "hour", "day_of_week", "month", "is_weekend", "is_rush_hour", "is_late_night", "passenger_count", *[f"dist_{k}_km" for k, _, _ in geo.HUBS]]


def tier() -> Column:
    return geo.tier(F.col("distance_haversine_km"), *[F.col(f"dist_{k}_km") for k in ("jfk", "lga", "ewr")])


def with_fare(df: DataFrame, seconds: Column) -> DataFrame:
    """Fare items, each rounded to cents (halves to even), their total, and telemetry."""
    cents = lambda c: F.bround(c, 2)
    airport = (F.col("dist_jfk_km") <= geo.AIRPORT_KM) | (F.col("dist_lga_km") <= geo.AIRPORT_KM)
    items = {
        "base_fare": F.lit(BASE_FARE), "distance_charge": cents(F.col("distance_manhattan_km") / KM_PER_MILE * PER_MILE), "time_charge": cents(seconds / 60.0 * PER_MINUTE),
        "rush_hour_surcharge": F.col("is_rush_hour") * RUSH_FEE, "late_night_surcharge": F.col("is_late_night") * NIGHT_FEE, "congestion_fee": F.lit(CONGESTION_FEE), "airport_fee": airport.cast("int") * AIRPORT_FEE,
    }
    out = df.withColumns(items)
    total = sum((F.col(c) for c in items), F.lit(0.0))
    return out.withColumns({"fare": cents(total), "miles": F.col("distance_manhattan_km") / KM_PER_MILE, "speed_kmh": F.col("distance_manhattan_km") / (seconds / 3600.0), "clock": clock_text(seconds)})


def residual_band(calibration: DataFrame, group: str, residual: str, low: float = 0.05, high: float = 0.95, least: int = 200) -> tuple[DataFrame, DataFrame]:
    """Residual quantiles of each group with enough rows, and those of all rows for the other groups."""
    cut = [F.percentile(residual, F.lit(low)).alias("low"), F.percentile(residual, F.lit(high)).alias("high")]
    return calibration.groupBy(group).agg(F.count("*").alias("n"), *cut).where(F.col("n") >= least), calibration.agg(*[c.alias(f"all_{n}") for c, n in zip(cut, ("low", "high"), strict=True)])


def with_band(df: DataFrame, band: tuple[DataFrame, DataFrame], group: str) -> DataFrame:
    own, overall = band
    out = df.join(own.select(group, "low", "high"), group, "left").crossJoin(F.broadcast(overall))  # overall is one row
    return out.withColumns({"low": F.coalesce("low", "all_low"), "high": F.coalesce("high", "all_high")}).drop("all_low", "all_high")


def scored(df: DataFrame, band: tuple[DataFrame, DataFrame], seen: DataFrame) -> DataFrame:
    """One row for each trip with a column predicted (seconds): the prediction from the floor up, its band, distances, speed, fare, and whether the pickup lies outside the times (a, b) learned from. seen is one row."""
    floor = lambda c: F.greatest(F.lit(FLOOR), c)
    rows = with_band(df, band, "tier").withColumn("seconds", floor(F.col("predicted")))
    rows = rows.withColumn("low_s", floor(F.col("predicted") + F.col("low"))).withColumn("high_s", F.greatest("low_s", F.col("predicted") + F.col("high")))
    rows = with_fare(rows, F.col("seconds")).crossJoin(F.broadcast(seen))
    far = lambda c, n: F.round(c, 6).alias(n)
    km = F.col("distance_haversine_km")
    return rows.select(
        "id", "tier", *[F.round(c, 5).alias(c) for c in ("seconds", "low_s", "high_s")], "clock", far(km, "distance_haversine_km"), far(km / KM_PER_MILE, "distance_haversine_mi"), far(F.col("miles"), "miles"), far(F.col("bearing_deg"), "bearing_deg"),
        far(F.col("speed_kmh"), "speed_kmh"), far(F.col("speed_kmh") / KM_PER_MILE, "speed_mph"), (~F.col("pickup_datetime").between(F.col("a"), F.col("b"))).alias("extrapolated"), "distance_charge", "time_charge", "airport_fee", "fare",
    )
