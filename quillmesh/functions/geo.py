"""Geometry of trips on a sphere, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sphere, and places as (key, latitude, longitude).
EARTH_KM = 6371.0088
HUBS = (("jfk", 40.6413, -73.7781), ("lga", 40.7769, -73.8740), ("ewr", 40.6895, -74.1745), ("times_sq", 40.7580, -73.9855), ("wall_st", 40.7060, -74.0086), ("grand_central", 40.7527, -73.9772))
BOX = (40.49, 40.92, -74.27, -73.68)
AIRPORT_KM, SHORT_KM, COMMUTE_KM = 2.0, 2.0, 5.0


def lit(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def great_circle(lat1: Column, lon1: Column, lat2: Column | float, lon2: Column | float) -> Column:
    """Haversine distance in km; the argument of the root is held in [0, 1]."""
    p1, p2 = F.radians(lat1), F.radians(lit(lat2))
    up, over = F.sin((p2 - p1) / 2), F.sin((F.radians(lit(lon2)) - F.radians(lon1)) / 2)
    chord = up * up + F.cos(p1) * F.cos(p2) * over * over
    return F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), chord)))) * (2 * EARTH_KM)


def city_block(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """East-west at the first latitude, then north-south."""
    return great_circle(lat1, lon1, lat1, lon2) + great_circle(lat1, lon1, lat2, lon1)


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Compass degrees from 0 to 360."""
    p1, p2, turn = F.radians(lat1), F.radians(lat2), F.radians(lon2) - F.radians(lon1)
    east = F.sin(turn) * F.cos(p2)
    north = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(turn)
    return F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0))


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float] = BOX) -> Column:
    return lat.between(box[0], box[1]) & lon.between(box[2], box[3])


def hub_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column, hub: tuple[float, float]) -> Column:
    """The nearer end's distance to a hub."""
    return F.least(great_circle(lat1, lon1, *hub), great_circle(lat2, lon2, *hub))


def tier(distance: Column, *airports: Column) -> Column:
    """airport if an end is near one, else by distance."""
    near = airports[0] <= AIRPORT_KM
    for a in airports[1:]:
        near = near | (a <= AIRPORT_KM)
    return F.when(near, "airport").when(distance < SHORT_KM, "short").when(distance < COMMUTE_KM, "commute").otherwise("cross_borough")
