"""Column expressions over points, boxes, projections and winds."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radius of the web-mercator sphere, and the latitude where its square ends.
RADIUS, TOP_LAT = 6378137.0, 85.051129
MPS_TO_MPH = 2.23694


def parse_lat_lon(text: Column, ranged: bool = False) -> Column:
    """B1: struct(lon, lat) of 'lat, lon'; null unless two numbers (within range if asked)."""
    parts = F.split(text, ",")
    lat, lon = (F.trim(F.try_element_at(parts, F.lit(i))).try_cast("double") for i in (1, 2))
    ok = (F.size(parts) == 2) & lat.isNotNull() & lon.isNotNull()
    if ranged:
        ok = ok & lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(ok, F.struct(lon.alias("lon"), lat.alias("lat")))


def box(w: Column, s: Column, e: Column, n: Column) -> Column:
    return F.struct(w.alias("w"), s.alias("s"), e.alias("e"), n.alias("n"))


def rect(lon: Column, lat: Column, dx: float = 0.6, dy: float = 0.5) -> Column:
    """Box around a point."""
    return box(lon - dx, lat - dy, lon + dx, lat + dy)


def box_union(a: Column, b: Column) -> Column:
    return box(F.least(a["w"], b["w"]), F.least(a["s"], b["s"]), F.greatest(a["e"], b["e"]), F.greatest(a["n"], b["n"]))


def pad(b: Column, fraction: float, clamp: float | None = None) -> Column:
    """Box grown by a share of its size on each side; latitudes clamped if asked."""
    dx, dy = (b["e"] - b["w"]) * fraction, (b["n"] - b["s"]) * fraction
    s, n = b["s"] - dy, b["n"] + dy
    if clamp is not None:
        s, n = F.greatest(s, F.lit(-clamp)), F.least(n, F.lit(clamp))
    return box(b["w"] - dx, s, b["e"] + dx, n)


def snap(b: Column, grid: float = 0.25) -> Column:
    """Box grown outward to the grid."""
    return box(F.floor(b["w"] / grid) * grid, F.floor(b["s"] / grid) * grid, F.ceil(b["e"] / grid) * grid, F.ceil(b["n"] / grid) * grid)


def box_contains(outer: Column, inner: Column) -> Column:
    return (outer["w"] <= inner["w"]) & (outer["s"] <= inner["s"]) & (outer["e"] >= inner["e"]) & (outer["n"] >= inner["n"])


def in_box(lon: Column, lat: Column, b: Column) -> Column:
    """Edges belong to the box."""
    return lon.between(b["w"], b["e"]) & lat.between(b["s"], b["n"])


def merc_x(lon: Column) -> Column:
    return F.radians(lon) * RADIUS


def merc_y(lat: Column) -> Column:
    """Web-mercator northing, latitude clamped to the square."""
    held = F.greatest(F.lit(-TOP_LAT), F.least(F.lit(TOP_LAT), lat))
    return F.log(F.tan(F.lit(0.7853981633974483) + F.radians(held) / 2)) * RADIUS


def inv_merc_y(y: Column) -> Column:
    return F.degrees(2 * F.atan(F.exp(y / RADIUS)) - F.lit(1.5707963267948966))


# WGS84 ellipsoid (fixed values).
AXIS, FLATTENING, SCALE, FALSE_EAST, FALSE_NORTH = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0


def utm_to_lonlat(easting: Column, northing: Column, zone: Column, north: Column) -> Column:
    """struct(lon, lat) by the usual series from the footpoint latitude."""
    e2 = FLATTENING * (2 - FLATTENING)
    second = e2 / (1 - e2)
    third = (1 - sqrt(1 - e2)) / (1 + sqrt(1 - e2))
    arc = AXIS * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256)
    mu = F.when(north, northing).otherwise(northing - FALSE_NORTH) / SCALE / arc
    series = ((3 * third / 2 - 27 * third**3 / 32, 2), (21 * third**2 / 16 - 55 * third**4 / 32, 4), (151 * third**3 / 96, 6), (1097 * third**4 / 512, 8))
    foot = mu
    for weight, times in series:
        foot = foot + weight * F.sin(mu * times)
    tan2, bend = F.pow(F.tan(foot), 2), second * F.pow(F.cos(foot), 2)
    inner = 1 - e2 * F.pow(F.sin(foot), 2)
    normal, meridian = AXIS / F.sqrt(inner), AXIS * (1 - e2) / F.pow(inner, 1.5)
    d = (easting - FALSE_EAST) / (normal * SCALE)
    up = F.pow(d, 2) / 2 - (5 + 3 * tan2 + 10 * bend - 4 * bend * bend - 9 * second) * F.pow(d, 4) / 24
    up = up + (61 + 90 * tan2 + 298 * bend + 45 * tan2 * tan2 - 252 * second - 3 * bend * bend) * F.pow(d, 6) / 720
    side = d - (1 + 2 * tan2 + bend) * F.pow(d, 3) / 6
    side = side + (5 - 2 * bend + 28 * tan2 - 3 * bend * bend + 8 * second + 24 * tan2 * tan2) * F.pow(d, 5) / 120
    return F.struct((zone * 6 - 183 + F.degrees(side / F.cos(foot))).alias("lon"), F.degrees(foot - normal * F.tan(foot) / meridian * up).alias("lat"))


def wind_speed_mph(u: Column, v: Column) -> Column:
    """Null below 1 mph (calm)."""
    speed = F.hypot(u, v) * MPS_TO_MPH
    return F.when(speed >= 1, speed)


def wind_bearing(u: Column, v: Column) -> Column:
    """The bearing the air moves toward."""
    return F.pmod(F.degrees(F.atan2(u, v)) + 360, F.lit(360.0))


def flip_bearing(degrees: Column) -> Column:
    return F.pmod(degrees + 180, F.lit(360))


def convert_units(product: Column, a: Column, b: Column) -> Column:
    """Raw record values to the product's unit."""
    return (
        F.when(product == "ws", F.hypot(a, b) * MPS_TO_MPH).when(product == "wg", a * MPS_TO_MPH).when(product == "tmpf", (a - 273.15) * 9 / 5 + 32)
        .when(product == "smoke", a * 1e9).when(product == "apcp01", a / 25.4).otherwise(a)
    )
