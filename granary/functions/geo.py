"""Coordinates as column expressions; a cell is a square of a fixed grid, behind one function."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres on a sphere."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def cell(lat: Column, lon: Column, step: float) -> Column:
    return F.concat_ws(":", F.floor(lat / step).cast("string"), F.floor(lon / step).cast("string"))


def cell_disk(lat: Column, lon: Column, step: float, rings: int = 1) -> Column:
    """The cells around a point, as an array to explode."""
    near = F.sequence(F.lit(-rings), F.lit(rings))
    return F.flatten(F.transform(near, lambda i: F.transform(near, lambda j: F.concat_ws(":", (F.floor(lat / step) + i).cast("string"), (F.floor(lon / step) + j).cast("string")))))


def in_bounds(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180)


def fog(points: Column, segments: Column, full: float, weight: float, full_segments: float) -> Column:
    """Coverage of a cell: saturating in points, with segments at less weight, at most 1."""
    part = lambda n, sat: F.least(F.lit(1.0), F.log(1 + n) / F.log(F.lit(1 + sat)))
    return F.least(F.lit(1.0), part(points, full) + weight * part(segments, full_segments))


def dms(value: Column, positive: str, negative: str) -> Column:
    """Degrees, minutes and whole seconds with a hemisphere."""
    seconds = F.round(F.abs(value) * 3600).cast("long")
    mark = F.when(value < 0, negative).otherwise(positive)
    return F.concat(F.floor(seconds / 3600).cast("string"), F.lit(" "), F.floor(seconds % 3600 / 60).cast("string"), F.lit(" "), (seconds % 60).cast("string"), F.lit(" "), mark)


def mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Spherical web Mercator metres."""
    return F.radians(lon) * 6378137.0, F.log(F.tan(F.radians(lat) / 2 + F.lit(0.7853981633974483))) * 6378137.0


# Fixed value: the digits of a geohash.
GEOHASH_DIGITS = "0123456789bcdefghjkmnpqrstuvwxyz"


def geohash(lat: Column, lon: Column, precision: int = 9) -> Column:
    """Bits of longitude and latitude in turn, five a character. The far edges belong to the last cell."""
    bits = 5 * precision
    parts = []
    for value, low, span, n in ((lon, -180.0, 360.0, (bits + 1) // 2), (lat, -90.0, 180.0, bits // 2)):
        parts.append((F.least(F.floor((value - low) / span * float(1 << n)), F.lit((1 << n) - 1)), n))

    def digit(i: int) -> Column:
        out = F.lit(0)
        for b in range(5):
            of, n = parts[(5 * i + b) % 2]
            out = out + F.shiftleft((F.shiftright(of, n - 1 - (5 * i + b) // 2) % 2).cast("int"), 4 - b)
        return F.substring(F.lit(GEOHASH_DIGITS), out + 1, F.lit(1))

    return F.concat(*map(digit, range(precision)))


def maidenhead(lat: Column, lon: Column) -> Column:
    """Field, square and subsquare: six characters."""
    out = []
    for value in (lon + 180, (lat + 90) * 2):  # both in units of 20 degrees a field
        field, rest = F.floor(value / 20), value % 20
        out.append((F.char(F.lit(65) + field), F.floor(rest / 2).cast("string"), F.char(F.lit(97) + F.floor(rest % 2 * 12))))
    (a, c, e), (b, d, f) = out
    return F.concat(a, b, c, d, e, f)


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial course of the great circle, in degrees from north, 0 to 360."""
    p, q, turn = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    course = F.atan2(F.sin(turn) * F.cos(q), F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(turn))
    return (F.degrees(course) + 360) % 360


def in_rings(lon: Column, lat: Column, rings: Column) -> Column:
    """Even-odd containment in a polygon, rings: array<array<struct<x, y>>>, outer ring and holes in any order."""
    def crossings(ring: Column) -> Column:
        def crosses(i: Column) -> Column:
            p, q = F.element_at(ring, i + 1), F.element_at(ring, F.when(i == 0, F.size(ring)).otherwise(i))
            side = (p["y"] > lat) != (q["y"] > lat)
            return side & (lon < (q["x"] - p["x"]) * (lat - p["y"]) / F.when(side, q["y"] - p["y"]) + p["x"])

        return F.when(F.size(ring) > 0, F.size(F.filter(F.sequence(F.lit(0), F.size(ring) - 1), crosses))).otherwise(0)

    return F.aggregate(rings, F.lit(0), lambda n, ring: n + crossings(ring)) % 2 == 1


def in_fixed_rings(lon: Column, lat: Column, rings: list[list[tuple[Column, Column]]]) -> Column:
    """in_rings() for rings of fixed numbers of points (x, y): one plain expression, without arrays."""
    def crosses(p: tuple[Column, Column], q: tuple[Column, Column]) -> Column:
        side = (p[1] > lat) != (q[1] > lat)
        return F.when(side & (lon < (q[0] - p[0]) * (lat - p[1]) / F.when(side, q[1] - p[1]) + p[0]), 1).otherwise(0)

    return sum((crosses(p, q) for ring in rings for p, q in zip(ring, ring[-1:] + ring[:-1], strict=True)), F.lit(0)) % 2 == 1


def point_along(line: Column, share: Column) -> Column:
    """struct(x, y, km): the point at a share (0 to 1) of the length of a line, array<struct<x, y>>, and that length.

    A line without length gives its first point.
    """
    start = F.struct(F.lit(0.0).alias("km"), F.array().cast("array<struct<p:struct<x:double,y:double>,q:struct<x:double,y:double>,at:double,km:double>>").alias("legs"))

    def add(acc: Column, i: Column) -> Column:
        p, q = F.element_at(line, i), F.element_at(line, i + 1)
        km = haversine(p["y"], p["x"], q["y"], q["x"])
        leg = F.struct(F.struct(p["x"].alias("x"), p["y"].alias("y")).alias("p"), F.struct(q["x"].alias("x"), q["y"].alias("y")).alias("q"), acc["km"].alias("at"), km.alias("km"))
        return F.struct((acc["km"] + km).alias("km"), F.concat(acc["legs"], F.array(leg)).alias("legs"))

    first = F.element_at(line, 1)
    numbers = F.when(F.size(line) > 1, F.sequence(F.lit(1), F.size(line) - 1)).otherwise(F.array().cast("array<int>"))

    def place(all_: Column) -> Column:
        goal = share * all_["km"]
        reached = F.filter(all_["legs"], lambda g: (g["at"] + g["km"] >= goal) & (g["km"] > 0))
        leg = F.coalesce(F.get(reached, F.lit(0)), F.try_element_at(F.filter(all_["legs"], lambda g: g["km"] > 0), F.lit(-1)))
        part = F.least(F.lit(1.0), (goal - leg["at"]) / leg["km"])
        there = F.struct(*[(leg["p"][c] + (leg["q"][c] - leg["p"][c]) * part).alias(c) for c in ("x", "y")], all_["km"].alias("km"))
        return F.when(all_["km"] == 0, F.struct(first["x"].alias("x"), first["y"].alias("y"), F.lit(0.0).alias("km"))).otherwise(there)

    return F.element_at(F.transform(F.array(F.aggregate(numbers, start, add)), place), 1)


# Kilometres of a degree of latitude, and the least cosine that a box's width is divided by.
KM_PER_DEGREE, LEAST_COSINE = 111.0, 1e-6


def box_around(lat: Column, lon: Column, km: Column) -> tuple[Column, Column, Column, Column]:
    """(lat low, lat high, lon low, lon high) of a box that reaches km from a point."""
    up = km / KM_PER_DEGREE
    side = km / (KM_PER_DEGREE * F.greatest(F.cos(F.radians(lat)), F.lit(LEAST_COSINE)))
    return lat - up, lat + up, lon - side, lon + side


def _band(lat: Column, km: float) -> Column:
    return F.floor((lat + 90) / (km / 111.0))


def _width(band: Column, km: float) -> Column:
    """Degrees of longitude that km may reach from or into a band of latitude: those at its outer neighbour's far edge."""
    step = km / 111.0
    edge = F.least(F.greatest(F.abs(band * step - 90 - step), F.abs(band * step - 90 + 2 * step)), F.lit(90.0))
    return F.least(F.lit(360.0), km / 111.0 / F.greatest(F.cos(F.radians(edge)), F.lit(1e-6)))


def reach_cell(lat: Column, lon: Column, km: float) -> Column:
    """The cell of a point: bands of latitude as high as km, cut into cells at least as wide as km there."""
    band = _band(lat, km)
    return F.concat_ws(":", band.cast("string"), F.floor((lon + 180) / _width(band, km)).cast("string"))


def reach_cells(lat: Column, lon: Column, km: float) -> Column:
    """Cells that hold every point within km, by reach_cell, across the 180th meridian too: an array to explode."""
    around = F.sequence(F.lit(-1), F.lit(1))

    def of(b: Column) -> Column:
        band = _band(lat, km) + b
        width = _width(band, km)
        last = F.floor(F.lit(360.0) / width)
        at = F.floor((lon + 180) / width)
        # The last cell of a band may be narrow, so both ends look one further round.
        return F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda k: F.concat_ws(":", band.cast("string"), F.pmod(at + k, last + 1).cast("string")))

    return F.array_distinct(F.flatten(F.transform(around, of)))
