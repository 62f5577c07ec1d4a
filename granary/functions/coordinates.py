"""Other ways to write a place: degrees and minutes, military grid, plus codes, the British grid, sun times, boxes."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def degrees_text(c: Column, positive: str, negative: str, places: int = 2) -> Column:
    """48° 51′ 24.10″ N"""
    size = F.abs(c)
    degrees = F.floor(size)
    minutes = F.floor((size - degrees) * 60)
    seconds = ((size - degrees) * 60 - minutes) * 60
    return F.concat(degrees.cast("string"), F.lit("° "), minutes.cast("string"), F.lit("′ "), F.format_number(seconds, places), F.lit("″ "), F.when(c >= 0, positive).otherwise(negative))


def mercator_clamped(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Web Mercator metres; latitudes beyond the square map count as its edge."""
    edge = F.greatest(F.lit(-85.05112878), F.least(F.lit(85.05112878), lat))
    return F.radians(lon) * 6378137.0, F.log(F.tan(F.lit(math.pi / 4) + F.radians(edge) / 2)) * 6378137.0


# The ellipsoid of the universal transverse Mercator grid, its scale, and the letters of the military grid.
UTM_A, UTM_F, UTM_K = 6378137.0, 1 / 298.257223563, 0.9996
BANDS, ROWS, COLUMNS = "CDEFGHJKLMNPQRSTUVWX", "ABCDEFGHJKLMNPQRSTUV", "ABCDEFGHJKLMNPQRSTUVWXYZ"


def utm(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """(zone, easting, northing) by the usual series; 10,000 km are added south of the equator."""
    e2 = UTM_F * (2 - UTM_F)
    ep = e2 / (1 - e2)
    zone = F.floor((lon + 180) / 6) + 1
    phi = F.radians(lat)
    sin, cos, tan = F.sin(phi), F.cos(phi), F.tan(phi)
    n = UTM_A / F.sqrt(1 - e2 * sin * sin)
    t, c, a = tan * tan, ep * cos * cos, cos * (F.radians(lon) - F.radians((zone - 1) * 6 - 177))
    arc = UTM_A * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi) - (35 * e2**3 / 3072) * F.sin(6 * phi))
    easting = UTM_K * n * (a + (1 - t + c) * F.pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * F.pow(a, 5) / 120) + 500000.0
    northing = UTM_K * (arc + n * tan * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * F.pow(a, 6) / 720))
    return zone, easting, northing + F.when(lat < 0, 1e7).otherwise(0.0)


def mgrs(lat: Column, lon: Column) -> Column:
    """Zone, band, square and ten digits; empty beyond 80 south and 84 north."""
    zone, easting, northing = utm(lat, lon)
    letter = lambda s, i: F.substring(F.lit(s), i.cast("int") + 1, F.lit(1))
    band = letter(BANDS, F.least(F.floor((lat + 80) / 8), F.lit(19)))
    column = letter(COLUMNS, (zone - 1) % 3 * 8 + F.floor(easting / 100000) - 1)
    row = (F.floor(northing / 100000) % 20 + F.when(zone % 2 == 0, 5).otherwise(0)) % 20
    digits = lambda c: F.lpad(F.floor(c % 100000).cast("string"), 5, "0")
    return F.when(lat.between(-80, 84), F.concat(zone.cast("string"), band, column, letter(ROWS, row), digits(easting), digits(northing))).otherwise("")


# Fixed value: the digits of a plus code.
PLUS_DIGITS = "23456789CFGHJMPQRVWX"
PLUS_STEPS = (20.0, 1.0, 1 / 20, 1 / 400, 1 / 8000)


def plus_code(lat: Column, lon: Column) -> Column:
    """Ten digits, with a plus after the eighth."""
    digits = []
    for value in (F.least(F.greatest(lat + 90, F.lit(0.0)), F.lit(180 - 1e-12)), F.pmod(lon + 180, F.lit(360.0))):
        cells = F.floor(F.round(value * 8000, 6))
        digits.append([F.floor(cells / 20**k) % 20 for k in (4, 3, 2, 1, 0)])
    letter = lambda i: F.substring(F.lit(PLUS_DIGITS), i.cast("int") + 1, F.lit(1))
    pairs = [letter(d) for both in zip(*digits, strict=True) for d in both]
    return F.concat(*pairs[:8], F.lit("+"), *pairs[8:])


def plus_decode(code: Column) -> Column:
    """struct(lat, lon, lat_span, lon_span): the middle and size of a full code's cell, of ten or eleven digits; or null."""
    full = F.regexp_like(code, F.lit(f"(?i)^[{PLUS_DIGITS}]{{8}}\\+[{PLUS_DIGITS}]{{2,3}}$"))
    digits = F.replace(F.upper(code), F.lit("+"), F.lit(""))
    value = lambda i: F.instr(F.lit(PLUS_DIGITS), F.substring(digits, i + 1, 1)) - 1
    low = [sum((value(2 * k + side) * PLUS_STEPS[k] for k in range(5)), F.lit(float(-90 if side == 0 else -180))) for side in (0, 1)]
    longer, eleventh = F.length(digits) > 10, value(10)
    span = [F.when(longer, PLUS_STEPS[4] / cut).otherwise(PLUS_STEPS[4]) for cut in (5, 4)]
    lat = low[0] + F.when(longer, F.floor(eleventh / 4) * span[0]).otherwise(0.0) + span[0] / 2
    lon = low[1] + F.when(longer, eleventh % 4 * span[1]).otherwise(0.0) + span[1] / 2
    return F.when(full, F.struct(lat.alias("lat"), lon.alias("lon"), span[0].alias("lat_span"), span[1].alias("lon_span")))


def plus_recover(short: Column, lat: Column, lon: Column) -> Column:
    """The cell of a short code that lies nearest to a place: struct as plus_decode; null for what is no short code."""
    at = F.instr(short, "+")
    good = F.regexp_like(short, F.lit(f"(?i)^[{PLUS_DIGITS}]{{2,6}}\\+[{PLUS_DIGITS}]{{2,3}}$")) & (at % 2 == 1)
    missing = 9 - at
    step = F.element_at(F.array(*map(F.lit, PLUS_STEPS)), (missing / 2).cast("int"))

    def nearest(value: Column, here: Column, least: float, most: float) -> Column:
        return F.when((here + step / 2 < value) & (value - step >= least), value - step).when((here - step / 2 > value) & (value + step <= most), value + step).otherwise(value)

    def moved(cell: Column) -> Column:
        return F.struct(nearest(cell["lat"], lat, -90.0, 90.0).alias("lat"), nearest(cell["lon"], lon, -1e9, 1e9).alias("lon"), cell["lat_span"].alias("lat_span"), cell["lon_span"].alias("lon_span"))

    # Arrays of one, so that the code and its cell are written, and computed, once.
    code = F.array(F.concat(F.substring(plus_code(lat, lon), F.lit(1), missing), F.upper(short)))
    cells = F.transform(F.transform(code, plus_decode), lambda c: F.when(c.isNotNull(), moved(c)))
    return F.when(good, F.get(cells, F.lit(0)))


# The British national grid (Airy's ellipsoid, scale, origin) and the shift to WGS 84 (metres, parts per
# million, seconds of arc).
AIRY_A, AIRY_B, GRID_SCALE = 6377563.396, 6356256.909, 0.9996012717
GRID_LAT, GRID_LON, GRID_E, GRID_N = math.radians(49), math.radians(-2), 400000.0, -100000.0
SHIFT = {"x": 446.448, "y": -125.157, "z": 542.06, "ppm": -20.4894, "rx": 0.1502, "ry": 0.247, "rz": 0.8421}
WGS_A, WGS_B = 6378137.0, 6356752.3141


def british_grid(easting: Column, northing: Column, rounds: int = 8) -> Column:
    """struct(lat, lon) in WGS 84 of a place on the British grid. The meridian's arc is inverted by `rounds` steps, each
    of which divides what is left by more than a hundred."""
    e2 = 1 - AIRY_B**2 / AIRY_A**2
    n = (AIRY_A - AIRY_B) / (AIRY_A + AIRY_B)

    def arc(phi: Column) -> Column:
        a, b = phi - GRID_LAT, phi + GRID_LAT
        return AIRY_B * GRID_SCALE * (
            (1 + n + 1.25 * n**2 + 1.25 * n**3) * a - (3 * n + 3 * n**2 + 21 / 8 * n**3) * F.sin(a) * F.cos(b)
            + 15 / 8 * (n**2 + n**3) * F.sin(2 * a) * F.cos(2 * b) - 35 / 24 * n**3 * F.sin(3 * a) * F.cos(3 * b)
        )

    goal = northing - GRID_N
    phi = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), GRID_LAT + goal / (AIRY_A * GRID_SCALE), lambda p, _: p + (goal - arc(p)) / (AIRY_A * GRID_SCALE))

    def place(phi: Column) -> Column:
        sin2 = F.sin(phi) * F.sin(phi)
        nu = AIRY_A * GRID_SCALE / F.sqrt(1 - e2 * sin2)
        rho = AIRY_A * GRID_SCALE * (1 - e2) * F.pow(1 - e2 * sin2, F.lit(-1.5))
        t, eta, sec, d = F.tan(phi), nu / rho - 1, 1 / F.cos(phi), easting - GRID_E
        t2 = t * t
        lat = phi - t / (2 * rho * nu) * F.pow(d, 2) + t / (24 * rho * F.pow(nu, 3)) * (5 + 3 * t2 + eta - 9 * t2 * eta) * F.pow(d, 4) - t / (720 * rho * F.pow(nu, 5)) * (61 + 90 * t2 + 45 * t2 * t2) * F.pow(d, 6)
        lon = GRID_LON + sec / nu * d - sec / (6 * F.pow(nu, 3)) * (nu / rho + 2 * t2) * F.pow(d, 3) + sec / (120 * F.pow(nu, 5)) * (5 + 28 * t2 + 24 * t2 * t2) * F.pow(d, 5) - sec / (5040 * F.pow(nu, 7)) * (61 + 662 * t2 + 1320 * t2 * t2 + 720 * F.pow(t2, 3)) * F.pow(d, 7)
        return F.struct(lat.alias("lat"), lon.alias("lon"))

    def solid(p: Column) -> Column:
        nu = AIRY_A / F.sqrt(1 - e2 * F.sin(p["lat"]) * F.sin(p["lat"]))
        x, y, z = nu * F.cos(p["lat"]) * F.cos(p["lon"]), nu * F.cos(p["lat"]) * F.sin(p["lon"]), (1 - e2) * nu * F.sin(p["lat"])
        s, turn = 1 + SHIFT["ppm"] * 1e-6, {k: math.radians(SHIFT[k] / 3600) for k in ("rx", "ry", "rz")}
        return F.struct(
            (SHIFT["x"] + s * x - turn["rz"] * y + turn["ry"] * z).alias("x"), (SHIFT["y"] + turn["rz"] * x + s * y - turn["rx"] * z).alias("y"), (SHIFT["z"] - turn["ry"] * x + turn["rx"] * y + s * z).alias("z"),
        )

    def geographic(c: Column) -> Column:
        w2 = 1 - WGS_B**2 / WGS_A**2
        p = F.sqrt(c["x"] * c["x"] + c["y"] * c["y"])

        def again(phi: Column, _: Column) -> Column:
            nu = WGS_A / F.sqrt(1 - w2 * F.sin(phi) * F.sin(phi))
            return F.atan2(c["z"] + w2 * nu * F.sin(phi), p)

        phi = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.atan2(c["z"], p * (1 - w2)), again)
        return F.struct(F.degrees(phi).alias("lat"), F.degrees(F.atan2(c["y"], c["x"])).alias("lon"))

    steps = F.transform(F.transform(F.transform(F.array(phi), place), solid), geographic)
    return F.get(steps, F.lit(0))


def sun_times(lat: Column, lon: Column, seconds: Column) -> Column:
    """struct(rise, noon, set) in seconds since 1970 for the day of a moment; no rise or set where the sun does neither."""
    sin = lambda d: F.sin(F.radians(d))
    n = F.floor(seconds / 86400.0 + 2440587.5 - 2451545 - 0.0009 + lon / 360 + 0.5)
    mean = n + 0.0009 - lon / 360
    anomaly = (357.5291 + 0.98560028 * mean) % 360
    center = 1.9148 * sin(anomaly) + 0.02 * sin(2 * anomaly) + 0.0003 * sin(3 * anomaly)
    longitude = (anomaly + center + 180 + 102.9372) % 360
    noon = 2451545 + mean + 0.0053 * sin(anomaly) - 0.0069 * sin(2 * longitude)
    tilt = F.asin(sin(longitude) * F.sin(F.radians(F.lit(23.4397))))
    cosine = (F.sin(F.radians(F.lit(-0.833))) - sin(lat) * F.sin(tilt)) / (F.cos(F.radians(lat)) * F.cos(tilt))
    turn = F.when(F.abs(cosine) < 1, F.degrees(F.acos(cosine)) / 360)
    epoch = lambda j: F.round((j - 2440587.5) * 86400).cast("long")
    return F.struct(epoch(noon - turn).alias("rise"), epoch(noon).alias("noon"), epoch(noon + turn).alias("set"))


def box_text(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column) -> Column:
    """A box as a POLYGON in well-known text, from its lower left corner round."""
    point = lambda x, y: F.concat_ws(" ", x.cast("string"), y.cast("string"))
    return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", point(min_lon, min_lat), point(max_lon, min_lat), point(max_lon, max_lat), point(min_lon, max_lat), point(min_lon, min_lat)), F.lit("))"))


def text_box(c: Column) -> Column:
    """struct(min_lon, min_lat, max_lon, max_lat) of the coordinates of any well-known text; null without any."""
    numbers = F.transform(F.regexp_extract_all(c, F.lit("-?[0-9]+(?:\\.[0-9]+)?(?:E-?[0-9]+)?"), F.lit(0)), lambda x: x.cast("double"))
    xs, ys = F.filter(numbers, lambda _, i: i % 2 == 0), F.filter(numbers, lambda _, i: i % 2 == 1)
    return F.when(F.size(numbers) > 1, F.struct(F.array_min(xs).alias("min_lon"), F.array_min(ys).alias("min_lat"), F.array_max(xs).alias("max_lon"), F.array_max(ys).alias("max_lat")))


def in_polygons(lon: Column, lat: Column, polygons: Column) -> Column:
    """Whether any polygon holds the point: array of polygons, each an array of rings; null where there is no geometry."""
    from granary.functions.geo import in_rings

    return F.when(polygons.isNotNull(), F.exists(polygons, lambda p: in_rings(lon, lat, p)))
