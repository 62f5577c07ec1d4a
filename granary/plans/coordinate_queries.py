"""Coordinates in other forms. Customers stand on points that their keys fix."""
from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import coordinates as C
from granary.plans.registry import query
from granary.plans.tables import points, sql_points, table

P = sql_points("customer", "c_custkey")


def _points(spark, d):
    return points(spark, d, "customer", "c_custkey").select("id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))


_DMS = "CAST(floor(abs({0})) AS BIGINT) || '° ' || CAST(floor((abs({0}) - floor(abs({0}))) * 60) AS BIGINT) || '′ ' || printf('%.2f', ((abs({0}) - floor(abs({0}))) * 60 - floor((abs({0}) - floor(abs({0}))) * 60)) * 60) || '″ ' || CASE WHEN {0} >= 0 THEN '{1}' ELSE '{2}' END"


@query("geo_degrees_text", f"SELECT id, {_DMS.format('lat', 'N', 'S')} AS lat, {_DMS.format('lon', 'E', 'W')} AS lon FROM (SELECT id, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon FROM {P})")
def geo_degrees_text(spark, d):
    return _points(spark, d).select("id", C.degrees_text(F.col("lat"), "N", "S").alias("lat"), C.degrees_text(F.col("lon"), "E", "W").alias("lon"))


@query("geo_plus_code", f"""SELECT id, array_to_string(list_transform(range(0, 5), lambda i: substring('23456789CFGHJMPQRVWX', CAST(a // CAST(pow(20, 4 - i) AS BIGINT) % 20 + 1 AS INTEGER), 1) || substring('23456789CFGHJMPQRVWX', CAST(b // CAST(pow(20, 4 - i) AS BIGINT) % 20 + 1 AS INTEGER), 1) || CASE WHEN i = 3 THEN '+' ELSE '' END), '') AS code
 FROM (SELECT id, CAST(floor(round((lat + 90) * 8000, 6)) AS BIGINT) AS a, CAST(floor(round((lon + 180) * 8000, 6)) AS BIGINT) AS b FROM {P})""")
def geo_plus_code(spark, d):
    return _points(spark, d).select("id", C.plus_code(F.col("lat"), F.col("lon")).alias("code"))


@query("geo_plus_decode", f"SELECT id, round(floor(round((lat + 90) * 8000, 6)) / 8000 + 1 / 16000.0 - 90, 9) AS lat, round(floor(round((lon + 180) * 8000, 6)) / 8000 + 1 / 16000.0 - 180, 9) AS lon FROM {P}")
def geo_plus_decode(spark, d):
    p = _points(spark, d).select("id", C.plus_decode(C.plus_code(F.col("lat"), F.col("lon"))).alias("p"))
    return p.select("id", F.round("p.lat", 9).alias("lat"), F.round("p.lon", 9).alias("lon"))


@query("geo_plus_recover", f"SELECT id, round(floor(round((lat + 90) * 8000, 6)) / 8000 + 1 / 16000.0 - 90, 9) AS lat, round(floor(round((lon + 180) * 8000, 6)) / 8000 + 1 / 16000.0 - 180, 9) AS lon FROM {P}")
def geo_plus_recover(spark, d):
    """A code without its first four digits, from a place 0.3 degrees away."""
    short = F.substring(C.plus_code(F.col("lat"), F.col("lon")), 5, 10)
    p = _points(spark, d).select("id", C.plus_recover(short, F.col("lat") + 0.3, F.col("lon") - 0.3).alias("p"))
    return p.select("id", F.round("p.lat", 9).alias("lat"), F.round("p.lon", 9).alias("lon"))


_U = f"""u AS (SELECT id, lat, lon, CAST(floor((lon + 180) / 6) AS BIGINT) + 1 AS zone, radians(lat) AS phi FROM {P}),
 v AS (SELECT *, 6378137.0 / sqrt(1 - {{e}} * pow(sin(phi), 2)) AS n, pow(tan(phi), 2) AS t, {{ep}} * pow(cos(phi), 2) AS c, cos(phi) * (radians(lon) - radians((zone - 1) * 6 - 177)) AS a,
 6378137.0 * ((1 - {{e}} / 4 - 3 * pow({{e}}, 2) / 64 - 5 * pow({{e}}, 3) / 256) * phi - (3 * {{e}} / 8 + 3 * pow({{e}}, 2) / 32 + 45 * pow({{e}}, 3) / 1024) * sin(2 * phi) + (15 * pow({{e}}, 2) / 256 + 45 * pow({{e}}, 3) / 1024) * sin(4 * phi) - (35 * pow({{e}}, 3) / 3072) * sin(6 * phi)) AS m FROM u),
 w AS (SELECT *, 0.9996 * n * (a + (1 - t + c) * pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * {{ep}}) * pow(a, 5) / 120) + 500000.0 AS e, 0.9996 * (m + n * tan(phi) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * {{ep}}) * pow(a, 6) / 720)) AS y FROM v)""".format(e=C.UTM_F * (2 - C.UTM_F), ep=C.UTM_F * (2 - C.UTM_F) / (1 - C.UTM_F * (2 - C.UTM_F)))


@query("geo_military_grid", f"""WITH {_U} SELECT id, zone || substring('{C.BANDS}', CAST(floor((lat + 80) / 8) AS INTEGER) + 1, 1) || substring('{C.COLUMNS}', CAST((zone - 1) % 3 * 8 + floor(e / 100000) AS INTEGER), 1) || substring('{C.ROWS}', CAST((CAST(floor(y / 100000) AS BIGINT) % 20 + CASE WHEN zone % 2 = 0 THEN 5 ELSE 0 END) % 20 AS INTEGER) + 1, 1)
 || lpad(CAST(CAST(floor(e - floor(e / 100000) * 100000) AS BIGINT) AS VARCHAR), 5, '0') || lpad(CAST(CAST(floor(y - floor(y / 100000) * 100000) AS BIGINT) AS VARCHAR), 5, '0') AS grid FROM w""")
def geo_military_grid(spark, d):
    return _points(spark, d).select("id", C.mgrs(F.col("lat"), F.col("lon")).alias("grid"))


@query("geo_sun", f"""WITH a AS (SELECT id, lat, floor(19000.5 + 2440587.5 - 2451545 - 0.0009 + lon / 360 + 0.5) + 0.0009 - lon / 360 AS mean FROM {P}), b AS (SELECT *, (357.5291 + 0.98560028 * mean) % 360 AS m FROM a),
 c AS (SELECT *, (m + 1.9148 * sin(radians(m)) + 0.02 * sin(radians(2 * m)) + 0.0003 * sin(radians(3 * m)) + 180 + 102.9372) % 360 AS l FROM b) SELECT id, CAST(round((2451545 + mean + 0.0053 * sin(radians(m)) - 0.0069 * sin(radians(2 * l)) - 2440587.5) * 86400) AS BIGINT) AS noon FROM c""")
def geo_sun(spark, d):
    s = C.sun_times(F.col("lat"), F.col("lon"), F.lit(19000.5 * 86400))
    return _points(spark, d).select("id", s["noon"].alias("noon"))


@query("geo_british_grid")
def geo_british_grid(spark, d):
    """Iterative; a test holds it to published points."""
    grid = table(spark, d, "customer").select("c_custkey", (200000 + F.col("c_custkey") * 37 % 400000).cast("double").alias("e"), (50000 + F.col("c_custkey") * 91 % 900000).cast("double").alias("n"))
    return grid.select("c_custkey", C.british_grid(F.col("e"), F.col("n")).alias("p")).select("c_custkey", F.round("p.lat", 7).alias("lat"), F.round("p.lon", 7).alias("lon"))


@query("geo_box_text", f"SELECT c_nationkey, min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat, 5 AS corners FROM {P} p JOIN customer ON c_custkey = p.id GROUP BY 1")
def geo_box_text(spark, d):
    """Boxes written as well-known text and read back."""
    c = _points(spark, d).join(table(spark, d, "customer"), F.col("id") == F.col("c_custkey")).groupBy("c_nationkey")
    b = c.agg(*[f(x).alias(f"{n}_{x}") for x in ("lon", "lat") for n, f in (("min", F.min), ("max", F.max))])
    text = C.box_text(*(F.col(x) for x in ("min_lon", "min_lat", "max_lon", "max_lat")))
    out = b.select("c_nationkey", text.alias("t")).select("c_nationkey", C.text_box(F.col("t")).alias("b"), F.size(F.split("t", ",")).alias("corners"))
    return out.select("c_nationkey", "b.*", "corners")


_SQUARES = ((-110.0, 30.0, -100.0, 40.0), (-95.0, 35.0, -85.0, 45.0))


@query("geo_multipolygon", f"SELECT id, CAST(CASE WHEN id % 10 <> 0 THEN ({' OR '.join(f'(lat > {b} AND lat < {d} AND lon > {a} AND lon < {c})' for a, b, c, d in _SQUARES)}) AND NOT (lat > 33 AND lat < 36 AND lon > -107 AND lon < -103) END AS VARCHAR) AS inside FROM {P} WHERE lat NOT IN (30, 33, 35, 36, 40, 45) AND lon NOT IN (-110, -107, -103, -100, -95, -85)")
def geo_multipolygon(spark, d):
    """Two squares, one with a hole; unknown where there is no geometry."""
    square = lambda a, b, c, e: F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((a, b), (c, b), (c, e), (a, e))])
    shapes = F.array(F.array(square(*_SQUARES[0]), square(-107.0, 33.0, -103.0, 36.0)), F.array(square(*_SQUARES[1])))
    p = _points(spark, d).filter(~F.col("lat").isin(30.0, 33.0, 35.0, 36.0, 40.0, 45.0) & ~F.col("lon").isin(-110.0, -107.0, -103.0, -100.0, -95.0, -85.0))
    return p.select("id", C.in_polygons(F.col("lon"), F.col("lat"), F.when(F.col("id") % 10 != 0, shapes)).cast("string").alias("inside"))
