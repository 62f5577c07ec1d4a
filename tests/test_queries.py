"""Every registered query of the library against its SQL on the smallest tables."""
import math
import os

import duckdb
import pandas as pd
import pytest

from granary.plans import registry

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(DIR):
        c.sql(f"create view {t.removesuffix('.parquet')} as select * from read_parquet('{DIR}/{t}')")
    return c


def plain(df):
    def one(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
            return None
        if isinstance(x, float):
            return round(x, 6)
        return int(x) if hasattr(x, "__index__") and not isinstance(x, bool) else x

    df = df[sorted(df.columns)]
    return list(df.columns), sorted((tuple(map(one, r)) for r in df.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    assert plain(registry.queries()[name](spark, DIR).toPandas()) == plain(duck.sql(registry.oracle_sql()[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_components_of_a_chain(spark):
    from granary.operators.linkage import connected

    edges = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(20, 21)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(10), 20, 21, 30]], "node long")
    got = {r["node"]: r["label"] for r in connected(edges, nodes, lambda d: d.persist()).collect()}
    assert got == {**dict.fromkeys(range(10), 0), 20: 20, 21: 20, 30: 30}


def test_closure_stops_at_cycles(spark):
    from granary.operators.linkage import closure

    from granary.operators.lineage import cut

    p = spark.createDataFrame([(1, 2), (2, 1), (3, -1), (4, 99)], "id long, parent_id long")
    assert {(r["id"], r["ancestor"], r["depth"]) for r in closure(p, cut).collect()} == {(1, 1, 0), (1, 2, 1), (2, 2, 0), (2, 1, 1), (3, 3, 0), (4, 4, 0)}


def test_closure_of_a_chain_has_every_level(spark):
    from granary.operators.linkage import closure
    from granary.operators.lineage import cut

    p = spark.createDataFrame([(i, i - 1) for i in range(1, 42)], "id long, parent_id long")
    got = closure(p, cut).filter("id = 41").collect()
    assert sorted((r["ancestor"], r["depth"]) for r in got) == [(41 - i, i) for i in range(40, -1, -1)]


def test_near_cells_hold_every_point_within_reach(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from granary.functions import geo as G

    r = np.random.default_rng(5)
    lat, lon = np.degrees(np.arcsin(r.uniform(-1, 1, 3000))), r.uniform(-180, 180, 3000)
    lat[:600], lon[:600] = r.uniform(86, 90, 600) * r.choice([-1, 1], 600), r.uniform(-180, 180, 600)
    lat[600:900], lon[600:900] = r.uniform(-2, 2, 300), 180 - np.abs(r.normal(0, 1, 300))
    lon[600:750] *= -1
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon))], "id long, lat double, lon double")
    for km in (150.0, 900.0):
        a = df.select("id", "lat", "lon", F.explode(G.reach_cells(F.col("lat"), F.col("lon"), km)).alias("cell"))
        b = df.select(F.col("id").alias("id2"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), G.reach_cell(F.col("lat"), F.col("lon"), km).alias("cell"))
        near = a.join(b, "cell").filter(G.haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")) <= km).select("id", "id2").distinct()
        p, q = np.radians(lat), np.radians(lon)
        h = np.sin((p[:, None] - p) / 2) ** 2 + np.cos(p[:, None]) * np.cos(p) * np.sin((q[:, None] - q) / 2) ** 2
        want = {(int(i), int(j)) for i, j in np.argwhere(2 * 6371.0 * np.arctan2(np.sqrt(h), np.sqrt(1 - h)) <= km - 1e-6)}
        assert want <= {(x["id"], x["id2"]) for x in near.collect()}


def test_nearest_by_growing_reach(spark):
    import numpy as np

    from granary.operators.lineage import cut
    from granary.operators.nearest import nearest

    r = np.random.default_rng(6)
    q = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(r.uniform(-89, 89, 60), r.uniform(-180, 180, 60)))]
    p = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(r.uniform(-40, 40, 25), r.uniform(-180, 180, 25)))]
    schema = "id long, lat double, lon double"
    got = nearest(spark.createDataFrame(q, schema), spark.createDataFrame(p, schema), 4, cut, first_km=100.0).collect()

    def km(a, b):
        x, y, u, v = map(math.radians, (a[1], a[2], b[1], b[2]))
        h = math.sin((x - u) / 2) ** 2 + math.cos(x) * math.cos(u) * math.sin((y - v) / 2) ** 2
        return 2 * 6371.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    want = {(a[0], b[0], k + 1) for a in q for k, b in enumerate(sorted(p, key=lambda b: (km(a, b), b[0]))[:4])}
    assert {(g["id"], g["near"], g["rank"]) for g in got} == want


def test_blocks_of_any_size_give_all_pairs(spark, tmp_path):
    from granary.operators.linkage import blocking_pairs, dropped_keys
    from granary.plans.linkage_queries import _keys

    rows = [(i, f"Red {'blue' if i % 3 else 'tan'}", 7 if i < 60 else i) for i in range(70)] + [(70, None, 7)]
    part = spark.createDataFrame(rows, "p_partkey long, p_name string, p_size int")
    part.write.parquet(f"{tmp_path}/part.parquet")
    got = [(r["lo"], r["hi"]) for r in registry.queries()["lnk_blocking"](spark, str(tmp_path)).collect()]
    assert sorted(got) == [(a, b) for a in range(60) for b in range(a + 1, 60)]
    capped = {(r["lo"], r["hi"]) for r in blocking_pairs(part, _keys(), "p_partkey", 40).collect()}
    assert {(r["key"], r["n"]) for r in dropped_keys(part, _keys(), 40).collect()} == {("red7", 60)}
    assert capped == {(a, b) for a, b in got if a % 3 and b % 3 or not (a % 3 or b % 3)}
