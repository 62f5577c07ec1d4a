"""Clusters, lookups and decoding against plain versions."""
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import clusters, decode, places

DIR = "/root/testdata/sf0.001"


def test_average_linkage_cuts_a_weak_bridge():
    dense = [(0, 1, 9.0), (0, 2, 9.0), (1, 2, 9.0), (3, 4, 9.0)]
    assert clusters.merge_average(5, [*dense, (2, 3, 6.0), (1, 4, 1.0)], 5.0).tolist() == [0, 0, 0, 3, 3]
    assert clusters.merge_average(5, [*dense, (2, 3, 6.0)], 5.0).tolist() == [0] * 5
    assert clusters.merge_average(0, [], 5.0).tolist() == [] and clusters.merge_average(2, [], 5.0).tolist() == [0, 1]


def test_refine_and_cohesion(spark):
    labels = spark.createDataFrame([(i, 0) for i in range(5)] + [(9, 9)] + [(i, 20) for i in range(20, 24)], "node long, label long")
    links = spark.createDataFrame([(0, 1, 9.0), (0, 2, 9.0), (1, 2, 8.0), (3, 4, 9.0), (2, 3, 6.0), (1, 4, 1.0), (20, 21, 7.0), (21, 22, 6.0), (22, 23, 5.0)], "a long, b long, weight double")
    got = {r["node"]: r["label"] for r in clusters.refine(labels, links, 5.0, largest=5).collect()}
    assert got == {**dict.fromkeys(range(3), 0), 3: 3, 4: 3, 9: 9, **dict.fromkeys(range(20, 24), 20)}
    got = {r["node"]: r["label"] for r in clusters.refine(labels, links, 5.0, largest=4).collect()}
    assert [got[i] for i in range(5)] == [0] * 5
    assert {(r["label"], r["size"], r["cohesion"]) for r in clusters.cohesion(labels, links, 5.0).collect()} == {(0, 5, 6.0), (9, 1, None), (20, 4, 5.0)}


def test_cluster_queries_agree(spark):
    from granary.plans import registry

    q = registry.queries()
    nodes = spark.read.parquet(f"{DIR}/part.parquet").count()
    sizes = {r["label"]: r["size"] for r in q["lnk_cohesion"](spark, DIR).collect()}
    refined = {r["node"]: r["label"] for r in q["lnk_average_linkage"](spark, DIR).collect()}
    assert sum(sizes.values()) == len(refined) == nodes and set(sizes) <= set(refined.values())


def test_best_path_equals_all_paths():
    rng = np.random.default_rng(5)
    for n in (1, 2, 4):
        scores, moves = rng.normal(size=(n, 3)), rng.normal(size=(3, 3))
        value = lambda p: sum(scores[i, x] for i, x in enumerate(p)) + sum(moves[a, b] for a, b in itertools.pairwise(p))  # noqa: B023, E731
        path, score = decode.best_path(scores, moves)
        assert tuple(path) == max(itertools.product(range(3), repeat=n), key=value) and score == pytest.approx(value(path))
    assert decode.best_path(np.zeros((0, 3)), np.zeros((3, 3))) == ([], 0.0)


def test_decode_query(spark):
    from granary.plans import registry

    got = registry.queries()["cor_decode"](spark, DIR).collect()
    moves = {("O", "O"): 0.1, ("O", "B"): 0.2, ("B", "O"): 0.0, ("B", "B"): 0.1, ("B", "I"): 0.5, ("I", "O"): 0.1, ("I", "B"): 0.1, ("I", "I"): 0.2}
    names = {r["p_partkey"]: r["p_name"].split(" ") for r in spark.read.parquet(f"{DIR}/part.parquet").collect()}
    assert len(got) == len(names)
    for r in got:
        words = names[r["p_partkey"]]
        of = lambda p: sum({"O": len(w) / 10, "B": ord(w[0]) % 5 / 4, "I": len(w) % 3 / 2}[x] for w, x in zip(words, p)) + sum(moves.get(m, float("-inf")) for m in itertools.pairwise(p))  # noqa: B023, E731
        assert r["score"] == pytest.approx(max(of(p) for p in itertools.product("OBI", repeat=len(words)))) == pytest.approx(of(r["path"].split(" ")))


def test_neighbours(spark):
    known = spark.createDataFrame([("a", 10, 0.0, 0.0), ("a", 20, 1.0, 2.0), ("a", 20, 3.0, 2.0), ("b", 5, 1.0, 1.0)], "street string, number long, lat double, lon double")
    asked = spark.createDataFrame([(1, "a", 15), (2, "a", 10), (3, "a", 30), (4, "a", 31), (5, "a", 5), (6, "b", 6), (7, "c", 1)], "id long, street string, n long")
    got = {r["id"]: (r["lat"], r["lon"], r["bracket"]) for r in places.between_neighbours(asked, known, "street").collect()}
    assert got == {1: (1.0, 1.0, "both"), 3: (4.0, 4.0, "single"), 5: (-1.0, -1.0, "single")}


def test_hash_and_keys(spark):
    r = spark.range(1).select(T.fnv1a(F.lit("a")), T.fnv1a(F.lit("foobar")), T.fnv1a(F.lit("")), T.conjunction(F.array(F.lit("x"), F.lit("y")), F.array().cast("array<string>"))).first()
    assert tuple(r) == (0xE40C292C, 0xBF9CF968, 0x811C9DC5, [])
