"""Estimation, alignment and expressions against plain versions and known values."""
import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.functions import geo as G
from granary.functions import similarity as S
from granary.functions import text as T
from granary.operators import alignment, estimation


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_similarities(spark):
    pair = lambda a, b: (F.lit(a), F.lit(b))
    got = one(spark, S.jaro(*pair("MARTHA", "MARHTA")), S.jaro_winkler(*pair("MARTHA", "MARHTA")), S.jaro(*pair("DIXON", "DICKSONX")), S.jaro(*pair("", "A")), S.jaro(*pair("", "")), S.jaro(*pair("ab", "xy")), S.jaro(F.lit(None).cast("string"), F.lit("a")))
    assert got == pytest.approx((17 / 18, 0.961111, 0.766667, 0.0, 1.0, 0.0, None), abs=1e-6)
    got = one(spark, S.name_similarity(*pair("Ann  Lee", "ann lee")), S.name_similarity(*pair("Lee", "Xo Lee Qa")), S.name_similarity(*pair("", "a")))
    assert got[0] == 1 and got[1] >= 0.9 and got[2] == 0


def test_fit_equals_pair_by_pair():
    rng = np.random.default_rng(3)
    pairs = [(int(rng.integers(-1, 3)), int(rng.integers(0, 2))) for _ in range(300)]
    kinds = sorted(set(pairs))
    m, u, prior = [[0.7, 0.2, 0.1], [0.8, 0.2]], [[0.1, 0.2, 0.7], [0.3, 0.7]], 0.2
    got = estimation.fit(np.array(kinds), np.array([pairs.count(k) for k in kinds], float), [np.array(x) for x in m], [np.array(x) for x in u], prior, rounds=5, tolerance=0)
    for _ in range(5):
        gs = []
        for p in pairs:
            a, b = prior, 1 - prior
            for c, level in enumerate(p):
                if level >= 0:
                    a, b = a * m[c][level], b * u[c][level]
            gs.append(a / (a + b))
        prior = sum(gs) / len(gs)
        share = lambda c, level, g: (sum(x for x, p in zip(g, pairs) if p[c] == level) + 1e-9) / (sum(x for x, p in zip(g, pairs) if p[c] >= 0) + 1e-9 * len(m[c]))  # noqa: B023, E731
        m, u = ([[share(c, i, g) for i in range(len(m[c]))] for c in range(2)] for g in (gs, [1 - x for x in gs]))
    assert got.rounds == 5 and not got.converged and got.prior == pytest.approx(prior)
    assert np.concatenate(got.m) == pytest.approx(sum(m, [])) and np.concatenate(got.u) == pytest.approx(sum(u, []))


def test_estimate_without_pairs(spark):
    got = estimation.estimate(spark.createDataFrame([], "x int"), ["x"], [[0.9, 0.1]], [[0.1, 0.9]], 0.1)
    assert (got.prior, got.rounds, got.converged) == (0.1, 0, False)


def test_alignment():
    assert alignment.align_one("Umak AK 99", {"region": "AK", "n": "99", "none": None}) == (["Umak", "AK", "99"], ["O", "B-region", "B-n"], [5, 8], [7, 10], ["region", "n"], None)
    assert alignment.align_one("Hauptstrasse 5", {"suffix": "strasse"})[2:4] == ([5], [12])
    assert alignment.align_one("10 Elm Streat", {"street": "Elm Street"})[1] == ["O", "B-street", "I-street"]
    assert alignment.align_one("a b", {"x": "zzzz"})[5] == "component-not-found:x"
    assert alignment.align_one("", {})[5] == alignment.align_one(None, {})[5] == "raw-empty"
    assert alignment.within("abcd", "bcde", 2) and not alignment.within("abcd", "xyzd", 2)


def test_alignment_routes_rows(spark):
    rows = spark.createDataFrame([(1, "5 Elm", {"street": "Elm"}), (2, "5 Elm", {"street": "Oakwood"}), (3, None, None), (4, "x", None)], "id long, raw string, parts map<string,string>")
    done, bad = alignment.routed(alignment.align(rows, "raw", "parts"))
    assert {(r["id"], *r["labels"]) for r in done.collect()} == {(1, "O", "B-street"), (4, "O")}
    assert {(r["row"]["id"], r["reason"]) for r in bad.collect()} == {(2, "component-not-found:street"), (3, "raw-empty")}


def test_street_lines(spark):
    lines = ["123A Main St", " 40-12 Bell Blvd ", "PO Box 5", "", "7\t\tElm"]
    got = [r[0] and tuple(r[0]) for r in spark.createDataFrame([(x,) for x in lines], "x string").select(T.street_line(F.regexp_replace("x", "^ +| +$", ""))).collect()]
    assert got == [("123A", "Main St"), ("40-12", "Bell Blvd"), (None, "PO Box 5"), None, ("7", "Elm")]


def test_grids_and_courses(spark):
    assert one(spark, G.geohash(F.lit(57.64911), F.lit(10.40744), 11), G.maidenhead(F.lit(41.714775), F.lit(-72.727260))) == ("u4pruydqqvj", "FN31pr")
    assert one(spark, G.bearing(F.lit(0), F.lit(0), F.lit(0), F.lit(90)), G.bearing(F.lit(0), F.lit(0), F.lit(-10), F.lit(0))) == pytest.approx((90.0, 180.0))


def test_rings(spark):
    at = lambda *ps: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ps])
    rings = F.array(at((0, 0), (4, 0), (4, 4), (0, 4)), at((1, 1), (2, 1), (2, 2), (1, 2)))
    assert one(spark, *[G.in_rings(F.lit(x), F.lit(y), rings) for x, y in ((3.0, 3.0), (1.5, 1.5), (5.0, 1.0), (0.5, 3.5))]) == (True, False, False, True)


def test_points_along(spark):
    at = lambda *ps: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ps])
    r = one(spark, *[G.point_along(at(*ps), F.lit(f)) for ps, f in (([(0, 0), (0, 1), (0, 1), (0, 2)], 0.75), ([(5, 6), (5, 6)], 0.5), ([(0, 0), (0, 2)], 1.0), ([(3, 4)], 0.2))])
    assert [tuple(p)[:2] for p in r] == [pytest.approx((0, 1.5)), (5, 6), pytest.approx((0, 2)), (3, 4)]


def plain_similarity(x, y):
    """Of canonical, non-empty names that differ."""
    reach, taken = max(max(len(x), len(y)) // 2 - 1, 0), []
    for i, c in enumerate(x):
        taken += [j for j in range(max(0, i - reach), min(len(y), i + reach + 1)) if y[j] == c and j not in taken][:1]
    m = len(taken)
    score = (m / len(x) + m / len(y) + (m - sum(y[i] != y[j] for i, j in zip(taken, sorted(taken))) / 2) / m) / 3 if m else 0.0
    if score >= 0.7:
        score += 0.1 * len(os.path.commonprefix([x[:4], y[:4]])) * (1 - score)
    u, v = set(x.split()), set(y.split())
    if u < v or v < u:
        return max(score, 0.9)
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        row = list(itertools.accumulate(range(1, len(y) + 1), lambda left, j: min(left + 1, row[j] + 1, row[j - 1] + (c != y[j - 1])), initial=i))
    return max(score, 1 - row[-1] / max(len(x), len(y)))


def test_name_similarity_query(spark):
    from granary.plans import registry

    directory = "/root/testdata/sf0.001"
    names = {r["p_partkey"]: r["p_name"].lower() for r in spark.read.parquet(f"{directory}/part.parquet").collect()}
    got = registry.queries()["lnk_name_similarity"](spark, directory).collect()
    assert len(got) == len({(r["lo"], r["hi"]) for r in got}) == registry.queries()["lnk_blocking"](spark, directory).count() > 0
    for r in got:
        x, y = names[r["lo"]], names[r["hi"]]
        assert r["similarity"] == pytest.approx(1.0 if x == y else plain_similarity(x, y), abs=1e-6)
