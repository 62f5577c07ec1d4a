"""Queries whose work must not grow with copies, wide ranges or long texts, against SQL and plain versions."""
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.functions import normalize as N
from granary.operators import linkage as L
from granary.operators import places
from granary.plans import linkage_queries, registry

PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


def written(spark, tmp_path, rows):
    spark.createDataFrame(rows, PART).write.parquet(f"{tmp_path}/part.parquet")
    c = duckdb.connect()
    c.sql(f"create view part as select * from read_parquet('{tmp_path}/part.parquet/*.parquet')")
    return str(tmp_path), c


def odd_parts():
    names = ["red bolt", "Red bolt", "red gear", "blue gear", "red red bolt", "", None, "cold  nut"]
    return [(i, names[i % 8], None if i % 11 == 0 else f"Brand#{i % 3}", "T", None if i % 17 == 0 else i % 2, 1.0) for i in range(90)]


@pytest.mark.parametrize("name", ["lnk_blocking", "lnk_score_pairs", "lnk_patterns", "lnk_resolve"])
def test_pairs_by_classes_equal_sql(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(L, "SLICE", 2)
    directory, duck = written(spark, tmp_path, odd_parts())
    got = registry.queries()[name](spark, directory)
    want = duck.sql(f"select {', '.join(got.columns)} from ({registry.oracle_sql()[name]})").fetchall()
    flat = lambda rows: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    assert flat(map(tuple, got.collect())) == flat(want) and want


def test_cluster_queries_equal_row_pairs(spark, tmp_path):
    from granary.operators import clusters
    from granary.operators.lineage import cut

    directory, duck = written(spark, tmp_path, odd_parts())
    s = registry.queries()["lnk_score_pairs"](spark, directory)
    links = cut(s.select(F.col("lo").alias("a"), F.col("hi").alias("b"), "weight"))
    for threshold in (5.0, 2.0, -1.0):
        labels = cut(L.connected(links.filter(F.col("weight") >= threshold), spark.read.parquet(f"{directory}/part.parquet").select(F.col("p_partkey").alias("node")), cut))
        members = cut(linkage_queries._members(spark, directory))
        by_class = cut(linkage_queries._scored(spark, directory).select("a", "b", "weight"))
        mine = cut(L.connected_classes(members, by_class.filter(F.col("weight") >= threshold), cut))
        rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
        assert rows(mine) == rows(labels)
        assert rows(clusters.refine_classes(members, by_class, mine, threshold)) == rows(clusters.refine(labels, links, threshold).select("node", "label"))
        rounded = lambda df: rows(df.withColumn("cohesion", F.round("cohesion", 6)))
        assert rounded(clusters.cohesion(mine, by_class, threshold)) == rounded(clusters.cohesion(labels, links, threshold))


def test_copies_meet_as_one(spark, tmp_path):
    directory, _ = written(spark, tmp_path, [(i, "red bolt", "Brand#1", "T", 1, 1.0) for i in range(3000)])
    assert [(r["a"], r["b"], r["n"]) for r in linkage_queries._scored(spark, directory).collect()] == [(0, 0, 3000 * 2999 // 2)]
    assert registry.queries()["lnk_blocking"](spark, directory).count() == 3000 * 2999 // 2


def test_tightest_range_by_blocks(spark):
    rng = random.Random(3)
    ranges = [(i, "ab"[i % 2], low, low + rng.choice([-1, 0, 1, 7, 64, 1000]), rng.choice(["odd", "even", "mixed", None])) for i, low in enumerate(rng.randrange(-300, 300) for _ in range(200))]
    asked = [(i, rng.choice(["a", "b", "c", None]), rng.choice([rng.randrange(-320, 1300), None])) for i in range(300)]
    got = places.tightest_range(spark.createDataFrame(asked, "id long, key string, n long"), spark.createDataFrame(ranges, "rid long, key string, low long, high long, parity string"), "key")
    want = []
    for i, k, n in asked:
        hits = [(0 if p == ("odd" if n % 2 == 1 and n > 0 else "even" if n % 2 == 0 or n < 0 else None) else 1 if p == "mixed" else 2, h - low, rid, low, h) for rid, key, low, h, p in ranges if n is not None and key == k and low <= n <= h]
        want += [(i, n, *min(hits))] if hits else []
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 50
    blocks = spark.range(1).select(places._blocks(F.lit(-5), F.lit(10))).first()[0]
    assert sorted(x for b in blocks for x in range(b["at"] << b["level"], b["at"] + 1 << b["level"])) == list(range(-5, 11))
    # A wide range is a few blocks, not a row for each number or query.
    assert len(spark.range(1).select(places._blocks(F.lit(1), F.lit(10**9))).first()[0]) <= 60


def test_offsets_of_a_long_text(spark):
    """Each step reads the characters once: work in proportion to the length."""
    raw = " \t" + "“ab”  c…\t " * 2000 + ".;"
    m = N.text_and_map(N.whitespace_with_offsets(N.punctuation_with_offsets(N.characters(F.col("raw")))))
    text, places_ = spark.createDataFrame([(raw,)], "raw string").select(m.alias("m")).first()[0]
    assert text == ('"ab" c... ' * 2000).rstrip(" .") and len(text) == len(places_)
    assert all(raw[i] == c or raw[i] in N.PUNCTUATION or (raw[i], c) == ("\t", " ") for c, i in zip(text, places_))


def test_candidates_of_records_equal_brute_force(spark, monkeypatch):
    """Lists of records that agree are compared once; each pair comes once, by keys or by cells, whatever it shares."""
    from granary.operators import resolution as R

    monkeypatch.setattr(L, "SLICE", 2)
    rng = random.Random(7)
    pick = lambda *v: rng.choice(v)
    rows = [(i, pick("Ann", None), "Lee", None, pick("1 2", "1  2", " ", None), pick("A@x", "a@X", None), pick("k", "", None), "Oak 1", pick(None, 1.01, 1.09, 1.3, -0.01), pick(2.0, 2.16, None)) for i in range(40)]
    records = spark.createDataFrame(rows, "id long, given string, family string, organization string, phone string, email string, address_key string, address_raw string, lat double, lon double")
    got = [(r["lo"], r["hi"]) for r in R.leveled(records, R.Model(), R.address_frequency(records)).collect()]
    key = lambda v: " ".join((v or "").split()).lower() or None
    cell = lambda v: math.floor(v / 0.05)
    near = lambda a, b: None not in (a[8], a[9], b[8], b[9]) and all(abs(cell(a[k]) - cell(b[k])) <= 2 for k in (8, 9))
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and (near(a, b) or any(key(a[k]) and key(a[k]) == key(b[k]) for k in (4, 5, 6)))}
    assert len(got) == len(set(got)) and set(got) == want and want


def plain_average(n, edges, threshold):
    """Average linkage as its definition has it: exact fractions, all pairs of clusters looked at before each merger."""
    from fractions import Fraction

    w = {frozenset(e[:2]): Fraction(e[2]) for e in edges}
    groups = [[i] for i in range(n)]
    while True:
        best = None
        for p in range(len(groups)):
            for q in range(p + 1, len(groups)):
                found = [w[frozenset((i, j))] for i in groups[p] for j in groups[q] if frozenset((i, j)) in w]
                if found and (best is None or sum(found) / len(found) > best[0]):
                    best = (sum(found) / len(found), p, q)
        if best is None or best[0] < Fraction(threshold):
            return [min(g) for i in range(n) for g in groups if i in g]
        groups[best[1]] += groups.pop(best[2])


def test_average_linkage_of_classes_equals_plain():
    """Ties, classes weaker within than without, and missing links: by rows and by classes as the plain way."""
    from granary.operators import clusters

    rng = random.Random(11)
    for _ in range(150):
        n, k = rng.randint(1, 11), rng.randint(1, 4)
        of = [rng.randrange(k) for _ in range(n)]
        values = rng.choice([(9.5, 6.25, 1.3, -1.5), (6.0, 4.0), (10.4, 6.23, 1.32)])
        links = {(i, j): rng.choice(values) for i in range(k) for j in range(i, k) if i == j or rng.random() < 0.8}
        edges = [(a, b, links[tuple(sorted((of[a], of[b])))]) for a in range(n) for b in range(a + 1, n) if tuple(sorted((of[a], of[b]))) in links]
        want = plain_average(n, edges, 5.0)
        assert clusters.merge_average(n, edges, 5.0).tolist() == want
        nodes, labels = clusters.merge_classes([np.array([i for i in range(n) if of[i] == c], dtype=int) for c in range(k)], links, 5.0)
        assert dict(zip(nodes.tolist(), labels.tolist())) == dict(enumerate(want))


def test_large_components_are_refined(spark):
    """100 rows that a weak bridge holds together come apart, by rows and by classes."""
    from granary.operators import clusters

    side = lambda i: i >= 50
    labels = spark.createDataFrame([(i, 0) for i in range(100)], "node long, label long")
    rows = [(a, b, 9.0 if side(a) == side(b) else 6.0 if (a, b) == (49, 50) else 1.0) for a in range(100) for b in range(a + 1, 100)]
    want = {i: 50 * side(i) for i in range(100)}
    found = lambda df: {r["node"]: r["label"] for r in df.collect()}
    assert found(clusters.refine(labels, spark.createDataFrame(rows, "a long, b long, weight double"), 5.0)) == want
    of = {i: 49 if i == 49 else 50 if i == 50 else 0 if i < 49 else 51 for i in range(100)}
    members = spark.createDataFrame([(i, c) for i, c in of.items()], "node long, _class long")
    links = [(0, 0, 9.0), (0, 49, 9.0), (50, 51, 9.0), (51, 51, 9.0), (49, 50, 6.0), (0, 50, 1.0), (0, 51, 1.0), (49, 51, 1.0)]
    assert found(clusters.refine_classes(members, spark.createDataFrame(links, "a long, b long, weight double"), labels, 5.0)) == want


def test_profiles_are_compared_once(spark):
    """Lists of records that agree in all but coordinates meet in many cells; their names are compared once a way, and a pair
    only takes the distance."""
    from granary.operators import resolution as R

    rows = [(i, "Ann" if i % 2 else "Anne", "Lee", None, None, None, None, "Oak 1", 1.0 + i * 0.01, 2.0) for i in range(60)]
    records = spark.createDataFrame(rows, "id long, given string, family string, organization string, phone string, email string, address_key string, address_raw string, lat double, lon double")
    model = R.Model()
    asked = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(a, b):
        asked.add(1)
        return 0 if a == b else 1

    given = R.Comparison("given", lambda a, b: counted(f"{a}given", f"{b}given"), (0.8, 0.15, 0.05), (0.01, 0.03, 0.96))
    counting = R.Model((given, *model.comparisons[1:]), frequency=None)
    got = [(r["lo"], r["hi"], r["l_given"], r["l_spatial"]) for r in R.scored(records, counting, None).collect()]
    km = lambda a, b: abs(a[8] - b[8]) * math.pi / 180 * 6371.0
    near = [(a, b) for a in rows for b in rows if a[0] < b[0] and abs(math.floor(a[8] / 0.05) - math.floor(b[8] / 0.05)) <= 2]
    assert sorted(got) == sorted((a[0], b[0], int(a[1] != b[1]), 1 + sum(km(a, b) > x for x in (0.05, 0.5, 5.0))) for a, b in near)
    assert asked.value == 8  # two profiles: four pairs at most, both ways round
