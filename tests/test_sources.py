"""Sources, sinks and streams by round trips."""
import json

import pytest
from pyspark.sql import functions as F

from granary.sources import readers as R
from granary.sources import sinks as W
from granary.streaming import streams as X


def put(path, text):
    path.write_text(text)
    return str(path)


def test_ban(spark, tmp_path):
    p = put(tmp_path / "a.csv", "id;numero;rep;nom_voie;code_postal;nom_commune\n1;5;bis;Rue  X;75001;Paris\n2;5;bis;rue x;75001;PARIS\n3;;;;;\n4;7;;Rue Y;75002;Paris\n5;5;bis;Rue  X;75001;Paris\n")
    rows = R.run_adapter(spark, "ban", p, "v1").collect()
    assert sorted(r["raw"] for r in rows) == ["5 bis Rue X, 75001 Paris", "5 bis rue x, 75001 PARIS", "7 Rue Y, 75002 Paris"]
    r = next(r for r in rows if r["raw"].startswith("7"))
    assert r["components"] == {"house_number": "7", "street": "Rue Y", "postcode": "75002", "locality": "Paris"}
    assert (r["country"], r["source"], r["corpus_version"], r["license"]) == ("FR", "ban", "v1", "Licence Ouverte 2.0") and r["source_id"].startswith("ban-")


def test_openaddresses_and_geonames(spark, tmp_path):
    feature = {"type": "Feature", "properties": {"hash": "h", "number": "1", "street": "Elm St", "unit": "", "city": "Ames", "region": "IA", "postcode": "50010"}, "geometry": {"type": "Point", "coordinates": [-93.6, 42.0]}}
    p = put(tmp_path / "a.geojson", json.dumps(feature) + "\n\n")
    assert [(r["raw"], r["components"]["postcode"]) for r in R.run_adapter(spark, "openaddresses", p, "v1").collect()] == [("1 Elm St, Ames, IA 50010", "50010")]
    line = R.read_geojson_lines(spark, p, "hash string").first()
    assert (line["lon"], line["lat"]) == (-93.6, 42.0)
    p = put(tmp_path / "p.txt", "DE\t10115\tBerlin\tBerlin\tBE\t\t\t\t\t52.5\t13.4\t4\n")
    assert [(r["raw"], r["country"]) for r in R.run_adapter(spark, "geonames_postal", p, "v1").collect()] == [("10115 Berlin, Berlin", "DE")]
    assert R.ADAPTERS.ids()[:3] == ["ban", "openaddresses", "geonames_postal"]


def test_delimited(spark, tmp_path):
    p = put(tmp_path / "a.tsv", "a\tb\n1\tx y\n2\t\n")
    assert [tuple(r) for r in R.read_delimited(spark, p).collect()] == [("1", "x y"), ("2", None)]
    bad = put(tmp_path / "b.csv", "a,b\n1,2\n1,2,3\n")
    with pytest.raises(Exception, match="MALFORMED"):
        R.read_delimited(spark, bad, "a int, b int", strict=True).collect()
    p = put(tmp_path / "c.csv", "h1,h2,h3,h4\n1,2,x,4\n")
    assert [tuple(r) for r in R.read_positional(spark, p, 4, {0: ("a", "int"), 2: ("c", "int"), 3: ("d", "string")}).collect()] == [(1, None, "4")]


def rows(spark, n=50):
    return spark.range(n).select(F.concat(F.lit("s-"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("source_id"), F.when(F.col("id") % 5 == 0, "val").otherwise("train").alias("split"), F.create_map(F.lit("k"), F.col("id").cast("string")).alias("components"))


def test_bad_rows_end_the_job(spark):
    good = spark.createDataFrame([("a", "id", "raw", "US", "x")], "source string, source_id string, raw string, country string, license string")
    assert R.checked(good, "a").first()["raw"] == "raw"
    with pytest.raises(Exception, match="bad row id: source,license"):
        R.checked(good.withColumn("license", F.lit(None).cast("string")), "b").collect()


def test_shards(spark, tmp_path):
    path = str(tmp_path / "out")
    table = W.write_shards(rows(spark), path, "v1", most=7).collect()
    assert sum(r["rows"] for r in table) == 50 and max(r["rows"] for r in table) <= 7
    assert {r["source_id"] for r in spark.read.parquet(path).collect()} == {r["source_id"] for r in rows(spark).collect()}
    again = W.write_shards(rows(spark, 3), path, "v2").collect()  # resumed: the manifest is there
    assert sorted(again) == sorted(table)
    made = W.overlay(spark, {"base": path}, str(tmp_path / "overlay.json"))
    assert made["parts"][0] | {"path": ""} == {"name": "base", "path": "", "rows": 50, "files": len(table), "first_id": "s-0000", "last_id": "s-0049"}
    assert json.loads(W.read_text(spark, str(tmp_path / "overlay.json"))) == made


def test_id_lists(spark, tmp_path):
    W.write_id_lists(rows(spark), str(tmp_path / "ids"))
    found = [x for f in sorted((tmp_path / "ids/train").glob("part-*")) for x in f.read_text().split()]
    assert found == sorted(found) and len(found) == 40


def test_typed_copy(spark, tmp_path):
    schema = "source_id string, span_starts array<int>, span_ends array<int>, span_tags array<string>"
    p = put(tmp_path / "a.json", json.dumps({"source_id": "a", "span_starts": [0, 3], "span_ends": [2, 5], "span_tags": ["x", "y"]}) + "\n")
    W.typed_copy(spark, p, str(tmp_path / "a"), schema)
    assert spark.read.parquet(str(tmp_path / "a")).first()["span_ends"] == [2, 5]
    for n, bad in enumerate(([[0, 1], [2, 5], ["x", "y"]], [[0], [2, 3], ["x"]], [[2], [2], ["x"]])):
        p = put(tmp_path / f"b{n}.json", json.dumps(dict(zip(("span_starts", "span_ends", "span_tags"), bad))) + "\n")
        with pytest.raises(Exception, match="spans out of order"):
            W.typed_copy(spark, p, str(tmp_path / f"b{n}"), schema)


def test_features(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5, 2.5), ("b", None, 2.5)], "hash string, lon double, lat double")
    W.write_features(df.select(W.feature(F.col("lon"), F.col("lat"), F.struct("hash")).alias("feature")), str(tmp_path / "f"))
    got = R.read_geojson_lines(spark, str(tmp_path / "f"), "hash string").collect()
    assert sorted((r["hash"], r["lon"], r["lat"]) for r in got if r["lon"]) == [("a", 1.5, 2.5)] and len(got) == 2


def test_stream_dedup_resumes(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    (tmp_path / "in").mkdir()
    put(tmp_path / "in/a.csv", "2024-01-01 00:00:00,x,1\n2024-01-01 00:00:10,x,2\n2024-01-01 00:00:20,y,3\n")
    stream = lambda: X.first_wins(X.read_stream(spark, source, "ts timestamp, k string, value double"), F.col("k"), "ts", "1 hour")
    X.run(stream(), out, check, "seen").awaitTermination()
    put(tmp_path / "in/b.csv", "2024-01-01 00:00:30,y,4\n2024-01-01 00:00:40,z,5\n")
    X.run(stream(), out, check).awaitTermination()
    got = [(r["k"], r["value"]) for r in spark.read.parquet(out).collect()]
    assert len(got) == 3 and sorted(k for k, _ in got) == ["x", "y", "z"] and ("z", 5.0) in got


def test_stream_windows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in/a.csv", "2024-01-01 00:00:00,x,1\n2024-01-01 00:00:10,x,2\n2024-01-01 00:02:00,x,3\n2024-01-01 01:00:00,x,9\n")
    rows = X.read_stream(spark, str(tmp_path / "in"), "ts timestamp, k string, value double")
    for n, (made, expected) in enumerate(((X.window_counts(rows, "ts", "1 minute", "1 minute", "k"), [1, 2]), (X.sessions(rows, "ts", "30 seconds", "1 minute", "k"), [1, 2]))):
        X.run(made.select("k", "n"), str(tmp_path / f"o{n}"), str(tmp_path / f"c{n}")).awaitTermination()
        assert sorted(r["n"] for r in spark.read.parquet(str(tmp_path / f"o{n}")).collect()) == expected
