"""Sources and sinks end to end: each query writes a file of the source's format to the shared folder and reads it back."""
from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators.lineage import folder
from granary.plans.registry import query
from granary.plans.tables import ADDRESSES, addresses
from granary.sources import adapters_us as A
from granary.sources import readers as R

_RAW = "house_number || ' ' || trim(street) || ', ' || locality || ', ' || region || ' ' || postcode"


def _file(spark, d, columns: dict, name: str, sep: str = ",") -> str:
    """The addresses as a delimited file with these headers."""
    path = folder(spark, name)
    addresses(spark, d).select(*[c.alias(k) for k, c in columns.items()]).write.option("header", True).option("sep", sep).option("escape", '"').csv(path)
    return path


def _rows(spark, d, name: str, columns: dict):
    out = R.run_adapter(spark, name, _file(spark, d, columns, name), "v1")
    return out.select("raw", "country", "license", F.element_at("components", F.lit("street")).alias("street"), F.element_at("components", F.lit("venue")).alias("venue"))


def _line():
    return F.concat_ws(" ", "house_number", F.trim("street"))


_PUBLIC = "'US' AS country, 'Public Domain' AS license, trim(street) AS street"


@query("src_nppes", f"SELECT DISTINCT 'Clinic ' || (id % 9) || ', ' || {_RAW} AS raw, {_PUBLIC}, 'Clinic ' || (id % 9) AS venue FROM {ADDRESSES}")
def src_nppes(spark, d):
    a = "Provider Business Practice Location Address "
    return _rows(spark, d, "usgov_nppes", {
        "NPI": F.col("id"), "Provider Organization Name (Legal Business Name)": F.concat(F.lit("Clinic "), (F.col("id") % 9).cast("string")), "Provider Last Name (Legal Name)": F.lit(""), "Provider First Name": F.lit(""),
        "Provider First Line Business Practice Location Address": _line(), "Provider Second Line Business Practice Location Address": F.lit(""), a + "City Name": F.col("locality"), a + "State Name": F.col("region"), a + "Postcode": F.col("postcode"),
    })


@query("src_hrsa", f"SELECT DISTINCT 'Site, \"A\"' || ', ' || {_RAW} AS raw, {_PUBLIC}, 'Site, \"A\"' AS venue FROM {ADDRESSES}")
def src_hrsa(spark, d):
    return _rows(spark, d, "usgov_hrsa_fqhc", {"Site ID": F.col("id"), "Site Name": F.lit('Site, "A"'), "Site Address": _line(), "Site City": F.col("locality"), "Site State Abbreviation": F.col("region"), "Site Postal Code": F.col("postcode")})


@query("src_imls", f"SELECT DISTINCT 'Library, ' || {_RAW} AS raw, {_PUBLIC}, 'Library' AS venue FROM {ADDRESSES}")
def src_imls(spark, d):
    return _rows(spark, d, "usgov_imls_pls", {"FSCSKEY": F.col("id"), "LIBNAME": F.lit("Library"), "ADDRESS": _line(), "CITY": F.col("locality"), "STABR": F.col("region"), "ZIP": F.col("postcode"), "CNTY": F.lit("Lane")})


@query("src_irs", f"SELECT DISTINCT CASE WHEN id % 3 = 0 THEN 'Fund, PO Box ' || house_number || ', ' || locality || ', ' || region || ' ' || postcode ELSE 'Fund, ' || {_RAW} END AS raw, 'US' AS country, 'Public Domain' AS license, CASE WHEN id % 3 <> 0 THEN trim(street) END AS street, 'Fund' AS venue FROM {ADDRESSES}")
def src_irs(spark, d):
    line = F.when(F.col("id") % 3 == 0, F.concat_ws(" ", F.lit("PO Box"), "house_number")).otherwise(_line())
    return _rows(spark, d, "usgov_irs_bmf", {"EIN": F.col("id"), "NAME": F.lit("Fund"), "STREET": line, "CITY": F.col("locality"), "STATE": F.col("region"), "ZIP": F.concat_ws("-", "postcode", F.lit("0001"))})


@query("src_samhsa", f"SELECT DISTINCT 'Hope House West, ' || house_number || ' ' || trim(street) || ' Floor 2, ' || locality || ', ' || region || ' ' || postcode AS raw, 'US' AS country, 'Public Domain' AS license, trim(street) || ' Floor 2' AS street, 'Hope House West' AS venue FROM {ADDRESSES}")
def src_samhsa(spark, d):
    return _rows(spark, d, "usgov_samhsa", {"frid": F.col("id"), "name1": F.lit("Hope House"), "name2": F.lit(" West"), "street1": _line(), "street2": F.lit("Floor 2"), "city": F.col("locality"), "state": F.col("region"), "zip": F.col("postcode")})


@query("src_state_lists", f"SELECT DISTINCT 'Builder, ' || {_RAW} AS raw, {_PUBLIC}, 'Builder' AS venue FROM {ADDRESSES} WHERE id % 4 <> 0")
def src_state_lists(spark, d):
    """Rows without a town name no place and are left out."""
    town = F.when(F.col("id") % 4 != 0, F.col("locality"))
    return _rows(spark, d, "state_ia_contractors", {"Registration #": F.col("id"), "Business Name": F.lit("Builder"), "Address 1": _line(), "Address 2": F.lit(" "), "City": town, "State": F.col("region"), "Zip Code": F.col("postcode")})


@query("src_nad", f"SELECT DISTINCT house_number || ' N Oak St, ' || locality || ', ' || region || ' ' || postcode || '-1234' AS raw, 'US' AS country, 'Public Domain' AS license, 'Oak' AS street, CAST(NULL AS VARCHAR) AS venue FROM {ADDRESSES}")
def src_nad(spark, d):
    blank = {k: F.lit("") for k in "AddNum_Pre AddNum_Suf AddNo_Full St_PreMod St_PreTyp St_PreSep St_PosDir St_PosMod StNam_Full Building Floor Unit Room Seat LandmkName Inc_Muni Uninc_Comm Census_Plc".split()}
    return _rows(spark, d, "usgov_nad", {"UUID": F.col("id"), "Add_Number": F.col("house_number"), "St_PreDir": F.lit("N"), "St_Name": F.lit("Oak"), "St_PosTyp": F.lit("St"), "Post_City": F.col("locality"), "State": F.col("region"), "Zip_Code": F.col("postcode"), "Plus_4": F.lit("1234"), **blank})


@query("src_overture", f"SELECT DISTINCT house_number || ' ' || trim(street) || ', ' || postcode || ' ' || CASE WHEN id % 2 = 0 THEN locality ELSE region END AS raw, country, 'CDLA-Permissive-2.0' AS license, trim(street) AS street, CAST(NULL AS VARCHAR) AS venue FROM {ADDRESSES}")
def src_overture(spark, d):
    path = folder(spark, "overture")
    level = lambda c: F.struct(F.col(c).alias("value"))
    a = addresses(spark, d).select(F.col("id").cast("string").alias("id"), F.col("house_number").alias("number"), F.trim("street").alias("street"), F.lit(None).cast("string").alias("unit"), "postcode", F.when(F.col("id") % 2 == 0, F.col("locality")).otherwise(" ").alias("postal_city"), F.array(level("country"), level("region")).alias("address_levels"), F.lower("country").alias("country"))
    a.write.partitionBy("country").parquet(path)
    out = R.run_adapter(spark, "overture", path, "v1")
    return out.select("raw", "country", "license", F.element_at("components", F.lit("street")).alias("street"), F.element_at("components", F.lit("venue")).alias("venue"))


@query("src_inferred_types", f"SELECT id, CAST(house_number AS BIGINT) AS house_number, CAST(NULL AS VARCHAR) AS empty, id / 4.0 AS quarter, locality FROM {ADDRESSES}")
def src_inferred_types(spark, d):
    """A delimited file without a schema; types by a sample, names in one style."""
    path = _file(spark, d, {"Id": F.col("id"), "houseNumber": F.col("house_number"), "Empty!": F.lit("N/A"), "quarter": (F.col("id") / 4).cast("decimal(20,2)"), "Locality": F.col("locality")}, "typed")
    return A.inferred(R.read_delimited(spark, path))


@query("src_gnaf", f"SELECT CAST(id AS VARCHAR) AS id, house_number || '-' || house_number || 'A' AS number, 'OAK ST' AS street, 'TOWN ' || (id % 7) AS locality, 'NSW' AS region, postcode FROM {ADDRESSES} WHERE id % 10 <> 0")
def src_gnaf(spark, d):
    """Five joined files; retired rows are left out."""
    a, none = addresses(spark, d), F.lit("")
    key = F.col("id").cast("string")
    details = a.select(key.alias("ADDRESS_DETAIL_PID"), F.lit("S1").alias("STREET_LOCALITY_PID"), (F.col("id") % 7).cast("string").alias("LOCALITY_PID"), F.col("house_number").alias("NUMBER_FIRST"), none.alias("NUMBER_FIRST_SUFFIX"), F.col("house_number").alias("NUMBER_LAST"), F.lit("A").alias("NUMBER_LAST_SUFFIX"), F.col("postcode").alias("POSTCODE"), F.when(F.col("id") % 10 == 0, "2001-01-01").otherwise("").alias("DATE_RETIRED"))
    streets = spark.createDataFrame([("S1", "OAK", "ST", "")], "STREET_LOCALITY_PID string, STREET_NAME string, STREET_TYPE_CODE string, DATE_RETIRED string")
    towns = spark.createDataFrame([(str(i), f"TOWN {i}", "1", "") for i in range(7)], "LOCALITY_PID string, LOCALITY_NAME string, STATE_PID string, DATE_RETIRED string")
    states = spark.createDataFrame([("1", "NSW", "")], "STATE_PID string, STATE_ABBREVIATION string, DATE_RETIRED string")
    places = a.select(key.alias("ADDRESS_DETAIL_PID"), F.lit("-33.8").alias("LATITUDE"), F.lit("151.2").alias("LONGITUDE"), none.alias("DATE_RETIRED"))
    out = A.assemble_gnaf(details, streets, towns, states, places)
    return out.drop("lat", "lon")
