"""American public lists as canonical rows: venues, contractors, schools, notaries, providers, addresses, and Overture."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.functions.shape import us_street_parts
from granary.sources.readers import ADAPTERS, Adapter, read_delimited

# Postal abbreviations of states and what they stand for.
STATES = dict(x.split(":") for x in (
    "AL:Alabama|AK:Alaska|AZ:Arizona|AR:Arkansas|CA:California|CO:Colorado|CT:Connecticut|DE:Delaware|DC:District of Columbia|FL:Florida|GA:Georgia|HI:Hawaii|ID:Idaho|IL:Illinois|IN:Indiana|IA:Iowa|KS:Kansas|"
    "KY:Kentucky|LA:Louisiana|ME:Maine|MD:Maryland|MA:Massachusetts|MI:Michigan|MN:Minnesota|MS:Mississippi|MO:Missouri|MT:Montana|NE:Nebraska|NV:Nevada|NH:New Hampshire|NJ:New Jersey|NM:New Mexico|NY:New York|"
    "NC:North Carolina|ND:North Dakota|OH:Ohio|OK:Oklahoma|OR:Oregon|PA:Pennsylvania|RI:Rhode Island|SC:South Carolina|SD:South Dakota|TN:Tennessee|TX:Texas|UT:Utah|VT:Vermont|VA:Virginia|WA:Washington|"
    "WV:West Virginia|WI:Wisconsin|WY:Wyoming|PR:Puerto Rico|GU:Guam|VI:Virgin Islands|AS:American Samoa|MP:Northern Mariana Islands").split("|"))


def state(c: Column) -> Column:
    """The abbreviation of a state's abbreviation or name; null for anything else."""
    known = {k.lower(): k for k in STATES} | {v.lower(): k for k, v in STATES.items()}
    return F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), F.lower(F.trim(c)))


def _text(name: str) -> Column:
    return F.coalesce(F.trim(F.col(f"`{name}`")), F.lit(""))


def _listed(name: str, read, venue: Column, line: Column, town: Column, region: Column, code: Column, identity: tuple[str, ...], county: Column | None = None, box: bool = False) -> Adapter:
    """An adapter of a list with a venue and a street line. Rows without a line, town, state or code give no raw text,
    and are left out."""
    split = T.street_line(line)
    is_box = F.regexp_like(line, F.lit(T.PO_BOX)) if box else F.lit(False)
    street = F.when(~is_box, split["street"])
    number = F.when(~is_box, split["house_number"])
    whole = (F.trim(line) != "") & (town != "") & region.isNotNull() & (code != "")
    named = T.empty_to_null(venue)
    place = F.concat_ws(", ", T.empty_to_null(town), T.empty_to_null(F.concat_ws(" ", region, T.empty_to_null(code))))
    raw = F.when(whole, F.concat_ws(", ", named, F.coalesce(F.when(is_box, line), F.concat_ws(" ", number, street)), place)).otherwise("")
    parts = {"venue": named, "house_number": number, "street": street, "po_box": F.when(is_box, F.trim(line)), "locality": town, "region": region, "postcode": code}
    if county is not None:
        parts["subregion"] = county
    return Adapter(name, read, parts, raw, F.lit("US"), "Public Domain", identity, F.lit("en-US"))


@ADAPTERS.add
def usgov_nppes() -> Adapter:
    """Health care providers by their practice address; an organization's name, or a person's."""
    a = "Provider Business Practice Location Address "
    venue = F.coalesce(T.empty_to_null(_text("Provider Organization Name (Legal Business Name)")), F.concat_ws(" ", T.empty_to_null(_text("Provider First Name")), T.empty_to_null(_text("Provider Last Name (Legal Name)"))))
    line = F.concat_ws(" ", T.empty_to_null(_text("Provider First Line Business Practice Location Address")), T.empty_to_null(_text("Provider Second Line Business Practice Location Address")))
    return _listed("usgov_nppes", lambda s, p: read_delimited(s, p), venue, line, _text(a + "City Name"), state(_text(a + "State Name")), _text(a + "Postcode"), ("NPI",))


@ADAPTERS.add
def usgov_hrsa_fqhc() -> Adapter:
    """Health centers."""
    return _listed("usgov_hrsa_fqhc", lambda s, p: read_delimited(s, p), _text("Site Name"), _text("Site Address"), _text("Site City"), state(_text("Site State Abbreviation")), _text("Site Postal Code"), ("Site ID",))


@ADAPTERS.add
def usgov_imls_pls() -> Adapter:
    """Public libraries, with their county."""
    return _listed("usgov_imls_pls", lambda s, p: read_delimited(s, p), _text("LIBNAME"), _text("ADDRESS"), _text("CITY"), state(_text("STABR")), _text("ZIP"), ("FSCSKEY",), _text("CNTY"))


@ADAPTERS.add
def usgov_irs_bmf() -> Adapter:
    """Exempt organizations; a box number stands where others have a street. The postcode's last four digits go."""
    return _listed("usgov_irs_bmf", lambda s, p: read_delimited(s, p), _text("NAME"), _text("STREET"), _text("CITY"), F.nullif(_text("STATE"), F.lit("")), F.trim(F.get(F.split(_text("ZIP"), "-"), F.lit(0))), ("EIN",), box=True)


@ADAPTERS.add
def usgov_samhsa() -> Adapter:
    """Treatment facilities: names and streets of two lines each."""
    two = lambda a, b: F.concat_ws(" ", T.empty_to_null(_text(a)), T.empty_to_null(_text(b)))
    return _listed("usgov_samhsa", lambda s, p: read_delimited(s, p), two("name1", "name2"), two("street1", "street2"), _text("city"), state(_text("state")), _text("zip"), ("frid",))


@ADAPTERS.add
def state_hi_schools() -> Adapter:
    """Schools of Hawaii; a postcode that lost its zero gets it back."""
    code = F.when(F.regexp_like(_text("zip"), F.lit("^[0-9]{4}$")), F.concat(F.lit("0"), _text("zip"))).otherwise(_text("zip"))
    return _listed("state_hi_schools", lambda s, p: read_delimited(s, p), _text("name"), _text("address"), _text("city"), F.lit("HI"), code, ("code",))


@ADAPTERS.add
def state_ia_contractors() -> Adapter:
    """Contractors of Iowa."""
    line = F.concat_ws(" ", T.empty_to_null(_text("Address 1")), T.empty_to_null(_text("Address 2")))
    return _listed("state_ia_contractors", lambda s, p: read_delimited(s, p), _text("Business Name"), line, _text("City"), state(_text("State")), _text("Zip Code"), ("Registration #",))


@ADAPTERS.add
def state_ny_notaries() -> Adapter:
    """Notaries of New York at their business, if they name one, with the county of their commission."""
    venue = F.coalesce(T.empty_to_null(_text("Business Name (if available)")), _text("Commission Holder Name"))
    line = F.concat_ws(" ", *[T.empty_to_null(_text(f"Business Address {i} (if available)")) for i in (1, 2)])
    return _listed("state_ny_notaries", lambda s, p: read_delimited(s, p), venue, line, _text("Business City (if available)"), state(_text("Business State (if available)")), _text("Business Zip (if available)"), ("Commission Number (UID)",), _text("Commissioned County"))


@ADAPTERS.add
def usgov_nad() -> Adapter:
    """The national address list: numbers of three parts, street names of up to seven, the first of several towns."""
    join = lambda *names: F.concat_ws(" ", *[T.empty_to_null(_text(n)) for n in names])
    number = F.coalesce(T.empty_to_null(_text("AddNo_Full")), T.empty_to_null(F.concat(_text("AddNum_Pre"), _text("Add_Number"), _text("AddNum_Suf"))))
    prefix, suffix = join("St_PreMod", "St_PreDir", "St_PreTyp", "St_PreSep"), join("St_PosTyp", "St_PosDir", "St_PosMod")
    full = F.coalesce(T.empty_to_null(_text("StNam_Full")), T.empty_to_null(F.concat_ws(" ", T.empty_to_null(prefix), T.empty_to_null(_text("St_Name")), T.empty_to_null(suffix))))
    town = F.coalesce(*[T.empty_to_null(_text(n)) for n in ("Post_City", "Inc_Muni", "Uninc_Comm", "Census_Plc")])
    code = F.when(_text("Plus_4") != "", F.concat_ws("-", _text("Zip_Code"), _text("Plus_4"))).otherwise(_text("Zip_Code"))
    region, venue, unit = state(_text("State")), T.empty_to_null(_text("LandmkName")), T.empty_to_null(join("Building", "Floor", "Unit", "Room", "Seat"))
    named = _text("St_Name") != ""
    whole = town.isNotNull() & region.isNotNull() & (_text("Zip_Code") != "")
    line = T.empty_to_null(F.concat_ws(" ", number, full, unit))
    raw = F.when(whole, F.concat_ws(", ", venue, line, F.concat(town, F.lit(", "), region, F.lit(" "), code))).otherwise("")
    parts = {"venue": venue, "house_number": number, "street_prefix": F.when(named, prefix), "street": F.when(named, _text("St_Name")).otherwise(full), "street_suffix": F.when(named, suffix), "unit": unit, "locality": town, "region": region, "postcode": code}
    return Adapter("usgov_nad", lambda s, p: read_delimited(s, p), parts, raw, F.lit("US"), "Public Domain", ("UUID",), F.lit("en-US"))


@ADAPTERS.add
def tiger() -> Adapter:
    """Road names of the census, extracted to columns, cut into prefix, name and suffix."""
    p = us_street_parts(F.col("FULLNAME"))
    parts = {"street_prefix": p["prefix"], "street": p["street"], "street_suffix": p["suffix"], "postcode": _text("ZIPL"), "region": state(_text("STATE"))}
    raw = F.concat_ws(", ", T.empty_to_null(_text("FULLNAME")), T.empty_to_null(F.concat_ws(" ", state(_text("STATE")), T.empty_to_null(_text("ZIPL")))))
    return Adapter("tiger", lambda s, path: read_delimited(s, path), parts, F.when(_text("FULLNAME") != "", raw).otherwise(""), F.lit("US"), "Public Domain", ("LINEARID", "ZIPL"), F.lit("en-US"))


@ADAPTERS.add
def overture() -> Adapter:
    """Address rows of Parquet: the town is the postal one, or the innermost filled level."""
    level = F.element_at(F.filter(F.col("address_levels"), lambda x: F.coalesce(F.trim(x["value"]), F.lit("")) != ""), -1)["value"]
    town = F.coalesce(T.empty_to_null(F.col("postal_city")), level)
    region = F.when(F.size("address_levels") > 1, F.get("address_levels", F.lit(0))["value"])
    parts = {"house_number": F.col("number"), "street": F.col("street"), "unit": F.col("unit"), "locality": town, "region": region, "postcode": F.col("postcode")}
    raw = F.concat_ws(", ", T.empty_to_null(F.concat_ws(" ", T.empty_to_null(F.col("number")), T.empty_to_null(F.col("street")))), T.empty_to_null(F.concat_ws(" ", T.empty_to_null(F.col("postcode")), town)))
    return Adapter("overture", lambda s, p: s.read.parquet(p), parts, raw, F.upper("country"), "CDLA-Permissive-2.0", ("id",))


@ADAPTERS.add
def geonames_places() -> Adapter:
    """Places of the tab-separated list, without a header."""
    names = "geonameid name asciiname alternatenames lat lon feature_class feature_code country cc2 admin1 admin2 admin3 admin4 population elevation dem timezone modified".split()
    schema = ", ".join(f"{n} string" for n in names)
    place = F.col("feature_class") == "P"
    return Adapter("geonames_places", lambda s, p: read_delimited(s, p, schema, "\t", header=False), {"locality": F.when(place, F.col("name")), "region": F.when(~place, F.col("name"))}, F.col("name"), F.col("country"), "CC-BY-4.0", ("geonameid",))


# --- files with schemas to be found, and joined files

NULLS = ("", "null", "NULL", "N/A", "n/a", "-", "<UNAVAIL>")


def inferred(df: DataFrame, sample: int = 100) -> DataFrame:
    """Text columns cast by a sample: real if half of the values have a fraction, else whole if half are numbers, else text.

    Values that say "missing" are null and count neither way; those that don't fit the type found become null. Names are
    lower case words joined by underscores; a name that repeats gets a number.
    """
    import re

    texts = df.select(*[F.when(F.trim(c).isin(*NULLS), None).otherwise(F.trim(c)).alias(c) for c in (f"`{x}`" for x in df.columns)]).toDF(*df.columns) if df.columns else df
    some = texts.limit(sample)
    counts = some.agg(*[x for i, c in enumerate(df.columns) for x in (
        F.count(f"`{c}`").alias(f"n{i}"), F.count_if(F.regexp_like(f"`{c}`", F.lit("^[+-]?[0-9]*\\.[0-9]+$"))).alias(f"r{i}"), F.count_if(F.regexp_like(f"`{c}`", F.lit("^[+-]?[0-9]+$"))).alias(f"i{i}"))]).first()
    out, seen = [], {}
    for i, c in enumerate(df.columns):
        n, r, w = counts[f"n{i}"], counts[f"r{i}"], counts[f"i{i}"]
        kind = "double" if n and 2 * r >= n else "bigint" if n and 2 * w >= n else "string"
        name = re.sub("[^a-z0-9]+", "_", re.sub("([a-z0-9])([A-Z])", r"\1_\2", c).lower()).strip("_") or "column"
        seen[name] = seen.get(name, 0) + 1
        out.append(F.col(f"`{c}`").try_cast(kind).alias(name if seen[name] == 1 else f"{name}_{seen[name]}"))
    return texts.select(*out)


def read_zipped(spark: SparkSession, path: str, member: str) -> DataFrame:
    """Rows of a delimited member of a zip file by its header, as a map of texts. One task reads a file, line by line."""
    import csv
    import io
    import zipfile
    from collections.abc import Iterator

    import pyarrow as pa

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                with zipfile.ZipFile(io.BytesIO(content.as_buffer().to_pybytes())) as z, z.open(member) as f:
                    held = []
                    for row in csv.DictReader(io.TextIOWrapper(f, "utf-8", newline="")):
                        held.append([(k, v) for k, v in row.items() if k is not None and v is not None])
                        if len(held) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(held, pa.map_(pa.string(), pa.string()))], names=["row"])
                            held = []
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.map_(pa.string(), pa.string()))], names=["row"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, "row map<string,string>")


def assemble_gnaf(details: DataFrame, streets: DataFrame, localities: DataFrame, states: DataFrame, geocodes: DataFrame) -> DataFrame:
    """Australian addresses out of their five files: number, street, town, state, postcode, lat, lon of live rows."""
    live = lambda df: df.filter(F.coalesce(F.trim("DATE_RETIRED"), F.lit("")) == "")
    a = live(details).join(live(streets).select("STREET_LOCALITY_PID", "STREET_NAME", "STREET_TYPE_CODE"), "STREET_LOCALITY_PID")
    a = a.join(live(localities).select("LOCALITY_PID", "LOCALITY_NAME", "STATE_PID"), "LOCALITY_PID").join(F.broadcast(live(states).select("STATE_PID", "STATE_ABBREVIATION")), "STATE_PID")
    a = a.join(live(geocodes).select("ADDRESS_DETAIL_PID", "LATITUDE", "LONGITUDE"), "ADDRESS_DETAIL_PID", "left")
    first, last = F.concat(_text("NUMBER_FIRST"), _text("NUMBER_FIRST_SUFFIX")), F.concat(_text("NUMBER_LAST"), _text("NUMBER_LAST_SUFFIX"))
    number = F.concat_ws("-", T.empty_to_null(first), T.empty_to_null(last))
    return a.select(F.col("ADDRESS_DETAIL_PID").alias("id"), number.alias("number"), F.concat_ws(" ", "STREET_NAME", T.empty_to_null(F.col("STREET_TYPE_CODE"))).alias("street"), F.col("LOCALITY_NAME").alias("locality"), F.col("STATE_ABBREVIATION").alias("region"), F.col("POSTCODE").alias("postcode"), F.col("LATITUDE").try_cast("double").alias("lat"), F.col("LONGITUDE").try_cast("double").alias("lon"))
