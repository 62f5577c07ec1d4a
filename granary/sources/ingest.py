"""Tables with unknown headers: roles of columns by their words, and rows as records."""
from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions import names as N
from granary.functions import text as T

# Words of headers by role, in the order in which roles are tried; and which roles take one column.
WORDS = {
    "email": "email|e mail", "phone": "phone|telephone|tel|mobile|cell", "id": "id|npi|ein|frn|spin|uuid|guid|key",
    "organization": "org|organization|organisation|company|business|facility|agency|employer",
    "address": "street|address|addr|city|town|state|province|zip|zipcode|postal|postcode|county", "name": "name|first|last|given|family|middle|surname|fullname|contact",
}
SINGLE = ("email", "phone", "id")


def infer_mapping(header: Sequence[str]) -> dict[str, list[str]]:
    """role -> columns. A column has one role: the first whose words it has, unless a role of one column is taken."""
    out: dict[str, list[str]] = {}
    for column in header:
        words = f" {re.sub('[^a-z0-9]+', ' ', column.lower()).strip()} "
        for role, known in WORDS.items():
            if any(f" {w} " in words for w in known.split("|")) and not (role in SINGLE and role in out):
                if role != "organization" or role not in out:
                    out.setdefault(role, []).append(column)
                break
    return out


def records(df: DataFrame, mapping: Mapping[str, Sequence[str]], attributes: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """id, name, organization, phone, email, address, attributes, raw of each row; blank fields are null.

    Without an id column, or where it is blank, the id is a number of the row. raw: the row as a map of texts.
    """
    from pyspark.sql import Column

    def one(role: str, separator: str = " ") -> Column:
        return T.pick([f"`{c}`" for c in mapping[role]], separator) if mapping.get(role) else F.lit(None).cast("string")

    number = F.monotonically_increasing_id().cast("string")
    extra = F.create_map(*[x for k, v in (attributes or {}).items() for x in (F.lit(k), T.pick([f"`{c}`" for c in v]))]) if attributes else F.lit(None).cast("map<string,string>")
    raw = F.create_map(*[x for c in df.columns for x in (F.lit(c), F.col(f"`{c}`").cast("string"))])
    return df.select(
        F.coalesce(one("id"), number).alias("id"), N.person_name(one("name")).alias("name"), N.organization_name(one("organization")).alias("organization"),
        one("phone").alias("phone"), F.lower(one("email")).alias("email"), one("address", ", ").alias("address"), extra.alias("attributes"), raw.alias("raw"),
    )
