"""URL canonicalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

URL_PARTS = r"(?s)^([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def _encoded(text: Column) -> Column:
    # The form encoding leaves `*` and escapes `~`; query strings elsewhere do the opposite.
    out = F.url_encode(text)
    return F.replace(F.replace(out, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column, keep: str = "jk") -> Column:
    """The URL with only the `keep` query values left, in order; blanks go, the fragment stays."""
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
    base = F.regexp_extract(url, URL_PARTS, 1)
    base = F.concat(F.lower(scheme), F.substr(base, F.length(scheme) + 1))
    pairs = F.split(F.regexp_extract(url, URL_PARTS, 2), "&")
    fragment = F.regexp_extract(url, URL_PARTS, 3)

    def value(pair: Column) -> Column:
        return F.regexp_extract(pair, r"(?s)^[^=]*=(.*)$", 1)

    wanted = F.filter(
        pairs,
        lambda p: (_decoded(F.substring_index(p, "=", 1)) == keep) & (value(p) != ""),
    )
    query = F.array_join(
        F.transform(wanted, lambda p: F.concat(F.lit(f"{keep}="), _encoded(_decoded(value(p))))),
        "&",
    )
    return F.concat(
        base,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""),
    )
