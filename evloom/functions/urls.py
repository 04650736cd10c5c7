"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.dims import TRACKING_KEYS

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):(?=.*)"


def _parts(url: Column) -> dict[str, Column]:
    scheme = F.lower(F.regexp_extract(url, _SCHEME, 1))
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*:", "")
    return {
        "scheme": scheme,
        "authority": F.regexp_extract(rest, r"^//([^/?#]*)", 1),
        "path": F.regexp_extract(rest, r"^(?://[^/?#]*)?([^?#]*)", 1),
        "query": F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1),
    }


def _host(authority: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(authority, r"(?:^|.*@)([^@:]*)(?::[^@]*)?$", 1)), r"^www\.", "")


def domain(url: Column) -> Column:
    """Host in lower case without `www.`; empty if there is none."""
    return _host(_parts(F.coalesce(url, F.lit("")))["authority"])


def _decode(x: Column) -> Column:
    return F.coalesce(F.try_url_decode(x), F.replace(x, F.lit("+"), F.lit(" ")))


def _encode(x: Column) -> Column:
    """Python's quote_plus: unlike Java's encoder it keeps ~ and not *."""
    return F.replace(F.replace(F.url_encode(x), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _query(query: Column, tracking: list[str]) -> Column:
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    split = F.transform(pairs, lambda p, i: F.struct(_decode(F.substring_index(p, "=", 1)).alias("k"), i.alias("i"), _decode(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)).alias("v")))
    kept = F.array_sort(F.filter(split, lambda x: ~F.lower(x["k"]).isin(tracking)))
    return F.array_join(F.transform(kept, lambda x: F.concat(_encode(x["k"]), F.lit("="), _encode(x["v"]))), "&")


def canonical(url: Column, tracking: list[str] = TRACKING_KEYS) -> Column:
    """A form under which variants of one page are equal.

    Scheme (https if there is none) and host in lower case, no user, no `www.`, no default port, no fragment, no `;parameters` of the last
    segment and no slashes at the path's end; the query decoded, without tracking keys, sorted by key (equal keys in
    their order) and encoded again. A port that is no number is dropped with its host kept.
    """
    p = _parts(url)
    scheme = F.when(p["scheme"] == "", "https").otherwise(p["scheme"])
    port = F.regexp_extract(p["authority"], r":(\d+)$", 1)
    default = (port == "") | ((scheme == "https") & (port == "443")) | ((scheme == "http") & (port == "80"))
    path = F.regexp_replace(F.regexp_replace(p["path"], r";[^/]*$", ""), "/+$", "")
    query = _query(p["query"], tracking)
    return F.concat(scheme, F.lit("://"), _host(p["authority"]), F.when(default, "").otherwise(F.concat(F.lit(":"), port)), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
