"""Links: canonical form, admission, host."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track (fixed values), besides those that begin with utm_.
TRACKING = ["from", "source", "ref", "referrer", "trackingid"]
LOCAL_ENDS = ["local", "internal", "localhost", "home", "lan"]


def _part(url: Column, part: str) -> Column:
    return F.try_parse_url(url, F.lit(part))


def host(url: Column) -> Column:
    return F.lower(_part(url, "HOST"))


def canonical_url(url: Column) -> Column:
    """http(s) links without credentials, tracking and blank parameters, fragment and last slashes; else ''.

    Scheme and authority are lower-cased, the parameters sorted by name and value and encoded anew."""
    pairs = F.transform(F.split(F.coalesce(_part(url, "QUERY"), F.lit("")), "&"), lambda p: F.struct(
        F.coalesce(F.try_url_decode(F.split(p, "=", 2)[0]), F.lit("")).alias("k"),
        F.coalesce(F.try_url_decode(F.try_element_at(F.split(p, "=", 2), F.lit(2))), F.lit("")).alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda p: (p["v"] != "") & ~F.lower(p["k"]).startswith("utm_") & ~F.lower(p["k"]).isin(TRACKING)))
    query = F.array_join(F.transform(kept, lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&")
    scheme = F.lower(_part(url, "PROTOCOL"))
    good = scheme.isin("http", "https") & (F.coalesce(_part(url, "HOST"), F.lit("")) != "") & _part(url, "USERINFO").isNull()
    out = F.concat(scheme, F.lit("://"), F.lower(_part(url, "AUTHORITY")), F.regexp_replace(F.coalesce(_part(url, "PATH"), F.lit("")), "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.coalesce(F.when(good, out), F.lit(""))


def admission(url: Column, restricted: list[str] | None = None) -> Column:
    """Why a link may not be fetched, or 'ok': the lexical part of admission, before any name is resolved."""
    h, port = F.rtrim(host(url), F.lit(".")), F.regexp_extract(F.coalesce(_part(url, "AUTHORITY"), F.lit("")), r":(\d+)$", 1)
    barred = F.lit(False)
    for domain in restricted or []:
        barred = barred | (h == domain) | h.endswith(f".{domain}")
    return (
        F.when(url.isNull() | (F.length(url) > 4096) | url.rlike(r"[\x00-\x20\\]"), "invalid")
        .when(F.coalesce(F.lower(_part(url, "PROTOCOL")) != "https", F.lit(True)) | ~port.isin("", "443"), "not_https")
        .when(_part(url, "USERINFO").isNotNull() | F.coalesce(h == "", F.lit(True)), "credentials_or_no_host")
        .when(~h.rlike(r"^[a-z0-9.-]+$") | ~h.contains(".") | ~h.rlike(r"\.[^.]*[a-z][^.]*$"), "address_or_local")
        .when(h.rlike(rf"\.({'|'.join(LOCAL_ENDS)})$"), "internal")
        .when(barred, "restricted")
        .otherwise("ok")
    )


def safe_link(url: Column) -> Column:
    """The link itself if it is http(s) with a host and without credentials, else ''."""
    good = F.lower(_part(url, "PROTOCOL")).isin("http", "https") & (F.coalesce(_part(url, "HOST"), F.lit("")) != "") & _part(url, "USERINFO").isNull()
    return F.coalesce(F.when(good, url), F.lit(""))


def split_links(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda x: x != "")


def slug_ok(value: Column) -> Column:
    return F.coalesce(value.rlike(r"\A[A-Za-z0-9_-]{1,100}\z"), F.lit(False))
