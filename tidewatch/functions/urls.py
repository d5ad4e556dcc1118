"""Url normalisation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidewatch import vocab as V


def _reencode(value: Column) -> Column:
    out = F.url_encode(F.coalesce(F.try_url_decode(value), value))
    return F.replace(F.replace(out, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


# one query pair that is empty or only tracks the reader, with the separator after it
DROPPED_PAIR = r"(?i)(?<=&|^\?)(?:(?:utm_[^=&]*|" + "|".join(V.TRACKING_PARAMS) + r")(?:=[^&]*)?)?(?:&|$)"


def normalize_url(url: Column, strict: bool = False) -> Column:
    """Drop the fragment and tracking parameters, keep the others in order.

    The kept pairs stay as written; ``strict`` decodes and encodes each of them again, which also
    turns a bare ``a`` into ``a=``.
    """
    page = F.substring_index(url, "#", 1)
    base = F.substring_index(page, "?", 1)
    query = F.regexp_replace(F.regexp_replace(F.substring(page, F.length(base) + 1, F.length(page)), DROPPED_PAIR, ""),
                             r"&$|^\?$", "")
    if strict:
        def pair(p: Column) -> Column:
            key = F.substring_index(p, "=", 1)
            return F.concat(_reencode(key), F.lit("="), _reencode(F.substring(p, F.length(key) + 2, F.length(p))))

        pairs = F.transform(F.split(F.substring(query, F.lit(2), F.length(query)), "&", -1), pair)
        query = F.when(query == "", "").otherwise(F.concat(F.lit("?"), F.array_join(pairs, "&")))
    return F.concat(base, query)


def resolve_href(href: Column, page_url: Column) -> Column:
    """Absolute form of a link found on a page."""
    origin = F.regexp_extract(page_url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(page_url, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    bare = F.regexp_replace(page_url, r"[?#].*$", "")
    folder = F.when(F.length(bare) <= F.length(origin), F.concat(origin, F.lit("/"))).otherwise(
        F.regexp_replace(bare, r"[^/]*$", ""))
    return (F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
            .when(F.startswith(href, F.lit("//")), F.concat(scheme, href))
            .when(F.startswith(href, F.lit("/")), F.concat(origin, href))
            .when(F.startswith(href, F.lit("#")), F.concat(F.substring_index(page_url, "#", 1), href))
            .when(F.startswith(href, F.lit("?")), F.concat(bare, href))
            .when(href == "", page_url)
            .otherwise(F.concat(folder, href)))
