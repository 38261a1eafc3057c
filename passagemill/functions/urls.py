"""Url functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WHITESPACE

# Schemes whose last segment may have parameters.
WITH_PARAMETERS = "ftp|hdl|prospero|http|https|shttp|rtsp|rtspu|sip|sips|mms|sftp|tel"
# What stands between the scheme and the query.
_PLACE = r"(?s)^[^:]*:(?://[^/?]*)?"


def _whole(url: Column) -> Column:
    """Without white space around it and fragment; https where there is no scheme."""
    said = F.regexp_replace(F.coalesce(url, F.lit("")), rf"^{WHITESPACE}|{WHITESPACE}$", "")
    return F.regexp_replace(F.regexp_replace(said, r"^(?![A-Za-z][A-Za-z0-9+.-]*:)", "https://"), r"(?s)#.*$", "")


def parts(url: Column) -> dict[str, Column]:
    """Scheme, place (host and port), path and query of a url; a missing scheme is https."""
    whole = _whole(url)
    return {
        "scheme": F.lower(F.regexp_extract(whole, r"^([^:]*)", 1)),
        "place": F.lower(F.regexp_extract(whole, r"(?s)^[^:]*://([^/?]*)", 1)),
        "path": F.regexp_extract(whole, _PLACE + r"([^?]*)", 1),
        "query": F.regexp_extract(whole, _PLACE + r"[^?]*\?(.*)$", 1),
    }


def normalize_url(url: Column) -> Column:
    """Lower-case scheme and place, ``/`` for no path, the query, no fragment, no parameters of the last segment where
    the scheme has any; empty stays empty."""
    whole = _whole(url)
    front = F.lower(F.concat(F.regexp_extract(whole, r"^([^:]*)", 1), F.lit("://"), F.regexp_extract(whole, r"(?s)^[^:]*://([^/?]*)", 1)))
    path = F.regexp_replace(F.regexp_extract(whole, _PLACE + r"([^?]*)", 1), "^$", "/")
    said = F.regexp_replace(F.concat(front, path), rf"(?s)^((?:{WITH_PARAMETERS})://.*?);[^/]*$", "$1")
    return F.when(F.trim(F.regexp_replace(F.coalesce(url, F.lit("")), WHITESPACE, " ")) == "", "").otherwise(F.concat(said, F.regexp_extract(whole, _PLACE + r"[^?]*(\?.+)$", 1)))


def host(url: Column) -> Column:
    """The place without its port."""
    return F.regexp_replace(parts(url)["place"], ":.*$", "")


def same_site(url: Column, seed: Column, *, bare_suffix: bool = False) -> Column:
    """Whether the host is the seed's or below it; ``bare_suffix`` takes any host that ends alike."""
    a, b = host(url), host(seed)
    if bare_suffix:
        return a.endswith(b)
    return (a == b) | a.endswith(F.concat(F.lit("."), b))


def url_allowed(url: Column, seed: Column | None = None, allow: tuple[str, ...] = (), deny: tuple[str, ...] = (), robots_ok: Column | None = None, *, bare_suffix: bool = False) -> Column:
    """The crawl policy: the seed's site, some allow pattern if there are any, no deny pattern, and robots."""
    ok = F.lit(True) if seed is None else same_site(url, seed, bare_suffix=bare_suffix)
    if allow:
        some = F.lit(False)
        for p in allow:
            some |= url.rlike(p)
        ok &= some
    for p in deny:
        ok &= ~url.rlike(p)
    return ok if robots_ok is None else ok & F.coalesce(robots_ok, F.lit(True))
