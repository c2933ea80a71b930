"""Column expressions for URLs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_SCHEME = r"(?is)^[\x00-\x20]*(?:https?|ftp):"
_AUTHORITY = r"//(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:]*)"
_WELL_FORMED = _SCHEME + "(?:" + _AUTHORITY + r"(?::[0-9]*)?(?:[/?#].*)?|(?!//).*)$"

# Characters that end or split the authority, so no host contains them.
HOST_BREAKS = r"[/?#:@]+"


def host_of(url: Column) -> Column:
    """Host of a URL without user and port: NULL if malformed, '' if it has none."""
    return F.when(url.rlike(_WELL_FORMED), F.regexp_extract(url, _SCHEME + _AUTHORITY, 1))


def is_well_formed(url: Column) -> Column:
    return F.coalesce(url.rlike(_WELL_FORMED), F.lit(False))


def https_form(url: Column) -> Column:
    return F.replace(url, F.lit("http://"), F.lit("https://"))


DISABLED = "!disabled"


def host_label(url: Column) -> Column:
    """First label of a host with at least two dots, else the disabled mark."""
    host = host_of(url)
    dots = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))
    return F.when(dots > 1, F.substring_index(host, ".", 1)).otherwise(F.lit(DISABLED))
