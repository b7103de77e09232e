"""URL helpers built on patterns, because ``parse_url`` throws on odd input under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framescope.functions.text import is_blank

_NETLOC = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)"


def valid_url(url: Column) -> Column:
    """Scheme and network location are both present."""
    return F.coalesce(url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]+"), F.lit(False))


def extract_domain(url: Column) -> Column:
    """Lower-cased network location without one leading ``www.``; empty when absent."""
    netloc = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _NETLOC, 1))
    return F.regexp_replace(netloc, r"^www\.", "")


def infer_source(url: Column) -> Column:
    """Source label of a history row: host part as written, or a fixed name."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^https?://(www\.)?", "")
    host = F.split_part(rest, F.lit("/"), F.lit(1))
    return (
        F.when(is_blank(url), F.lit("Raw Text"))
        .when(host == "", F.lit("Unknown"))
        .otherwise(host)
    )


def normalize_domain(domain: Column) -> Column:
    """Lookup key: trimmed, lower case, without one leading ``www.``."""
    return F.regexp_replace(F.trim(F.lower(F.coalesce(domain, F.lit("")))), r"^www\.", "")


def normalize_domain_loose(domain: Column) -> Column:
    """Variant that removes ``www.`` anywhere and keeps the case."""
    return F.replace(F.coalesce(domain, F.lit("")), F.lit("www."), F.lit(""))
