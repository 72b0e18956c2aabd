"""URL checks as column expressions; a malformed url is invalid, not an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMES = ("http", "https")


def url_host(url: Column) -> Column:
    """The host, null where there is none or the url cannot be read."""
    return F.try_parse_url(url, F.lit("HOST"))


def valid_url(url: Column) -> Column:
    """Whether the url has a host and a scheme that may be fetched; null is invalid."""
    scheme = F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.lit(""))
    return scheme.isin(*SCHEMES) & (F.coalesce(url_host(url), F.lit("")) != "")
