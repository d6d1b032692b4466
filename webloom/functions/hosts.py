"""Which host a corpus row belongs to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def url_host(url: Column) -> Column:
    """Host of an absolute URL: no user, no port, lower case, no leading www.; '' if there is none."""
    raw = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\s]+)", 1)
    return F.regexp_replace(F.lower(raw), r"^www\.", "")


def row_host(host: Column, url: Column) -> Column:
    """The host column; if it is null, empty or in capitals, the host in the URL; '' if neither is known."""
    unusable = host.isNull() | (F.trim(host) == "") | (host != F.lower(host))
    return F.coalesce(F.when(unusable, url_host(url)).otherwise(host), F.lit(""))
