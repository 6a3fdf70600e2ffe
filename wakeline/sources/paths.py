"""Paths as Spark reports them, relative to a dataset root."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def relative_path(full: Column, root: str) -> Column:
    base = "/" + root.split("://", 1)[-1].strip("/") + "/"
    bare = F.regexp_replace(full, r"^[a-z0-9]+:/*", "/")
    return F.substring(bare, F.locate(base, bare) + len(base), F.length(bare))


def url_decoded(uri: Column) -> Column:
    """File metadata gives escaped URIs, in which a plus sign is a plus sign."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
