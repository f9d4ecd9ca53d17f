"""Column functions on URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two forms of repository address that count as valid.
GIT_URL_PATTERNS = (
    r"^https?://github\.com/[\w-]+/[\w-]+(?:\.git)?/?$",
    r"^git@github\.com:[\w-]+/[\w-]+(?:\.git)?/?$",
)


def is_http(item: Column) -> Column:
    return item.rlike("^https?://")


def git_url_valid(url: Column) -> Column:
    return F.coalesce(url.rlike("|".join(GIT_URL_PATTERNS)), F.lit(False))


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def sitemap_address(base: Column, filename: str = "sitemap.xml") -> Column:
    """``filename`` resolved against ``base``: it replaces what follows the last ``/`` of the path."""
    clean = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(
        clean.rlike(r"^[a-z][a-z0-9+.-]*://[^/]*$"), F.concat(clean, F.lit("/"))
    ).otherwise(F.regexp_replace(clean, r"[^/]*$", ""))
    return F.concat(folder, F.lit(filename))


def base_address(url: Column) -> Column:
    """The base URL used when a site has no sitemap: no trailing slashes."""
    return F.regexp_replace(url, "/+$", "")


def url_parts(url: Column) -> dict[str, Column]:
    return {
        "scheme": F.regexp_extract(url, r"^(https?)://", 1),
        "host": F.regexp_extract(url, r"^https?://([^/?#]+)", 1),
        "path": F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1),
        "query": F.regexp_extract(url, r"\?([^#]*)", 1),
    }
