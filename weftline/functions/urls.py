"""Column expressions on addresses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of addresses that are not documentation pages (fixed values).
SKIPPED = ("_modules/", "genindex", "py-modindex", "search")


def _page_path(url: Column, prefix: str) -> Column:
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    return F.regexp_replace(F.regexp_replace(path, f"^{prefix}", ""), "^/+|/+$", "")


def section(url: Column, prefix: str = "/docs/stable/") -> Column:
    """The first part of the path below the prefix, without its extension; root if there is none."""
    first = F.regexp_replace(F.split_part(_page_path(url, prefix), F.lit("/"), F.lit(1)), r"\.[^.]*$", "")
    return F.coalesce(F.nullif(first, F.lit("")), F.lit("root"))


def relative_path(url: Column, prefix: str = "/docs/stable/") -> Column:
    """Where a page's Markdown goes, relative to the output folder."""
    path = F.regexp_replace(_page_path(url, prefix), r"\.html?$", ".md")
    return F.coalesce(F.nullif(path, F.lit("")), F.lit("index.md"))


def skipped(url: Column, patterns: Sequence[str] = SKIPPED) -> Column:
    out = F.lit(False)
    for pattern in patterns:
        out = out | F.contains(url, F.lit(pattern))
    return out


def citation(url: Column, anchor: Column) -> Column:
    """The page's address without trailing slashes, and the anchor."""
    return F.concat(F.regexp_replace(url, "/+$", ""), F.coalesce(anchor, F.lit("")))
