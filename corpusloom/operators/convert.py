"""Pages to markdown, text or structured columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import html as h
from corpusloom.functions import markdown as m

# Numbered lists, tables, preformatted text, and a list inside a list.
# Possessive, so that a page of any length costs no stack.
_NESTED = r"(?i)<(?:ol|table|pre|code)[\s>]|<ul[\s>][^<]*+(?:<(?!/ul|ul[\s>])[^<]*+)*+<ul[\s>]"


def markdown(html: Column) -> Column:
    """Markdown of a page. One with an element that needs to know what it stands in is walked
    with a stack of open elements; only such pages reach a Python worker."""

    @F.arrow_udf("string")
    def walked(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([m.to_markdown(page) if page is not None else None for page in column.to_pylist()], pa.string())

    nested = html.rlike(_NESTED)
    return F.coalesce(walked(F.when(nested, html)), h.to_markdown(html))


def structured(html: Column) -> Column:
    return F.struct(
        h.title(html).alias("title"),
        h.headings(html).alias("headings"),
        h.paragraphs(html).alias("paragraphs"),
        h.links(html).alias("links"),
    )


def html_markdown(pages: DataFrame, key: str = "page_id") -> DataFrame:
    return pages.select(key, markdown(F.col("html")).alias("markdown"))


def html_text(pages: DataFrame, key: str = "page_id") -> DataFrame:
    return pages.select(key, h.to_text(F.col("html")).alias("text"))


def html_struct(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per page with the document as a struct."""
    return pages.select(key, structured(h.body(F.col("html"))).alias("doc"))


def converted(pages: DataFrame, keys: list[str], output_format: str = "markdown") -> DataFrame:
    """``document`` in the wanted format; an unknown format gives nothing."""
    html = F.col("html")
    if output_format == "markdown":
        document = markdown(html)
    elif output_format == "json":
        document = F.to_json(structured(h.body(html)))
    else:
        document = F.lit(None).cast("string")
    return pages.select(*keys, document.alias("document"))


def sitemap_documents(
    sitemap_urls: DataFrame, pages: DataFrame, output_format: str = "markdown"
) -> DataFrame:
    """Convert each page a sitemap lists, in sitemap order; pages without a snapshot are skipped.

    ``sitemap_urls(sitemap_url, pos, url)`` -> ``sitemap_url, pos, url, document``.
    """
    found = sitemap_urls.join(pages.select("url", "html"), "url")
    return converted(found, ["sitemap_url", "pos", "url"], output_format)
