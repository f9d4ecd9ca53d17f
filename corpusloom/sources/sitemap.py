"""Sitemaps held as a snapshot table ``sitemap_url, xml``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import urls
from corpusloom.session import stored

# Fixed value: the namespace a sitemap has to declare to be followed recursively.
SITEMAP_NAMESPACE = "http://www.sitemaps.org/schemas/sitemap/0.9"

# Every loc whose prefix is the root's own, at any depth (leaves out image:loc).
_FLAT = (
    '//*[local-name()="loc" and '
    'substring-before(name(),":")=substring-before(name(/*),":")]/text()'
)
_INDEX = '//*[local-name()="sitemap"]/*[local-name()="loc"]'
_PAGES = '//*[local-name()="url"]/*[local-name()="loc"]'


def well_formed(xml: Column) -> Column:
    """Whether the text parses; asked first, because xpath fails the job on bad XML."""
    parsed = F.from_xml(
        xml,
        "url ARRAY<STRING>, _bad STRING",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"},
    )
    return F.coalesce(xml.isNotNull() & parsed["_bad"].isNull() & parsed.isNotNull(), F.lit(False))


def flat(sites: DataFrame, snapshots: DataFrame, filename: str = "sitemap.xml") -> DataFrame:
    """``base_url, pos, url, error`` of each site's own sitemap.

    A site without one gives its base URL; a sitemap that does not parse gives an error
    row instead of failing the job.
    """
    joined = sites.select(
        "base_url", urls.sitemap_address(F.col("base_url"), filename).alias("sitemap_url")
    ).join(snapshots, "sitemap_url", "left").withColumn("ok", well_formed(F.col("xml")))
    xml = F.col("xml")
    found = F.when(xml.isNull(), F.array(urls.base_address(F.col("base_url")))).when(
        F.col("ok"), F.xpath(xml, F.lit(_FLAT))
    )
    parsed = joined.select("base_url", found.alias("found"))
    good = parsed.select("base_url", F.posexplode("found").alias("pos", "url")).select(
        "base_url", F.col("pos").cast("long").alias("pos"), "url", F.lit(None).cast("string").alias("error")
    )
    bad = parsed.filter(F.col("found").isNull()).select(
        "base_url",
        F.lit(None).cast("long").alias("pos"),
        F.lit(None).cast("string").alias("url"),
        F.lit("Failed to parse sitemap XML").alias("error"),
    )
    return good.unionByName(bad)


def read_snapshots(snapshots: DataFrame) -> DataFrame:
    """What each snapshot lists: ``sitemap_url, children, pages``.

    ``children`` is null unless the document is an index. A document that does not
    parse, or does not declare the namespace, lists nothing and is left out.
    """
    xml = F.col("xml")
    space = SITEMAP_NAMESPACE.replace(".", r"\.")
    known = xml.rlike(rf'xmlns(?::\w+)?\s*=\s*["\']{space}["\']')
    readable = snapshots.filter(known).filter(well_formed(xml))
    checked = readable.withColumn("is_index", F.xpath_boolean(xml, F.lit(_INDEX)))
    return checked.select(
        "sitemap_url",
        F.when(F.col("is_index"), F.xpath(xml, F.lit(_INDEX + "/text()"))).alias("children"),
        F.when(~F.col("is_index"), F.xpath(xml, F.lit(_PAGES + "/text()"))).alias("pages"),
    )


def recursive(roots: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``sitemap_url, pos, url, via``: every page URL below each root, in document order.

    One equi join per level of nesting, to whatever depth there is. A sitemap that is its own ancestor is not
    entered again; listing the same sitemap twice lists its pages twice. ``pos`` is the
    path of positions that orders the URLs of a root; ``via`` is the sitemap that lists
    the page.
    """
    parsed = stored(read_snapshots(snapshots), "sitemaps")
    frontier = roots.select(
        "sitemap_url",
        F.col("sitemap_url").alias("at"),
        F.array().cast("array<int>").alias("order"),
        F.array("sitemap_url").alias("trail"),
    )
    pages = []
    while True:
        here = stored(
            frontier.join(parsed.withColumnRenamed("sitemap_url", "at"), "at"), "sitemap-level"
        )
        pages.append(
            here.select("sitemap_url", "order", "at", F.posexplode("pages").alias("i", "url"))
            .filter(F.col("url") != "")
            .select("sitemap_url", F.array_append("order", F.col("i")).alias("pos"), "url", F.col("at").alias("via"))
        )
        frontier = (
            here.select("sitemap_url", "order", "trail", F.posexplode("children").alias("i", "child"))
            .filter((F.col("child") != "") & ~F.array_contains("trail", F.col("child")))
            .select(
                "sitemap_url",
                F.col("child").alias("at"),
                F.array_append("order", F.col("i")).alias("order"),
                F.array_append("trail", F.col("child")).alias("trail"),
            )
        )
        if frontier.isEmpty():
            break
    out = pages[0]
    for more in pages[1:]:
        out = out.unionByName(more)
    return out


def sitemap_counts(found: DataFrame) -> DataFrame:
    """URLs per root and how many sitemaps listed them."""
    return found.groupBy("sitemap_url").agg(
        F.count("*").alias("n_urls"), F.count_distinct("via").alias("n_sitemaps")
    )
