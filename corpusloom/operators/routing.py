"""Route each input item to the treatment that takes it first.

A treatment is registered with a predicate column and works on columns or on a
DataFrame. The registry becomes one CASE over the manifest, so routing, and every
treatment that works on columns, is a projection.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions import urls
from corpusloom.options import Options

Predicate = Callable[[Column, Column], Column]
RowTreatment = Callable[[Column, Options], Column]
TableTreatment = Callable[[DataFrame, Options], DataFrame]

# What is skipped in a repository working tree.
SKIP_SUFFIXES = (
    ".exe",
    ".dll",
    ".so",
    ".dylib",
    ".obj",
    ".o",
    ".bin",
    ".dat",
    ".db",
    ".sqlite",
    ".idx",
    ".pack",
    ".jpg",
    ".jpeg",
    ".png",
    ".gif",
    ".bmp",
    ".ico",
    ".mp3",
    ".mp4",
    ".avi",
    ".mov",
    ".zip",
    ".tar",
    ".gz",
)
SKIP_PARTS = (
    "node_modules",
    "__pycache__",
    ".DS_Store",
    "thumbs.db",
    ".idea",
    ".vscode",
    ".github",
)
REPOSITORY_PART = ".git"
TEXT_PROBE = 1024
# A text reader asked for TEXT_PROBE characters decodes a buffer of this many bytes.
TEXT_BUFFER = 8192


def takes_pdf(item: Column, kind: Column) -> Column:
    return (kind == "file") & (F.lower(tx.suffix(item)) == ".pdf")


def takes_git(item: Column, kind: Column) -> Column:
    return item.endswith(".git") | item.contains("github.com") | item.contains("gitlab.com")


def takes_url(item: Column, kind: Column) -> Column:
    return (kind == "url") & urls.is_http(item)


def is_sitemap(item: Column, options: Options) -> Column:
    """Only an address that ends in ``sitemap.xml`` expands, and only when asked to."""
    return item.endswith("sitemap.xml") & F.lit(options.sitemap_only)


def kind_of(item: Column) -> Column:
    """Items are strings; an http(s) address is a URL and all else a path."""
    return F.when(urls.is_http(item), "url").otherwise("file")


def _row(item: Column, files: Column, metadata: Column, success: Column, error: Column) -> Column:
    return F.struct(
        item.alias("item"),
        files.cast("array<string>").alias("files"),
        metadata.cast("map<string,string>").alias("metadata"),
        success.alias("success"),
        error.cast("string").alias("error"),
    )


def error_row(item: Column, message: Column) -> Column:
    """A failed result as a struct."""
    return _row(item, F.array(), F.create_map(), F.lit(False), message)


def result_row(item: Column, files: Column, metadata: Column) -> Column:
    """A result as a struct; it succeeds when it names at least one file."""
    return _row(item, files, metadata, F.size(files) > 0, F.lit(None))


def as_results(df: DataFrame, row: Column) -> DataFrame:
    return df.select(row.alias("row")).select("row.*")


def no_processor(item: Column) -> Column:
    return F.concat(F.lit("No processor found for "), item)


def invalid_path(item: Column) -> Column:
    return F.concat(F.lit("Invalid input path: "), item)


def pdf_result(item: Column, options: Options) -> Column:
    """PDF text needs a converter the caller supplies; without one the row is an error."""
    return error_row(item, F.concat(F.lit("Error processing PDF "), item, F.lit(": no converter given")))


def git_result(item: Column, options: Options) -> Column:
    bad = F.concat(F.lit("Invalid Git repository URL: "), item)
    absent = F.concat(F.lit("Error processing Git repository: no working tree for "), item)
    return error_row(item, F.when(urls.git_url_valid(item), absent).otherwise(bad))


def url_result(item: Column, options: Options) -> Column:
    return result_row(item, F.array(item), F.create_map())


@dataclass(frozen=True)
class Entry:
    source_type: str
    predicate: Predicate
    row: RowTreatment | None = None
    table: TableTreatment | None = None


@dataclass
class Registry:
    """Treatments in order of registration: the first whose predicate holds takes the item."""

    entries: list[Entry] = field(default_factory=list)

    def register(
        self,
        source_type: str,
        predicate: Predicate,
        row: RowTreatment | None = None,
        table: TableTreatment | None = None,
    ) -> Registry:
        """``row`` makes the result from the item's columns, ``table`` from all its items."""
        if (row is None) == (table is None):
            raise ValueError("give either a row or a table treatment")
        self.entries.append(Entry(source_type, predicate, row, table))
        return self

    def replace(
        self, source_type: str, row: RowTreatment | None = None, table: TableTreatment | None = None
    ) -> Registry:
        """The same rules with another treatment for one source type."""
        changed = Registry()
        for e in self.entries:
            if e.source_type == source_type:
                changed.register(source_type, e.predicate, row, table)
            else:
                changed.register(e.source_type, e.predicate, e.row, e.table)
        return changed

    def source_type(self, item: Column, kind: Column) -> Column:
        route = F.lit(None).cast("string")
        for e in reversed(self.entries):
            route = F.when(e.predicate(item, kind), e.source_type).otherwise(route)
        return route

    def route(self, manifest: DataFrame) -> DataFrame:
        return manifest.withColumn("source_type", self.source_type(F.col("item"), F.col("kind")))

    def process(self, manifest: DataFrame, options: Options | None = None) -> DataFrame:
        """Results of every item; an item nobody takes becomes an error row.

        All row treatments share one pass over the manifest; each table treatment
        reads its own items.
        """
        options = options or Options()
        routed = self.route(manifest)
        item, kind = F.col("item"), F.col("source_type")
        row = error_row(item, no_processor(item))
        for e in self.entries:
            if e.row is not None:
                row = F.when(kind == e.source_type, e.row(item, options)).otherwise(row)
        tables = [e for e in self.entries if e.table is not None]
        names = [e.source_type for e in tables]
        rest = routed.filter(kind.isNull() | ~kind.isin(*names)) if names else routed
        parts = [e.table(routed.filter(kind == e.source_type), options) for e in tables]
        return reduce(DataFrame.unionByName, parts, as_results(rest, row))


def default_registry() -> Registry:
    return (
        Registry()
        .register("pdf", takes_pdf, pdf_result)
        .register("git", takes_git, git_result)
        .register("url", takes_url, url_result)
    )


def path_allowed(path: Column) -> Column:
    """The part of the working-tree filter that needs no content."""
    parts = F.split(path, "/")
    banned = F.array(*[F.lit(p) for p in (REPOSITORY_PART, *SKIP_PARTS)])
    return ~F.arrays_overlap(parts, banned) & ~F.lower(tx.suffix(path)).isin(*SKIP_SUFFIXES)


# What the last one, two or three bytes of a buffer look like, in hex, when they are the
# beginning of a character that goes on behind it.
_OPEN_TAILS = {
    1: r"^(?:C[2-9A-F]|D.|E.|F[0-4])$",
    2: r"^(?:E.|F[0-4])[89AB].$",
    3: r"^F[0-4][89AB].[89AB].$",
}


def looks_like_text(content: Column) -> Column:
    """Reading the first ``TEXT_PROBE`` characters as UTF-8 does not fail.

    A file with fewer characters is read to its end and has to be valid throughout. Any
    other is judged by its first ``TEXT_BUFFER`` bytes, where a character cut off at the
    end is not an error.
    """
    head = F.substring(content, 1, TEXT_BUFFER)
    text = head.cast("string")
    valid = F.is_valid_utf8(text)
    open_end = F.lit(False)
    for n, tail in _OPEN_TAILS.items():
        size = F.length(head)
        cut = F.substring(head, F.lit(1), size - n).cast("string")
        open_end = open_end | (
            F.hex(F.substring(head, size - n + 1, F.lit(n))).rlike(tail) & F.is_valid_utf8(cut)
        )
    return valid | ((F.length(text) >= TEXT_PROBE) & open_end)


def processable_files(files: DataFrame) -> DataFrame:
    """Text files of a working tree; the path tests come first, so ``content`` of a
    file they reject is never decoded. ``path`` is relative to the scan root."""
    return files.filter(path_allowed(F.col("path"))).filter(looks_like_text(F.col("content")))
