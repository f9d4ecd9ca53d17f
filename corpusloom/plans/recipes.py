"""The operators applied to the given tables: one function per query.

Each takes ``(spark, sf_dir)`` and returns a DataFrame of scalar columns. Inputs the
tables do not hold as such (file trees, sitemaps, source files, GraphML) are derived
from them by Spark, so every query grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions import urls
from corpusloom.operators import (
    chatlog,
    chunking,
    code,
    context,
    convert,
    graph,
    retrieval,
    routing,
    summaries,
)
from corpusloom.operators import vector_index
from corpusloom.operators.skew import top_k
from corpusloom.options import CONTEXT_LIMIT, DEFAULT_LIMIT, Options
from corpusloom.plans import graphstore, search
from corpusloom.plans import ingest as runs
from corpusloom.plans.index import Index, build, corpus_chunks, phrase_gazetteer, word_gazetteer
from corpusloom.session import new_path, stored
from corpusloom.sources import files as file_source
from corpusloom.sources import graphfiles, idstore, sinks, sitemap, tables
from corpusloom.streaming import ingest

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

LINES = 5
PACK_TOKENS = 200
SECTION_TOKENS = 30
WINDOW_TOKENS = 100
OVERLAP = 20
RUN_AT = "2024-05-06 07:08:09"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# Tables with long texts, and the key that deals them out where a session asks for it.
_TEXT_TABLES = {"documents": "doc_id", "pages": "page_id"}
INPUT_PARTITIONS = "corpusloom.inputPartitions"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as it is stored. A session may set ``corpusloom.inputPartitions`` to deal out
    text tables that are one row group, which one task would read; nothing does so by itself."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    parts = spark.conf.get(INPUT_PARTITIONS, None)
    return df.repartition(int(parts), _TEXT_TABLES[name]) if parts and name in _TEXT_TABLES else df


def long(column: Column) -> Column:
    return column.cast("long")


def message_id() -> Column:
    """A key of one message: conversation and turn, whatever their size."""
    return F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))


# ---------------------------------------------------------------- chunking


@query
def line_windows(spark, sf_dir):
    return chunking.line_windows(table(spark, sf_dir, "documents"), "doc_id", LINES)


@query
def paragraph_pack(spark, sf_dir):
    return chunking.paragraph_pack(table(spark, sf_dir, "documents"), ["doc_id"], PACK_TOKENS)


@query
def structured_chunks(spark, sf_dir):
    """Converted pages cut along their headings."""
    pages = convert.html_markdown(table(spark, sf_dir, "pages"))
    chunks = chunking.structured_chunks(pages, ["page_id"], SECTION_TOKENS, "markdown")
    return chunks.withColumn("headings", F.array_join("headings", " > "))


@query
def token_windows(spark, sf_dir):
    return chunking.token_windows(table(spark, sf_dir, "documents"), ["doc_id"], WINDOW_TOKENS)


@query
def token_windows_overlap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return chunking.token_windows(docs, ["doc_id"], WINDOW_TOKENS, OVERLAP)


@query
def token_counts(spark, sf_dir):
    return chunking.token_counts(table(spark, sf_dir, "documents"), ["doc_id"])


def python_files(spark, sf_dir) -> DataFrame:
    """Documents rewritten as Python sources: their lines become the bodies of nested
    classes and functions."""
    body = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.when(i % 5 == 0, F.concat(F.lit("class C"), i.cast("string"), F.lit(":")))
        .when(i % 5 == 1, F.concat(F.lit("    def f"), i.cast("string"), F.lit("(self):")))
        .when(i % 5 == 2, F.concat(F.lit("        x = '"), line, F.lit("'")))
        .when(i % 5 == 3, F.lit(""))
        .otherwise(F.concat(F.lit("print('"), line, F.lit("')"))),
    )
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("file_id"),
        F.concat("source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"),
        F.array_join(body, "\n").alias("text"),
    )


def script_files(spark, sf_dir) -> DataFrame:
    """Documents rewritten as JavaScript sources, braces in strings and comments included."""
    body = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.when(i % 4 == 0, F.concat(F.lit("class C"), i.cast("string"), F.lit(" {")))
        .when(i % 4 == 1, F.concat(F.lit("  m"), i.cast("string"), F.lit("(a) { // {")))
        .when(i % 4 == 2, F.concat(F.lit('    return "{ '), F.replace(line, F.lit('"'), F.lit("")), F.lit('";')))
        .otherwise(F.lit("} }")),
    )
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("file_id"),
        F.concat("source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".js")).alias("path"),
        F.array_join(body, "\n").alias("text"),
    )


@query
def code_blocks(spark, sf_dir):
    return code.python_blocks(python_files(spark, sf_dir))


@query
def code_blocks_js(spark, sf_dir):
    return code.script_blocks(script_files(spark, sf_dir))


@query
def chunk_dispatch(spark, sf_dir):
    """Each document as a file whose suffix follows its language: blocks, windows or text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    name = F.concat("source", F.lit("/doc_"), F.col("doc_id").cast("string"))
    plain = docs.filter("lang <> 'en'").select(
        F.col("doc_id").alias("file_id"),
        F.concat(name, F.when(F.col("lang") == "fr", ".lua").when(F.col("lang") == "de", ".js").otherwise(".md")).alias("path"),
        "text",
    )
    english = docs.filter("lang = 'en'").select(F.col("doc_id").alias("file_id"))
    source = python_files(spark, sf_dir).join(english, "file_id", "left_semi")
    chunks = code.file_chunks(source.unionByName(plain), PACK_TOKENS, LINES)
    return chunks.select("file_id", "path", "type", "start_line", "end_line", "seq", F.md5("text").alias("text_md5"))


def _line_records(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    source_file = F.concat("source", F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return sinks.chunk_records(
        docs, chunking.line_window_column(F.col("text"), LINES), source_file, F.lit(RUN_AT).cast("timestamp")
    )


@query
def chunk_export(spark, sf_dir):
    return _line_records(spark, sf_dir).select(
        "source_file", "chunks_file", "num_chunks", F.md5(F.array_join("chunks", "\n")).alias("chunks_md5")
    )


@query
def chunk_summary(spark, sf_dir):
    return sinks.chunk_summary(_line_records(spark, sf_dir))


@query
def chunk_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    windows = docs.select("source", F.inline(chunking.line_window_column(F.col("text"), LINES)))
    return summaries.chunk_counts(windows)


@query
def chunk_insert_incremental(spark, sf_dir):
    """The store holds the chunks of labelled documents; all documents are inserted."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    store = new_path(spark, "chunk-store")
    for number, part in enumerate((docs.join(labels, "doc_id", "left_semi"), docs)):
        chunks = chunking.unique_chunks(ingest.document_chunks(part, WINDOW_TOKENS))
        idstore.insert(chunks, store, "documents", number)
    added = idstore.read_store(spark, store, ingest.CHUNKS, "documents", 1)
    return added.select("chunk_id", "doc_id", "seq", "n_tokens")


@query
def stream_ingest(spark, sf_dir):
    """All documents as a stream; the store it leaves equals the batch result."""
    schema = table(spark, sf_dir, "documents").schema
    store, checkpoint = new_path(spark, "stream-store"), new_path(spark, "stream-state")
    docs = ingest.stream_documents(spark, sf_dir, schema, "documents.parquet")
    ingest.start_ingest(docs, store, checkpoint, WINDOW_TOKENS).awaitTermination()
    return ingest.read_store(spark, store).select("chunk_id", "doc_id", "seq", "n_tokens")


# ---------------------------------------------------------------- sources and routing


def document_items(spark, sf_dir) -> DataFrame:
    ending = (
        F.when(F.col("lang") == "de", ".pdf")
        .when(F.col("lang") == "fr", ".PDF")
        .when(F.col("lang") == "es", ".git")
        .otherwise(".txt")
    )
    return table(spark, sf_dir, "documents").select(
        F.concat("source", F.lit("/doc_"), F.col("doc_id").cast("string"), ending).alias("item")
    )


def git_items(spark, sf_dir) -> DataFrame:
    """Repository addresses made from page hosts: valid ones, other hosts and deeper paths."""
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    page = F.col("page_id").cast("string")
    forms = F.array(
        F.concat(F.lit("https://github.com/"), F.regexp_replace(host, r"\..*$", ""), F.lit("/r"), page),
        F.concat(F.lit("http://github.com/u/"), F.regexp_replace(host, r"\..*$", ""), page, F.lit(".git/")),
        F.concat(F.lit("https://github.com/u/"), host),
        F.concat(F.lit("https://gitlab.com/u/r"), page),
        F.concat(F.lit("git@github.com:u/r"), page, F.lit(".git")),
        F.concat(F.lit("https://github.com/u/r/blob/main/x"), page),
    )
    return table(spark, sf_dir, "pages").select(F.explode(forms).alias("item"))


def manifest(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("url").alias("item"))
    items = pages.unionByName(git_items(spark, sf_dir)).unionByName(document_items(spark, sf_dir))
    return items.withColumn("kind", routing.kind_of(F.col("item")))


@query
def src_manifest(spark, sf_dir):
    return file_source.scan(spark, sf_dir).select("path", "length")


@query
def src_invalid_paths(spark, sf_dir):
    """Document paths asked for next to the table files that do exist."""
    found = file_source.scan(spark, sf_dir)
    wanted = document_items(spark, sf_dir).unionByName(found.select(F.col("path").alias("item")))
    return file_source.invalid_paths(wanted, found).select("item", "error")


@query
def schema_listing(spark, sf_dir):
    return tables.schema_listing(spark, {t: f"{sf_dir}/{t}.parquet" for t in TABLES})


@query
def route_sources(spark, sf_dir):
    return routing.default_registry().route(manifest(spark, sf_dir))


@query
def git_url_valid(spark, sf_dir):
    items = manifest(spark, sf_dir)
    return items.select("item", urls.git_url_valid(F.col("item")).alias("valid"))


@query
def page_lookup(spark, sf_dir):
    """Every page asked for by its address without the fragment."""
    pages = table(spark, sf_dir, "pages")
    wanted = pages.select(urls.without_fragment(F.col("url")).alias("url")).distinct()
    sized = pages.select("page_id", "url", long(F.length("html")).alias("html_chars"))
    return tables.page_lookup(wanted, sized).select("url", "page_id", "found", "html_chars")


@query
def url_parts(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        *[c.alias(n) for n, c in urls.url_parts(url).items()],
        urls.sitemap_address(url).alias("sitemap_url"),
        urls.base_address(url).alias("base_url"),
    )


@query
def safe_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.safe_name(F.col("url")).alias("safe_name"))


@query
def export_name(spark, sf_dir):
    name = tx.export_name(F.col("url"), F.lit(RUN_AT).cast("timestamp"))
    return table(spark, sf_dir, "pages").select("page_id", name.alias("chunks_file"))


def page_tree(spark, sf_dir) -> DataFrame:
    """Pages laid out as repository working trees, one per host: ``repo, path, content``."""
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    folder = (
        F.when(host.startswith("m."), "node_modules/")
        .when(host.startswith("blog."), ".github/")
        .when(host.startswith("www."), "src/")
        .otherwise("")
    )
    ending = (
        F.when(host.endswith(".net"), ".PNG").when(host.endswith(".org"), ".py").otherwise(".html")
    )
    return table(spark, sf_dir, "pages").select(
        host.alias("repo"),
        F.concat(folder, F.lit("page_"), F.col("page_id").cast("string"), ending).alias("path"),
        F.encode("html", "UTF-8").alias("content"),
    )


@query
def repo_files(spark, sf_dir):
    return routing.processable_files(page_tree(spark, sf_dir)).select(
        "repo", "path", long(F.length("content")).alias("n_bytes")
    )


@query
def processable_files(spark, sf_dir):
    content = F.col("content")
    return page_tree(spark, sf_dir).select(
        "repo",
        "path",
        routing.path_allowed(F.col("path")).alias("path_allowed"),
        routing.looks_like_text(content).alias("is_text"),
        code.is_code(F.col("path")).alias("is_code"),
        code.language(F.col("path")).alias("language"),
    )


@query
def repo_file_counts(spark, sf_dir):
    kept = routing.processable_files(page_tree(spark, sf_dir))
    return summaries.counts_by(kept, "repo", "file_count")


SITE = "https://site.example"
PER_SITEMAP = 25
PER_INDEX = 10


def _address(kind: str, number: Column) -> Column:
    return F.concat(F.lit(f"{SITE}/{kind}"), number.cast("string"), F.lit("/sitemap.xml"))


def sitemaps(spark, sf_dir) -> DataFrame:
    """Sitemaps of a few pages each, indexes over them; each index also lists itself."""
    head = '<?xml version="1.0" encoding="UTF-8"?>'
    space = f'xmlns="{sitemap.SITEMAP_NAMESPACE}"'
    block = F.floor(F.col("page_id") / PER_SITEMAP).alias("block")
    loc = F.concat(
        F.lit("<url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>")
    )

    def document(tag: str, parts: Column, last: Column | None = None) -> Column:
        ordered = F.transform(F.array_sort(F.collect_list(parts)), lambda p: p["xml"])
        tail = [last] if last is not None else []
        return F.concat(
            F.lit(f"{head}<{tag} {space}>"), F.array_join(ordered, ""), *tail, F.lit(f"</{tag}>")
        ).alias("xml")

    def entry(address: Column) -> Column:
        return F.concat(F.lit("<sitemap><loc>"), address, F.lit("</loc></sitemap>"))

    pages = table(spark, sf_dir, "pages").select("page_id", block, loc.alias("xml"))
    maps = pages.groupBy("block").agg(document("urlset", F.struct("page_id", "xml")))
    listed = maps.select(
        F.floor(F.col("block") / PER_INDEX).alias("index"),
        "block",
        entry(_address("b", F.col("block"))).alias("xml"),
    )
    itself = entry(_address("i", F.col("index")))
    indexes = listed.groupBy("index").agg(document("sitemapindex", F.struct("block", "xml"), itself))
    return maps.select(_address("b", F.col("block")).alias("sitemap_url"), "xml").unionByName(
        indexes.select(_address("i", F.col("index")).alias("sitemap_url"), "xml")
    )


@query
def sitemap_flat(spark, sf_dir):
    """Each block's site, and a second one without a sitemap."""
    maps = stored(sitemaps(spark, sf_dir), "sitemap-snapshots")
    base = F.regexp_replace("sitemap_url", "sitemap.xml$", "")
    sites = maps.select(F.explode(F.array(base, F.concat(base, F.lit("none/")))).alias("base_url"))
    return sitemap.flat(sites, maps)


def _sitemap_pages(spark, sf_dir) -> DataFrame:
    maps = stored(sitemaps(spark, sf_dir), "sitemap-snapshots")
    roots = maps.filter(F.col("sitemap_url").startswith(f"{SITE}/i")).select("sitemap_url")
    return sitemap.recursive(roots, maps)


@query
def sitemap_recursive(spark, sf_dir):
    found = _sitemap_pages(spark, sf_dir)
    return found.select("sitemap_url", F.array_join("pos", ".").alias("pos"), "url", "via")


@query
def sitemap_counts(spark, sf_dir):
    return sitemap.sitemap_counts(_sitemap_pages(spark, sf_dir))


@query
def sitemap_convert(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    documents = convert.sitemap_documents(_sitemap_pages(spark, sf_dir), pages, "markdown")
    return documents.select(
        "sitemap_url", F.array_join("pos", ".").alias("pos"), "url", F.md5("document").alias("document_md5")
    )


@query
def sitemap_route(spark, sf_dir):
    maps = sitemaps(spark, sf_dir).select(F.col("sitemap_url").alias("item"))
    pages = table(spark, sf_dir, "pages").select(F.col("url").alias("item"))
    flag = routing.is_sitemap(F.col("item"), Options(sitemap_only=True))
    return maps.unionByName(pages).select("item", flag.alias("expand"))


# ---------------------------------------------------------------- conversion


@query
def html_markdown(spark, sf_dir):
    return convert.html_markdown(table(spark, sf_dir, "pages"))


@query
def html_nested(spark, sf_dir):
    """Pages set as a numbered list with a list in it, a table and preformatted text."""
    words = F.regexp_extract_all("url", F.lit("[A-Za-z]+"), F.lit(0))
    word = lambda i: F.get(words, F.lit(i))
    pieces = [
        "<ol><li>", word(0), "<ul><li>", word(1), "<li>", word(2), "</ul></li><li><b>", word(1), "</b></ol><table><tr><th>page<th>a &amp; b<tr><td>",
        F.col("page_id").cast("string"), "<td><a href='", F.col("url"), "'>", word(0), "</a></table><pre>  ", word(1), "\n    {", word(2), "}</pre><p>", word(0),
    ]
    html = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])
    return convert.html_markdown(table(spark, sf_dir, "pages").select("page_id", html.alias("html")))


@query
def html_text(spark, sf_dir):
    return convert.html_text(table(spark, sf_dir, "pages"))


@query
def html_struct(spark, sf_dir):
    return _page_fields(convert.html_struct(table(spark, sf_dir, "pages")))


def _page_fields(pages: DataFrame) -> DataFrame:
    return pages.select(
        "page_id",
        F.col("doc.title").alias("title"),
        F.array_join("doc.headings", " | ").alias("headings"),
        F.array_join("doc.links", " | ").alias("links"),
        long(F.size("doc.paragraphs")).alias("n_paragraphs"),
        F.md5(F.array_join("doc.paragraphs", "\n")).alias("paragraphs_md5"),
    )


@query
def html_json(spark, sf_dir):
    """The JSON documents, every field read back."""
    pages = convert.converted(table(spark, sf_dir, "pages"), ["page_id"], "json")
    schema = "title STRING, headings ARRAY<STRING>, paragraphs ARRAY<STRING>, links ARRAY<STRING>"
    return _page_fields(pages.select("page_id", F.from_json("document", schema).alias("doc")))


# ---------------------------------------------------------------- graph

_indexes: dict[tuple, Index] = {}


def index(spark: SparkSession, sf_dir: str) -> Index:
    """The stored corpus of a data folder, built on first use in a session and again after its
    tables were rewritten."""
    changed = [tables.last_change(spark, f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark")]
    key = (spark.sparkContext.applicationId, sf_dir, *changed)
    if key not in _indexes:
        docs = table(spark, sf_dir, "documents")
        gazetteer = word_gazetteer(table(spark, sf_dir, "benchmark"))
        _indexes[key] = build(docs, gazetteer, WINDOW_TOKENS)
    return _indexes[key]


def _mentions(spark, sf_dir) -> DataFrame:
    chunks = corpus_chunks(table(spark, sf_dir, "documents"), WINDOW_TOKENS)
    return graph.mentions(chunks, word_gazetteer(table(spark, sf_dir, "benchmark")))


@query
def entity_mentions(spark, sf_dir):
    return _mentions(spark, sf_dir).select("chunk_id", "pos", "name", "entity_type", "link")


# Shapes of addresses and numbers that stand in for a model's entity types.
PATTERNS = {
    "email": r"[A-Za-z0-9._]+@[A-Za-z0-9.]+",
    "number": r"[0-9][0-9.-]+[0-9]",
}


@query
def entity_patterns(spark, sf_dir):
    chunks = corpus_chunks(table(spark, sf_dir, "documents"), WINDOW_TOKENS)
    return graph.pattern_mentions(chunks, PATTERNS).select("chunk_id", "name", "entity_type")


@query
def entity_phrases(spark, sf_dir):
    """Names of two and three long words from the questions."""
    chunks = corpus_chunks(table(spark, sf_dir, "documents"), WINDOW_TOKENS)
    names = stored(phrase_gazetteer(table(spark, sf_dir, "benchmark")), "phrases")
    return graph.phrase_mentions(chunks, names).select("chunk_id", "pos", "name", "entity_type", "link")


@query
def entity_merge(spark, sf_dir):
    return graph.entity_merge(graph.entity_sources(_mentions(spark, sf_dir)))


@query
def entity_sources(spark, sf_dir):
    return graph.entity_sources(_mentions(spark, sf_dir)).select("chunk_id", "name", "n")


@query
def relation_pairs(spark, sf_dir):
    return graph.relation_pairs(_mentions(spark, sf_dir)).select(
        "chunk_id", "source", "target", "weight", F.array_join("links", ",").alias("links")
    )


@query
def relation_pairs_chunk(spark, sf_dir):
    """All pairs of a chunk, however far apart."""
    pairs = graph.relation_pairs(_mentions(spark, sf_dir), None)
    return pairs.select("chunk_id", "source", "target", "weight", F.md5(F.array_join("links", ",")).alias("links_md5"))


@query
def relation_keywords(spark, sf_dir):
    return graph.relation_keywords(index(spark, sf_dir).pairs)


@query
def relation_merge(spark, sf_dir):
    return graph.relation_merge(graph.relation_pairs(_mentions(spark, sf_dir))).drop("rel_type")


def _conversation_nodes(spark, sf_dir) -> DataFrame:
    """Entities of the conversations: a second, later corpus over the same gazetteer."""
    talks = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunk_id"),
        F.col("conv_id").alias("doc_id"),
        F.col("role").alias("lang"),
        "text",
    )
    found = graph.mentions(talks, word_gazetteer(table(spark, sf_dir, "benchmark")))
    return graph.entity_merge(graph.entity_sources(found))


@query
def node_upsert(spark, sf_dir):
    columns = ["id", "entity_type", "description", "source_id"]
    existing = index(spark, sf_dir).nodes.select(*columns)
    new = _conversation_nodes(spark, sf_dir).select(*columns, F.lit(1).alias("batch"))
    return graph.node_upsert(existing, new)


@query
def label_counts(spark, sf_dir):
    return graph.label_counts(index(spark, sf_dir).nodes)


@query
def relation_type(spark, sf_dir):
    edges = index(spark, sf_dir).edges
    return graph.with_relation_type(edges).select("source", "target", "keywords", "rel_type")


@query
def edge_endpoints(spark, sf_dir):
    """Edges of the documents whose two ends also occur in the conversations."""
    nodes = stored(_conversation_nodes(spark, sf_dir), "conversation-nodes")
    return graph.edges_with_endpoints(index(spark, sf_dir).edges, nodes).select(
        "source", "target", "weight", "keywords", "source_id"
    )


@query
def edge_dropped(spark, sf_dir):
    nodes = stored(_conversation_nodes(spark, sf_dir), "conversation-nodes")
    return graph.edges_without_endpoints(index(spark, sf_dir).edges, nodes)


def _busiest(spark, sf_dir) -> DataFrame:
    """The most mentioned entity of each type, as the selected nodes."""
    nodes = index(spark, sf_dir).nodes
    first = top_k(nodes, ["entity_type"], [F.desc("n_mentions"), F.col("id")], 1)
    return first.select("id", "entity_type")


@query
def graph_two_hop(spark, sf_dir):
    seeds = _busiest(spark, sf_dir).select(F.col("id").alias("seed"))
    return graph.two_hop(index(spark, sf_dir).edges, seeds)


@query
def graph_subgraph(spark, sf_dir):
    """Nodes with more sources than mentions in the average chunk, and their edges."""
    idx = index(spark, sf_dir)
    mean = idx.nodes.agg(F.avg("n_sources")).scalar()
    chosen = idx.nodes.filter(F.col("n_sources") > mean).select("id")
    _, edges = graph.subgraph(idx.nodes, idx.edges, stored(chosen, "selection"))
    return edges.select("source", "target", "weight")


@query
def graph_filter_nodes(spark, sf_dir):
    return graph.filter_nodes(index(spark, sf_dir).nodes, "entity_type", ["fr", "de"])


@query
def graph_filter_edges(spark, sf_dir):
    return graph.filter_edges(index(spark, sf_dir).edges, "weight", ["1", "2"])


@query
def triples_limit(spark, sf_dir):
    idx = index(spark, sf_dir)
    return graph.triples(idx.edges, idx.nodes)


@query
def graph_counts(spark, sf_dir):
    idx = index(spark, sf_dir)
    return summaries.graph_counts(idx.nodes, idx.edges)


@query
def graph_batches(spark, sf_dir):
    idx = index(spark, sf_dir)
    return (
        graph.batches(idx.nodes, idx.edges)
        .groupBy("kind", "batch")
        .agg(
            F.count("*").alias("n_rows"),
            F.min("key").alias("min_key"),
            F.max("key").alias("max_key"),
        )
    )


def _graphml(idx: Index, path: str) -> None:
    """The graph as GraphML elements: key declarations, nodes and edges."""
    fields = {"node": graphfiles.NODE_FIELDS, "edge": graphfiles.EDGE_FIELDS}

    def data(kind: str) -> Column:
        return F.array(
            *[
                F.struct(
                    F.lit(f"{kind[0]}{i}").alias("_key"),
                    F.coalesce(F.col(n).cast("string"), F.lit("")).alias("_VALUE"),
                )
                for i, n in enumerate(fields[kind])
            ]
        ).alias("data")

    keys = idx.nodes.sparkSession.createDataFrame(
        [(f"{kind[0]}{i}", kind, n) for kind, names in fields.items() for i, n in enumerate(names)],
        "_id STRING, _for STRING, `_attr.name` STRING",
    )
    nodes = idx.nodes.select(F.col("id").alias("_id"), data("node"))
    edges = idx.edges.select(F.col("source").alias("_source"), F.col("target").alias("_target"), data("edge"))
    for df, tag in ((keys.coalesce(1), "key"), (nodes, "node"), (edges, "edge")):
        df.write.format("xml").option("rootTag", "graphml").option("rowTag", tag).save(f"{path}/{tag}")


@query
def graphml_read(spark, sf_dir):
    """The graph written as GraphML files and read again."""
    path = new_path(spark, "graphml")
    _graphml(index(spark, sf_dir), path)
    return _graph_rows(*graphfiles.read_graphml(spark, f"{path}/*"))


def _graph_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select(
        F.lit("node").alias("kind"), F.col("id").alias("key"), "entity_type", "description",
        F.lit(None).cast("double").alias("weight"), F.lit(None).cast("string").alias("keywords"), "source_id",
    ).unionByName(
        edges.select(
            F.lit("edge").alias("kind"), F.concat_ws("|", "source", "target").alias("key"),
            F.lit(None).cast("string").alias("entity_type"), "description", "weight",
            F.nullif("keywords", F.lit("")).alias("keywords"), "source_id",
        )
    )


@query
def graph_incremental(spark, sf_dir):
    """The graph of all documents, grown in two batches: ids up to the mean, then the others."""
    docs = table(spark, sf_dir, "documents")
    words = word_gazetteer(table(spark, sf_dir, "benchmark"))
    mean = docs.agg(F.avg("doc_id")).scalar()
    store = new_path(spark, "graph-store")
    for number, part in enumerate((docs.filter(F.col("doc_id") <= mean), docs.filter(F.col("doc_id") > mean))):
        graphstore.add_documents(part, words, store, "documents", number, WINDOW_TOKENS)
    return _graph_rows(graphstore.nodes(spark, store), graphstore.edges(spark, store))


@query
def graph_json_read(spark, sf_dir):
    """The graph exported as JSON, and the export reused instead of a conversion."""
    path = new_path(spark, "graph-json")
    idx = index(spark, sf_dir)
    sinks.write_graph(
        idx.nodes.select("id", *graphfiles.NODE_FIELDS),
        idx.edges.select("source", "target", *graphfiles.EDGE_FIELDS),
        path,
    )
    nodes, edges = graphfiles.load_graph(spark, "", path, skip_conversion=True)
    return nodes.select(
        F.lit("node").alias("kind"), F.col("id").alias("key"), "description", F.lit(None).cast("double").alias("weight")
    ).unionByName(
        edges.select(F.lit("edge").alias("kind"), F.concat_ws("|", "source", "target").alias("key"), "description", "weight")
    )


# ---------------------------------------------------------------- retrieval


def questions(spark, sf_dir, limit: int = DEFAULT_LIMIT) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), "text", F.lit(limit).alias("top_k")
    )


@query
def tfidf_weights(spark, sf_dir):
    vectors = retrieval.term_vectors(table(spark, sf_dir, "documents"), "doc_id")
    return retrieval.tfidf_weights(stored(vectors, "document-terms"), "doc_id")


@query
def search_naive(spark, sf_dir):
    return search.naive(index(spark, sf_dir), questions(spark, sf_dir))


@query
def search_naive_index(spark, sf_dir):
    return search.naive_by_index(index(spark, sf_dir), questions(spark, sf_dir))


@query
def search_local(spark, sf_dir):
    return search.local(index(spark, sf_dir), questions(spark, sf_dir))


@query
def search_global(spark, sf_dir):
    return search.global_(index(spark, sf_dir), questions(spark, sf_dir))


@query
def search_hybrid(spark, sf_dir):
    return search.hybrid(index(spark, sf_dir), questions(spark, sf_dir))


@query
def search_mix(spark, sf_dir):
    mixed = search.mix(index(spark, sf_dir), questions(spark, sf_dir))
    return mixed.select("query_id", "item", "graph_score", "text_score", "part")


@query
def search_all_modes(spark, sf_dir):
    return search.all_modes(index(spark, sf_dir), questions(spark, sf_dir, CONTEXT_LIMIT))


@query
def search_modes(spark, sf_dir):
    """Every question with every mode it can be asked in."""
    asked = retrieval.with_modes(questions(spark, sf_dir))
    return asked.select("query_id", retrieval.checked_mode(F.col("mode")).alias("mode"))


@query
def search_no_hits(spark, sf_dir):
    """Conversation messages asked as questions to the graph: which name no entity."""
    asked = table(spark, sf_dir, "conversations").select(
        message_id().alias("query_id"), "text", F.lit(1).alias("top_k")
    )
    idx = index(spark, sf_dir)
    found = retrieval.match_entities(retrieval.named(retrieval.query_terms(asked), idx.nodes), idx.total, 1)
    return retrieval.no_hits(asked, found)


@query
def vector_topk(spark, sf_dir):
    """Nearest vectors to the mean vector of each label."""
    vectors = table(spark, sf_dir, "embeddings")
    means = (
        vectors.select("label", F.posexplode("embedding").alias("i", "x"))
        .groupBy("label", "i")
        .agg(F.avg("x").alias("x"))
        .groupBy("label")
        .agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
        .select(long(F.col("label")).alias("query_id"), F.transform("v", lambda s: s["x"]).alias("embedding"))
    )
    return retrieval.vector_topk(vectors, means, CONTEXT_LIMIT, "vec_id")


@query
def vector_index_topk(spark, sf_dir):
    """Nearest vectors to every vector whose id is divisible by 100, from the stored index."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return vector_index.nearest(vector_index.build(vectors, "vec_id"), asked, CONTEXT_LIMIT)


# ---------------------------------------------------------------- contexts


def _contexts(spark, sf_dir) -> DataFrame:
    return search.contexts(index(spark, sf_dir), questions(spark, sf_dir, CONTEXT_LIMIT))


@query
def context_assemble(spark, sf_dir):
    return _contexts(spark, sf_dir)


@query
def context_entities(spark, sf_dir):
    return context.entities(stored(_contexts(spark, sf_dir), "contexts"))


@query
def context_relationships(spark, sf_dir):
    return context.relationships(stored(_contexts(spark, sf_dir), "contexts"))


@query
def context_sources(spark, sf_dir):
    return context.sources(stored(_contexts(spark, sf_dir), "contexts"))


@query
def context_number(spark, sf_dir):
    """The messages of each conversation line, as a list of contexts numbered from 1."""
    lists = table(spark, sf_dir, "conversations").select(
        message_id().alias("query_id"), F.split("text", "\n").alias("context_list")
    )
    return context.numbered_contexts(lists)


# ---------------------------------------------------------------- summaries


def _results(spark, sf_dir) -> DataFrame:
    return routing.default_registry().process(manifest(spark, sf_dir))


@query
def process_summary(spark, sf_dir):
    return summaries.process_summary(_results(spark, sf_dir))


@query
def process_errors(spark, sf_dir):
    return summaries.process_errors(_results(spark, sf_dir))


def _run_store(spark, sf_dir) -> str:
    """The store after a run over all items, whose pages are converted, and the same run again."""
    pages = convert.html_markdown(table(spark, sf_dir, "pages"), "url")
    documents = pages.select(F.col("url").alias("item"), F.col("markdown").alias("text"))
    store, when = new_path(spark, "run-store"), F.lit(RUN_AT).cast("timestamp")
    for _ in range(2):
        runs.process_run(manifest(spark, sf_dir), documents, store, "first", when, Options(max_token_size=SECTION_TOKENS + 1))
    return store


@query
def process_run(spark, sf_dir):
    chunks = runs.stored_chunks(spark, _run_store(spark, sf_dir))
    return chunks.select("chunk_id", "source", "seq", F.array_join("headings", " > ").alias("headings"), "n_tokens")


@query
def process_run_summary(spark, sf_dir):
    return runs.run_summaries(spark, _run_store(spark, sf_dir))


@query
def store_summary(spark, sf_dir):
    """Documents as files: their line windows are the chunks, and the insert fails for
    those labelled toxic."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    status = docs.join(labels, "doc_id", "left").select(
        long(F.size(chunking.line_window_column(F.col("text"), LINES))).alias("n_chunks"),
        (F.coalesce("toxic", F.lit(0)) == 0).alias("insert_ok"),
    )
    return summaries.store_summary(_results(spark, sf_dir), status)


# ---------------------------------------------------------------- chat log


@query
def chat_transcript(spark, sf_dir):
    return chatlog.transcript(table(spark, sf_dir, "conversations"))


@query
def chat_pairs(spark, sf_dir):
    return chatlog.pairs(table(spark, sf_dir, "conversations"))


@query
def chat_append(spark, sf_dir):
    """Two messages more for every conversation and for as many new ones."""
    messages = table(spark, sf_dir, "conversations")
    opening = messages.groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    unused = messages.agg(F.max("conv_id") + 1).scalar()
    new = opening.select(
        F.explode(F.array(F.col("conv_id"), F.col("conv_id") + unused)).alias("conv_id"), "text"
    ).select(
        "conv_id",
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("seq"), F.lit("user").alias("role"), F.col("text").alias("text")),
                F.struct(F.lit(1).alias("seq"), F.lit("assistant").alias("role"), F.md5("text").alias("text")),
            )
        ),
    )
    return chatlog.append(messages, new)
