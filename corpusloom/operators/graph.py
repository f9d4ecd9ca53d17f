"""Entity graph: mentions, relations, merging, upsert and neighbourhoods.

Long lists stay in long form. An entity that occurs in a third of all chunks has as
many rows in ``entity_sources``; its node row carries counts and the first source.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators.skew import numbered, salted_join
from corpusloom.options import EDGE_BATCH, NODE_BATCH, TRIPLE_LIMIT

# An edge row shows this many keywords, the commonest; ``relation_keywords`` has all of them.
SHOWN_KEYWORDS = 5
# Words between two related entities at most, unless a caller says otherwise.
PAIR_WINDOW = 5

# Keyword fragments that name a relation type, first match wins.
RELATION_TYPES = ("lead", "participate", "uses", "located", "occurs")


def mentions(chunks: DataFrame, gazetteer: DataFrame, kind: str = "lang") -> DataFrame:
    """Gazetteer words in each chunk with their position.

    ``chunks(chunk_id, doc_id, text, <kind>)``, ``gazetteer(term)`` or
    ``gazetteer(term, entity_type)``; without a type of its own a mention takes the
    chunk's ``kind``. Rows: ``chunk_id, doc_id, pos, name, entity_type, link``, where ``link`` is
    the word that follows, whatever it is, null at the end of a chunk.
    The join is a plain equi join: Catalyst broadcasts the gazetteer while it is under
    the size threshold and otherwise sort-merges with skew splitting.
    """

    def with_context(ws: Column) -> Column:
        return F.transform(
            ws,
            lambda w, i: F.struct(
                w.alias("name"), i.alias("pos"), F.get(ws, i + 1).alias("next_word")
            ),
        )

    found = (
        chunks.select("chunk_id", "doc_id", F.col(kind).alias("_kind"), tx.words(F.col("text")).alias("_w"))
        .select("chunk_id", "doc_id", "_kind", F.inline(with_context(F.col("_w"))))
        .join(gazetteer.withColumnRenamed("term", "name"), "name")
    )
    own = F.col("entity_type") if "entity_type" in gazetteer.columns else F.lit(None).cast("string")
    return found.select(
        "chunk_id",
        "doc_id",
        F.col("pos").cast("long").alias("pos"),
        "name",
        F.coalesce(own, F.col("_kind")).alias("entity_type"),
        F.col("next_word").alias("link"),
    )


def pattern_mentions(chunks: DataFrame, patterns: Mapping[str, str]) -> DataFrame:
    """Entities found by regular expressions, one per type; no join at all."""

    def hits(kind: str, pattern: str) -> Column:
        return F.transform(
            F.regexp_extract_all(F.col("text"), F.lit(pattern), F.lit(0)),
            lambda m: F.struct(m.alias("name"), F.lit(kind).alias("entity_type")),
        )

    found = F.concat(*[hits(kind, pattern) for kind, pattern in patterns.items()])
    return chunks.select("chunk_id", "doc_id", F.inline(found))


def phrase_mentions(chunks: DataFrame, gazetteer: DataFrame, kind: str = "lang") -> DataFrame:
    """Names of several words in each chunk, the longest from the left, no two overlapping.

    ``gazetteer(term)`` or ``gazetteer(term, entity_type)``; words of a term are separated by one
    blank. Rows as those of ``mentions``; ``link`` is the word that follows the name.

    The first words of all names are a table of their own with the length of the longest name
    that begins so. Only words found in it go on, with as many words after them as such a name
    has; these openings are looked up among the names by equi join. What overlaps is decided
    in a chunk's own row, by a fold over the names found there.
    """
    names = gazetteer.withColumn("_n", F.size(F.split("term", " ")))
    first = F.split_part(F.col("term"), F.lit(" "), F.lit(1))
    heads = names.groupBy(first.alias("_first")).agg(F.max("_n").alias("_most"))
    longest = names.agg(F.coalesce(F.max("_n"), F.lit(1))).first()[0]

    def with_next(ws: Column) -> Column:
        return F.transform(
            ws, lambda w, i: F.struct(w.alias("_first"), i.alias("pos"), F.slice(ws, i + 1, F.lit(longest + 1)).alias("_ahead"))
        )

    words = chunks.select("chunk_id", "doc_id", F.col(kind).alias("_kind"), tx.words(F.col("text")).alias("_w"))
    opened = words.select("chunk_id", "doc_id", "_kind", F.inline(with_next(F.col("_w")))).join(heads, "_first")
    tried = F.explode(F.sequence(F.lit(1), F.least("_most", F.size("_ahead")))).alias("_n")
    tried = opened.select("chunk_id", "doc_id", "_kind", "pos", "_ahead", tried)
    tried = tried.withColumn("term", F.array_join(F.slice("_ahead", F.lit(1), F.col("_n")), " "))
    own = F.col("entity_type") if "entity_type" in gazetteer.columns else F.lit(None).cast("string")
    found = tried.join(names.drop("_n"), "term").select(
        "chunk_id",
        "doc_id",
        F.struct(
            F.col("pos").cast("long").alias("pos"),
            (-F.col("_n")).alias("less"),
            F.col("term").alias("name"),
            F.coalesce(own, F.col("_kind")).alias("entity_type"),
            F.get("_ahead", F.col("_n")).alias("link"),
        ).alias("m"),
    )
    per_chunk = found.groupBy("chunk_id", "doc_id").agg(F.array_sort(F.collect_list("m")).alias("all"))
    kind_of = "array<struct<pos:bigint,less:int,name:string,entity_type:string,link:string>>"
    start = F.struct(F.lit(0).cast("long").alias("free"), F.array().cast(kind_of).alias("kept"))

    def step(acc: Column, m: Column) -> Column:
        fits = m["pos"] >= acc["free"]
        return F.struct(
            F.when(fits, m["pos"] - m["less"]).otherwise(acc["free"]).alias("free"),
            F.when(fits, F.concat(acc["kept"], F.array(m).cast(kind_of))).otherwise(acc["kept"]).alias("kept"),
        )

    kept = F.aggregate("all", start, step, lambda acc: acc["kept"])
    return per_chunk.select("chunk_id", "doc_id", F.inline(kept)).drop("less")


def entity_sources(found: DataFrame) -> DataFrame:
    """Every (entity, chunk) pair with its number of mentions."""
    return found.groupBy("chunk_id", "doc_id", "name", "entity_type").agg(
        F.count("*").alias("n")
    )


def entity_counts(sources: DataFrame) -> DataFrame:
    """What a batch of chunks says of its entities: ``name, entity_type, n, n_sources, first_doc``.
    Counts of batches that share no chunk add up, see ``add_entity_counts``."""
    return sources.groupBy("name", "entity_type").agg(
        F.sum("n").alias("n"), F.count("*").alias("n_sources"), F.min("doc_id").alias("first_doc")
    )


def add_entity_counts(counts: DataFrame) -> DataFrame:
    """Counts of several batches as those of one."""
    return counts.groupBy("name", "entity_type").agg(
        F.sum("n").alias("n"), F.sum("n_sources").alias("n_sources"), F.min("first_doc").alias("first_doc")
    )


def entity_nodes(counts: DataFrame) -> DataFrame:
    """One node per entity: most frequent type (ties by name), counts, first source."""
    return (
        counts.groupBy("name")
        .agg(
            F.min_by("entity_type", F.struct(-F.col("n"), F.col("entity_type"))).alias("entity_type"),
            F.sum("n").alias("n_mentions"),
            F.sum("n_sources").alias("n_sources"),
            F.min("first_doc").alias("first_doc"),
        )
        .select(
            F.col("name").alias("id"),
            "entity_type",
            F.concat(
                F.col("name"),
                F.lit(": "),
                F.col("n_mentions").cast("string"),
                F.lit(" mentions in "),
                F.col("n_sources").cast("string"),
                F.lit(" chunks"),
            ).alias("description"),
            F.col("first_doc").cast("string").alias("source_id"),
            "n_mentions",
            "n_sources",
        )
    )


def entity_merge(sources: DataFrame) -> DataFrame:
    """The nodes of one batch of chunks."""
    return entity_nodes(entity_counts(sources))


def relation_pairs(found: DataFrame, window: int | None = PAIR_WINDOW) -> DataFrame:
    """Undirected relations per chunk: two different entities at most ``window`` words apart, or,
    without a window, anywhere in the chunk.

    ``links`` are the words that follow the first of the two, where one stands between them.

    Each mention meets only the mentions in the next ``window`` words, so the rows grow
    with the text and not with the square of a chunk's mentions. Without a window they grow with
    the square of a chunk's length, which the chunking bounds.
    """
    reach = Window.unboundedFollowing if window is None else window
    ahead = Window.partitionBy("chunk_id").orderBy("pos").rangeBetween(1, reach)
    return (
        found.withColumn("ahead", F.collect_list(F.struct("pos", "name")).over(ahead))
        .withColumn("next", F.explode("ahead"))
        .withColumn("later", F.col("next.name"))
        .withColumn("between", F.when(F.col("next.pos") > F.col("pos") + 1, F.col("link")))
        .filter(F.col("name") != F.col("later"))
        .groupBy(
            "chunk_id",
            "doc_id",
            F.least("name", "later").alias("source"),
            F.greatest("name", "later").alias("target"),
        )
        .agg(F.count("*").alias("weight"), F.sort_array(F.collect_set("between")).alias("links"))
    )


def relation_keywords(pairs: DataFrame) -> DataFrame:
    """``source, target, keyword, n_chunks``: every word that links two entities."""
    words = pairs.select("source", "target", F.explode("links").alias("keyword"))
    return words.groupBy("source", "target", "keyword").agg(F.count("*").alias("n_chunks"))


def relation_counts(pairs: DataFrame) -> DataFrame:
    """What a batch of chunks says of its relations: ``source, target, keyword, weight, n_sources,
    first_doc, n_chunks``.

    The row without a keyword has the relation's weight, chunks and first document, the others
    in how many chunks a word links the two. Counts of batches that share no chunk add up.
    """
    nothing = F.lit(0).cast("long")
    own = F.struct(
        F.lit(None).cast("string").alias("keyword"),
        F.col("weight").cast("long").alias("weight"),
        F.lit(1).cast("long").alias("n_sources"),
        F.col("doc_id").alias("first_doc"),
        nothing.alias("n_chunks"),
    )
    words = F.transform(
        "links",
        lambda word: F.struct(
            word.alias("keyword"),
            nothing.alias("weight"),
            nothing.alias("n_sources"),
            F.lit(None).cast("long").alias("first_doc"),
            F.lit(1).cast("long").alias("n_chunks"),
        ),
    )
    return add_relation_counts(pairs.select("source", "target", F.inline(F.concat(F.array(own), words))))


def add_relation_counts(counts: DataFrame) -> DataFrame:
    """Counts of several batches as those of one."""
    return counts.groupBy("source", "target", "keyword").agg(
        F.sum("weight").alias("weight"),
        F.sum("n_sources").alias("n_sources"),
        F.min("first_doc").alias("first_doc"),
        F.sum("n_chunks").alias("n_chunks"),
    )


def relation_edges(counts: DataFrame) -> DataFrame:
    """One edge per (source, target): summed weight, commonest keywords, first source, and the
    relation type, decided on all of its keywords and not only on those shown."""
    turn = Window.partitionBy("source", "target").orderBy(F.desc("n_chunks"), "keyword")
    ranked = counts.withColumn("rank", F.row_number().over(turn))
    word = F.col("keyword")
    known = F.coalesce(*[F.when(word.contains(name), F.lit(i)) for i, name in enumerate(RELATION_TYPES, 1)])
    shown = F.collect_list(F.when((F.col("rank") <= SHOWN_KEYWORDS) & word.isNotNull(), F.struct("rank", "keyword")))
    listed = F.transform(F.array_sort("shown"), lambda k: k["keyword"])
    first = F.replace(F.split_part(F.col("first_word"), F.lit(","), F.lit(1)), F.lit('"'), F.lit(""))
    names = F.array(*[F.lit(name) for name in RELATION_TYPES])
    return (
        ranked.groupBy("source", "target")
        .agg(
            F.sum("weight").alias("w"),
            F.sum("n_sources").alias("n_sources"),
            F.min("first_doc").alias("first_doc"),
            shown.alias("shown"),
            F.min(known).alias("known"),
            F.min(F.when(F.col("rank") == 1, word)).alias("first_word"),
        )
        .select(
            "source",
            "target",
            F.col("w").cast("double").alias("weight"),
            F.concat(
                F.col("source"),
                F.lit(" with "),
                F.col("target"),
                F.lit(" in "),
                F.col("n_sources").cast("string"),
                F.lit(" chunks"),
            ).alias("description"),
            F.when(F.size("shown") > 0, F.array_join(listed, ",")).alias("keywords"),
            F.col("first_doc").cast("string").alias("source_id"),
            "n_sources",
            F.coalesce(F.get(names, F.col("known") - 1), first).alias("rel_type"),
        )
    )


def relation_merge(pairs: DataFrame) -> DataFrame:
    """The edges of one batch of chunks."""
    return relation_edges(relation_counts(pairs))


def node_upsert(existing: DataFrame, new: DataFrame, order: str = "batch") -> DataFrame:
    """``new`` replaces rows of ``existing`` with the same id; within ``new`` the row with
    the largest ``order`` wins. The display name is the id."""
    columns = existing.columns
    latest = (
        new.groupBy("id")
        .agg(F.max_by(F.struct(*[F.col(c) for c in columns if c != "id"]), order).alias("row"))
        .select("id", "row.*")
        .select(*columns)
    )
    return (
        existing.join(latest.select("id"), "id", "left_anti")
        .select(*columns)
        .unionByName(latest)
        .withColumn("display_name", F.col("id"))
    )


def with_label(nodes: DataFrame) -> DataFrame:
    """A node's one label is its type."""
    return nodes.withColumn("label", F.col("entity_type"))


def label_counts(nodes: DataFrame) -> DataFrame:
    return with_label(nodes).groupBy("label").agg(F.count("*").alias("n_nodes"))


def relation_type(words: Column) -> Column:
    """First known fragment contained in the keywords (case-sensitive), else the first
    comma part without double quotes."""
    kind = F.replace(F.split_part(words, F.lit(","), F.lit(1)), F.lit('"'), F.lit(""))
    for name in reversed(RELATION_TYPES):
        kind = F.when(words.contains(name), name).otherwise(kind)
    return kind


def with_relation_type(edges: DataFrame) -> DataFrame:
    """Edges with their type: the one they have from ``relation_edges``, or that of their keywords."""
    if "rel_type" in edges.columns:
        return edges
    return edges.withColumn("rel_type", relation_type(F.col("keywords")))


def _ids(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.select(F.col("id").alias(name))


def edges_with_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two endpoints exist. A hub may hold a large share of the edges, so
    both semi joins salt hot endpoints."""
    kept = salted_join(edges, _ids(nodes, "source"), "source", "left_semi")
    return salted_join(kept, _ids(nodes, "target"), "target", "left_semi").select(*edges.columns)


def edges_without_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges that an insert would drop, with which end is missing."""
    source = _ids(nodes, "source").withColumn("has_source", F.lit(True))
    target = _ids(nodes, "target").withColumn("has_target", F.lit(True))
    flagged = salted_join(salted_join(edges, source, "source", "left"), target, "target", "left")
    return (
        flagged.filter(F.col("has_source").isNull() | F.col("has_target").isNull())
        .select(
            "source",
            "target",
            F.col("has_source").isNull().alias("source_missing"),
            F.col("has_target").isNull().alias("target_missing"),
        )
    )


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of every edge: ``id, neighbour``."""
    ends = F.array(
        F.struct(F.col("source").alias("id"), F.col("target").alias("neighbour")),
        F.struct(F.col("target").alias("id"), F.col("source").alias("neighbour")),
    )
    return edges.select(F.inline(ends))


def two_hop(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``seed, id, hop`` of every node within two steps of a seed; the nearest hop wins.

    The first step is made distinct before the second, so the second join sees each
    (seed, node) once however many edges lead there.
    """
    links = adjacency(edges)
    start = seeds.select(F.col("seed"), F.col("seed").alias("id"))
    first = salted_join(links, start, "id").select("seed", F.col("neighbour").alias("id")).distinct()
    second = salted_join(links, first, "id").select("seed", F.col("neighbour").alias("id"))
    return (
        start.withColumn("hop", F.lit(0))
        .unionByName(first.withColumn("hop", F.lit(1)))
        .unionByName(second.withColumn("hop", F.lit(2)))
        .groupBy("seed", "id")
        .agg(F.min("hop").cast("long").alias("hop"))
    )


def highlight(nodes: DataFrame, hops: DataFrame) -> DataFrame:
    """All nodes with their hop class for one selected node; null means out of reach."""
    return nodes.join(hops.select("id", "hop"), "id", "left")


def subgraph(nodes: DataFrame, edges: DataFrame, selection: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of ``selection(id)`` and the edges among them; an empty selection keeps all."""
    chosen = selection.select("id").distinct()
    nothing = chosen.agg(F.count("*")).scalar() == 0
    flag = chosen.withColumn("chosen", F.lit(True))
    kept_nodes = nodes.join(flag, "id", "left").filter(F.col("chosen") | nothing).drop("chosen")
    ends = edges
    for end in ("source", "target"):
        ends = salted_join(
            ends, flag.select(F.col("id").alias(end), F.col("chosen").alias(f"_{end}")), end, "left"
        )
    kept_edges = ends.filter((F.col("_source") & F.col("_target")) | nothing).select(*edges.columns)
    return kept_nodes, kept_edges


def _truthy(df: DataFrame, prop: str) -> Column:
    value = F.col(prop)
    kind = df.schema[prop].dataType.typeName()
    if kind == "string":
        return value != ""
    if kind == "boolean":
        return value
    if kind in ("double", "float"):
        return (value != 0) & ~F.isnan(value)
    if kind in ("byte", "short", "integer", "long", "decimal"):
        return value != 0
    return value.isNotNull()


def _matches(df: DataFrame, prop: str, values: list[str] | str) -> Column:
    """The property is set and its text is one of ``values``, or part of a single string."""
    text = F.col(prop).cast("string")
    if df.schema[prop].dataType.typeName() in ("double", "float"):
        text = F.regexp_replace(text, r"\.0$", "")  # a whole number is written without a point
    hit = F.lit(values).contains(text) if isinstance(values, str) else text.isin(*values)
    return _truthy(df, prop) & hit


def filter_nodes(nodes: DataFrame, prop: str, values: list[str] | str) -> DataFrame:
    return nodes.filter(_matches(nodes, prop, values)).select("id")


def filter_edges(edges: DataFrame, prop: str, values: list[str] | str) -> DataFrame:
    """Both endpoints of every matching edge, each once."""
    return (
        edges.filter(_matches(edges, prop, values))
        .select(F.explode(F.array("source", "target")).alias("id"))
        .distinct()
    )


def triples(edges: DataFrame, nodes: DataFrame, limit: int = TRIPLE_LIMIT) -> DataFrame:
    """The first ``limit`` node–relation–node triples by key."""
    ends = nodes.select("id", "entity_type")
    source = ends.withColumnsRenamed({"id": "source", "entity_type": "source_type"})
    target = ends.withColumnsRenamed({"id": "target", "entity_type": "target_type"})
    joined = salted_join(salted_join(edges, source, "source"), target, "target")
    return (
        joined.select("source", "source_type", "target", "target_type", "weight", "keywords")
        .orderBy("source", "target")
        .limit(limit)
    )


def batches(
    nodes: DataFrame, edges: DataFrame, node_batch: int = NODE_BATCH, edge_batch: int = EDGE_BATCH
) -> DataFrame:
    """``kind, key, batch`` of every row in export order, batches counted from 0."""

    def cut(df: DataFrame, kind: str, key: Column, n: int) -> DataFrame:
        return numbered(df.select(key.alias("key")), F.col("key")).select(
            F.lit(kind).alias("kind"),
            "key",
            F.floor((F.col("row_no") - 1) / n).cast("long").alias("batch"),
        )

    return cut(nodes, "nodes", F.col("id"), node_batch).unionByName(
        cut(edges, "edges", F.concat_ws("|", "source", "target"), edge_batch)
    )
