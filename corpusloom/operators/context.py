"""Context texts: assembled from ranked results, and taken apart into tables again.

A context is one string of three fenced CSV sections. It is bounded by the result
limit of its query, so it is split inside its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.schemas import RELATION_ROWS

# Section markers and fences of a context.
ENTITIES = "-----Entities-----"
RELATIONSHIPS = "-----Relationships-----"
SOURCES = "-----Sources-----"
FENCE_OPEN = "```csv"
FENCE = "```"

SECTION_HEADERS = {
    "entity": "id,entity,type,description",
    "relation": "id,source,target,description,keywords,weight,source_id",
    "chunk": "id,content",
}


def csv_cell(value: Column) -> Column:
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def csv_line(first: Column, *cells: Column) -> Column:
    return F.concat_ws(",", first.cast("string"), *[csv_cell(c) for c in cells])


def assemble(lines: DataFrame) -> DataFrame:
    """``lines(query_id, part, rank, line)`` to ``query_id, context``.

    A query has at most its result limit of lines per section.
    """

    def section(name: str, marker: str) -> Column:
        ordered = F.array_sort(
            F.collect_list(F.when(F.col("part") == name, F.struct("rank", "line")))
        )
        body = F.concat(F.array(F.lit(SECTION_HEADERS[name])), F.transform(ordered, lambda s: s["line"]))
        return F.concat(
            F.lit(marker + "\n" + FENCE_OPEN + "\n"), F.array_join(body, "\n"), F.lit("\n" + FENCE)
        )

    return lines.groupBy("query_id").agg(
        F.concat_ws(
            "\n",
            section("entity", ENTITIES),
            section("relation", RELATIONSHIPS),
            section("chunk", SOURCES),
        ).alias("context")
    )


def _section(context: Column, marker: str, until: str | None) -> Column:
    body = F.split_part(context, F.lit(marker), F.lit(2))
    return F.split_part(body, F.lit(until), F.lit(1)) if until else body


def _unfenced(section: Column) -> Column:
    inside = F.split_part(
        F.split_part(section, F.lit(FENCE_OPEN), F.lit(2)), F.lit(FENCE), F.lit(1)
    )
    return tx.strip(F.when(section.contains(FENCE_OPEN), inside).otherwise(section))


def quoted_split(line: Column) -> Column:
    """Split on commas outside double quotes; quotes stay, fields are trimmed.

    Every second piece between quotes is outside of them, so only the commas there
    become separators.
    """
    mark = "\u0001"
    pieces = F.transform(
        F.split(line, '"'),
        lambda p, i: F.when(i % 2 == 0, F.replace(p, F.lit(","), F.lit(mark))).otherwise(p),
    )
    return F.transform(F.split(F.array_join(pieces, '"'), mark), tx.strip)


def _entity_lines(contexts: DataFrame) -> DataFrame:
    """``query_id, row_no, header, fields`` of each data line of the entity section."""
    body = _unfenced(_section(F.col("context"), ENTITIES, RELATIONSHIPS))
    header = F.split(tx.strip(F.get("lines", F.lit(0))), ",")
    return (
        contexts.filter(F.col("context").contains(ENTITIES))
        .select("query_id", F.split(body, "\n").alias("lines"))
        .select(
            "query_id",
            F.transform(header, tx.strip).alias("header"),
            F.posexplode("lines").alias("row_no", "line"),
        )
        .filter((F.col("row_no") > 0) & tx.not_blank(F.col("line")))
        .select(
            "query_id",
            F.col("row_no").cast("long").alias("row_no"),
            "header",
            quoted_split(F.col("line")).alias("fields"),
        )
    )


def entities(contexts: DataFrame) -> DataFrame:
    """Entity rows in long form: ``query_id, row_no, col_no, column, value``.

    Each context's header names its columns; short rows are padded with '' and long
    ones cut.
    """
    return (
        _entity_lines(contexts)
        .select("query_id", "row_no", "fields", F.posexplode("header").alias("col_no", "column"))
        .select(
            "query_id",
            "row_no",
            (F.col("col_no") + 1).cast("long").alias("col_no"),
            "column",
            F.coalesce(F.get("fields", F.col("col_no")), F.lit("")).alias("value"),
        )
    )


def entity_table(contexts: DataFrame, columns: list[str]) -> DataFrame:
    """Entity rows with ``columns`` looked up in each context's header; null where a
    header does not have one."""

    def value(name: str) -> Column:
        place = F.array_position("header", F.lit(name)).cast("int")
        padded = F.coalesce(F.get("fields", place - 1), F.lit(""))
        return F.when(place > 0, padded).alias(name)

    return _entity_lines(contexts).select("query_id", "row_no", *[value(c) for c in columns])


def logical_lines(text: Column) -> Column:
    """Lines of CSV text, with a line break inside quotes kept in its line."""

    def step(acc: Column, line: Column) -> Column:
        quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
        joined = F.when(
            acc["open"],
            F.concat(
                F.slice(acc["lines"], 1, F.size(acc["lines"]) - 1),
                F.array(F.concat(F.element_at(acc["lines"], -1), F.lit("\n"), line)),
            ),
        ).otherwise(F.concat(acc["lines"], F.array(line)))
        return F.struct(
            joined.alias("lines"), (acc["open"] != (quotes % 2 == 1)).alias("open")
        )

    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit(False).alias("open"))
    return F.aggregate(F.split(text, "\n"), start, step, lambda acc: acc["lines"])


def relationships(contexts: DataFrame, schema: str = RELATION_ROWS) -> DataFrame:
    """Relationship rows by standard CSV rules with a declared schema.

    A context without the marker, or with a row of more fields than its header, gives
    no rows at all.
    """
    section = _section(F.col("context"), RELATIONSHIPS, SOURCES)
    body = tx.strip(
        F.replace(F.replace(section, F.lit(FENCE_OPEN), F.lit("")), F.lit(FENCE), F.lit(""))
    )
    width = lambda line: F.size(quoted_split(line))
    lines = (
        contexts.filter(F.col("context").contains(RELATIONSHIPS))
        .select("query_id", F.filter(logical_lines(body), tx.not_blank).alias("lines"))
        .filter(F.size("lines") > 1)
        .filter(~F.exists("lines", lambda line: width(line) > width(F.get("lines", F.lit(0)))))
        .select("query_id", F.posexplode("lines").alias("row_no", "line"))
        .filter(F.col("row_no") > 0)
    )
    row = F.from_csv("line", schema, {"escape": '"', "multiLine": "true"})
    return lines.select("query_id", F.col("row_no").cast("long").alias("row_no"), row.alias("row")).select(
        "query_id", "row_no", "row.*"
    )


def sources(contexts: DataFrame) -> DataFrame:
    """Source rows: the first comma parts id from content; without one the id is
    ``row_<line number>``, blank lines counted."""
    lines = (
        contexts.filter(F.col("context").contains(SOURCES))
        .select(
            "query_id",
            F.posexplode(F.split(_unfenced(_section(F.col("context"), SOURCES, None)), "\n")).alias(
                "row_no", "line"
            ),
        )
        .filter((F.col("row_no") > 0) & tx.not_blank(F.col("line")))
    )
    comma = F.instr("line", ",")
    cut = lambda expr: tx.strip(F.expr(expr))
    return lines.select(
        "query_id",
        F.col("row_no").cast("long").alias("row_no"),
        F.when(comma > 0, cut("substr(line, 1, instr(line, ',') - 1)"))
        .otherwise(F.concat(F.lit("row_"), F.col("row_no").cast("string")))
        .alias("id"),
        F.when(comma > 0, cut("substr(line, instr(line, ',') + 1)"))
        .otherwise(tx.strip(F.col("line")))
        .alias("content"),
    )


def numbered_contexts(contexts: DataFrame, column: str = "context_list") -> DataFrame:
    """Each context of a list with its number from 1."""
    return contexts.select("query_id", F.posexplode(column).alias("pos", "context")).select(
        "query_id", (F.col("pos") + 1).cast("long").alias("number"), "context"
    )
