"""Documents to chunks.

One document is one row, so every cut is worked out inside that row and only the
finished chunks are exploded: chunking itself never shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.options import CHUNK_TOKENS, CODE_WINDOW_LINES


def line_window_column(text: Column, lines_per_window: int = CODE_WINDOW_LINES) -> Column:
    """Fixed line windows as ``ARRAY<STRUCT<start_line, end_line, text>>``, blank ones left out."""
    n = lines_per_window

    def cut(lines: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(lines) - 1, F.lit(n)),
            lambda start: F.struct(
                (start + 1).cast("long").alias("start_line"),
                F.least(start + n, F.size(lines)).cast("long").alias("end_line"),
                F.array_join(F.slice(lines, start + 1, F.lit(n)), "\n").alias("text"),
            ),
        )
        return F.filter(windows, lambda w: tx.not_blank(w["text"]))

    return tx.let(F.split(text, "\n"), cut)


def line_windows(
    files: DataFrame, key: str, lines_per_window: int = CODE_WINDOW_LINES, text: str = "text"
) -> DataFrame:
    """Rows ``key, start_line, end_line, type, text``; lines count from 1."""
    return files.select(
        key, F.inline(line_window_column(F.col(text), lines_per_window))
    ).select(key, "start_line", "end_line", F.lit("fallback_chunk").alias("type"), "text")


def token_window_column(text: Column, size: int = CHUNK_TOKENS, overlap: int = 0) -> Column:
    """Windows of at most ``size`` tokens as ``ARRAY<STRUCT<seq, n_tokens, text>>``."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below the window size")
    step = size - overlap

    def cut(toks: Column) -> Column:
        # With an overlap, a window that would only repeat the tail of the one
        # before it is not started.
        last = F.greatest(F.size(toks) - 1 - overlap, F.lit(0))
        return F.transform(
            F.sequence(F.lit(0), last, F.lit(step)),
            lambda start, i: F.struct(
                i.cast("long").alias("seq"),
                F.least(F.lit(size), F.size(toks) - start).cast("long").alias("n_tokens"),
                F.array_join(F.slice(toks, start + 1, F.lit(size)), " ").alias("text"),
            ),
        )

    empty = F.array().cast("array<struct<seq:bigint,n_tokens:bigint,text:string>>")
    return tx.let(tx.tokens(text), lambda t: F.when(F.size(t) > 0, cut(t)).otherwise(empty))


def token_windows(
    docs: DataFrame, keys: list[str], size: int = CHUNK_TOKENS, overlap: int = 0, text: str = "text"
) -> DataFrame:
    return docs.select(*keys, F.inline(token_window_column(F.col(text), size, overlap)))


def paragraph_pack_column(text: Column, max_tokens: int = CHUNK_TOKENS) -> Column:
    """Lines merged greedily up to ``max_tokens``: ``ARRAY<STRUCT<seq, n_tokens, text>>``.

    A line over the limit is first cut into token windows. The running fold keeps
    only the positions where a chunk starts, so its state grows with the number of
    chunks, not of lines.
    """
    piece_type = "array<struct<n:bigint,text:string>>"

    def line_pieces(line: Column) -> Column:
        n = tx.token_count(line)
        whole = F.array(F.struct(n.alias("n"), line.alias("text"))).cast(piece_type)
        cut = F.transform(
            token_window_column(line, max_tokens),
            lambda w: F.struct(w["n_tokens"].alias("n"), w["text"].alias("text")),
        ).cast(piece_type)
        return F.when(n <= max_tokens, whole).otherwise(cut)

    def starts(pieces: Column) -> Column:
        zero = F.struct(
            F.lit(0).cast("int").alias("at"),
            F.lit(0).cast("long").alias("run"),
            F.array(F.lit(0)).alias("starts"),
        )

        def step(acc: Column, piece: Column) -> Column:
            fits = acc["run"] + piece["n"] <= max_tokens
            return F.struct(
                (acc["at"] + 1).alias("at"),
                F.when(fits, acc["run"] + piece["n"]).otherwise(piece["n"]).alias("run"),
                F.when(fits | (acc["at"] == 0), acc["starts"])
                .otherwise(F.concat(acc["starts"], F.array(acc["at"])))
                .alias("starts"),
            )

        return F.aggregate(pieces, zero, step, lambda acc: acc["starts"])

    def pack(pieces: Column) -> Column:
        return tx.let(
            starts(pieces),
            lambda s: F.transform(
                s,
                lambda first, i: tx.let(
                    F.slice(
                        pieces, first + 1, F.coalesce(F.get(s, i + 1), F.size(pieces)) - first
                    ),
                    lambda part: F.struct(
                        i.cast("long").alias("seq"),
                        F.aggregate(
                            part, F.lit(0).cast("long"), lambda total, p: total + p["n"]
                        ).alias("n_tokens"),
                        F.array_join(F.transform(part, lambda p: p["text"]), "\n").alias("text"),
                    ),
                ),
            ),
        )

    return tx.let(F.flatten(F.transform(F.split(text, "\n"), line_pieces)), pack)


def paragraph_pack(
    docs: DataFrame, keys: list[str], max_tokens: int = CHUNK_TOKENS, text: str = "text"
) -> DataFrame:
    """Structural chunks: neighbouring lines together, blank chunks dropped."""
    return docs.select(*keys, F.inline(paragraph_pack_column(F.col(text), max_tokens))).filter(
        tx.not_blank(F.col("text"))
    )


_HEADING = r"^#{1,6} "


def section_column(markdown: Column) -> Column:
    """Sections of a converted page as ``ARRAY<STRUCT<headings ARRAY<STRING>, text>>``.

    A heading line opens a section and closes those of its level and below; a section has
    its own heading last in ``headings`` and the ones it stands under before. The text before
    the first heading has none; sections without text of their own are left out. The fold
    goes over the headings of a page, not over its lines.
    """
    path_type = "array<struct<level:int,title:string>>"
    found_type = "array<struct<at:int,headings:array<string>>>"

    def marks(lines: Column) -> Column:
        told = F.transform(
            lines,
            lambda line, i: F.struct(
                i.cast("int").alias("at"),
                F.length(F.regexp_extract(line, r"^(#{1,6}) ", 1)).cast("int").alias("level"),
                F.trim(F.regexp_replace(line, _HEADING, "")).alias("title"),
            ),
        )
        return F.filter(told, lambda m: m["level"] > 0)

    def step(acc: Column, mark: Column) -> Column:
        own = F.array(F.struct(mark["level"].alias("level"), mark["title"].alias("title"))).cast(path_type)
        above = F.concat(F.filter(acc["open"], lambda o: o["level"] < mark["level"]), own)
        titles = F.transform(above, lambda o: o["title"])
        here = F.array(F.struct(mark["at"].alias("at"), titles.alias("headings"))).cast(found_type)
        return F.struct(above.alias("open"), F.concat(acc["found"], here).alias("found"))

    def cut(lines: Column) -> Column:
        top = F.array(F.struct(F.lit(-1).alias("at"), F.array().cast("array<string>").alias("headings"))).cast(found_type)
        start = F.struct(F.array().cast(path_type).alias("open"), top.alias("found"))

        def sections(found: Column) -> Column:
            def body(section: Column, i: Column) -> Column:
                end = F.coalesce(F.get(found, i + 1)["at"], F.size(lines))
                own = F.slice(lines, section["at"] + 2, end - section["at"] - 1)
                return F.struct(section["headings"].alias("headings"), F.array_join(own, "\n").alias("text"))

            return F.filter(F.transform(found, body), lambda s: tx.not_blank(s["text"]))

        return tx.let(F.aggregate(marks(lines), start, step, lambda acc: acc["found"]), sections)

    return tx.let(F.split(markdown, "\n"), cut)


def structured_chunk_column(markdown: Column, max_tokens: int = CHUNK_TOKENS) -> Column:
    """Chunks that keep to the headings: ``ARRAY<STRUCT<headings, n_tokens, text>>``. Neighbouring
    lines merge up to ``max_tokens``, but only under one heading; longer sections are cut."""

    def packed(section: Column) -> Column:
        parts = F.filter(paragraph_pack_column(section["text"], max_tokens), lambda c: tx.not_blank(c["text"]))
        return F.transform(
            parts,
            lambda c: F.struct(section["headings"].alias("headings"), c["n_tokens"].alias("n_tokens"), c["text"].alias("text")),
        )

    return F.flatten(F.transform(section_column(markdown), packed))


def structured_chunks(
    docs: DataFrame, keys: list[str], max_tokens: int = CHUNK_TOKENS, text: str = "text"
) -> DataFrame:
    """``keys, seq, headings, n_tokens, text``: a null text has no chunks."""
    cut = docs.select(*keys, F.posexplode(structured_chunk_column(F.col(text), max_tokens)).alias("seq", "chunk"))
    return cut.select(*keys, F.col("seq").cast("long").alias("seq"), "chunk.*")


def token_counts(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    return docs.select(*keys, tx.token_count(F.col(text)).alias("n_tokens"))


def with_chunk_id(chunks: DataFrame, text: str = "text") -> DataFrame:
    return chunks.withColumn("chunk_id", F.md5(F.col(text)))


def unique_chunks(chunks: DataFrame) -> DataFrame:
    """One row per ``chunk_id``: the copy with the smallest ``(doc_id, seq)``.

    Copies are merged before the shuffle, so a text that fills a third of the
    corpus sends one row per task. The result is partitioned by ``chunk_id``, which
    the per-chunk steps that follow rely on.
    """
    kept = ["doc_id", "seq", *[c for c in chunks.columns if c not in ("chunk_id", "doc_id", "seq")]]
    return (
        chunks.groupBy("chunk_id")
        .agg(F.min(F.struct(*kept)).alias("first"))
        .select("chunk_id", "first.*")
    )
