"""Source files to blocks.

A file is one row and its blocks are worked out in that row, so nothing shuffles. What runs
over its lines is a loop in Python (``functions.lexer``) that sees the text column alone, in
Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import lexer
from corpusloom.functions import text as tx
from corpusloom.operators import chunking
from corpusloom.options import CHUNK_TOKENS, CODE_WINDOW_LINES

# Suffixes that count as code, and those with a block grammar.
CODE_SUFFIXES = (
    ".py",
    ".lua",
    ".js",
    ".ts",
    ".java",
    ".c",
    ".cpp",
    ".h",
    ".go",
    ".rb",
    ".php",
)
LANGUAGES = {".py": "python", ".js": "javascript", ".ts": "typescript"}


def is_code(path: Column) -> Column:
    return F.lower(tx.suffix(path)).isin(*CODE_SUFFIXES)


def language(path: Column) -> Column:
    """Language with a block grammar, else null."""
    pairs = [F.lit(v) for item in LANGUAGES.items() for v in item]
    return F.create_map(*pairs)[F.lower(tx.suffix(path))]


BLOCK_COLUMNS = ("file_id", "path", "start_line", "end_line", "type", "text")
_BLOCKS = "array<struct<start_line:bigint,end_line:bigint,type:string,text:string>>"
_ARROW = pa.list_(
    pa.struct([("start_line", pa.int64()), ("end_line", pa.int64()), ("type", pa.string()), ("text", pa.string())])
)


def _lexed(text: Column, blocks: Callable[[str], list[lexer.Block]]) -> Column:
    """``blocks`` of each text; a null one has none."""
    names = [field.name for field in _ARROW.value_type]

    @F.arrow_udf(_BLOCKS)
    def lex(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            rows = ([dict(zip(names, b)) for b in blocks(t.as_py())] if t.is_valid else [] for t in column)
            yield pa.array(rows, _ARROW)

    return lex(text)


def python_blocks(files: DataFrame) -> DataFrame:
    """Classes and functions at every depth, nested ones as well as their parents.

    ``files(file_id, path, text)`` -> ``file_id, path, start_line, end_line, type, text``.
    A file without any gives one ``module`` row, a blank one none. Comments, continuation
    lines and the insides of strings never end a block, wherever they stand.
    """
    return files.select("file_id", "path", F.inline(_lexed(F.col("text"), lexer.python_blocks)))


def script_blocks(files: DataFrame) -> DataFrame:
    """Classes, functions, methods and arrow functions of brace languages.

    A block runs from its header to the line where the brace depth is back at the
    header's; the brace may stand on a later line than the header. Strings, templates over
    several lines and comments do not count. Limits: blocks are whole lines, and a regular
    expression that holds quotes or braces is taken for code.
    """
    return files.select("file_id", "path", F.inline(_lexed(F.col("text"), lexer.script_blocks)))


def file_chunks(
    files: DataFrame, max_tokens: int = CHUNK_TOKENS, window_lines: int = CODE_WINDOW_LINES
) -> DataFrame:
    """Chunk every file by the strategy its suffix calls for.

    Code with a grammar gives blocks; code without one, or without blocks, gives line
    windows; everything else is packed by paragraphs. Rows:
    ``file_id, path, start_line, end_line, seq, type, text`` (lines are null for
    packed paragraphs, ``seq`` for the others).
    """
    path = F.col("path")
    code = files.filter(is_code(path))
    python = code.filter(language(path) == "python")
    script = code.filter(language(path).isin("javascript", "typescript"))
    other = code.filter(language(path).isNull())

    def windows(text: Column) -> Column:
        return F.transform(
            chunking.line_window_column(text, window_lines),
            lambda w: F.struct(
                w["start_line"].alias("start_line"),
                w["end_line"].alias("end_line"),
                F.lit("fallback_chunk").alias("type"),
                w["text"].alias("text"),
            ),
        )

    lexed = script.withColumn("blocks", _lexed(F.col("text"), lexer.script_blocks))
    some = F.when(F.size("blocks") > 0, F.col("blocks")).otherwise(windows(F.col("text")))
    scripts = lexed.select("file_id", "path", F.inline(some))
    plain = other.select("file_id", "path", F.inline(windows(F.col("text"))))
    packed = (
        chunking.paragraph_pack(files.filter(~is_code(path)), ["file_id", "path"], max_tokens)
        .drop("n_tokens")
        .withColumn("type", F.lit("document_chunk"))
    )
    blocks = python_blocks(python).unionByName(scripts).unionByName(plain)
    return blocks.unionByName(packed, allowMissingColumns=True)
