"""Files on storage: scans, single paths, working trees and text reads.

``scan`` is Spark's own file source. It leaves out names that start with ``_`` or
``.``, which a source tree needs (``__init__.py``), so working trees are listed by
``scan_tree``: one small task per folder, level by level.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import routing
from corpusloom.operators.skew import salted_join
from corpusloom.session import stored


def scan(spark: SparkSession, root: str, content: bool = False, glob: str | None = None) -> DataFrame:
    """All files below ``root``: ``path`` (relative), ``full_path``, ``length`` and, if
    asked for, ``content``. Left out, the content is never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    plain = root.rstrip("/").removeprefix("file://").removeprefix("file:")
    below = F.expr("substr(path, instr(path, _root) + length(_root) + 1)")
    files = (
        reader.load(root)
        .withColumn("_root", F.lit(plain))
        .select(
            below.alias("path"),
            F.col("path").alias("full_path"),
            "length",
            *(["content"] if content else []),
        )
    )
    return files


def _base(root: str) -> str:
    return (root if "://" in root else f"file://{os.path.abspath(root)}").rstrip("/")


def _list_folders(base: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = fs.FileSystem.from_uri(base)
        for pdf in batches:
            for folder in pdf["path"]:
                where = f"{root}/{folder}".rstrip("/")
                found = system.get_file_info(fs.FileSelector(where))
                yield pd.DataFrame(
                    {
                        "path": [f"{folder}/{i.base_name}".lstrip("/") for i in found],
                        "folder": [i.type == fs.FileType.Directory for i in found],
                        "length": [i.size or 0 for i in found],
                    }
                )

    return run


def _read_files(base: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = fs.FileSystem.from_uri(base)
        for pdf in batches:
            for path in pdf["path"]:
                with system.open_input_stream(f"{root}/{path}") as stream:
                    yield pd.DataFrame({"path": [path], "content": [stream.read()]})

    return run


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """Every file below ``root``, hidden ones included: ``path`` (relative), ``length``."""
    base = _base(root)
    tasks = spark.sparkContext.defaultParallelism
    level = spark.range(1).select(F.lit("").alias("path"))
    files = []
    while True:
        listed = level.repartition(tasks, "path").mapInPandas(
            _list_folders(base), "path STRING, folder BOOLEAN, length BIGINT"
        )
        listed = stored(listed, "tree-level")
        files.append(listed.filter(~F.col("folder")).select("path", "length"))
        level = listed.filter("folder").select("path")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, files)


def with_content(files: DataFrame, root: str) -> DataFrame:
    """``path, content`` of the files named in ``files(path)``."""
    tasks = files.sparkSession.sparkContext.defaultParallelism
    return files.select("path").repartition(tasks, "path").mapInPandas(
        _read_files(_base(root)), "path STRING, content BINARY"
    )


def text_of(content: Column) -> Column:
    """UTF-8 text with every kind of line end as ``\\n``."""
    return F.regexp_replace(F.decode(content, "UTF-8"), r"\r\n?", "\n")


def code_files(files: DataFrame) -> DataFrame:
    """``files(path, content)`` or ``files(repo, path, content)`` as ``file_id, path, text`` for the
    chunkers. ``file_id`` is the repository and the path, so equal paths of two stay apart."""
    whole = ["repo", "path"] if "repo" in files.columns else ["path"]
    return files.select(F.concat_ws("\n", *whole).alias("file_id"), "path", text_of(F.col("content")).alias("text"))


def expand_paths(requested: DataFrame, found: DataFrame) -> DataFrame:
    """Match requested items with found files: ``item, path``.

    A file matches its own path and a directory every file below it. Each found path
    offers itself and its parent folders as keys, so this is an equi join.
    """
    parts = F.split("path", "/")
    keys = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")
    )
    offered = found.select("path", F.explode(keys).alias("item"))
    wanted = requested.filter(~routing.urls.is_http(F.col("item"))).select(
        "item", F.regexp_replace("item", "/+$", "").alias("_key")
    )
    # A top folder is offered by every file below it.
    return salted_join(offered.withColumnRenamed("item", "_key"), wanted, "_key").select("item", "path")


def invalid_paths(requested: DataFrame, found: DataFrame) -> DataFrame:
    """Error results for requested items that are neither URL, file nor folder."""
    item = F.col("item")
    missing = requested.filter(~routing.urls.is_http(item)).join(
        expand_paths(requested, found).select("item").distinct(), "item", "left_anti"
    )
    return routing.as_results(missing, routing.error_row(item, routing.invalid_path(item)))


def input_manifest(requested: DataFrame, found: DataFrame) -> DataFrame:
    """``item, kind`` of everything to process: URLs as given, folders as their files."""
    item = F.col("item")
    return (
        requested.filter(routing.urls.is_http(item))
        .select("item", F.lit("url").alias("kind"))
        .unionByName(
            expand_paths(requested, found).select(F.col("path").alias("item"), F.lit("file").alias("kind"))
        )
    )


def repository_files(spark: SparkSession, root: str) -> DataFrame:
    """Processable files of a working tree already on storage: ``path, content``.

    The path tests come before any file is opened.
    """
    named = scan_tree(spark, root).filter(routing.path_allowed(F.col("path")))
    return with_content(named, root).filter(routing.looks_like_text(F.col("content")))


def repository_results(repo_url: str, files: DataFrame) -> DataFrame:
    """Per file results of a repository: one row per file, with the repository's URL."""
    row = routing.result_row(
        F.lit(repo_url), F.array("path"), F.create_map(F.lit("repo_url"), F.lit(repo_url))
    )
    return routing.as_results(files, row)
