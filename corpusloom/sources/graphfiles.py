"""Graphs kept in files: GraphML and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_DATA = "data ARRAY<STRUCT<_VALUE STRING, _key STRING>>"
NODE_FIELDS = ("entity_type", "description", "source_id")
EDGE_FIELDS = ("weight", "description", "keywords", "source_id")
_JSON = (
    "nodes ARRAY<STRUCT<id STRING, entity_type STRING, description STRING, source_id STRING>>, "
    "edges ARRAY<STRUCT<source STRING, target STRING, weight DOUBLE, description STRING, "
    "keywords STRING, source_id STRING>>"
)


def _rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of GraphML files.

    The ``<key>`` declarations belong to their own file, so the attributes of a node or edge
    meet them by (file, key id). A file has a handful of keys, its rows any number: the
    declarations of each file become one map, which its rows are joined with. A file
    without any, a part of a graph written in pieces, takes those of all the others.
    """
    file = F.col("_metadata.file_path").alias("_file")
    keys = _rows(spark, path, "key", "_id STRING, `_attr.name` STRING, _for STRING").select(
        file, F.col("_id").alias("k"), F.col("`_attr.name`").alias("v"), F.col("_for").alias("kind")
    )

    def decoded(tag: str, fields: tuple[str, ...], ends: dict[str, str]) -> DataFrame:
        mine = keys.filter(F.col("kind").isin(tag, "all")).groupBy("_file", "k").agg(F.min("v").alias("v"))
        names = mine.groupBy("_file").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("_names"))
        shared = mine.groupBy("k").agg(F.min("v").alias("v"))
        others = shared.agg(F.map_from_entries(F.collect_list(F.struct("k", "v")))).scalar()
        rows = _rows(spark, path, tag, f"{', '.join(f'{c} STRING' for c in ends)}, {_DATA}").select("*", file)

        def field(name: str) -> Column:
            hit = F.filter("data", lambda d: F.col("_names")[d["_key"]] == name)
            return F.get(hit, F.lit(0))["_VALUE"].alias(name)

        joined = rows.join(names, "_file", "left").withColumn("_names", F.coalesce("_names", others))
        return joined.select(*[F.col(c).alias(n) for c, n in ends.items()], *[field(n) for n in fields])

    edges = decoded("edge", EDGE_FIELDS, {"_source": "source", "_target": "target"})
    return decoded("node", NODE_FIELDS, {"_id": "id"}), edges.withColumn("weight", F.col("weight").cast("double"))


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of ``{nodes: [...], edges: [...]}`` files; an absent list is empty."""
    docs = spark.read.option("multiLine", "true").schema(_JSON).json(path)
    return docs.select(F.inline("nodes")), docs.select(F.inline("edges"))


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path)


def load_graph(
    spark: SparkSession, graphml: str, saved: str, skip_conversion: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The graph in ``graphml``; with ``skip_conversion`` an earlier export in ``saved``
    (written by ``sinks.write_graph``) is reused when it is there."""
    if skip_conversion and path_exists(spark, saved):
        nodes = spark.read.json(f"{saved}/nodes", schema=_fields(_JSON, "nodes", spark))
        return nodes, spark.read.json(f"{saved}/edges", schema=_fields(_JSON, "edges", spark))
    return read_graphml(spark, graphml)


def _fields(ddl: str, name: str, spark: SparkSession):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)[name].dataType.elementType
