"""The knowledge graph's tables, filled from entities that documents share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "id string, label string, node_type string, metadata map<string,string>, doc_ids array<long>"
EDGES = "source string, target string, relationship string, weight double"


def empty(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES)


def from_entities(docs: DataFrame, id_col: str = "doc_id", entities_col: str = "entities") -> tuple[DataFrame, DataFrame]:
    """Entity nodes, document nodes, and a "mentions" edge from document to entity.

    The graph has one edge for each mention, so it grows with the text and not with pairs of entities.
    Documents of an entity are its edges; their list is null in its node, since it has no bound.
    """
    mention = docs.select(F.col(id_col).cast("long").alias("doc"), F.explode(F.array_distinct(entities_col)).alias("entity"))
    label = F.concat(F.lit("entity:"), F.lower("entity"))
    entity_nodes = mention.groupBy(label.alias("id")).agg(F.min("entity").alias("label")).select("id", "label", F.lit("entity").alias("node_type"), F.lit(None).cast("map<string,string>").alias("metadata"), F.lit(None).cast("array<long>").alias("doc_ids"))
    doc_name = F.concat(F.lit("document:"), F.col("doc").cast("string"))
    doc_nodes = mention.select("doc").distinct().select(doc_name.alias("id"), doc_name.alias("label"), F.lit("document").alias("node_type"), F.lit(None).cast("map<string,string>").alias("metadata"), F.array("doc").alias("doc_ids"))
    edges = mention.select(doc_name.alias("source"), label.alias("target"), F.lit("mentions").alias("relationship"), F.lit(1.0).alias("weight")).distinct()
    return entity_nodes.unionByName(doc_nodes), edges


def node(nodes: DataFrame, key: str) -> DataFrame:
    return nodes.where(F.col("id") == key)


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("node_count")).crossJoin(edges.agg(F.count("*").alias("edge_count")))  # two one-row tables
