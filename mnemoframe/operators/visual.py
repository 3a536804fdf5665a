"""Measures that a graph drawing needs: stages, ranks, classes, importance, map of a memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemoframe.functions import text
from mnemoframe.functions.fixed import STAGE_BY_TYPE, STAGE_ORDER, STRUCTURAL_RELATIONS
from mnemoframe.operators import graph, ledger


def stage(kind: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for s in dict.fromkeys(STAGE_BY_TYPE.values()):
        out = out.when(kind.isin(*(k for k, v in STAGE_BY_TYPE.items() if v == s)), F.lit(s))
    return out.otherwise(F.lit("other"))


def visual_rank(topological: Column, stage_name: Column) -> Column:
    """The stored rank if positive, else the place of the stage."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, STAGE_ORDER)), stage_name), F.lit(0).cast("long")), F.lit(len(STAGE_ORDER)).cast("long"))
    return F.when(topological > 0, topological.cast("long")).otherwise(place)


def edge_class(relationship: Column) -> Column:
    return F.when(F.lower(relationship).isin(*STRUCTURAL_RELATIONS), F.lit("structural")).otherwise(F.lit("semantic"))


def display_name(name: Column, fallback: Column, node_id: Column) -> Column:
    """The name unless it is blank or looks like an identifier, then a text, then the id's begin."""
    good = F.when(~text.identifier_shaped(name), F.nullif(F.trim(name), F.lit("")))
    return F.coalesce(good, F.nullif(F.left(F.trim(fallback), F.lit(60)), F.lit("")), F.left(node_id, F.lit(8)))


def preprocess(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with degree, importance, stage and rank; edges with class, stages and bundle."""
    placed = nodes.join(graph.degrees(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0))).withColumn("stage", stage(F.col("type")))
    top = placed.agg(F.greatest(F.max("degree"), F.lit(1)).alias("top"))
    placed = placed.crossJoin(F.broadcast(top)).withColumn("importance", F.round(F.log1p("degree") / F.log1p("top"), 6)).drop("top").withColumn("visual_rank", visual_rank(F.lit(None).cast("int"), F.col("stage")))
    ends = placed.select(F.col("id").alias("source_id"), F.col("stage").alias("source_stage"))
    out = edges.join(ends, "source_id").join(ends.select(F.col("source_id").alias("target_id"), F.col("source_stage").alias("target_stage")), "target_id")
    out = out.withColumn("edge_class", edge_class(F.col("relationship_name"))).withColumn("bundle", F.concat_ws("|", "source_stage", "target_stage", "edge_class", "relationship_name"))
    return placed, out


def labelled(nodes: DataFrame, percentile: float = 0.75) -> DataFrame:
    """Nodes whose label is always shown: importance at the percentile or above, and landmarks."""
    threshold = ledger.percentile_lower(nodes, "importance", percentile)
    return nodes.crossJoin(F.broadcast(threshold)).filter(((F.col("threshold") > 0) & (F.col("importance") >= F.col("threshold"))) | F.col("stage").isin("document", "type")).drop("threshold")


def timeline(nodes: DataFrame, gap_ms: int) -> DataFrame:
    """Runs of creation times ``t_created`` (milliseconds): begin, end and number of each cluster."""
    return ledger.gap_clusters(nodes, "t_created", "id", gap_ms).groupBy("cluster").agg(F.min("t_created").alias("t0"), F.max("t_created").alias("t1"), F.count("*").alias("n"))


def schema_graph(tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fields and relations of schema tables ``(id, name, schema JSON)`` with ``columns`` and ``foreign_keys`` lists."""
    shape = "columns array<struct<name:string,type:string>>, foreign_keys array<struct<column:string,ref_table:string,ref_column:string>>"
    read = tables.select("id", "name", F.from_json("schema", shape).alias("s"))
    fields = read.select("id", "name", F.posexplode("s.columns").alias("place", "f")).select("id", "name", "place", F.col("f.name").alias("field"), F.col("f.type").alias("field_type"))
    keys = read.select("id", "name", F.explode("s.foreign_keys").alias("k")).select(F.col("name").alias("source"), F.col("k.column").alias("field"), F.col("k.ref_table").alias("target"), F.col("k.ref_column").alias("target_field"))
    return fields, keys.join(tables.select(F.col("name").alias("target")), "target", "left_semi")


def operation_layer(nodes: DataFrame) -> DataFrame:
    """Nodes per pipeline and task that made them."""
    return nodes.groupBy(F.coalesce("source_pipeline", F.lit("unknown")).alias("pipeline"), F.coalesce("source_task", F.lit("unknown")).alias("task")).agg(F.count("*").alias("nodes"), F.count_distinct("type").alias("types"))


def memory_map(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Chunks of every document in their order with the number of entities that each mentions."""
    docs = edges.filter("relationship_name = 'is_part_of'").select(F.col("source_id").alias("chunk_id"), F.col("target_id").alias("document_id"))
    chunks = nodes.filter("type = 'DocumentChunk'").select(F.col("id").alias("chunk_id"), "chunk_index")
    entities = nodes.filter("type = 'Entity'").select(F.col("id").alias("target_id"))
    counts = edges.select("source_id", "target_id").distinct().join(entities, "target_id", "left_semi").groupBy(F.col("source_id").alias("chunk_id")).agg(F.count("*").alias("entities"))
    return docs.join(chunks, "chunk_id").join(counts, "chunk_id", "left").select("document_id", "chunk_id", "chunk_index", F.coalesce("entities", F.lit(0)).alias("entities"))


def colours(values: DataFrame, column: str) -> DataFrame:
    """A stable colour for each distinct value, from its hash."""
    return values.select(column).distinct().withColumn("colour", F.concat(F.lit("#"), F.left(F.md5(column), F.lit(6))))
