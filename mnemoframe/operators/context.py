"""Contexts of retrieval: entity and fact lanes, rendering, merging, views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.functions import text
from mnemoframe.functions.fixed import STOP_WORDS
from mnemoframe.operators import graph
from mnemoframe.session import hinted


def edge_ranks(hits: DataFrame) -> DataFrame:
    """First rank of each relationship among a query's edge hits ``(query_id, relationship_name, rank)``."""
    return hits.groupBy("query_id", "relationship_name").agg(F.min("rank").alias("edge_rank"))


def entity_bullets(nodes: DataFrame, edges: DataFrame, entities: DataFrame, ranks: DataFrame | None = None, most: int = 10) -> DataFrame:
    """Up to ``most`` edges of each hit entity ``(query_id, id)``: type edges first, then those the query ranks, then by id."""
    hit = hinted(entities.select("query_id", "id").distinct())
    out = edges.join(hit.select("query_id", F.col("id").alias("source_id")), "source_id").withColumn("entity_id", F.col("source_id"))
    back = edges.filter("source_id <> target_id").join(hit.select("query_id", F.col("id").alias("target_id")), "target_id").withColumn("entity_id", F.col("target_id"))
    both = out.unionByName(back)
    both = both.join(hinted(ranks), ["query_id", "relationship_name"], "left") if ranks is not None else both.withColumn("edge_rank", F.lit(None).cast("int"))
    is_type = text.is_type_edge(F.col("relationship_name"), F.lit(None).cast("string"))
    group = F.when(is_type, 0).when(F.col("edge_rank").isNotNull(), 1).otherwise(2)
    w = Window.partitionBy("query_id", "entity_id").orderBy(group, F.asc_nulls_last("edge_rank"), "source_id", "relationship_name", "target_id")
    best = both.withColumn("place", F.row_number().over(w) - 1).filter(F.col("place") < most)
    names = nodes.select("id", "name")
    named = best.join(names.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_id").join(names.select(F.col("id").alias("target_id"), F.col("name").alias("target_name")), "target_id")
    return named.select("query_id", "entity_id", "place", "source_id", "relationship_name", "target_id", F.format_string("%s --[%s]--> %s", "source_name", "relationship_name", "target_name").alias("bullet"))


def facts(edge_hits: DataFrame, shown: DataFrame, k: int) -> DataFrame:
    """Edge hits ``(query_id, edge_id, text, rank)`` that no entity shows and that have three words, the first ``k``."""
    rest = edge_hits.join(shown.select("query_id", "edge_id").distinct(), ["query_id", "edge_id"], "left_anti").filter(text.word_count(F.col("text")) >= 3)
    return rest.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "edge_id")) - 1).filter(F.col("place") < k).withColumn("text", text.fact_display(F.col("text")))


def backfill(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk texts for pairs that a summary brought in; pairs whose chunk is gone are dropped."""
    return pairs.join(chunks.select("id", F.col("text").alias("chunk_text")), "id").withColumn("text", F.coalesce("text", "chunk_text")).drop("chunk_text")


def title(texts: DataFrame, first: int = 7, top: int = 3) -> DataFrame:
    """``(id, title)``: the first words and the most frequent ones, ties by word."""
    split = texts.select("id", F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("w"))
    heads = split.select("id", F.array_join(F.slice("w", 1, first), " ").alias("head"))
    bare = split.select("id", F.explode("w").alias("x")).select("id", F.regexp_replace(F.lower("x"), r"^\p{Punct}+|\p{Punct}+$", "").alias("word")).filter((F.col("word") != "") & ~F.col("word").isin(*STOP_WORDS))
    n = bare.groupBy("id", "word").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "word"))).filter(F.col("r") <= top)
    words = n.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))), lambda s: s["word"]), ", ").alias("words"))
    return heads.join(words, "id", "left").select("id", F.concat("head", F.lit("... ["), F.coalesce("words", F.lit("")), F.lit("]")).alias("title"))


def edges_text(ranked: DataFrame, nodes: DataFrame) -> DataFrame:
    """Prompt text of each query's ranked edges: ``(query_id, text)`` with one line an edge."""
    names = nodes.select("id", F.coalesce(F.nullif("name", F.lit("")), "text", F.lit("Unnamed Node")).alias("shown"))
    lines = ranked.join(names.select(F.col("id").alias("source_id"), F.col("shown").alias("s")), "source_id").join(names.select(F.col("id").alias("target_id"), F.col("shown").alias("t")), "target_id")
    line = F.format_string("%s --[%s]--> %s", "s", "relationship_name", "t")
    return lines.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))


def merge(left: DataFrame, right: DataFrame, key: list[str], order: str = "seq") -> DataFrame:
    """Two contexts in order, the first of every key kept."""
    both = left.withColumn("_side", F.lit(0)).unionByName(right.withColumn("_side", F.lit(1)))
    return graph.keep_last(both, key, F.asc("_side"), F.asc(order)).drop("_side")


def graph_view(ranked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct nodes and edges of contexts ``(query_id, source_id, relationship_name, target_id)``."""
    edges = ranked.select("query_id", "source_id", "relationship_name", "target_id").distinct()
    return edges.select("query_id", F.explode(F.array("source_id", "target_id")).alias("id")).distinct(), edges


def markdown(dataset: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines ``(section, seq, line)`` of a dataset's Markdown export; an empty section has none."""
    clean = lambda c: F.replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    own = nodes.select(F.lit(1).alias("section"), F.col("id").alias("seq"), F.format_string("| %s | %s |", clean("name"), clean("type")).alias("line"))
    ways = edges.select(F.lit(2).alias("section"), F.concat_ws("/", "source_id", "relationship_name", "target_id").alias("seq"), F.format_string("| %s | %s | %s |", "source_id", clean("relationship_name"), "target_id").alias("line"))
    heads = own.limit(1).select(F.lit(1).alias("section"), F.lit("").alias("seq"), F.lit(f"## {dataset}: entities\n\n| name | type |\n|---|---|").alias("line"))
    heads = heads.unionByName(ways.limit(1).select(F.lit(2).alias("section"), F.lit("").alias("seq"), F.lit("## relations\n\n| source | relation | target |\n|---|---|---|").alias("line")))
    return heads.unionByName(own).unionByName(ways)
