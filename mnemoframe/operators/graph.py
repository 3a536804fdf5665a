"""Property graph as two DataFrames: nodes ``(id, name, type, ...)`` and edges ``(source_id, target_id, relationship_name, ...)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.functions import ids
from mnemoframe.functions.fixed import TRIPLET_PENALTY
from mnemoframe.functions.score import triplet_distance
from mnemoframe.session import hinted, materialize


def keep_last(df: DataFrame, key: list[str], *newest: Column) -> DataFrame:
    """One row per key, the first in the given order (newest first)."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*newest))).filter("_r = 1").drop("_r")


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep_from_old: tuple[str, ...] = ()) -> DataFrame:
    """Merge ``new`` into ``old`` by key; the columns named last keep their old value."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c not in key]
    if not rest:
        return both.select(*old.columns).distinct()
    groups = both.groupBy(*key).agg(*(F.min_by(c, "_new").alias(c) if c in keep_from_old else F.max_by(c, "_new").alias(c) for c in rest))
    return groups.select(*old.columns)


def induced(nodes: DataFrame, edges: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of an id set and the edges with both ends in it."""
    own = kept.select(F.col("id")).distinct()
    s, t = own.withColumnRenamed("id", "source_id"), own.withColumnRenamed("id", "target_id")
    return nodes.join(own, "id", "left_semi"), edges.join(s, "source_id", "left_semi").join(t, "target_id", "left_semi")


def filtered(nodes: DataFrame, edges: DataFrame, wanted: dict[str, list]) -> tuple[DataFrame, DataFrame]:
    """All attributes must match, each with any of its values."""
    kept = nodes
    for name, values in wanted.items():
        kept = kept.filter(F.col(name).isin(*values))
    return induced(nodes, edges, kept)


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge as ``(id, other)`` in both directions, without loops and repeats."""
    a = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"))
    return a.unionByName(a.select(F.col("other").alias("id"), F.col("id").alias("other"))).filter("id <> other").distinct()


def neighbours(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(seed_id, id, ...)``: nodes one undirected step from each seed."""
    near = both_ways(edges).join(hinted(seeds.select("id").distinct()), "id", "left_semi")
    return near.select(F.col("id").alias("seed_id"), F.col("other").alias("id")).join(nodes, "id")


def connections(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Edges that touch a seed, with the names of both ends."""
    own = hinted(seeds.select("id").distinct())
    flags = edges.join(own.select(F.col("id").alias("source_id"), F.lit(True).alias("_s")), "source_id", "left").join(own.select(F.col("id").alias("target_id"), F.lit(True).alias("_t")), "target_id", "left")
    touched = flags.filter("_s or _t").drop("_s", "_t")
    s = nodes.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    t = nodes.select(F.col("id").alias("target_id"), F.col("name").alias("target_name"))
    return touched.join(s, "source_id").join(t, "target_id")


def reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """``(id, hops)``: everything within ``depth`` undirected steps, seeds at 0."""
    steps = both_ways(edges)
    found = seeds.select("id").distinct().withColumn("hops", F.lit(0))
    for hop in range(1, depth + 1):
        # one cut per step keeps the plan short; a hub's edges are spread by the skew join
        border = found.filter(F.col("hops") == hop - 1)
        new = steps.join(border.select("id"), "id", "left_semi").select(F.col("other").alias("id")).distinct()
        found = materialize(found.unionByName(new.join(found, "id", "left_anti").withColumn("hops", F.lit(hop))), "reach")
    return found


def neighbourhood(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``depth`` steps and all edges between them, in their stored direction."""
    return induced(nodes, edges, reach(edges, seeds, depth))


def node_set(nodes: DataFrame, edges: DataFrame, kind: str, names: list[str], all_of: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes of a type and name, their neighbours (of any, or of every one of them), and the edges between."""
    primary = nodes.filter((F.col("type") == kind) & F.col("name").isin(*names)).select("id") if names else nodes.filter("false").select("id")
    near = both_ways(edges).join(hinted(primary), "id", "left_semi")
    if all_of:
        need = primary.distinct().agg(F.count("*").alias("need"))
        near = near.groupBy("other").agg(F.count_distinct("id").alias("n")).crossJoin(F.broadcast(need)).filter("n = need")
    return induced(nodes, edges, primary.unionByName(near.select(F.col("other").alias("id"))))


def degrees(edges: DataFrame) -> DataFrame:
    """``(id, degree)``; a loop counts twice."""
    return edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, component)``: the smallest id that each node is connected with.

    Labels move along edges and are then shortened through their own labels, so
    the rounds grow with the logarithm of the longest path, not with its length.
    """
    steps = materialize(both_ways(edges), "steps")
    labels = materialize(nodes.select("id", F.col("id").alias("component")), "labels")
    while True:
        offered = steps.join(labels.select(F.col("id").alias("other"), "component"), "other").groupBy("id").agg(F.min("component").alias("offer"))
        lower = labels.join(offered, "id", "left").select("id", F.col("component").alias("old"), F.least("component", "offer").alias("component"))
        jump = lower.select(F.col("id").alias("component"), F.col("component").alias("further"))
        new = materialize(lower.join(jump, "component", "left").select("id", "old", F.coalesce("further", "component").alias("component")), "labels")
        if new.filter("old <> component").isEmpty():
            return new.select("id", "component")
        labels = new.select("id", "component")


def metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, mean degree, density, loops, components and the largest."""
    n = nodes.agg(F.count("*").alias("num_nodes"))
    e = edges.agg(F.count("*").alias("num_edges"), F.count_if(F.col("source_id") == F.col("target_id")).alias("num_selfloops"))
    c = components(nodes, edges).groupBy("component").count().agg(F.count("*").alias("num_components"), F.max("count").alias("largest_component"))
    v, w = F.col("num_nodes"), F.col("num_edges")
    return n.crossJoin(e).crossJoin(c).select(
        "num_nodes", "num_edges", F.round(F.when(v > 0, 2.0 * w / v).otherwise(0.0), 6).alias("mean_degree"), F.round(F.when(v > 1, w / (v * (v - 1.0))).otherwise(0.0), 9).alias("edge_density"), "num_selfloops", "num_components", "largest_component"
    )


def triplets(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each edge with the text of its ends, joined by arrows; edges without an end or without any text are left out."""
    s = nodes.select(F.col("id").alias("source_id"), F.col("text").alias("source_text"))
    t = nodes.select(F.col("id").alias("target_id"), F.col("text").alias("target_text"))
    joined = edges.join(s, "source_id").join(t, "target_id")
    text = F.concat(F.coalesce("source_text", F.lit("")), F.lit("-›"), F.coalesce("relationship_name", F.lit("")), F.lit("-›"), F.coalesce("target_text", F.lit("")))
    some = F.concat(F.coalesce("source_text", F.lit("")), F.coalesce("relationship_name", F.lit("")), F.coalesce("target_text", F.lit(""))) != ""
    return joined.filter(some).select("source_id", "relationship_name", "target_id", text.alias("text"))


def triplet_search(edges: DataFrame, node_hits: DataFrame, edge_hits: DataFrame, k: int = 10, penalty: float = TRIPLET_PENALTY) -> DataFrame:
    """Edges that touch a hit, by the sum of the distances of both ends and of the relationship.

    ``node_hits`` is ``(id, distance)`` and ``edge_hits`` ``(relationship_name,
    distance)``, both possibly with several hits a key: the smallest counts.
    """
    near = hinted(node_hits.groupBy("id").agg(F.min("distance").alias("d")))
    kinds = hinted(edge_hits.groupBy("relationship_name").agg(F.min("distance").alias("edge_d")))
    scored = edges.join(near.select(F.col("id").alias("source_id"), F.col("d").alias("source_d")), "source_id", "left").join(near.select(F.col("id").alias("target_id"), F.col("d").alias("target_d")), "target_id", "left")
    scored = scored.filter("source_d is not null or target_d is not null").join(kinds, "relationship_name", "left")
    total = scored.withColumn("score", F.round(triplet_distance(F.col("source_d"), F.col("target_d"), F.col("edge_d")), 6))
    return total.select("source_id", "relationship_name", "target_id", "score").orderBy("score", "source_id", "relationship_name", "target_id").limit(k)


def expand(extracted: DataFrame, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Entities, types and edges of extracted chunk graphs.

    ``extracted`` has ``chunk_no, nodes array<struct<id,name,type,description>>,
    edges array<struct<source_node_id,target_node_id,relationship_name>>``.
    The first chunk wins; edges with an unknown end or already stored go.
    """
    flat = extracted.select("chunk_no", F.posexplode("nodes").alias("pos", "n")).select("chunk_no", "pos", "n.*")
    order = F.struct("chunk_no", "pos")
    types = flat.groupBy(F.concat(ids.normalize_identifier(F.col("type")), F.lit("_type")).alias("key")).agg(F.min_by("type", order).alias("name"))
    types = types.select(ids.data_point_id("EntityType", F.col("name")).alias("id"), ids.node_name(F.col("name")).alias("name"), F.lit("EntityType").alias("type"), F.lit(None).cast("string").alias("description"))
    keyed = flat.withColumn("key", ids.normalize_identifier(F.col("id")))
    first = keyed.groupBy("key").agg(F.min_by(F.struct("name", "type", "description"), order).alias("f"))
    entity = ids.data_point_id("Entity", F.col("key"))
    entities = first.select(entity.alias("id"), ids.node_name(F.col("f.name")).alias("name"), F.lit("Entity").alias("type"), F.col("f.description").alias("description"))
    is_a = first.select(entity.alias("source_id"), ids.data_point_id("EntityType", F.col("f.type")).alias("target_id"), F.lit("is_a").alias("relationship_name"))
    edges = extracted.select("chunk_no", F.explode("edges").alias("e")).select(ids.normalize_identifier(F.col("e.source_node_id")).alias("s"), ids.normalize_identifier(F.col("e.target_node_id")).alias("t"), ids.edge_name(F.col("e.relationship_name")).alias("relationship_name"))
    known = first.select("key", entity.alias("id"))
    found = edges.join(known.select(F.col("key").alias("s"), F.col("id").alias("source_id")), "s").join(known.select(F.col("key").alias("t"), F.col("id").alias("target_id")), "t")
    all_edges = found.select("source_id", "target_id", "relationship_name").unionByName(is_a).distinct()
    if stored is not None:
        all_edges = all_edges.join(stored, ["source_id", "target_id", "relationship_name"], "left_anti")
    return entities.unionByName(types), all_edges
