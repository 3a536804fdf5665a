"""Records of sessions, permissions, runs and properties; temporal graph; replayed answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.functions import ids, jsonx
from mnemoframe.operators import graph, ledger


def current(log: DataFrame, key: list[str], seq: str = "seq", deleted: str = "deleted") -> DataFrame:
    """View of an append-only log: the last entry of each key unless it is a deletion."""
    return graph.keep_last(log, key, F.desc(seq)).filter(~F.coalesce(F.col(deleted), F.lit(False)))


def set_feedback(entries: DataFrame, feedback: DataFrame) -> DataFrame:
    """Feedback ``(id, feedback_score, feedback_text)`` written into entries; a score outside 1 to 5 is refused."""
    good = feedback.filter(F.col("feedback_score").isNull() | F.col("feedback_score").between(1, 5)).select("id", F.col("feedback_score").alias("_s"), F.col("feedback_text").alias("_t"), F.lit(True).alias("_set"))
    joined = entries.join(good, "id", "left")
    return joined.withColumn("feedback_score", F.when(F.col("_set"), F.col("_s")).otherwise(F.col("feedback_score"))).withColumn("feedback_text", F.when(F.col("_set"), F.col("_t")).otherwise(F.col("feedback_text"))).drop("_s", "_t", "_set")


def patch_properties(rows: DataFrame, patches: DataFrame, key: list[str]) -> DataFrame:
    """JSON properties with the patched ``(key..., name, value)`` entries set, the last of a name winning."""
    w = Window.partitionBy(*key, "name").orderBy(F.desc("seq"))
    last = patches.withColumn("_r", F.row_number().over(w)).filter("_r = 1").groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("_patch"))
    old = F.coalesce(F.from_json("properties", "map<string,string>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys("_patch"), k))
    return rows.join(last, key, "left").withColumn("properties", F.when(F.col("_patch").isNull(), F.col("properties")).otherwise(F.to_json(F.map_concat(kept, "_patch")))).drop("_patch")


def authorised(grants: DataFrame, roles: DataFrame, user: str, permission: str) -> DataFrame:
    """Datasets that a user may access, directly or through a role: ``(dataset_id)``."""
    own = grants.filter((F.col("permission") == permission) & (F.col("principal_id") == user)).select("dataset_id")
    through = grants.filter(F.col("permission") == permission).join(roles.filter(F.col("user_id") == user).select(F.col("role_id").alias("principal_id")), "principal_id", "left_semi").select("dataset_id")
    return own.unionByName(through).distinct()


def resolve_scope(links: DataFrame, datasets: DataFrame, scope: str, value: str | None = None) -> DataFrame:
    """Pairs ``(dataset_id, data_id)`` that deleting a data item, a dataset, a user's data or everything touches."""
    owned = links.join(datasets.select("dataset_id", "owner_id", "dataset_name"), "dataset_id")
    tests = {"data": F.col("data_id") == value, "dataset": F.col("dataset_name") == value, "user": F.col("owner_id") == value, "all": F.lit(True)}
    return owned.filter(tests[scope]).select("dataset_id", "data_id").distinct()


def delete(links: DataFrame, targets: DataFrame, nodes: DataFrame, edges: DataFrame, hard: bool = False) -> dict[str, DataFrame]:
    """Tables after a delete: links without the targets, ledger rows of data nobody links any more gone.

    ``nodes`` and ``edges`` are ledgers with ``data_id``; a hard delete also
    removes entities whose only edge is left, once.
    """
    gone = ledger.deletable(links, targets)
    left = links.join(targets, ["dataset_id", "data_id"], "left_anti")
    n, e = nodes.join(gone, "data_id", "left_anti"), edges.join(gone, "data_id", "left_anti")
    if hard:
        lonely = graph.degrees(e.select("source_id", "target_id").distinct()).filter("degree = 1").select("id")
        n = n.join(lonely.join(n.filter(F.col("type").isin("Entity", "EntityType")).select("id"), "id", "left_semi"), "id", "left_anti")
        e = e.join(n.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(n.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    return {"links": left, "nodes": n, "edges": e, "data": gone}


def orphan_edge_types(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """EdgeType nodes without any edge whose label no edge carries any more."""
    kinds = nodes.filter("type = 'EdgeType'")
    touched = graph.degrees(edges).select("id")
    return kinds.join(touched, "id", "left_anti").join(edges.select(F.col("relationship_name").alias("name")).distinct(), "name", "left_anti")


def temporal_graph(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Event, Timestamp and Interval nodes of ``(event_id, name, at_ms, from_ms, to_ms)`` and the edges between them."""
    stamp = lambda ms: ids.data_point_id("Timestamp", ms.cast("string"))
    span = ids.data_point_id("Interval", F.col("from_ms").cast("string"), F.col("to_ms").cast("string"))
    whole = F.col("from_ms").isNotNull() & F.col("to_ms").isNotNull()
    blank = F.lit(None).cast("long")
    nodes = events.select(F.col("event_id").alias("id"), "name", F.lit("Event").alias("type"), blank.alias("time_at"))
    for at in ("at_ms", "from_ms", "to_ms"):
        nodes = nodes.unionByName(events.filter(F.col(at).isNotNull()).select(stamp(F.col(at)).alias("id"), F.col(at).cast("string").alias("name"), F.lit("Timestamp").alias("type"), F.col(at).alias("time_at")))
    nodes = nodes.unionByName(events.filter(whole).select(span.alias("id"), F.lit("").alias("name"), F.lit("Interval").alias("type"), blank.alias("time_at"))).distinct()
    edge = lambda df, s, t, rel: df.select(s.alias("source_id"), t.alias("target_id"), F.lit(rel).alias("relationship_name"))
    long = events.filter(whole)
    edges = edge(events.filter("at_ms is not null"), F.col("event_id"), stamp(F.col("at_ms")), "at").unionByName(edge(long, F.col("event_id"), span, "during"))
    return nodes, edges.unionByName(edge(long, span, stamp(F.col("from_ms")), "time_from")).unionByName(edge(long, span, stamp(F.col("to_ms")), "time_to")).distinct()


def index_rows(nodes: DataFrame, edges: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """Points ``(collection, id, text, vector)`` of every indexed field of the graph."""
    kinds = {"DocumentChunk": ("DocumentChunk_text", "text"), "Entity": ("Entity_name", "name"), "EntityType": ("EntityType_name", "name"), "TextSummary": ("TextSummary_text", "text")}
    parts = [nodes.filter(F.col("type") == k).select(F.lit(c).alias("collection"), "id", F.col(f).alias("text")) for k, (c, f) in kinds.items()]
    types = edges.groupBy("relationship_name").agg(F.count("*").alias("n")).select(F.lit("EdgeType_relationship_name").alias("collection"), ids.data_point_id("EdgeType", F.col("relationship_name")).alias("id"), F.col("relationship_name").alias("text"))
    rows = types
    for p in parts:
        rows = rows.unionByName(p)
    return rows.filter("trim(text) <> ''").withColumn("vector", embed(F.col("text")))


def replayed(requests: DataFrame, tape: DataFrame, text: str = "prompt") -> DataFrame:
    """Recorded answers by the SHA-256 of the request; null where nothing was recorded."""
    return requests.join(tape.select(F.col("digest").alias("_d"), "answer"), F.sha2(F.col(text), 256) == F.col("_d"), "left").drop("_d")


def recall_scopes(scope: str | list[str] | None, has_session: bool) -> list[str]:
    """Lanes that a recall reads, in order: ``auto`` is the session, if there is one, then the graph."""
    known = ["graph", "session", "trace", "graph_context"]
    asked = [scope] if isinstance(scope, str) else list(scope or ["auto"])
    if "auto" in asked:
        return ["session", "graph"] if has_session else ["graph"]
    if "all" in asked:
        return known
    bad = [s for s in asked if s not in known]
    if bad:
        raise ValueError(f"unknown scope {bad}")
    return list(dict.fromkeys(asked))


def clear_status(rows: DataFrame, dataset: str) -> DataFrame:
    return rows.withColumn("pipeline_status", jsonx.drop_status(F.col("pipeline_status"), dataset))
