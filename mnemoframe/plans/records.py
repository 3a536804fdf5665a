"""Queries: contexts, permissions, maintenance, temporal graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoframe.functions import jsonx, vector
from mnemoframe.functions.ids import uuid5_sql
from mnemoframe.operators import context, graph, records, router, visual
from mnemoframe.session import table


def _nodes(spark, sf) -> DataFrame:
    return table(spark, sf, "graph_node").select("id", "name", "type", F.get_json_object("properties", "$.text").alias("text"), F.get_json_object("properties", "$.chunk_index").cast("int").alias("chunk_index"))


def _edges(spark, sf) -> DataFrame:
    return table(spark, sf, "graph_edge").select("source_id", "target_id", "relationship_name").distinct()


def entity_lane(spark, sf):
    """Up to ten edges of every entity that is a product, type edges first."""
    hits = table(spark, sf, "graph_node").filter("get_json_object(properties, '$.is_a') = 'product'").select(F.lit(1).alias("query_id"), "id")
    return context.entity_bullets(_nodes(spark, sf), _edges(spark, sf), hits).select("entity_id", "place", "source_id", "relationship_name", "target_id")


def fact_lane(spark, sf):
    """The first five descriptions of every search that its first two hits do not show."""
    e = table(spark, sf, "entity_results").filter("description is not null").select(F.col("query_no").alias("query_id"), F.col("name").alias("edge_id"), F.col("description").alias("text"), F.col("hit_no").alias("rank"))
    hits = e.groupBy("query_id", "edge_id").agg(F.min_by("text", F.struct("rank", "text")).alias("text"), F.min("rank").alias("rank"))
    return context.facts(hits, e.filter("rank <= 2"), 5).select("query_id", "edge_id", "text", "place")


def memory_titles(spark, sf):
    return context.title(table(spark, sf, "memories").filter("content is not null").select(F.col("memory_no").alias("id"), F.col("content").alias("text")))


def edge_prompt(spark, sf):
    """Prompt lines of the edges of every place entity."""
    hits = table(spark, sf, "graph_node").filter("get_json_object(properties, '$.is_a') = 'place'").select(F.lit(1).alias("q"), F.col("id").alias("source_id"))
    e = _edges(spark, sf).join(hits, "source_id")
    ranked = e.select(F.col("source_id").alias("query_id"), "source_id", "relationship_name", "target_id", F.concat_ws("/", "relationship_name", "target_id").alias("rank"))
    return context.edges_text(ranked, _nodes(spark, sf)).select("query_id", F.md5("text").alias("digest"))


def markdown_export(spark, sf):
    n = _nodes(spark, sf).filter("type = 'Entity'")
    return context.markdown("graph", n, _edges(spark, sf)).filter("seq <> ''")


def property_patch(spark, sf):
    """Entities with two properties set, one of them twice."""
    n = table(spark, sf, "graph_node").filter("type = 'Entity'").select("id", "properties")
    one = lambda seq, name, value: n.select("id", F.lit(seq).alias("seq"), F.lit(name).alias("name"), F.lit(value).alias("value"))
    out = records.patch_properties(n, one(1, "weight", "0.1").unionByName(one(2, "weight", "0.2")).unionByName(one(1, "is_a", "thing")), ["id"])
    return out.select("id", F.get_json_object("properties", "$.weight").alias("weight"), F.get_json_object("properties", "$.is_a").alias("is_a"), F.get_json_object("properties", "$.place").alias("place"))


def session_log(spark, sf):
    """The current messages of sessions: of repeated sequence numbers the last delivery, deletions by empty content."""
    m = table(spark, sf, "messages").select("session_id", "seq_no", "message_no", (F.coalesce("content", F.lit("")) == "").alias("deleted"))
    return records.current(m, ["session_id", "seq_no"], "message_no").select("session_id", "seq_no", "message_no")


def feedback_writes(spark, sf):
    """Scores written to messages; those outside 1 to 5 are refused."""
    m = table(spark, sf, "messages").select(F.col("message_no").alias("id"), F.lit(None).cast("int").alias("feedback_score"), F.lit(None).cast("string").alias("feedback_text"))
    f = m.select("id", (F.col("id") % 8).cast("int").alias("feedback_score"), F.lit("t").alias("feedback_text"))
    return records.set_feedback(m, f).groupBy("feedback_score").agg(F.count("*").alias("n"))


def authorised_datasets(spark, sf):
    """Datasets of owner groups: names are granted to owners, and to roles by their first letter."""
    m = table(spark, sf, "memories").filter("owner_id is not null and dataset_name is not null")
    owner = m.agg(F.min("owner_id").alias("o")).first().o or ""
    own = m.select("dataset_name", F.col("owner_id").alias("principal_id")).distinct()
    by_role = m.select("dataset_name", F.concat(F.lit("role_"), F.left("dataset_name", F.lit(1))).alias("principal_id")).distinct()
    grants = own.unionByName(by_role).select(F.col("dataset_name").alias("dataset_id"), "principal_id", F.lit("read").alias("permission"))
    roles = m.select(F.col("owner_id").alias("user_id"), F.lit("role_a").alias("role_id")).distinct()
    return records.authorised(grants, roles, owner, "read")


def scope_of_owner(spark, sf):
    """Data that deleting everything of one dataset would touch."""
    links = table(spark, sf, "memories").filter("dataset_name is not null and owner_id is not null").select(F.concat_ws("/", "owner_id", "dataset_name").alias("dataset_id"), F.col("memory_no").cast("string").alias("data_id"), "owner_id", "dataset_name")
    first = links.agg(F.min("dataset_name").alias("d")).first().d
    return records.resolve_scope(links.select("dataset_id", "data_id"), links.select("dataset_id", "owner_id", "dataset_name").distinct(), "dataset", first)


def temporal_graph(spark, sf):
    """Events of searches as a temporal graph: nodes and edges by type."""
    e = table(spark, sf, "entity_results").groupBy("query_no").agg(F.min("found_at").alias("a"), F.max("found_at").alias("b"))
    ms = lambda c: F.unix_millis(F.date_trunc("day", F.col(c).cast("timestamp")))
    events = e.select(F.concat(F.lit("event "), F.col("query_no")).alias("event_id"), F.concat(F.lit("search "), F.col("query_no")).alias("name"), ms("a").alias("at_ms"), F.when(F.col("b") > F.col("a"), ms("a")).alias("from_ms"), F.when(F.col("b") > F.col("a"), ms("b")).alias("to_ms"))
    nodes, edges = records.temporal_graph(events)
    return nodes.groupBy(F.col("type").alias("kind")).agg(F.count("*").alias("n")).unionByName(edges.groupBy(F.col("relationship_name").alias("kind")).agg(F.count("*").alias("n")))


def index_all(spark, sf):
    """Points of every indexed field, with offline vectors."""
    rows = records.index_rows(_nodes(spark, sf), _edges(spark, sf), lambda t: vector.deterministic_vector(t, 16))
    return rows.groupBy("collection").agg(F.count("*").alias("points"), F.min(F.size("vector")).alias("dimensions"))


def edge_type_ids(spark, sf):
    rows = records.index_rows(_nodes(spark, sf).filter("false"), _edges(spark, sf), lambda t: F.lit(0))
    return rows.select("id", "text")


def router_overrides(spark, sf):
    """How often the routed type differs from the one the message's role would choose."""
    m = table(spark, sf, "messages").filter("content is not null")
    routed = router.route(m.select(F.col("message_no").alias("query_id"), F.col("content").alias("text")))
    chosen = m.select(F.col("message_no").alias("query_id"), F.when(F.col("role") == "user", "GraphCompletion").otherwise("ChunksLexical").alias("override"))
    return routed.join(chosen, "query_id").filter("target <> override").groupBy("target", "override").agg(F.count("*").alias("n"))


def memory_map(spark, sf):
    return visual.memory_map(_nodes(spark, sf), _edges(spark, sf))


def display_names(spark, sf):
    n = _nodes(spark, sf)
    return n.select("id", visual.display_name(F.col("name"), F.col("text"), F.col("id")).alias("shown"), visual.stage(F.col("type")).alias("stage"), visual.visual_rank(F.lit(None).cast("int"), visual.stage(F.col("type"))).alias("visual_rank"))


def json_fields(spark, sf):
    """Scalar properties of nodes as display text, arrays and blanks as null."""
    r = table(spark, sf, "cognee_data_record")
    return r.select("record_no", jsonx.display_value(F.col("external_metadata"), "$.source").alias("source"), jsonx.display_value(F.col("external_metadata"), "$.tags").alias("tags"), jsonx.display_value(F.col("external_metadata"), "$.rev").alias("rev"))


def id_filtered(spark, sf):
    """Edges inside the set of all chunks and summaries."""
    n = _nodes(spark, sf)
    return graph.induced(n, _edges(spark, sf), n.filter("type <> 'Entity'"))[1]


QUERIES = {
    f.__name__: f
    for f in (
        entity_lane, fact_lane, memory_titles, edge_prompt, markdown_export, property_patch, session_log, feedback_writes, authorised_datasets, scope_of_owner, temporal_graph,
        index_all, edge_type_ids, router_overrides, memory_map, display_names, json_fields, id_filtered,
    )
}

_E = "e AS (SELECT DISTINCT source_id, target_id, relationship_name FROM graph_edge)"
_M = "m AS (SELECT * FROM memories WHERE owner_id IS NOT NULL AND dataset_name IS NOT NULL)"
ORACLE = {
    "entity_lane": f"""WITH {_E}, h AS (SELECT id FROM graph_node WHERE properties->>'is_a' = 'product'), b AS (SELECT source_id AS entity_id, * FROM e WHERE source_id IN (SELECT id FROM h) UNION ALL SELECT target_id, * FROM e WHERE source_id <> target_id AND target_id IN (SELECT id FROM h))
      SELECT entity_id, (row_number() OVER (PARTITION BY entity_id ORDER BY CASE WHEN relationship_name = 'is_a' THEN 0 ELSE 2 END, source_id, relationship_name, target_id) - 1)::INT AS place, source_id, relationship_name, target_id FROM b QUALIFY place < 10""",
    "fact_lane": r"""WITH h AS (SELECT query_no AS query_id, name AS edge_id, arg_min(description, (hit_no, description)) AS text, min(hit_no) AS rank FROM entity_results WHERE description IS NOT NULL GROUP BY ALL),
      r AS (SELECT * FROM h WHERE (query_id, edge_id) NOT IN (SELECT query_no, name FROM entity_results WHERE description IS NOT NULL AND hit_no <= 2) AND len(list_filter(string_split_regex(text, '[ \t\n\v\f\r]+'), lambda x: x <> '')) >= 3)
      SELECT query_id, edge_id, upper(left(trim(text, ' '), 1)) || substr(trim(text, ' '), 2) AS text, (row_number() OVER (PARTITION BY query_id ORDER BY rank, edge_id) - 1)::INT AS place FROM r QUALIFY place < 5""",
    "edge_prompt": f"""WITH {_E}, n AS (SELECT id, coalesce(nullif(name, ''), properties->>'text', 'Unnamed Node') AS shown FROM graph_node)
      SELECT source_id AS query_id, md5(string_agg(s.shown || ' --[' || relationship_name || ']--> ' || t.shown, chr(10) ORDER BY relationship_name || '/' || target_id)) AS digest FROM e JOIN n s ON s.id = source_id JOIN n t ON t.id = target_id
      WHERE source_id IN (SELECT id FROM graph_node WHERE properties->>'is_a' = 'place') GROUP BY 1""",
    "markdown_export": f"""WITH {_E} SELECT 1 AS section, id AS seq, '| ' || replace(replace(name, '|', '\\|'), chr(10), ' ') || ' | ' || type || ' |' AS line FROM graph_node WHERE type = 'Entity'
      UNION ALL SELECT 2, source_id || '/' || relationship_name || '/' || target_id, '| ' || source_id || ' | ' || relationship_name || ' | ' || target_id || ' |' FROM e""",
    "property_patch": "SELECT id, '0.2' AS weight, 'thing' AS is_a, properties->>'place' AS place FROM graph_node WHERE type = 'Entity'",
    "session_log": "SELECT session_id, seq_no, max(message_no) AS message_no FROM messages GROUP BY 1, 2 HAVING coalesce(arg_max(coalesce(content, ''), message_no), '') <> ''",
    "feedback_writes": "SELECT CASE WHEN message_no % 8 BETWEEN 1 AND 5 THEN (message_no % 8)::INT END AS feedback_score, count(*) AS n FROM messages GROUP BY 1",
    "authorised_datasets": f"WITH {_M} SELECT DISTINCT dataset_name AS dataset_id FROM m WHERE owner_id = (SELECT min(owner_id) FROM m) OR left(dataset_name, 1) = 'a'",
    "scope_of_owner": f"WITH {_M} SELECT owner_id || '/' || dataset_name AS dataset_id, memory_no::VARCHAR AS data_id FROM m WHERE dataset_name = (SELECT min(dataset_name) FROM m)",
    "temporal_graph": """WITH q AS (SELECT query_no, min(found_at) AS a, max(found_at) AS b FROM entity_results GROUP BY 1), x AS (SELECT query_no, epoch_ms(date_trunc('day', a)) AS w, CASE WHEN b > a THEN epoch_ms(date_trunc('day', a)) END AS f, CASE WHEN b > a THEN epoch_ms(date_trunc('day', b)) END AS t FROM q)
      SELECT 'Event' AS kind, count(*) AS n FROM x UNION ALL SELECT 'Timestamp', count(DISTINCT v) FROM (SELECT w AS v FROM x UNION ALL SELECT f FROM x UNION ALL SELECT t FROM x) UNION ALL SELECT 'Interval', count(DISTINCT (f, t)) FROM x WHERE f IS NOT NULL
      UNION ALL SELECT 'at', count(*) FROM x UNION ALL SELECT 'during', count(*) FROM x WHERE f IS NOT NULL UNION ALL SELECT 'time_from', count(DISTINCT (f, t)) FROM x WHERE f IS NOT NULL UNION ALL SELECT 'time_to', count(DISTINCT (f, t)) FROM x WHERE f IS NOT NULL""",
    "index_all": """SELECT CASE type WHEN 'DocumentChunk' THEN 'DocumentChunk_text' WHEN 'Entity' THEN 'Entity_name' ELSE 'TextSummary_text' END AS collection, count(*) AS points, 16 AS dimensions FROM graph_node WHERE trim(CASE type WHEN 'Entity' THEN name ELSE properties->>'text' END, ' ') <> '' GROUP BY 1
      UNION ALL SELECT 'EdgeType_relationship_name', count(DISTINCT relationship_name), 16 FROM graph_edge""",
    "edge_type_ids": f"SELECT {uuid5_sql(chr(39) + 'EdgeType:' + chr(39) + ' || relationship_name')} AS id, relationship_name AS text FROM (SELECT DISTINCT relationship_name FROM graph_edge)",
    "memory_map": f"""WITH {_E}, c AS (SELECT source_id AS chunk_id, count(DISTINCT target_id) AS k FROM e WHERE target_id IN (SELECT id FROM graph_node WHERE type = 'Entity') GROUP BY 1)
      SELECT target_id AS document_id, source_id AS chunk_id, (n.properties->>'chunk_index')::INT AS chunk_index, coalesce(k, 0) AS entities FROM e JOIN graph_node n ON n.id = source_id AND n.type = 'DocumentChunk' LEFT JOIN c ON c.chunk_id = source_id WHERE relationship_name = 'is_part_of'""",
    "display_names": r"""SELECT id, coalesce(CASE WHEN NOT regexp_matches(name, '(?i)^\s*([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9a-f]{32,})\s*$') THEN nullif(trim(name, ' '), '') END, nullif(left(trim(properties->>'text', ' '), 60), ''), left(id, 8)) AS shown,
      CASE type WHEN 'DocumentChunk' THEN 'chunk' WHEN 'TextSummary' THEN 'summary' WHEN 'Entity' THEN 'entity' ELSE 'other' END AS stage, CASE type WHEN 'DocumentChunk' THEN 2 WHEN 'TextSummary' THEN 5 WHEN 'Entity' THEN 3 ELSE 8 END::BIGINT AS visual_rank FROM graph_node""",
    "json_fields": "SELECT record_no, nullif(trim(external_metadata->>'source', ' '), '') AS source, NULL AS tags, external_metadata->>'rev' AS rev FROM cognee_data_record",
    "id_filtered": f"WITH {_E}, k AS (SELECT id FROM graph_node WHERE type <> 'Entity') SELECT * FROM e WHERE source_id IN (SELECT id FROM k) AND target_id IN (SELECT id FROM k)",
}
