"""Queries: the property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.functions import ids, jsonx, text
from mnemoframe.functions.fixed import TRIPLET_PENALTY
from mnemoframe.functions.ids import uuid5_sql
from mnemoframe.operators import graph
from mnemoframe.session import table


def _nodes(spark, sf) -> DataFrame:
    """Nodes with their hot properties as columns."""
    prop = lambda k: F.get_json_object("properties", f"$.{k}")
    return table(spark, sf, "graph_node").select("id", "name", "type", prop("is_a").alias("is_a"), prop("place").alias("place"), prop("description").alias("description"), prop("text").alias("body"), "created_at", "updated_at")


def _edges(spark, sf) -> DataFrame:
    """Edges, the last update of every repeated triple."""
    e = table(spark, sf, "graph_edge")
    return graph.keep_last(e, ["source_id", "target_id", "relationship_name"], F.desc("updated_at"), F.desc("created_at"), F.desc_nulls_last("properties"))


def _triples(spark, sf) -> DataFrame:
    return table(spark, sf, "graph_edge").select("source_id", "target_id", "relationship_name").distinct()


def _seeds(spark, sf) -> DataFrame:
    return _nodes(spark, sf).filter("type = 'Entity' and is_a = 'product'").select("id")


def graph_filtered(spark, sf):
    nodes, edges = graph.filtered(_nodes(spark, sf), _triples(spark, sf), {"type": ["Entity"], "is_a": ["person", "organization"]})
    return edges.groupBy("relationship_name").agg(F.count("*").alias("edges")).crossJoin(nodes.agg(F.count("*").alias("nodes")))


def graph_neighbors(spark, sf):
    return graph.neighbours(_nodes(spark, sf), _triples(spark, sf), _seeds(spark, sf)).select("seed_id", "id", "type")


def graph_connections(spark, sf):
    return graph.connections(_nodes(spark, sf), _triples(spark, sf), _seeds(spark, sf)).select("source_id", "source_name", "relationship_name", "target_id", "target_name")


def graph_khop(spark, sf):
    return graph.reach(_triples(spark, sf), _seeds(spark, sf), 2)


def graph_khop_edges(spark, sf):
    return graph.neighbourhood(_nodes(spark, sf), _triples(spark, sf), _seeds(spark, sf), 1)[1].select("source_id", "target_id", "relationship_name")


def _hub_names(spark, sf) -> list[str]:
    """Names of the two entities with most edges: the parameters of the node-set queries."""
    named = graph.degrees(_triples(spark, sf)).join(_nodes(spark, sf).filter("type = 'Entity'"), "id").groupBy("name").agg(F.max("degree").alias("d"))
    return [r.name for r in named.orderBy(F.desc("d"), "name").limit(2).collect()]


def graph_nodeset_or(spark, sf):
    return graph.node_set(_nodes(spark, sf), _triples(spark, sf), "Entity", _hub_names(spark, sf))[1].select("source_id", "target_id", "relationship_name")


def graph_nodeset_and(spark, sf):
    return graph.node_set(_nodes(spark, sf), _triples(spark, sf), "Entity", _hub_names(spark, sf)[:1], all_of=True)[0].select("id", "type", "name")


def graph_degree_one(spark, sf):
    one = graph.degrees(_triples(spark, sf)).filter("degree = 1")
    return _nodes(spark, sf).filter("type = 'Entity'").join(one, "id", "left_semi").select("id", "name")


def graph_components(spark, sf):
    return graph.components(_nodes(spark, sf), _triples(spark, sf))


def graph_metrics(spark, sf):
    return graph.metrics(_nodes(spark, sf), _triples(spark, sf))


def relationship_names(spark, sf):
    return _triples(spark, sf).select("relationship_name").distinct()


def edge_type_counts(spark, sf):
    """Edges by retrieval text: the description where there is one, else the relationship."""
    e = _edges(spark, sf).withColumn("edge_text", jsonx.display_value(F.col("properties"), "$.edge_text"))
    return e.groupBy(text.retrieval_text(F.col("edge_text"), F.col("relationship_name")).alias("edge_text")).agg(F.count("*").alias("number_of_edges"))


def node_dedup_keep_last(spark, sf):
    return _edges(spark, sf).select("source_id", "target_id", "relationship_name", "updated_at")


def edge_antijoin_existing(spark, sf):
    """Edges of 2026 that were not stored before."""
    e = table(spark, sf, "graph_edge")
    old = e.filter("created_at < timestamp_ntz'2026-01-01'").select("source_id", "target_id", "relationship_name")
    return e.filter("created_at >= timestamp_ntz'2026-01-01'").select("source_id", "target_id", "relationship_name").distinct().join(old, ["source_id", "target_id", "relationship_name"], "left_anti")


def upsert_nodes(spark, sf):
    """Nodes of the graph merged with later versions named after their ids; the creation time stays."""
    nodes = table(spark, sf, "graph_node").select("id", "name", "type", "created_at", "updated_at")
    newer = nodes.filter("type = 'Entity'").select("id", F.upper("name").alias("name"), "type", F.col("updated_at").alias("created_at"), F.expr("updated_at + interval 1 day").alias("updated_at"))
    return graph.upsert(nodes, newer, ["id"], keep_from_old=("created_at",))


def triplets(spark, sf):
    shown = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("body"))
    nodes = _nodes(spark, sf).select("id", F.when(F.col("description").isNotNull(), F.concat(shown, F.lit(": "), "description")).otherwise(shown).alias("text"))
    return graph.triplets(nodes, _triples(spark, sf))


def triplet_search(spark, sf):
    """Hits of a made-up vector search: the distance follows from the id."""
    d = lambda c: F.round(F.conv(F.substring(F.md5(c), 1, 4), 16, 10).cast("double") / 65536, 6)
    nodes = _nodes(spark, sf).filter("type in ('Entity', 'DocumentChunk')").select("id", d(F.col("id")).alias("distance")).filter("distance < 0.2")
    rels = relationship_names(spark, sf).select("relationship_name", d(F.col("relationship_name")).alias("distance")).filter("distance < 0.5")
    return graph.triplet_search(_triples(spark, sf), nodes, rels, 10)


def type_rollup(spark, sf):
    """Edges by the types of their ends; behind the ten most frequent relationships everything is ``other``."""
    n = _nodes(spark, sf)
    e = _triples(spark, sf).join(n.select(F.col("id").alias("source_id"), F.col("type").alias("source_type")), "source_id").join(n.select(F.col("id").alias("target_id"), F.col("type").alias("target_type")), "target_id")
    counts = e.groupBy("source_type", "target_type", "relationship_name").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("source_type", "target_type").orderBy(F.desc("n"), "relationship_name")))
    return ranked.groupBy("source_type", "target_type", F.when(F.col("r") <= 3, F.col("relationship_name")).otherwise("other").alias("relationship")).agg(F.sum("n").alias("n"))


def relation_labels(spark, sf):
    """The two most frequent relationships of a source type, and how many more there are."""
    n = _nodes(spark, sf).select(F.col("id").alias("source_id"), "type")
    counts = _triples(spark, sf).join(n, "source_id").groupBy("type", "relationship_name").agg(F.count("*").alias("n"))
    r = counts.withColumn("r", F.row_number().over(Window.partitionBy("type").orderBy(F.desc("n"), "relationship_name")))
    parts = r.groupBy("type").agg(*(F.max(F.when(F.col("r") == i, F.format_string("%s (%d)", "relationship_name", "n"))).alias(f"p{i}") for i in (1, 2)), F.count("*").alias("k"))
    return parts.select("type", F.concat(F.concat_ws(", ", "p1", "p2"), F.when(F.col("k") > 2, F.format_string(", +%d more", F.col("k") - 2)).otherwise("")).alias("label"))


def semantic_types(spark, sf):
    """The type that an ``is_a`` edge names, else the stored type."""
    n = _nodes(spark, sf)
    named = _triples(spark, sf).filter("relationship_name = 'is_a'").join(n.select(F.col("id").alias("target_id"), F.col("name").alias("type_name")), "target_id").groupBy(F.col("source_id").alias("id")).agg(F.min(F.nullif("type_name", F.lit(""))).alias("type_name"))
    return n.join(named, "id", "left").select("id", F.coalesce(F.when(F.col("type") == "Entity", F.col("type_name")), "type", F.lit("Node")).alias("semantic_type"))


def fk_edges(spark, sf):
    """Rows as nodes, foreign keys as edges, over the order tables."""
    key = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    t = lambda name: table(spark, sf, name)
    parts = [
        t("nation").select(key("nation", "n_nationkey").alias("source_id"), key("region", "n_regionkey").alias("target_id"), F.lit("in_region").alias("relationship_name")),
        t("customer").select(key("customer", "c_custkey"), key("nation", "c_nationkey"), F.lit("in_nation")),
        t("supplier").select(key("supplier", "s_suppkey"), key("nation", "s_nationkey"), F.lit("in_nation")),
        t("orders").select(key("orders", "o_orderkey"), key("customer", "o_custkey"), F.lit("placed_by")),
        t("lineitem").select(key("orders", "l_orderkey"), key("part", "l_partkey"), F.lit("contains_part")).distinct(),
        t("lineitem").select(key("part", "l_partkey"), key("supplier", "l_suppkey"), F.lit("supplied_by")).distinct(),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def fk_degrees(spark, sf):
    d = graph.degrees(fk_edges(spark, sf))
    return d.groupBy(F.split("id", ":")[0].alias("kind")).agg(F.count("*").alias("nodes"), F.sum("degree").alias("ends"), F.max("degree").alias("most"))


def chunk_entities(spark, sf):
    """Which entities each chunk mentions, sorted."""
    n = _nodes(spark, sf)
    chunks, entities = n.filter("type = 'DocumentChunk'").select(F.col("id").alias("source_id")), n.filter("type = 'Entity'").select(F.col("id").alias("target_id"))
    e = _triples(spark, sf).join(chunks, "source_id", "left_semi").join(entities, "target_id", "left_semi")
    return e.select("source_id", "target_id").distinct().groupBy(F.col("source_id").alias("chunk_id")).agg(F.array_join(F.array_sort(F.collect_list("target_id")), ",").alias("contains"))


def edge_json_lines(spark, sf):
    """Edges between named entities as JSON lines."""
    n = _nodes(spark, sf).filter("type = 'Entity' and name <> ''").select("id", "name", "is_a")
    s = n.select(F.col("id").alias("source_id"), F.struct(F.col("name").alias("label"), F.col("is_a").alias("type")).alias("s"))
    t = n.select(F.col("id").alias("target_id"), F.struct(F.col("name").alias("label"), F.col("is_a").alias("type")).alias("t"))
    e = _triples(spark, sf).join(s, "source_id").join(t, "target_id")
    return e.select("source_id", "target_id", F.to_json(F.struct(F.col("s").alias("source"), F.col("relationship_name").alias("relationship"), F.col("t").alias("target"))).alias("line"))


def graph_snapshot(spark, sf):
    """Nodes as they are exported: the label is the name or type and id."""
    return _nodes(spark, sf).select("id", F.coalesce(F.nullif(F.col("name"), F.lit("")), F.concat_ws("_", "type", "id")).alias("label"), "type")


def uuid5_ids(spark, sf):
    n = table(spark, sf, "graph_node").filter("type = 'Entity' and name <> ''")
    return n.select("id", ids.node_id(F.col("name")).alias("node_id"), ids.data_point_id("Entity", F.col("name")).alias("entity_id"), ids.web_site_id(F.col("name")).alias("site_id"))


def normalize_identifier(spark, sf):
    n = table(spark, sf, "graph_node").filter("type = 'Entity'")
    return n.select("id", ids.normalize_identifier(F.col("name")).alias("identifier"), ids.node_name(F.col("name")).alias("node_name"))


QUERIES = {
    f.__name__: f
    for f in (
        graph_filtered, graph_neighbors, graph_connections, graph_khop, graph_khop_edges, graph_nodeset_or, graph_nodeset_and, graph_degree_one, graph_components, graph_metrics,
        relationship_names, edge_type_counts, node_dedup_keep_last, edge_antijoin_existing, upsert_nodes, triplets, triplet_search, type_rollup, relation_labels, semantic_types,
        fk_edges, fk_degrees, chunk_entities, edge_json_lines, graph_snapshot, uuid5_ids, normalize_identifier,
    )
}

_N = """n AS (SELECT id, name, type, properties->>'is_a' AS is_a, properties->>'place' AS place, properties->>'description' AS description, properties->>'text' AS body FROM graph_node),
e AS (SELECT DISTINCT source_id, target_id, relationship_name FROM graph_edge),
w AS (SELECT source_id AS id, target_id AS other FROM e WHERE source_id <> target_id UNION SELECT target_id, source_id FROM e WHERE source_id <> target_id),
seeds AS (SELECT id FROM n WHERE type = 'Entity' AND is_a = 'product')"""
_FK = """fk AS (SELECT 'nation:' || n_nationkey AS source_id, 'region:' || n_regionkey AS target_id, 'in_region' AS relationship_name FROM nation
UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'in_nation' FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'in_nation' FROM supplier
UNION ALL SELECT 'orders:' || o_orderkey, 'customer:' || o_custkey, 'placed_by' FROM orders UNION ALL SELECT DISTINCT 'orders:' || l_orderkey, 'part:' || l_partkey, 'contains_part' FROM lineitem
UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'supplied_by' FROM lineitem)"""
_HUBS = "hubs AS (SELECT name FROM (SELECT name, max(d) AS d FROM (SELECT id, count(*) AS d FROM (SELECT source_id AS id FROM e UNION ALL SELECT target_id FROM e) GROUP BY id) JOIN n USING (id) WHERE type = 'Entity' GROUP BY name) ORDER BY d DESC, name LIMIT {k})"
_D = "round(('0x' || substr(md5({0}), 1, 4))::INT / 65536.0::DOUBLE, 6)"

ORACLE = {
    "graph_filtered": f"""WITH {_N}, k AS (SELECT id FROM n WHERE type = 'Entity' AND is_a IN ('person', 'organization'))
      SELECT relationship_name, count(*) AS edges, (SELECT count(*) FROM k) AS nodes FROM e WHERE source_id IN (SELECT id FROM k) AND target_id IN (SELECT id FROM k) GROUP BY relationship_name""",
    "graph_neighbors": f"WITH {_N} SELECT w.id AS seed_id, n.id, n.type FROM w JOIN seeds USING (id) JOIN n ON n.id = w.other",
    "graph_connections": f"WITH {_N} SELECT source_id, s.name AS source_name, relationship_name, target_id, t.name AS target_name FROM e JOIN n s ON s.id = source_id JOIN n t ON t.id = target_id WHERE source_id IN (SELECT id FROM seeds) OR target_id IN (SELECT id FROM seeds)",
    "graph_khop": f"WITH RECURSIVE {_N}, r AS (SELECT id, 0 AS hops FROM seeds UNION SELECT w.other, r.hops + 1 FROM r JOIN w ON w.id = r.id WHERE r.hops < 2) SELECT id, min(hops) AS hops FROM r GROUP BY id",
    "graph_khop_edges": f"WITH {_N}, r AS (SELECT id FROM seeds UNION SELECT other FROM w WHERE id IN (SELECT id FROM seeds)) SELECT * FROM e WHERE source_id IN (SELECT id FROM r) AND target_id IN (SELECT id FROM r)",
    "graph_nodeset_or": f"WITH {_N}, {_HUBS.format(k=2)}, p AS (SELECT id FROM n WHERE type = 'Entity' AND name IN (SELECT name FROM hubs)), r AS (SELECT id FROM p UNION SELECT other FROM w WHERE id IN (SELECT id FROM p)) SELECT * FROM e WHERE source_id IN (SELECT id FROM r) AND target_id IN (SELECT id FROM r)",
    "graph_nodeset_and": f"WITH {_N}, {_HUBS.format(k=1)}, p AS (SELECT id FROM n WHERE type = 'Entity' AND name IN (SELECT name FROM hubs)), r AS (SELECT id FROM p UNION SELECT other FROM w WHERE id IN (SELECT id FROM p) GROUP BY other HAVING count(DISTINCT id) = (SELECT count(*) FROM p)) SELECT id, type, name FROM n WHERE id IN (SELECT id FROM r)",
    "graph_degree_one": f"WITH {_N}, d AS (SELECT id FROM (SELECT source_id AS id FROM e UNION ALL SELECT target_id FROM e) GROUP BY id HAVING count(*) = 1) SELECT id, name FROM n WHERE type = 'Entity' AND id IN (SELECT id FROM d)",
    "relationship_names": "SELECT DISTINCT relationship_name FROM graph_edge",
    "edge_type_counts": "WITH r AS (SELECT * FROM graph_edge QUALIFY row_number() OVER (PARTITION BY source_id, target_id, relationship_name ORDER BY updated_at DESC, created_at DESC, properties DESC NULLS LAST) = 1) SELECT coalesce(nullif(trim(properties->>'edge_text'), ''), relationship_name) AS edge_text, count(*) AS number_of_edges FROM r GROUP BY 1",
    "node_dedup_keep_last": "SELECT source_id, target_id, relationship_name, max(updated_at) AS updated_at FROM graph_edge GROUP BY ALL",
    "edge_antijoin_existing": "SELECT DISTINCT source_id, target_id, relationship_name FROM graph_edge e WHERE created_at >= TIMESTAMP '2026-01-01' AND NOT EXISTS (SELECT 1 FROM graph_edge o WHERE o.created_at < TIMESTAMP '2026-01-01' AND o.source_id = e.source_id AND o.target_id = e.target_id AND o.relationship_name = e.relationship_name)",
    "upsert_nodes": "SELECT id, CASE WHEN type = 'Entity' THEN upper(name) ELSE name END AS name, type, created_at, CASE WHEN type = 'Entity' THEN updated_at + INTERVAL 1 DAY ELSE updated_at END AS updated_at FROM graph_node",
    "triplets": f"WITH {_N}, x AS (SELECT id, CASE WHEN description IS NOT NULL THEN coalesce(nullif(name, ''), body) || ': ' || description ELSE coalesce(nullif(name, ''), body) END AS t FROM n) SELECT source_id, relationship_name, target_id, coalesce(s.t, '') || '-›' || relationship_name || '-›' || coalesce(o.t, '') AS text FROM e JOIN x s ON s.id = source_id JOIN x o ON o.id = target_id",
    "triplet_search": f"""WITH {_N}, h AS (SELECT id, {_D.format('id')} AS d FROM n WHERE type IN ('Entity', 'DocumentChunk')), k AS (SELECT * FROM h WHERE d < 0.2),
      r AS (SELECT relationship_name, {_D.format('relationship_name')} AS d FROM (SELECT DISTINCT relationship_name FROM e)), q AS (SELECT * FROM r WHERE d < 0.5)
      SELECT source_id, relationship_name, target_id, round(coalesce(s.d, {TRIPLET_PENALTY}::DOUBLE) + coalesce(t.d, {TRIPLET_PENALTY}::DOUBLE) + coalesce(q.d, {TRIPLET_PENALTY}::DOUBLE), 6) AS score
      FROM e LEFT JOIN k s ON s.id = source_id LEFT JOIN k t ON t.id = target_id LEFT JOIN q USING (relationship_name) WHERE s.d IS NOT NULL OR t.d IS NOT NULL ORDER BY score, source_id, relationship_name, target_id LIMIT 10""",
    "type_rollup": f"WITH {_N}, c AS (SELECT s.type AS source_type, t.type AS target_type, relationship_name, count(*) AS n FROM e JOIN n s ON s.id = source_id JOIN n t ON t.id = target_id GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source_type, target_type ORDER BY n DESC, relationship_name) AS r FROM c) SELECT source_type, target_type, CASE WHEN r <= 3 THEN relationship_name ELSE 'other' END AS relationship, sum(n)::BIGINT AS n FROM r GROUP BY ALL",
    "relation_labels": f"WITH {_N}, c AS (SELECT type, relationship_name, count(*) AS k FROM e JOIN n ON n.id = source_id GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY k DESC, relationship_name) AS r FROM c) SELECT type, string_agg(CASE WHEN r <= 2 THEN relationship_name || ' (' || k || ')' END, ', ' ORDER BY r) || CASE WHEN count(*) > 2 THEN ', +' || (count(*) - 2) || ' more' ELSE '' END AS label FROM r GROUP BY type",
    "semantic_types": f"WITH {_N}, t AS (SELECT source_id AS id, min(nullif(name, '')) AS t FROM e JOIN n ON n.id = target_id WHERE relationship_name = 'is_a' GROUP BY source_id) SELECT n.id, coalesce(CASE WHEN type = 'Entity' THEN t END, type, 'Node') AS semantic_type FROM n LEFT JOIN t USING (id)",
    "fk_edges": f"WITH {_FK} SELECT * FROM fk",
    "fk_degrees": f"WITH {_FK}, d AS (SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM fk UNION ALL SELECT target_id FROM fk) GROUP BY id) SELECT split_part(id, ':', 1) AS kind, count(*) AS nodes, sum(degree)::BIGINT AS ends, max(degree) AS most FROM d GROUP BY 1",
    "chunk_entities": f"WITH {_N} SELECT source_id AS chunk_id, string_agg(DISTINCT target_id, ',' ORDER BY target_id) AS contains FROM e WHERE source_id IN (SELECT id FROM n WHERE type = 'DocumentChunk') AND target_id IN (SELECT id FROM n WHERE type = 'Entity') GROUP BY source_id",
    "edge_json_lines": f"WITH {_N}, x AS (SELECT id, name, is_a FROM n WHERE type = 'Entity' AND name <> '') SELECT source_id, target_id, to_json({{source: {{label: s.name, type: s.is_a}}, relationship: relationship_name, target: {{label: t.name, type: t.is_a}}}})::VARCHAR AS line FROM e JOIN x s ON s.id = source_id JOIN x t ON t.id = target_id",
    "graph_snapshot": "SELECT id, coalesce(nullif(name, ''), type || '_' || id) AS label, type FROM graph_node",
    "uuid5_ids": "WITH x AS (SELECT id, name, replace(replace(lower(name), ' ', '_'), '''', '') AS k FROM graph_node WHERE type = 'Entity' AND name <> '') SELECT id, "
    + f"{uuid5_sql('k')} AS node_id, {uuid5_sql(chr(39) + 'Entity:' + chr(39) + ' || k')} AS entity_id, {uuid5_sql(chr(39) + 'WebSite:' + chr(39) + ' || name')} AS site_id FROM x",
    "normalize_identifier": "SELECT id, replace(replace(lower(name), ' ', '_'), '''', '') AS identifier, replace(lower(name), '''', '') AS node_name FROM graph_node WHERE type = 'Entity'",
    "graph_components": f"""WITH RECURSIVE {_N}, c AS (SELECT id, id AS root FROM n UNION SELECT w.other, c.root FROM c JOIN w ON w.id = c.id) SELECT id, min(root) AS component FROM c GROUP BY id""",
    "graph_metrics": f"""WITH RECURSIVE {_N}, c AS (SELECT id, id AS root FROM n UNION SELECT w.other, c.root FROM c JOIN w ON w.id = c.id), m AS (SELECT id, min(root) AS component FROM c GROUP BY id), z AS (SELECT component, count(*) AS k FROM m GROUP BY 1),
      v AS (SELECT (SELECT count(*) FROM n) AS nn, (SELECT count(*) FROM e) AS ee)
      SELECT nn AS num_nodes, ee AS num_edges, round(2.0::DOUBLE * ee / nn, 6) AS mean_degree, round(ee / (nn * (nn - 1.0::DOUBLE)), 9) AS edge_density, (SELECT count(*) FROM e WHERE source_id = target_id) AS num_selfloops, (SELECT count(*) FROM z) AS num_components, (SELECT max(k) FROM z) AS largest_component FROM v""",
}
