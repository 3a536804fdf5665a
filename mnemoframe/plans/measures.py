"""Queries of scalar functions, stores, ontologies, streams and pipelines over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoframe.functions import ids, jsonx, score, services, text, vector
from mnemoframe.operators import cypher, improve, ontology, records, visual
from mnemoframe.plans import pipeline
from mnemoframe.sources.tables import Store, add_edges, add_nodes, delete_nodes, index_points
from mnemoframe.session import shared_dir, table
from mnemoframe.streaming import streams


def _store(spark) -> Store:
    return Store(spark, f"{shared_dir(spark)}/mnemoframe/store-{uuid.uuid4().hex}")


def provenance_ids(spark, sf):
    """Ledger ids of nodes and edges, triplet slugs and learning ids."""
    e = table(spark, sf, "graph_edge").select("source_id", "target_id", "relationship_name").distinct()
    s, r, t = F.col("source_id"), F.col("relationship_name"), F.col("target_id")
    user, dataset = F.lit("user"), F.lit("dataset")
    return e.select("source_id", "target_id", "relationship_name", ids.provenance_node_id(F.lit(None).cast("string"), user, dataset, t, s).alias("node_id"), ids.provenance_edge_id(F.lit("tenant"), user, dataset, s, r, t).alias("edge_id"), ids.triplet_slug(s, r, t).alias("slug"))


def learning_ids(spark, sf):
    m = table(spark, sf, "memories").filter("title is not null")
    return m.select("memory_no", ids.learning_id(F.col("title")).alias("learning_id"))


def stable_signatures(spark, sf):
    m = table(spark, sf, "memories").filter("ref_names is not null")
    return m.select("memory_no", ids.stable_signature(F.array_sort(F.filter("ref_names", lambda x: x.isNotNull()))).alias("signature"))


def class_scoped_ids(spark, sf):
    """Identifiers of one name as different classes, and the key of a URI that ends in it."""
    n = table(spark, sf, "graph_node").filter("name is not null").select("name").distinct()
    return n.select("name", ids.data_point_id("Entity", F.col("name")).alias("entity"), ids.data_point_id("EntityType", F.col("name")).alias("type"), ids.uri_to_key(F.concat(F.lit("http://x.test/onto#"), F.translate("name", "/#", "  "))).alias("key"))


def vector_scalars(spark, sf):
    """Norm, padding, normalised form and clamped score of every vector."""
    e = table(spark, sf, "embeddings")
    v = F.col("embedding")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return e.select("vec_id", F.round(vector.norm(v), 5).alias("norm"), F.size(vector.pad(v, 80)).alias("padded"), F.round(total(vector.pad(v, 3)), 5).alias("head"), F.round(total(F.transform(vector.l2_normalize(v), lambda x: x * x)), 5).alias("unit"), F.round(score.clean_score(v[0].cast("double")), 5).alias("clean"))


def mean_pooling(spark, sf):
    """Masked mean of the vectors of every label group; every third vector is masked out."""
    e = table(spark, sf, "embeddings").filter("label < 4")
    g = e.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("s"))
    pooled = g.select("label", vector.mean_pool(F.transform("s", lambda x: x["embedding"]), F.transform("s", lambda x: F.when(x["vec_id"] % 3 == 0, 0).otherwise(1)), 64).alias("v"))
    return pooled.select("label", F.posexplode("v").alias("i", "x")).select("label", "i", F.round("x", 5).alias("x"))


def audit_times(spark, sf):
    """Times written as epoch milliseconds, as ISO text, or not at all."""
    m = table(spark, sf, "messages").filter("created_at is not null")
    at = F.col("created_at").cast("timestamp")
    written = F.when(F.col("message_no") % 3 == 0, F.unix_millis(at).cast("string")).when(F.col("message_no") % 3 == 1, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("at noon")
    return m.select("message_no", F.unix_millis(jsonx.audit_timestamp(written)).alias("ms"))


def scrubbed_texts(spark, sf):
    """Texts without escapes and control characters, and a prompt made of a title and a text."""
    d = table(spark, sf, "documents").filter("text is not null")
    return d.select("doc_id", F.md5(text.scrub(F.col("text"), 200)).alias("scrubbed"), F.md5(text.render_prompt(F.lit("Q {question} C {context}"), F.coalesce("title", F.lit("-")), F.left("text", F.lit(50)))).alias("prompt"))


def indexed_fields(spark, sf):
    """Fields read from JSON lists; what is no list has none."""
    m = table(spark, sf, "memories").select("memory_no", F.when(F.col("memory_no") % 4 == 0, F.lit(None)).when(F.col("memory_no") % 4 == 1, F.lit("no list")).otherwise(F.to_json(F.coalesce("ref_names", F.array().cast("array<string>")))).alias("t"), "ref_names")
    return m.select("memory_no", F.size(jsonx.indexed_fields(F.col("t"))).alias("n"))


def cleared_status(spark, sf):
    """Status maps of records without one dataset's key."""
    r = table(spark, sf, "cognee_data_record").select("record_no", F.to_json(F.map_from_arrays(F.array(F.lit("one"), F.lit("two")), F.array(F.lit("done"), F.coalesce("pipeline_status", F.lit("none"))))).alias("pipeline_status"))
    return records.clear_status(r, "one")


def edge_keys(spark, sf):
    """Edge identifiers with triple bars read back into their parts."""
    e = table(spark, sf, "graph_edge").select("source_id", "relationship_name", "target_id").distinct()
    written = e.select(F.when(F.length("source_id") % 2 == 0, F.concat_ws("|||", "source_id", "relationship_name", "target_id")).otherwise(F.concat_ws("|", "source_id", "target_id")).alias("edge_id"))
    k = written.select("edge_id", improve.edge_key(F.col("edge_id")).alias("k"))
    return k.groupBy(F.col("k.relationship_name").alias("relationship_name")).agg(F.count("*").alias("n"), F.count_distinct("k.source_id").alias("sources"))


def dataset_union_index(spark, sf):
    """Points indexed twice under different datasets: memberships unite, vectors are replaced."""
    store = _store(spark)
    e = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), F.col("label"))
    rows = e.select("id", "vector", F.map_from_arrays(F.array(F.lit("label")), F.array(F.col("label").cast("string"))).alias("metadata"))
    index_points(store, "c", rows.withColumn("dataset_ids", F.array(F.lit("first"))), 64)
    index_points(store, "c", rows.filter("cast(id as long) % 3 = 0").withColumn("dataset_ids", F.array(F.lit("second"))), 64)
    return store.read("vectors").select("id", F.array_join("dataset_ids", ",").alias("datasets"), F.size("vector").alias("dimensions"))


def store_retrieve_delete(spark, sf):
    """Points found by their ids after others were deleted from the store."""
    store = _store(spark)
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    store.write("points", e)
    store.delete("points", e.filter("id % 5 = 0").select("id"))
    return Store(spark, store.root).retrieve("points", e.filter("id % 2 = 0").select("id"))


def raw_vector_upsert(spark, sf):
    """Raw rows written over others of the same key, whatever their columns hold."""
    store = _store(spark)
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.lit("old").alias("state"))
    store.write("raw", e)
    store.merge("raw", e.filter("id % 4 = 1").withColumn("state", F.lit("new")), ["id"])
    return store.read("raw").groupBy("state").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def store_collections(spark, sf):
    """Collections that a store lists after one of three was dropped, with their sizes."""
    store = _store(spark)
    for name, source in (("nations", "nation"), ("regions", "region"), ("gone", "region")):
        store.write(name, table(spark, sf, source))
    store.drop("gone")
    return spark.createDataFrame([(n, store.read(n).count()) for n in store.collections()], "name string, size long")


def graph_sink(spark, sf):
    """Nodes and edges written twice, then every place deleted with its edges: what is left by type."""
    store = _store(spark)
    nodes = table(spark, sf, "graph_node").select("id", "name", F.coalesce(F.get_json_object("properties", "$.is_a"), F.col("type")).alias("type"), "created_at").dropDuplicates(["id"])
    edges = table(spark, sf, "graph_edge").select("source_id", "target_id", "relationship_name").distinct()
    for _ in range(2):
        add_nodes(store, nodes)
        add_edges(store, edges)
    delete_nodes(store, nodes.filter("type = 'place'").select("id"))
    left = store.read("nodes").groupBy(F.concat(F.lit("node "), "type").alias("kind")).agg(F.count("*").alias("n"))
    return left.unionByName(store.read("edges").groupBy(F.concat(F.lit("edge "), "relationship_name").alias("kind")).agg(F.count("*").alias("n")))


def embedding_reuse(spark, sf):
    """Vectors of the memories: stored ones where there are, made ones for the rest."""
    m = table(spark, sf, "memories").filter("content is not null").select(F.col("memory_no").alias("id"), F.col("content").alias("text"))
    known = m.filter("id % 3 = 0").select("id", F.array(F.lit(0.5), F.lit(0.25)).alias("vector"))
    out = improve.embed_with_reuse(m, known, lambda t: vector.hashed_vector(t, 2))
    return out.select("id", F.round(F.col("vector")[0], 6).alias("a"), F.round(F.col("vector")[1], 6).alias("b"))


def recorded_answers(spark, sf):
    """Answers played back from a tape by the digest of the prompt."""
    q = table(spark, sf, "eval_items").select("item_id", F.col("text").alias("prompt"))
    tape = q.filter("item_id % 2 = 0").select(F.sha2("prompt", 256).alias("digest"), F.concat(F.lit("answer "), "item_id").alias("answer")).dropDuplicates(["digest"])
    return records.replayed(q, tape).select("item_id", "answer")


def _triples(spark, sf) -> DataFrame:
    """The is_a edges of the graph as an ontology: their targets are classes, every other end of theirs an individual."""
    e = table(spark, sf, "graph_edge").filter("relationship_name = 'is_a'").select("source_id", "target_id").distinct()
    uri = lambda c: F.concat(F.lit("http://x.test/o#"), F.col(c))
    kind = e.select(uri("source_id").alias("s"), F.lit(ontology.RDF + "type").alias("p"), uri("target_id").alias("o"))
    classes = e.select(uri("target_id").alias("s"), F.lit(ontology.RDF + "type").alias("p"), F.lit(ontology.OWL + "Class").alias("o")).distinct()
    return kind.unionByName(classes)


def ontology_lookup(spark, sf):
    return ontology.lookup(_triples(spark, sf)).groupBy("category").agg(F.count("*").alias("n"), F.min("key").alias("first"))


def ontology_attached(spark, sf):
    """is_a edges that can be reached from the ends of the edges of the smallest source."""
    t = _triples(spark, sf).filter(F.col("o") != ontology.OWL + "Class")
    start = t.agg(F.min("s").alias("uri"))
    return ontology.attached(t, start)


def ontology_canonical(spark, sf):
    """Entities renamed to the names that an ontology matches them with."""
    n = table(spark, sf, "graph_node").filter("type = 'Entity'").select("id", F.coalesce("name", F.lit("")).alias("name"))
    matches = n.select("name").distinct().filter(F.length("name") % 3 == 0).select("name", F.upper("name").alias("candidate"))
    return ontology.canonical(n, matches)


def schema_graph(spark, sf):
    """Fields of made-up schema tables, one a node type."""
    n = table(spark, sf, "graph_node").groupBy("type").agg(F.count("*").alias("k"))
    shape = F.concat(F.lit('{"columns": [{"name": "id", "type": "string"}, {"name": "'), F.lower("type"), F.lit('", "type": "int"}], "foreign_keys": [{"column": "id", "ref_table": "Entity", "ref_column": "id"}]}'))
    t = n.select(F.col("type").alias("id"), F.col("type").alias("name"), shape.alias("schema"))
    fields, keys = visual.schema_graph(t)
    return fields.select(F.concat_ws(".", "name", "field", "field_type").alias("shown")).unionByName(keys.select(F.concat_ws(">", "source", "field", "target", "target_field").alias("shown")))


def operation_layer(spark, sf):
    n = table(spark, sf, "graph_node").select("id", "type")
    done = pipeline.stamped(n.withColumn("source_task", F.when(F.col("type") == "Entity", "extract")), "ingest", "write", 2)
    return visual.operation_layer(done)


def provenance_colours(spark, sf):
    return visual.colours(table(spark, sf, "graph_edge"), "relationship_name")


def stamped_pipeline(spark, sf):
    """A pipeline of three steps, one of them a fan-out, with stamped provenance."""
    keep = lambda df: df.filter("content is not null")
    both = pipeline.fan_out(lambda df: df.withColumn("half", F.lit("long")).filter(F.length("content") > 80), lambda df: df.withColumn("half", F.lit("short")).filter(F.length("content") <= 80))
    p = pipeline.Pipeline("texts").then("keep", keep, ("content",)).then("split", both)
    out = p.run(table(spark, sf, "memories").select("memory_no", "content"), stamp=True)
    return out.groupBy("half", "source_pipeline", "source_task", "topological_rank").agg(F.count("*").alias("n"))


def _streamed(spark, sf, made, mode: str) -> DataFrame:
    """A stream over the event table, read to its end; its path is a pattern, as a single file is no folder."""
    name = f"s{uuid.uuid4().hex}"
    return streams.run_to_table(made(streams.events(spark, f"{sf}/event[s].parquet")), name, f"{shared_dir(spark)}/mnemoframe/{name}", mode)


def stream_window_counts(spark, sf):
    """Events an hour and type, counted as a stream."""
    return _streamed(spark, sf, lambda s: streams.windowed_counts(s, lateness="3650 days"), "complete").select(F.unix_seconds("window_start").alias("at"), "event_type", "n")


def stream_usage(spark, sf):
    """Usage of every user and event type, folded as a stream."""
    return _streamed(spark, sf, streams.usage, "complete").select("user_id", "event_type", "n", F.round("value", 4).alias("value"))


def stream_sync(spark, sf):
    """Events handed on batch by batch with a checkpoint; a second run finds nothing new."""
    root = f"{shared_dir(spark)}/mnemoframe/sync-{uuid.uuid4().hex}"
    sink = lambda df, n: df.select("event_id", "event_type").write.mode("overwrite").parquet(f"{root}/out/{n}")
    for _ in range(2):
        streams.sync(streams.events(spark, f"{sf}/event[s].parquet"), f"{root}/check", sink).awaitTermination()
    return spark.read.parquet(f"{root}/out/*").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


def _graph(spark, sf):
    nodes = table(spark, sf, "graph_node").select("id", "name", "type", F.get_json_object("properties", "$.is_a").alias("is_a"))
    return nodes, table(spark, sf, "graph_edge").select("source_id", "target_id", "relationship_name").distinct()


def cypher_two_steps(spark, sf):
    """Who works for an organisation that is part of something, by two steps of a pattern."""
    return cypher.query(*_graph(spark, sf), "MATCH (a:Entity {is_a: 'person'})-[r:works_for]->(b:Entity)-[:is_part_of]->(c) WHERE b.is_a = 'organization' AND a.id <> c.id RETURN DISTINCT a.id AS a, b.id AS b, c.id AS c")


def cypher_counts(spark, sf):
    """Edges of every kind that lead to chunks, counted by a pattern against the direction."""
    return cypher.query(*_graph(spark, sf), "MATCH (c:DocumentChunk)<-[r]-(e:Entity) RETURN r.relationship_name AS relation, count(*) AS n, count(DISTINCT e.id) AS entities")


def cypher_common_neighbours(spark, sf):
    """Two patterns that share a variable: what a place's entity mentions and what mentions it."""
    return cypher.query(*_graph(spark, sf), "MATCH (p:Entity {is_a: 'place'})-[:mentions]->(x), (y:Entity {is_a: 'event'})-[:mentions]->(p) RETURN p.id AS place, count(*) AS n ORDER BY n DESC, place LIMIT 20")


def served_texts(spark, sf):
    """Answers of an outside service (here: the length of the text), in batches, with retries."""
    q = table(spark, sf, "eval_items")
    return q.select("item_id", services.served(F.col("text"), lambda values: [len(v) for v in values], "long", batch=16, retry=services.Retry(3)).alias("answer"))


QUERIES = {
    f.__name__: f
    for f in (
        cypher_two_steps, cypher_counts, cypher_common_neighbours, served_texts, provenance_ids, learning_ids, stable_signatures, class_scoped_ids, vector_scalars, mean_pooling, audit_times, scrubbed_texts, indexed_fields, cleared_status, edge_keys,
        dataset_union_index, store_retrieve_delete, raw_vector_upsert, store_collections, graph_sink, embedding_reuse, recorded_answers, ontology_lookup, ontology_attached, ontology_canonical,
        schema_graph, operation_layer, provenance_colours, stamped_pipeline, stream_window_counts, stream_usage, stream_sync,
    )
}

_E = "e AS (SELECT DISTINCT source_id, target_id, relationship_name FROM graph_edge)"
_NORM = "replace(replace(lower({0}), ' ', '_'), '''', '')"
_U5 = ids.uuid5_sql
_ISA = "i AS (SELECT DISTINCT source_id AS s, target_id AS t FROM graph_edge WHERE relationship_name = 'is_a')"
_N = "n AS (SELECT id, name, type, json_extract_string(properties, '$.is_a') AS is_a FROM graph_node)"
ORACLE = {
    "cypher_two_steps": f"WITH {_E}, {_N} SELECT DISTINCT a.id AS a, b.id AS b, c.id AS c FROM n a JOIN e x ON x.source_id = a.id JOIN n b ON b.id = x.target_id JOIN e y ON y.source_id = b.id JOIN n c ON c.id = y.target_id WHERE a.type = 'Entity' AND a.is_a = 'person' AND b.type = 'Entity' AND b.is_a = 'organization' AND x.relationship_name = 'works_for' AND y.relationship_name = 'is_part_of' AND a.id <> c.id",
    "cypher_counts": f"WITH {_E}, {_N} SELECT relationship_name AS relation, count(*) AS n, count(DISTINCT b.id) AS entities FROM e JOIN n c ON c.id = target_id JOIN n b ON b.id = source_id WHERE c.type = 'DocumentChunk' AND b.type = 'Entity' GROUP BY 1",
    "cypher_common_neighbours": f"WITH {_E}, {_N} SELECT p.id AS place, count(*) AS n FROM n p JOIN e a ON a.source_id = p.id AND a.relationship_name = 'mentions' JOIN n x ON x.id = a.target_id JOIN e b ON b.target_id = p.id AND b.relationship_name = 'mentions' JOIN n y ON y.id = b.source_id WHERE p.is_a = 'place' AND p.type = 'Entity' AND y.type = 'Entity' AND y.is_a = 'event' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "served_texts": "SELECT item_id, length(text) AS answer FROM eval_items",
    "provenance_ids": f"WITH {_E} SELECT source_id, target_id, relationship_name, {_U5(chr(39) + 'Noneuserdataset' + chr(39) + ' || target_id || source_id')} AS node_id, {_U5(chr(39) + 'tenantuserdataset' + chr(39) + ' || source_id || relationship_name || target_id')} AS edge_id, {_U5(_NORM.format('source_id || relationship_name || target_id'))} AS slug FROM e",
    "learning_ids": rf"SELECT memory_no, {_U5(chr(39) + 'TruthLearning:' + chr(39) + ' || ' + r'trim(regexp_replace(lower(title), ' + chr(39) + r'\s+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + '))')} AS learning_id FROM memories WHERE title IS NOT NULL",
    "stable_signatures": "SELECT memory_no, sha256(array_to_string(list_sort(list_filter(ref_names, lambda x: x IS NOT NULL)), '|')) AS signature FROM memories WHERE ref_names IS NOT NULL",
    "class_scoped_ids": f"SELECT DISTINCT name, {_U5(chr(39) + 'Entity:' + chr(39) + ' || ' + _NORM.format('name'))} AS entity, {_U5(chr(39) + 'EntityType:' + chr(39) + ' || ' + _NORM.format('name'))} AS type, replace(lower(translate(name, '/#', '  ')), ' ', '_') AS key FROM graph_node WHERE name IS NOT NULL",
    "vector_scalars": """SELECT vec_id, round(sqrt(list_dot_product(v, v)), 5) AS norm, 80::INT AS padded, round(v[1] + v[2] + v[3], 5) AS head, CASE WHEN list_dot_product(v, v) = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS unit, round(CASE WHEN isnan(v[1]) OR v[1] < 0 THEN 0 ELSE v[1] END, 5) AS clean
      FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)""",
    "mean_pooling": "SELECT label, (i - 1)::INT AS i, round(avg(x), 5) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE label < 4 AND vec_id % 3 <> 0) GROUP BY ALL",
    "audit_times": "SELECT message_no, CASE message_no % 3 WHEN 0 THEN floor(epoch_us(created_at) / 1000)::BIGINT WHEN 1 THEN floor(epoch_us(created_at) / 1000000)::BIGINT * 1000 END AS ms FROM messages WHERE created_at IS NOT NULL",
    "scrubbed_texts": r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, chr(27) || '\[[0-9;?]*[ -/]*[@-~]', '', 'g'), '[\x00-\x1f\x7f]+', ' ', 'g'), ' ')[:200]) AS scrubbed, md5('Q ' || coalesce(title, '-') || ' C ' || text[:50]) AS prompt FROM documents WHERE text IS NOT NULL",
    "indexed_fields": "SELECT memory_no, CASE WHEN memory_no % 4 < 2 THEN 0 ELSE coalesce(len(ref_names), 0) END::INT AS n FROM memories",
    "cleared_status": """SELECT record_no, '{"two":"' || coalesce(pipeline_status, 'none') || '"}' AS pipeline_status FROM (SELECT record_no, replace(pipeline_status, '"', '\\"') AS pipeline_status FROM cognee_data_record)""",
    "edge_keys": f"WITH {_E} SELECT CASE WHEN length(source_id) % 2 = 0 THEN relationship_name END AS relationship_name, count(*) AS n, count(DISTINCT CASE WHEN length(source_id) % 2 = 0 THEN source_id END) AS sources FROM e GROUP BY 1",
    "dataset_union_index": "SELECT vec_id::VARCHAR AS id, CASE WHEN vec_id % 3 = 0 THEN 'first,second' ELSE 'first' END AS datasets, len(embedding)::INT AS dimensions FROM embeddings",
    "store_retrieve_delete": "SELECT vec_id AS id, label FROM embeddings WHERE vec_id % 5 <> 0 AND vec_id % 2 = 0",
    "raw_vector_upsert": "SELECT CASE WHEN vec_id % 4 = 1 THEN 'new' ELSE 'old' END AS state, count(*) AS n, sum(vec_id)::BIGINT AS ids FROM embeddings GROUP BY 1",
    "store_collections": "SELECT 'nations' AS name, count(*) AS size FROM nation UNION ALL SELECT 'regions', count(*) FROM region",
    "graph_sink": f"""WITH {_E}, n AS (SELECT id, coalesce(json_extract_string(properties, '$.is_a'), type) AS type FROM graph_node)
      SELECT 'node ' || type AS kind, count(*) AS n FROM n WHERE type <> 'place' GROUP BY 1 UNION ALL SELECT 'edge ' || relationship_name, count(*) FROM e WHERE source_id NOT IN (SELECT id FROM n WHERE type = 'place') AND target_id NOT IN (SELECT id FROM n WHERE type = 'place') GROUP BY 1""",
    "embedding_reuse": f"SELECT memory_no AS id, CASE WHEN memory_no % 3 = 0 THEN 0.5::DOUBLE ELSE round(v[1], 6) END AS a, CASE WHEN memory_no % 3 = 0 THEN 0.25::DOUBLE ELSE round(v[2], 6) END AS b FROM (SELECT memory_no, {vector.hashed_vector_sql('content', 2)} AS v FROM memories WHERE content IS NOT NULL)",
    "recorded_answers": "SELECT q.item_id, a.answer FROM eval_items q LEFT JOIN (SELECT text, 'answer ' || any_value(item_id) AS answer FROM eval_items WHERE item_id % 2 = 0 GROUP BY text) a USING (text)",
    "ontology_lookup": f"WITH {_ISA}, k AS (SELECT 'Classes' AS category, t AS id FROM i UNION SELECT 'Individuals', s FROM i WHERE s NOT IN (SELECT t FROM i)) SELECT category, count(*) AS n, min(replace(lower(id), ' ', '_')) AS first FROM k GROUP BY 1",
    "ontology_attached": f"WITH RECURSIVE {_ISA}, r AS (SELECT min(s) AS u FROM i UNION SELECT t FROM r JOIN i ON i.s = u) SELECT DISTINCT replace(lower(s), ' ', '_') AS source, 'is_a' AS relationship, replace(lower(t), ' ', '_') AS target FROM r JOIN i ON i.s = u",
    "ontology_canonical": f"SELECT CASE WHEN length(coalesce(name, '')) % 3 = 0 THEN {_U5(chr(39) + 'Entity:' + chr(39) + ' || ' + _NORM.format('upper(coalesce(name, ' + chr(39) * 2 + '))'))} ELSE id END AS id, CASE WHEN length(coalesce(name, '')) % 3 = 0 THEN upper(coalesce(name, '')) ELSE name END AS name, length(coalesce(name, '')) % 3 = 0 AS ontology_valid FROM graph_node WHERE type = 'Entity'",
    "schema_graph": "SELECT unnest([type || '.id.string', type || '.' || lower(type) || '.int', type || '>id>Entity>id']) AS shown FROM (SELECT DISTINCT type FROM graph_node)",
    "operation_layer": "SELECT 'ingest' AS pipeline, CASE WHEN type = 'Entity' THEN 'extract' ELSE 'write' END AS task, count(*) AS nodes, count(DISTINCT type) AS types FROM graph_node GROUP BY ALL",
    "provenance_colours": "SELECT DISTINCT relationship_name, '#' || substr(md5(relationship_name), 1, 6) AS colour FROM graph_edge",
    "stamped_pipeline": "SELECT CASE WHEN length(content) > 80 THEN 'long' ELSE 'short' END AS half, 'texts' AS source_pipeline, 'keep' AS source_task, 0::INT AS topological_rank, count(*) AS n FROM memories WHERE content IS NOT NULL GROUP BY 1",
    "stream_window_counts": "SELECT epoch(date_trunc('hour', ts))::BIGINT AS at, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_usage": "SELECT user_id, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL",
    "stream_sync": "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY 1",
}
