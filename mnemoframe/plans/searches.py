"""Queries of the search types over the driver's tables, with vectors that SQL can repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoframe.functions import ids, vector
from mnemoframe.functions.fixed import F32_EPSILON, TRIPLET_PENALTY
from mnemoframe.operators import context, graph, ranking, records
from mnemoframe.plans import ranking as lexical
from mnemoframe.plans.retrieval import RELATIONSHIPS, Params, Tables, completion, context_text, events_inside, hybrid, hybrid_context, rank_events, search
from mnemoframe.session import materialize, spread, table


def _asked(spark, sf) -> DataFrame:
    items = table(spark, sf, "eval_items")
    return items.select(F.col("item_id").alias("query_id"), "text", vector.hashed_vector(F.col("text")).alias("vector"))


def _document_graph(spark, sf) -> Tables:
    """Documents as chunks, their titles as summaries; importance from the length."""
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", F.nullif("title", F.lit("")).alias("title"), F.when(F.col("lang").isNotNull(), (F.col("n_chars") % 100) / 100.0).alias("importance_weight"))
    d = spread(d)
    nodes = d.select("id", F.col("title").alias("name"), F.lit("DocumentChunk").alias("type"), "text", "importance_weight")
    chunk = d.select(F.lit("DocumentChunk_text").alias("collection"), "id", "text", F.lit(None).cast("string").alias("source_chunk_id"))
    summary = d.filter("title is not null").select(F.lit("TextSummary_text").alias("collection"), F.concat(F.lit("s"), "id").alias("id"), F.col("title").alias("text"), F.col("id").alias("source_chunk_id"))
    payload = chunk.unionByName(summary)
    vectors = payload.filter("text is not null").select("collection", "id", vector.hashed_vector(F.col("text")).alias("vector"))
    edges = spark.createDataFrame([], "source_id string, target_id string, relationship_name string")
    return Tables(nodes, edges, vectors, payload=payload)


def _entity_graph(spark, sf) -> Tables:
    """The graph tables with all six collections: nodes by their names, relationships, triplets."""
    name = F.coalesce(F.nullif("name", F.lit("")), F.get_json_object("properties", "$.text"))
    nodes = spread(table(spark, sf, "graph_node").select("id", F.coalesce("name", F.lit("")).alias("name"), "type", name.alias("text")))
    edges = spread(table(spark, sf, "graph_edge").select("source_id", "target_id", "relationship_name").distinct())
    kind = F.when(F.col("type") == "Entity", "Entity_name").when(F.col("type") == "TextSummary", "TextSummary_text").otherwise("DocumentChunk_text")
    own = nodes.filter("text is not null").select(kind.alias("collection"), "id", "text")
    relations = edges.select("relationship_name").distinct().select(F.lit(RELATIONSHIPS).alias("collection"), ids.data_point_id("EdgeType", F.col("relationship_name")).alias("id"), F.col("relationship_name").alias("text"))
    made = graph.triplets(nodes.select("id", "text"), edges)
    triplets = made.select(F.lit("Triplet_text").alias("collection"), ids.triplet_slug(F.col("source_id"), F.col("relationship_name"), F.col("target_id")).alias("id"), "text").dropDuplicates(["id"])
    payload = materialize(own.unionByName(relations).unionByName(triplets), "payload").withColumn("source_chunk_id", F.lit(None).cast("string"))
    return Tables(nodes, edges, payload.select("collection", "id", vector.hashed_vector(F.col("text")).alias("vector")), payload=payload)


def graph_completion_topk(spark, sf):
    """Triplet search over six collections for every test item."""
    return search(_entity_graph(spark, sf), _asked(spark, sf), "GraphCompletion")


def graph_completion_context(spark, sf):
    """The edges that a graph completion shows, as prompt text."""
    t, q = _entity_graph(spark, sf), _asked(spark, sf)
    return context_text(t, search(t, q, "GraphCompletion")).select("query_id", F.md5("context").alias("digest"), (F.size(F.split("context", "\n"))).alias("n_lines"))


def result_graph_view(spark, sf):
    """Distinct nodes of the edges that every query finds."""
    found = search(_entity_graph(spark, sf), _asked(spark, sf), "GraphCompletion")
    return context.graph_view(found)[0].groupBy("query_id").agg(F.count("*").alias("n_nodes"))


def search_summaries(spark, sf):
    return search(_document_graph(spark, sf), _asked(spark, sf), "Summaries").select("query_id", "id", "score", "rank", "text")


def rag_context(spark, sf):
    """Texts of the nearest chunks of every test item, as a prompt without an answering model."""
    t = _document_graph(spark, sf)
    out = search(t, _asked(spark, sf), "RagCompletion", Params(top_k=3))
    return out.select("query_id", F.md5("context").alias("context_digest"), F.md5("answer").alias("prompt_digest"))


def triplet_context(spark, sf):
    t = _entity_graph(spark, sf)
    return search(t, _asked(spark, sf), "TripletCompletion", Params(top_k=5)).select("query_id", "context")


def answered_completion(spark, sf):
    """A completion with an injected answer: the first line of the context."""
    p = Params(top_k=5, answer=lambda question, shown: F.substring_index(shown, "\n", 1))
    return completion(lambda t, q, p: search(t, q, "Summaries", p))(_document_graph(spark, sf), _asked(spark, sf), p).select("query_id", "answer")


def context_extension(spark, sf):
    """Two rounds: the injected answer, the best summary's title, becomes the next question; contexts merge."""
    from mnemoframe.plans.retrieval import rounds

    t, q = _document_graph(spark, sf), _asked(spark, sf)
    asks = lambda t, q, p: search(t, q.withColumn("vector", vector.hashed_vector(F.col("text"))), "Summaries", p)
    p = Params(top_k=3, answer=lambda question, shown: F.substring_index(shown, "\n", 1))
    return rounds(asks, 2)(t, q, p).select("query_id", "id", "round", "rank")


def reasoning_rounds(spark, sf):
    """Answers shorter than 20 letters are refused; the follow-up is the answer itself."""
    from mnemoframe.plans.retrieval import reasoned

    t, q = _document_graph(spark, sf), _asked(spark, sf)
    asks = lambda t, q, p: search(t, q.withColumn("vector", vector.hashed_vector(F.col("text"))), "Summaries", p)
    p = Params(top_k=3, answer=lambda question, shown: F.substring_index(shown, "\n", 1), validate=lambda q, a, c: F.length(a) >= 20, follow_up=lambda q, a, c: a)
    return reasoned(asks, 2)(t, q, p).select("query_id", "id", "round", "rank")


def hybrid_three_lanes(spark, sf):
    """BM25, vector and summary lanes of every test item, by chunk, weighed by importance."""
    return hybrid(_document_graph(spark, sf), _asked(spark, sf), Params())


def hybrid_context_parts(spark, sf):
    """Lines of the entity and fact parts of the hybrid context over the graph tables."""
    t = _entity_graph(spark, sf)
    shown = hybrid_context(t, _asked(spark, sf), Params(top_k=3))
    lines = lambda c: F.when(F.col(c) == "", 0).otherwise(F.size(F.split(c, "\n")))
    return shown.select("query_id", lines("facts").alias("n_facts"), F.md5("facts").alias("facts"), lines("entities").alias("n_bullets"))


def coding_rules(spark, sf):
    """Nodes whose type or name speaks of rules, for two questions."""
    m = table(spark, sf, "memories").select(F.concat(F.lit("m"), "memory_no").alias("id"), F.coalesce("title", F.lit("")).alias("name"), F.lit("Memory").alias("type"), F.col("content").alias("text"))
    rules = m.withColumn("type", F.when(F.length("name") % 7 == 0, "CodingRule").otherwise(F.col("type")))
    q = spark.createDataFrame([(1, "a"), (2, "b")], "query_id long, text string")
    return search(Tables(rules, None, None), q, "CodingRules").select("query_id", "id", "name")


def _events(spark, sf):
    """Messages as events: every third lasts until a day later, the others have one time."""
    m = table(spark, sf, "messages").select(F.concat(F.lit("m"), "message_no").alias("event_id"), F.concat(F.lit("message "), "message_no").alias("name"), F.unix_millis(F.col("created_at").cast("timestamp")).alias("at"), (F.col("message_no") % 3 == 0).alias("long"))
    end = F.col("at") + 86_400_000
    return m.select("event_id", "name", F.when(~F.col("long"), F.col("at")).alias("at_ms"), F.when(F.col("long"), F.col("at")).alias("from_ms"), F.when(F.col("long"), end).alias("to_ms"))


def _windows(spark, sf):
    """A window of 12 hours from the first message of every session; those of odd sessions are open behind."""
    m = table(spark, sf, "messages").groupBy("session_id").agg(F.min(F.unix_millis(F.col("created_at").cast("timestamp"))).alias("low_ms"), F.count("*").alias("n"))
    return m.select(F.col("session_id").alias("query_id"), "low_ms", (F.col("low_ms") + 43_200_000).alias("high_ms"))


def temporal_events(spark, sf):
    """How many events lie in every session's window, found over Timestamp and Interval nodes."""
    nodes, edges = records.temporal_graph(_events(spark, sf))
    return events_inside(materialize(nodes, "nodes"), materialize(edges, "edges"), _windows(spark, sf)).groupBy("query_id").agg(F.count("*").alias("n_events"), F.min("id").alias("first"))


def temporal_rank(spark, sf):
    """The five best events of every window by the largest of two scores of each."""
    nodes, edges = records.temporal_graph(_events(spark, sf))
    found = materialize(events_inside(materialize(nodes, "nodes"), materialize(edges, "edges"), _windows(spark, sf)), "found")
    no = F.substring("id", 2, 20).cast("long")
    scores = found.filter(no % 2 == 0).select("query_id", "id", ((no % 101) / 100.0).alias("score")).unionByName(found.filter(no % 3 == 0).select("query_id", "id", ((no % 67) / 66.0).alias("score")))
    return rank_events(found, scores, 5).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def edge_ranks(spark, sf):
    """First rank of each relationship among the hits of every search."""
    e = table(spark, sf, "entity_results").filter("edges is not null")
    hits = e.select(F.col("query_no").alias("query_id"), F.explode("edges").alias("e"), F.col("hit_no").alias("rank")).select("query_id", F.trim(F.substring_index("e", "->", 1)).alias("relationship_name"), "rank")
    return context.edge_ranks(hits)


def chunk_backfill(spark, sf):
    """Texts of the chunks that only a summary brought in; chunks that are gone are dropped."""
    r = table(spark, sf, "cognee_data_record")
    pairs = r.filter("batch_no >= 1").select("record_no", F.col("record_no").alias("id"), F.when(F.col("record_no") % 2 == 0, F.col("label")).alias("text"))
    chunks = r.filter("content is not null and record_no % 5 <> 0").select(F.col("record_no").alias("id"), F.col("content").alias("text"))
    return context.backfill(pairs, chunks).select("record_no", F.md5("text").alias("digest"))


def truth_alignment(spark, sf):
    """Alignment of the vectors with the means of two label groups as centroids, padded to eight numbers."""
    from mnemoframe.operators import improve

    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("d"), F.col("label") % 2).alias("dataset_id"), F.col("label"), F.col("embedding").alias("vector"))
    means = e.select("dataset_id", "label", F.posexplode("vector").alias("i", "x")).groupBy("dataset_id", "label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centroids = means.groupBy("dataset_id", F.col("label").alias("slot")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda z: z["m"]).alias("centroid"))
    aligned = improve.align_chunks(e.select("id", "dataset_id", "vector"), centroids)
    return aligned.select("id", F.posexplode("alignment").alias("place", "x")).select("id", "place", F.round("x", 5).alias("x"))


def novelty_search(spark, sf):
    """Nearest stored learnings of each new one, only among points of the node set ``alpha_notes``."""
    good = F.col("vector").isNotNull() & (F.size("vector") == F.col("dimension")) & ~F.exists("vector", lambda x: F.isnan(x)) & F.exists("vector", lambda x: x != 0)
    p = table(spark, sf, "vector_points").filter(good & (F.col("collection_name") == "DocumentChunk_text"))
    held = p.filter(F.try_element_at("metadata", F.lit("belongs_to_set")) == "alpha_notes").select(F.col("point_no").alias("id"), "vector")
    return ranking.nearest(held, p.filter("point_no % 20 = 0").select(F.col("point_no").alias("query_id"), "vector"), 3)


QUERIES = {
    f.__name__: f
    for f in (
        graph_completion_topk, graph_completion_context, result_graph_view, search_summaries, rag_context, triplet_context, answered_completion, context_extension, reasoning_rounds,
        hybrid_three_lanes, hybrid_context_parts, coding_rules, temporal_events, temporal_rank, edge_ranks, chunk_backfill, truth_alignment, novelty_search,
    )
}

_VEC = vector.hashed_vector_sql
_COSINE = f"round(list_dot_product({{0}}, {{1}}) / greatest(sqrt(list_dot_product({{0}}, {{0}})) * sqrt(list_dot_product({{1}}, {{1}})), {F32_EPSILON}), 6)"
_Q = f"q AS (SELECT item_id AS query_id, text AS question, {_VEC('text')} AS w FROM eval_items)"
_RANKED = "(row_number() OVER (PARTITION BY {0} ORDER BY score DESC, id) - 1)::INT AS rank"
_SUMMARIES = f"""{_Q}, sm AS (SELECT 's' || doc_id AS id, doc_id, title AS text, {_VEC('title')} AS v FROM documents WHERE title <> ''),
  ss AS (SELECT query_id, id, doc_id, text, {_COSINE.format('v', 'w')} AS score FROM sm, q), sr AS (SELECT *, {_RANKED.format('query_id')} FROM ss)"""
_CHUNKS = f"""ck AS (SELECT doc_id::VARCHAR AS id, text, {_VEC('text')} AS v FROM documents WHERE text IS NOT NULL), cs AS (SELECT query_id, id, text, {_COSINE.format('v', 'w')} AS score FROM ck, q), cr AS (SELECT *, {_RANKED.format('query_id')} FROM cs)"""
_NORM = "replace(replace(lower({0}), ' ', '_'), '''', '')"
_GRAPH = f"""{_Q}, n AS (SELECT id, coalesce(name, '') AS name, type, coalesce(nullif(name, ''), json_extract_string(properties, '$.text')) AS text FROM graph_node),
  e AS (SELECT DISTINCT source_id, target_id, relationship_name FROM graph_edge),
  tr AS (SELECT {ids.uuid5_sql(_NORM.format('source_id || relationship_name || target_id'))} AS id, any_value(a.text || '-›' || relationship_name || '-›' || b.text) AS text FROM e JOIN n a ON a.id = source_id JOIN n b ON b.id = target_id WHERE a.text IS NOT NULL AND b.text IS NOT NULL GROUP BY 1),
  pts AS (SELECT CASE type WHEN 'Entity' THEN 'Entity_name' WHEN 'TextSummary' THEN 'TextSummary_text' ELSE 'DocumentChunk_text' END AS c, id, text FROM n WHERE text IS NOT NULL
    UNION ALL SELECT 'EdgeType_relationship_name', r, r FROM (SELECT DISTINCT relationship_name AS r FROM e)),
  hit AS (SELECT query_id, c, id, text, {_COSINE.format(_VEC('text'), 'w')} AS score FROM pts, q)"""
_RELID = ids.uuid5_sql("'EdgeType:' || " + _NORM.format("id"))
_COMPLETION = f"""{_GRAPH},
  top AS (SELECT *, row_number() OVER (PARTITION BY query_id, c ORDER BY score DESC, CASE WHEN c = '{RELATIONSHIPS}' THEN {_RELID} ELSE id END) AS r FROM hit QUALIFY r <= 100),
  near AS (SELECT query_id, id, 1 - max(score) AS d FROM top WHERE c <> '{RELATIONSHIPS}' GROUP BY ALL), rel AS (SELECT query_id, id AS relationship_name, 1 - max(score) AS x FROM top WHERE c = '{RELATIONSHIPS}' GROUP BY ALL),
  tou AS (SELECT query_id, e.*, d AS s, NULL::DOUBLE AS t FROM e JOIN near ON near.id = source_id UNION ALL SELECT query_id, e.*, NULL, d FROM e JOIN near ON near.id = target_id),
  mrg AS (SELECT query_id, source_id, relationship_name, target_id, min(s) AS s, min(t) AS t FROM tou GROUP BY ALL),
  sco AS (SELECT mrg.*, round(coalesce(s, {TRIPLET_PENALTY}) + coalesce(t, {TRIPLET_PENALTY}) + coalesce(x, {TRIPLET_PENALTY}), 6) AS score FROM mrg LEFT JOIN rel USING (query_id, relationship_name)),
  fin AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score, source_id, relationship_name, target_id) - 1)::INT AS rank FROM sco QUALIFY rank < 10)"""
_EVENTS = """ev AS (SELECT 'm' || message_no AS id, message_no, floor(epoch_us(created_at) / 1000)::BIGINT AS a, message_no % 3 = 0 AS lasts FROM messages WHERE created_at IS NOT NULL),
  win AS (SELECT session_id AS query_id, min(floor(epoch_us(created_at) / 1000)::BIGINT) AS lo FROM messages GROUP BY 1),
  ins AS (SELECT query_id, id, message_no FROM win JOIN ev ON (a BETWEEN lo AND lo + 43200000) OR (lasts AND a + 86400000 BETWEEN lo AND lo + 43200000))"""
_SECOND = f"""{_SUMMARIES}, a1 AS (SELECT query_id, arg_min(text, rank) AS answer FROM sr WHERE rank < 3 GROUP BY 1), nx AS (SELECT query_id, answer, {_VEC('answer')} AS w FROM a1 @WHERE@),
  s2 AS (SELECT query_id, id, {_COSINE.format('v', 'w')} AS score FROM sm, nx), r2 AS (SELECT *, {_RANKED.format('query_id')} FROM s2),
  al AS (SELECT query_id, id, 0 AS round, rank FROM sr WHERE rank < 3 UNION ALL SELECT query_id, id, 1, rank FROM r2 WHERE rank < 3)
  SELECT query_id, id, round, rank FROM al QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY round, rank) = 1"""
ORACLE = {
    "graph_completion_topk": f"WITH {_COMPLETION} SELECT query_id, source_id, relationship_name, target_id, score, rank FROM fin",
    "graph_completion_context": f"""WITH {_COMPLETION}, nm AS (SELECT id, coalesce(nullif(name, ''), text, 'Unnamed Node') AS shown FROM n)
      SELECT query_id, md5(string_agg(a.shown || ' --[' || relationship_name || ']--> ' || b.shown, chr(10) ORDER BY rank)) AS digest, count(*)::INT AS n_lines FROM fin JOIN nm a ON a.id = source_id JOIN nm b ON b.id = target_id GROUP BY query_id""",
    "result_graph_view": f"WITH {_COMPLETION} SELECT query_id, count(DISTINCT id) AS n_nodes FROM (SELECT query_id, source_id AS id FROM fin UNION ALL SELECT query_id, target_id FROM fin) GROUP BY query_id",
    "search_summaries": f"WITH {_SUMMARIES} SELECT query_id, id, score, rank, text FROM sr WHERE rank < 10",
    "rag_context": f"WITH {_Q}, {_CHUNKS}, cx AS (SELECT query_id, string_agg(text, chr(10) ORDER BY rank) AS x FROM cr WHERE rank < 3 GROUP BY 1) SELECT query_id, md5(x) AS context_digest, md5('Question: ' || question || chr(10) || 'Context: ' || x) AS prompt_digest FROM q JOIN cx USING (query_id)",
    "triplet_context": f"WITH {_GRAPH}, ts AS (SELECT query_id, id, text, {_COSINE.format(_VEC('text'), 'w')} AS score FROM tr, q), t5 AS (SELECT *, {_RANKED.format('query_id')} FROM ts QUALIFY rank < 5) SELECT query_id, string_agg(text, chr(10) ORDER BY rank) AS context FROM t5 GROUP BY 1",
    "answered_completion": f"WITH {_SUMMARIES} SELECT query_id, split_part(arg_min(text, rank), chr(10), 1) AS answer FROM sr WHERE rank < 5 GROUP BY 1",
    "context_extension": f"WITH {_SECOND.replace('@WHERE@', '')}",
    "reasoning_rounds": f"WITH {_SECOND.replace('@WHERE@', 'WHERE length(answer) < 20')}",
    "hybrid_three_lanes": f"""WITH {lexical._BM25.strip()}, {_SUMMARIES}, {_CHUNKS},
      l1 AS (SELECT query_id, id::VARCHAR AS id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id::VARCHAR) - 1)::INT AS rank FROM bm WHERE score > 0 QUALIFY rank < 20),
      l3 AS (SELECT query_id, doc_id::VARCHAR AS id, min(rank) AS rank FROM sr WHERE rank < 10 GROUP BY ALL),
      u AS (SELECT query_id, id, min(x) AS x, min(y) AS y, min(z) AS z FROM (SELECT query_id, id, rank AS x, NULL AS y, NULL AS z FROM l1 UNION ALL SELECT query_id, id, NULL, rank, NULL FROM cr WHERE rank < 20 UNION ALL SELECT query_id, id, NULL, NULL, rank FROM l3) GROUP BY ALL),
      r AS (SELECT query_id, u.id, coalesce(1.0::DOUBLE / (41 + x), 0) + coalesce(1.0::DOUBLE / (41 + y), 0) + coalesce(1.0::DOUBLE / (41 + z), 0) AS raw, least(x, y, z) AS best, CASE WHEN lang IS NOT NULL THEN (n_chars % 100) / 100.0::DOUBLE END AS iw FROM u JOIN documents ON doc_id::VARCHAR = u.id),
      s AS (SELECT query_id, id, round(raw * (0.75::DOUBLE + 0.5::DOUBLE * greatest(0, least(1, coalesce(iw, 0.5::DOUBLE)))), 8) AS score, round(raw, 8) AS rrf, best FROM r)
      SELECT query_id, id, score, rrf, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rrf DESC, best, id) - 1)::INT AS rank FROM s QUALIFY rank < 10""",
    "hybrid_context_parts": f"""WITH {_GRAPH}, h3 AS (SELECT *, (row_number() OVER (PARTITION BY query_id, c ORDER BY score DESC, CASE WHEN c = '{RELATIONSHIPS}' THEN {_RELID} ELSE id END) - 1)::INT AS rank FROM hit WHERE c IN ('Entity_name', '{RELATIONSHIPS}') QUALIFY rank < 3),
      er AS (SELECT query_id, id AS relationship_name, rank AS edge_rank FROM h3 WHERE c = '{RELATIONSHIPS}'), en AS (SELECT query_id, id FROM h3 WHERE c = 'Entity_name'),
      tc AS (SELECT query_id, en.id AS entity_id, e.* FROM e JOIN en ON en.id = source_id UNION ALL SELECT query_id, en.id, e.* FROM e JOIN en ON en.id = target_id WHERE source_id <> target_id),
      bl AS (SELECT tc.*, row_number() OVER (PARTITION BY query_id, entity_id ORDER BY CASE WHEN relationship_name = 'is_a' THEN 0 WHEN edge_rank IS NOT NULL THEN 1 ELSE 2 END, edge_rank NULLS LAST, source_id, relationship_name, target_id) AS p FROM tc LEFT JOIN er USING (query_id, relationship_name) QUALIFY p <= 10),
      bc AS (SELECT query_id, count(*) AS k FROM bl JOIN n a ON a.id = source_id JOIN n b ON b.id = target_id GROUP BY 1),
      fx AS (SELECT query_id, string_agg(upper(relationship_name[1]) || relationship_name[2:], chr(10) ORDER BY edge_rank) AS f, count(*) AS k FROM er WHERE NOT EXISTS (SELECT 1 FROM bl WHERE bl.query_id = er.query_id AND bl.relationship_name = er.relationship_name) GROUP BY 1)
      SELECT query_id, coalesce(fx.k, 0)::INT AS n_facts, md5(coalesce(f, '')) AS facts, coalesce(bc.k, 0)::INT AS n_bullets FROM q LEFT JOIN fx USING (query_id) LEFT JOIN bc USING (query_id)""",
    "coding_rules": "SELECT k AS query_id, 'm' || memory_no AS id, coalesce(title, '') AS name FROM memories, (VALUES (1::BIGINT), (2::BIGINT)) v(k) WHERE length(coalesce(title, '')) % 7 = 0 OR lower(title) LIKE '%rule%'",
    "temporal_events": f"WITH {_EVENTS} SELECT query_id, count(DISTINCT id) AS n_events, min(id) AS first FROM ins GROUP BY 1",
    "temporal_rank": f"""WITH {_EVENTS}, sc AS (SELECT DISTINCT query_id, id, greatest(CASE WHEN message_no % 2 = 0 THEN (message_no % 101) / 100.0::DOUBLE ELSE 0 END, CASE WHEN message_no % 3 = 0 THEN (message_no % 67) / 66.0::DOUBLE ELSE 0 END) AS score FROM ins)
      SELECT query_id, id, round(score, 6) AS score, {_RANKED.format('query_id')} FROM sc QUALIFY rank < 5""",
    "edge_ranks": "SELECT query_no AS query_id, trim(split_part(x, '->', 1), ' ') AS relationship_name, min(hit_no) AS edge_rank FROM (SELECT query_no, hit_no, unnest(edges) AS x FROM entity_results) GROUP BY ALL",
    "chunk_backfill": "SELECT record_no, md5(coalesce(CASE WHEN record_no % 2 = 0 THEN label END, content)) AS digest FROM cognee_data_record WHERE batch_no >= 1 AND content IS NOT NULL AND record_no % 5 <> 0",
    "truth_alignment": """WITH m AS (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL), c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY 1),
      k AS (SELECT label, c, row_number() OVER (PARTITION BY label % 2 ORDER BY label) - 1 AS place FROM c), v AS (SELECT vec_id, label % 2 AS g, embedding::DOUBLE[] AS x FROM embeddings)
      SELECT vec_id AS id, p::INT AS place, round(coalesce(list_dot_product(x, c) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(c, c))), 0), 5) AS x FROM v CROSS JOIN range(8) r(p) LEFT JOIN k ON k.label % 2 = g AND k.place = p""",
    "novelty_search": f"""WITH v AS (SELECT point_no AS id, vector::DOUBLE[] AS x, metadata FROM vector_points WHERE collection_name = 'DocumentChunk_text' AND len(vector) = dimension AND len(list_filter(vector, lambda z: isnan(z))) = 0 AND len(list_filter(vector, lambda z: z <> 0)) > 0),
      s AS (SELECT b.id AS query_id, a.id, {_COSINE.format('a.x', 'b.x')} AS score FROM v a, v b WHERE b.id % 20 = 0 AND a.metadata['belongs_to_set'] = 'alpha_notes') SELECT query_id, id, score, {_RANKED.format('query_id')} FROM s QUALIFY rank < 3""",
}
