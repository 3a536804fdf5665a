"""Search types: each is a plan ``(tables, queries, params) -> DataFrame``; and the queries that exercise them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.functions import ids, score, text, vector
from mnemoframe.functions.fixed import TOP_K, WIDE_K
from mnemoframe.operators import context, cypher, graph, improve, ontology, ranking, records, router, visual
from mnemoframe.plans.ranking import tokens_sql
from mnemoframe.session import hinted, materialize, table


#: Collection whose hits are distances of relationships, not of nodes.
RELATIONSHIPS = "EdgeType_relationship_name"


@dataclass
class Tables:
    """What retrieval reads.  ``vectors`` is ``(collection, id, vector)``; queries are ``(query_id, text, vector)``.

    The id of a relationship's point is that of ``records.index_rows``.
    ``payload`` is ``(collection, id, text, source_chunk_id)``: the texts of the
    points, and for summaries the chunk that they sum up.  A column
    ``importance_weight`` of the nodes, if there is one, weighs chunks.
    """

    nodes: DataFrame
    edges: DataFrame
    vectors: DataFrame
    messages: DataFrame | None = None
    payload: DataFrame | None = None


@dataclass
class Params:
    top_k: int = TOP_K
    wide_k: int = WIDE_K
    collections: tuple[str, ...] = ("Entity_name", "TextSummary_text", "EntityType_name", "DocumentChunk_text", RELATIONSHIPS, "Triplet_text")
    answer: Callable | None = None  # a column function (question, context) -> answer; without it the prompt is returned
    template: str = "Question: {question}\nContext: {context}"
    # validate(question, answer, context) -> true if the answer will do; follow_up(question, answer, context) -> next question
    validate: Callable | None = None
    follow_up: Callable | None = None
    extra: dict = field(default_factory=dict)


def _collection(name: str):
    def search(t: Tables, queries: DataFrame, p: Params) -> DataFrame:
        found = ranking.nearest(t.vectors.filter(F.col("collection") == name), queries, p.top_k)
        if t.payload is None:
            return found
        return found.join(t.payload.filter(F.col("collection") == name).select("id", "text"), "id", "left").select("query_id", "id", "score", "rank", "text")

    return search


def chunks_lexical(t: Tables, queries: DataFrame, p: Params) -> DataFrame:
    return ranking.lexical(t.nodes.filter("type = 'DocumentChunk'").select("id", "text"), queries, p.top_k)


def graph_completion(t: Tables, queries: DataFrame, p: Params) -> DataFrame:
    """Triplet search for every query: the ``wide_k`` best hits of each collection, smallest distance per point, three distances per edge."""
    hits = materialize(ranking.nearest(t.vectors.filter(F.col("collection").isin(*p.collections)), queries, p.wide_k, by=("collection",)), "hits")
    near = hits.filter(F.col("collection") != RELATIONSHIPS).groupBy("query_id", "id").agg((1 - F.max("score")).alias("d"))
    ways = t.edges.select("source_id", "relationship_name", "target_id")
    touched = ways.join(hinted(near.select("query_id", F.col("id").alias("source_id"), F.col("d").alias("s"))), "source_id").select("query_id", *ways.columns, "s", F.lit(None).cast("double").alias("t"))
    touched = touched.unionByName(ways.join(hinted(near.select("query_id", F.col("id").alias("target_id"), F.col("d").alias("t"))), "target_id").select("query_id", *ways.columns, F.lit(None).cast("double").alias("s"), "t"))
    merged = touched.groupBy("query_id", *ways.columns).agg(F.min("s").alias("s"), F.min("t").alias("t"))
    names = t.edges.select("relationship_name").distinct().withColumn("id", ids.data_point_id("EdgeType", F.col("relationship_name")))
    kinds = hits.filter(F.col("collection") == RELATIONSHIPS).join(names, "id").groupBy("query_id", "relationship_name").agg((1 - F.max("score")).alias("e"))
    scored = merged.join(hinted(kinds), ["query_id", "relationship_name"], "left").withColumn("score", F.round(score.triplet_distance(F.col("s"), F.col("t"), F.col("e")), 6))
    return ranking.top_k(scored, ["query_id"], p.top_k, F.asc("score"), F.asc("source_id"), F.asc("relationship_name"), F.asc("target_id")).select("query_id", *ways.columns, "score", "rank")


def chunk_lanes(t: Tables, queries: DataFrame, p: Params) -> dict[str, DataFrame]:
    """Lexical, vector and summary lanes, all by chunk: a summary's hit counts for its source chunk, the first one of a chunk.

    Summaries without a source chunk, and those whose chunk is gone, take no part.
    """
    chunks = t.nodes.filter("type = 'DocumentChunk'").select("id", "text")
    wide = Params(top_k=2 * p.top_k)
    summaries = ranking.nearest(t.vectors.filter("collection = 'TextSummary_text'"), queries, p.top_k)
    payload = t.payload if t.payload is not None else t.nodes.select(F.lit("").alias("collection"), "id", F.lit(None).cast("string").alias("source_chunk_id")).filter("false")
    source = payload.filter("collection = 'TextSummary_text' and source_chunk_id is not null").select("id", "source_chunk_id")
    of_chunk = summaries.join(source, "id").groupBy("query_id", F.col("source_chunk_id").alias("id")).agg(F.min("rank").alias("rank"))
    kept = context.backfill(of_chunk.withColumn("text", F.lit(None).cast("string")), chunks).select("query_id", "id", "rank")
    near = ranking.nearest(t.vectors.filter("collection = 'DocumentChunk_text'"), queries, wide.top_k)
    return {"bm25": ranking.bm25(chunks, queries, wide.top_k), "vector": near, "summary": kept}


def hybrid(t: Tables, queries: DataFrame, p: Params) -> DataFrame:
    """Three lanes of chunks fused by reciprocal rank, weighed by importance."""
    chunks = t.nodes.filter("type = 'DocumentChunk'")
    weights = chunks.select("id", "importance_weight") if "importance_weight" in t.nodes.columns else chunks.select("id", F.lit(None).cast("double").alias("importance_weight"))
    return ranking.fuse(chunk_lanes(t, queries, p), p.top_k, weights)


def hybrid_context(t: Tables, queries: DataFrame, p: Params) -> DataFrame:
    """``(query_id, passages, entities, facts)``: what a hybrid completion shows, each part one line an item.

    Entities are the nearest ones with their edges, facts the nearest
    relationships that no entity shows.
    """
    lines = lambda df, order, line: df.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("l")))), lambda x: x["l"]), "\n").alias("lines"))
    texts = t.nodes.select("id", "text")
    passages = lines(hybrid(t, queries, p).join(texts, "id"), F.col("rank"), F.coalesce("text", F.lit("")))
    hits = materialize(ranking.nearest(t.vectors.filter(F.col("collection").isin("Entity_name", RELATIONSHIPS)), queries, p.top_k, by=("collection",)), "hits")
    kinds = t.edges.select("relationship_name").distinct().withColumn("id", ids.data_point_id("EdgeType", F.col("relationship_name")))
    ranked = context.edge_ranks(hits.join(kinds, "id").select("query_id", "relationship_name", "rank"))
    entities = hits.filter("collection = 'Entity_name'")
    bullets = materialize(context.entity_bullets(t.nodes, t.edges, entities, ranked), "bullets")
    shown = lines(bullets.join(entities.select("query_id", F.col("id").alias("entity_id"), "rank"), ["query_id", "entity_id"]), F.struct("rank", "place"), F.col("bullet"))
    rest = ranked.join(bullets.select("query_id", "relationship_name").distinct(), ["query_id", "relationship_name"], "left_anti")
    facts = lines(rest, F.col("edge_rank"), text.fact_display(F.col("relationship_name")))
    out = queries.select("query_id")
    for name, part in (("passages", passages), ("entities", shown), ("facts", facts)):
        out = out.join(part.withColumnRenamed("lines", name), "query_id", "left").withColumn(name, F.coalesce(name, F.lit("")))
    return out


def events_inside(nodes: DataFrame, edges: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, id)``: events at timestamps inside each query's interval ``(low_ms, high_ms)``, directly or through an interval node."""
    stamps = nodes.filter("type = 'Timestamp'").select(F.col("id").alias("stamp"), "time_at")
    inside = hinted(queries.select("query_id", "low_ms", "high_ms")).join(stamps, (F.col("low_ms").isNull() | (F.col("time_at") >= F.col("low_ms"))) & (F.col("high_ms").isNull() | (F.col("time_at") <= F.col("high_ms"))))
    ways = graph.both_ways(edges)
    kinds = nodes.select(F.col("id").alias("other"), "type")
    first = inside.join(ways, F.col("stamp") == F.col("id")).join(kinds, "other").select("query_id", F.col("other").alias("id"), "type")
    through = first.filter("type = 'Interval'").select("query_id", "id").join(ways, "id").join(kinds, "other").filter("type = 'Event'").select("query_id", F.col("other").alias("id"))
    return first.filter("type = 'Event'").select("query_id", "id").unionByName(through).distinct()


def rank_events(events: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """The first ``k`` events ``(query_id, id)`` by the largest of their scores ``(query_id, id, score)``, 0 without any."""
    best = scores.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return ranking.top_k(events.join(best, ["query_id", "id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0))), ["query_id"], k, F.desc("score"), F.asc("id"))


def temporal(t: Tables, queries: DataFrame, p: Params) -> DataFrame:
    """Events at the timestamps inside each query's interval ``(low_ms, high_ms)``, directly or through an interval node.

    Scores are the largest of those of touching triplets and of the event's own
    name, 0 without any, however different their scales.
    """
    events = events_inside(t.nodes, t.edges, queries)
    edges = graph_completion(t, queries, Params(top_k=p.wide_k, collections=p.collections))
    touch = edges.select("query_id", F.explode(F.array("source_id", "target_id")).alias("id"), "score")
    own = ranking.nearest(t.vectors.filter("collection = 'Event_name'"), queries, p.wide_k).select("query_id", "id", "score")
    return rank_events(events, touch.unionByName(own), p.top_k)


def coding_rules(t: Tables, queries: DataFrame, p: Params) -> DataFrame:
    rules = t.nodes.filter(F.exists(F.array("type", "name"), lambda x: F.contains(F.lower(x), F.lit("rule")))).select("id", "name", "text")
    return hinted(queries.select("query_id")).crossJoin(rules)  # every rule is for every query


def context_text(t: Tables, found: DataFrame) -> DataFrame:
    """``(query_id, context)``: the texts of the hits, or the edges with their nodes' names, in the order of their ranks; hits without text are left out."""
    if "relationship_name" in found.columns:
        return context.edges_text(found, t.nodes).withColumnRenamed("text", "context")
    shown = found if "text" in found.columns else found.join(t.nodes.select("id", "text"), "id", "left")
    # top_k rows a query
    return shown.filter("text is not null").groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda s: s["text"]), "\n").alias("context"))


def completion(search: Callable) -> Callable:
    """A search type whose context is answered by ``params.answer``, or returned as a prompt."""

    def run(t: Tables, queries: DataFrame, p: Params) -> DataFrame:
        joined = context_text(t, search(t, queries, p))
        asked = queries.select("query_id", F.col("text").alias("question")).join(joined, "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
        prompt = text.render_prompt(F.lit(p.template), F.col("question"), F.col("context"))
        return asked.select("query_id", (p.answer(F.col("question"), F.col("context")) if p.answer else prompt).alias("answer"), "context")

    return run


def _merged(before: DataFrame | None, found: DataFrame) -> DataFrame:
    """Hits of all rounds, each once, in the order in which they came."""
    keys = [c for c in ("source_id", "relationship_name", "target_id", "id") if c in found.columns]
    both = found if before is None else before.unionByName(found)
    kept = graph.keep_last(both, ["query_id", *keys], F.asc("round"), F.asc("rank"))
    return materialize(kept, "rounds")


def rounds(search: Callable, most: int = 4) -> Callable:
    """Up to ``most`` rounds: each answer is the next question; contexts merge; ends when nothing is new."""

    def run(t: Tables, queries: DataFrame, p: Params) -> DataFrame:
        asked, merged, size = queries, None, -1
        for n in range(most):
            merged = _merged(merged, search(t, asked, p).withColumn("round", F.lit(n)))
            if p.answer is None or merged.count() == size:
                break
            size = merged.count()
            answers = completion(lambda *_: merged)(t, queries, p)
            asked = queries.drop("text").join(answers.select("query_id", F.col("answer").alias("text")), "query_id")
        return merged

    return run


def reasoned(search: Callable, most: int = 4) -> Callable:
    """Up to ``most`` rounds: an answer that ``params.validate`` refuses leads to the question that ``params.follow_up`` asks; its hits are added."""

    def run(t: Tables, queries: DataFrame, p: Params) -> DataFrame:
        asked, merged = queries, None
        for n in range(most):
            merged = _merged(merged, search(t, asked, p).withColumn("round", F.lit(n)))
            if not (p.answer and p.validate and p.follow_up) or n == most - 1:
                break
            answers = completion(lambda *_: merged)(t, queries, p).join(queries.select("query_id", F.col("text").alias("question")), "query_id")
            said = (F.col("question"), F.col("answer"), F.col("context"))
            open_ = materialize(answers.filter(~F.coalesce(p.validate(*said), F.lit(False))).select("query_id", p.follow_up(*said).alias("text")), "open")
            if open_.isEmpty():
                break
            asked = queries.drop("text").join(open_, "query_id")
        return merged

    return run


def feeling_lucky(t: Tables, queries: DataFrame, p: Params) -> DataFrame:
    """Each query by the search type that the router chooses; types that are not here fall back to chunks."""
    routed = materialize(router.route(queries.select("query_id", "text")).select("query_id", "target"), "routed")
    out = None
    for kind in sorted(r.target for r in routed.select("target").distinct().collect()):  # at most as many as there are types
        plan = SEARCH_TYPES.get(kind, SEARCH_TYPES["Chunks"])
        found = plan(t, queries.join(routed.filter(F.col("target") == kind).select("query_id"), "query_id", "left_semi"), p).withColumn("search_type", F.lit(kind))
        out = found if out is None else out.unionByName(found, allowMissingColumns=True)
    return out if out is not None else SEARCH_TYPES["Chunks"](t, queries, p).withColumn("search_type", F.lit("Chunks"))


def natural_language(spark: SparkSession, t: Tables, question: str, write_query: Callable[[str, str | None], str], attempts: int = 3) -> DataFrame:
    """A question as a reading query that ``write_query(question, last error)`` writes; failed attempts are told to it."""
    error = None
    for _ in range(attempts):
        try:
            found = raw_query(spark, t, write_query(question, error))
            found.schema  # noqa: B018 - analysis finds what is wrong with the query
            return found
        except Exception as e:  # noqa: BLE001 - whatever went wrong goes back to the writer
            error = str(e).split("\n")[0]
    raise ValueError(f"no query after {attempts} attempts: {error}")


def store_feedback(interactions: DataFrame, feedback_id: str, content: str, rating: int, last: int = 5) -> tuple[DataFrame, DataFrame]:
    """Feedback node and its edges to the latest interactions ``(id, at)``, those without a time last."""
    spark = interactions.sparkSession
    node = spark.createDataFrame([(feedback_id, content, "Feedback", rating)], "id string, name string, type string, feedback_score int")
    recent = interactions.orderBy(F.desc_nulls_last("at"), "id").limit(last)
    return node, recent.select(F.lit(feedback_id).alias("source_id"), F.col("id").alias("target_id"), F.lit("gives_feedback_to").alias("relationship_name"))


SEARCH_TYPES: dict[str, Callable[[Tables, DataFrame, Params], DataFrame]] = {
    "Chunks": _collection("DocumentChunk_text"),
    "Summaries": _collection("TextSummary_text"),
    "TripletCompletion": completion(_collection("Triplet_text")),
    "RagCompletion": completion(_collection("DocumentChunk_text")),
    "ChunksLexical": chunks_lexical,
    "GraphCompletion": graph_completion,
    "GraphSummaryCompletion": completion(graph_completion),
    "GraphCompletionContextExtension": rounds(graph_completion),
    "GraphCompletionCot": reasoned(graph_completion),
    "HybridCompletion": hybrid,
    "Temporal": temporal,
    "CodingRules": coding_rules,
    "FeelingLucky": feeling_lucky,
}


def register(name: str, plan: Callable) -> None:
    """A named retriever; it replaces a search type of that name."""
    SEARCH_TYPES[name] = plan


def search(t: Tables, queries: DataFrame, kind: str = "GraphCompletion", params: Params | None = None) -> DataFrame:
    return SEARCH_TYPES[kind](t, queries, params or Params())


def raw_query(spark: SparkSession, t: Tables, sql: str) -> DataFrame:
    """A reading query over ``nodes`` and ``edges``: SQL over views of these names, or the Cypher subset of ``operators/cypher``."""
    if sql.lstrip().lower().startswith("match"):
        return cypher.query(t.nodes, t.edges, sql)
    if not sql.lstrip().lower().startswith(("select", "with")):
        raise ValueError("only reading queries are allowed")
    t.nodes.createOrReplaceTempView("nodes")
    t.edges.createOrReplaceTempView("edges")
    return spark.sql(sql)


def tables_of(spark: SparkSession, sf: str) -> Tables:
    """Graph tables and vectors of the driver's data; point numbers stand for node ids in the order of both."""
    nodes = table(spark, sf, "graph_node").select("id", "name", "type", F.get_json_object("properties", "$.text").alias("text"))
    edges = table(spark, sf, "graph_edge").select("source_id", "target_id", "relationship_name").distinct()
    good = F.col("vector").isNotNull() & (F.size("vector") == F.col("dimension")) & ~F.exists("vector", lambda x: F.isnan(x)) & F.exists("vector", lambda x: x != 0)
    points = table(spark, sf, "vector_points").filter(good).select(F.col("collection_name").alias("collection"), F.col("point_no").cast("string").alias("id"), "vector")
    return Tables(nodes, edges, points)


def _asked(t: Tables) -> DataFrame:
    """A query per collection of summaries: its first vectors, by a fixed property of their ids."""
    return t.vectors.filter("collection = 'TextSummary_text' and cast(id as long) % 20 = 0").select(F.col("id").alias("query_id"), F.lit("x").alias("text"), "vector")


def search_chunks(spark, sf):
    t = tables_of(spark, sf)
    return search(t, _asked(t), "Chunks")


def lexical_chunks(spark, sf):
    t = tables_of(spark, sf)
    q = table(spark, sf, "eval_items").select(F.col("item_id").alias("query_id"), "text")
    return search(t, q, "ChunksLexical")


def graph_triplet_ranking(spark, sf):
    """Triplet search with made-up vectors: nodes, relationships, triplets and queries embedded offline by their texts."""
    t = tables_of(spark, sf)
    shown = F.coalesce(F.nullif("name", F.lit("")), "text")
    kind = F.when(F.col("type") == "Entity", "Entity_name").when(F.col("type") == "TextSummary", "TextSummary_text").when(F.col("type") == "EntityType", "EntityType_name").otherwise("DocumentChunk_text")
    embedded = t.nodes.select(kind.alias("collection"), "id", vector.deterministic_vector(shown, 8).alias("vector")).filter("vector is not null")
    relationships = records.index_rows(t.nodes.filter("false"), t.edges, lambda x: vector.deterministic_vector(x, 8))
    triplets = improve.memify(t.nodes.select("id", shown.alias("text")), t.edges, 8).withColumn("collection", F.lit("Triplet_text"))
    embedded = embedded.unionByName(relationships.select(*embedded.columns)).unionByName(triplets.select(*embedded.columns))
    q = table(spark, sf, "eval_items").select(F.col("item_id").alias("query_id"), "text", vector.deterministic_vector(F.col("text"), 8).alias("vector"))
    return search(Tables(t.nodes, t.edges, embedded), q, "GraphCompletion")


def deterministic_embedding(spark, sf):
    m = table(spark, sf, "memories").filter("content is not null")
    return m.select("memory_no", F.array_join(F.transform(vector.deterministic_vector(F.col("content"), 8), lambda x: F.format_number(x.cast("double"), 5)), ",").alias("vector"))


def truth_centroids(spark, sf):
    """Centroids of the label groups: every vector is a learning."""
    e = table(spark, sf, "embeddings").select(F.concat(F.lit("label "), F.col("label") % 4).alias("dataset_id"), F.col("vec_id").alias("seq"), F.concat(F.lit("Statement "), F.col("vec_id")).alias("statement"), F.col("embedding").alias("vector"))
    return improve.truth_centroids(e).select("dataset_id", "slot", "count", F.size("learning_ids").alias("learnings"), F.round(vector.norm(F.col("centroid")), 6).alias("norm"))


def feedback_weights(spark, sf):
    """Weights of the entities that searches used, from made-up scores of each search."""
    e = table(spark, sf, "entity_results").filter("edges is not null")
    entries = e.select(F.col("id").alias("entry_id"), F.col("query_no").alias("seq"), (F.col("query_no") % 7).cast("int").alias("feedback_score"), F.col("edges").alias("node_ids"), F.array().cast("array<string>").alias("edge_ids"), F.lit(False).alias("applied"))
    known = e.select(F.explode("edges").alias("id")).distinct().filter(~F.col("id").startswith("knows")).withColumn("weight", F.lit(0.5))
    return improve.apply_feedback(known, entries)[0]


def memify_triplets(spark, sf):
    t = tables_of(spark, sf)
    nodes = t.nodes.select("id", F.coalesce(F.nullif("name", F.lit("")), "text").alias("text"))
    return improve.memify(nodes, t.edges).select("id", F.md5("text").alias("digest"), F.size("vector").alias("dimensions"))


def gestalt_match(spark, sf):
    """Entity names of searches against the names of the graph's organisations."""
    n = table(spark, sf, "graph_node").filter("type = 'Entity' and get_json_object(properties, '$.is_a') = 'organization'").groupBy(F.col("name").alias("candidate")).agg(F.min("id").alias("seq"))
    names = table(spark, sf, "entity_results").filter("entity_type = 'organization'").select("name").distinct()
    return ontology.closest(names, n).select("name", "candidate", F.round("similarity", 6).alias("similarity"))


def visual_nodes(spark, sf):
    t = tables_of(spark, sf)
    nodes, _ = visual.preprocess(t.nodes, t.edges)
    return visual.labelled(nodes).groupBy("stage").agg(F.count("*").alias("labelled"), F.max("importance").alias("most"))


def visual_timeline(spark, sf):
    n = table(spark, sf, "graph_node").select("id", F.unix_millis(F.col("created_at").cast("timestamp")).alias("t_created"))
    return visual.timeline(n, 6 * 3_600_000)


def graph_expansion(spark, sf):
    """Graphs extracted from search results (name, type and named edges), expanded into entities and types."""
    e = table(spark, sf, "entity_results").filter("edges is not null and name <> ''")
    node = lambda i, n, k: F.struct(i.alias("id"), n.alias("name"), k.alias("type"), F.lit(None).cast("string").alias("description"))
    ends = F.transform("edges", lambda x: F.trim(F.split(x, "->")[1]))
    extracted = e.select(
        F.concat(F.lpad(F.col("query_no").cast("string"), 12, "0"), F.lpad(F.col("hit_no").cast("string"), 6, "0"), F.col("id")).alias("chunk_no"),
        F.concat(F.array(node(F.col("name"), F.col("name"), F.coalesce("entity_type", F.lit("thing")))), F.transform(ends, lambda x: node(x, x, F.lit("place")))).alias("nodes"),
        F.transform("edges", lambda x: F.struct(F.col("name").alias("source_node_id"), F.trim(F.split(x, "->")[1]).alias("target_node_id"), F.trim(F.split(x, "->")[0]).alias("relationship_name"))).alias("edges"),
    )
    nodes, edges = graph.expand(extracted)
    return nodes.groupBy(F.col("type").alias("kind")).agg(F.count("*").alias("n")).unionByName(edges.groupBy(F.col("relationship_name").alias("kind")).agg(F.count("*").alias("n")))


QUERIES = {
    f.__name__: f
    for f in (search_chunks, lexical_chunks, graph_triplet_ranking, deterministic_embedding, truth_centroids, feedback_weights, memify_triplets, gestalt_match, visual_nodes, visual_timeline, graph_expansion)
}

_V = "v AS (SELECT collection_name AS c, point_no::VARCHAR AS id, vector::DOUBLE[] AS x FROM vector_points WHERE len(vector) = dimension AND len(list_filter(vector, lambda z: isnan(z))) = 0 AND len(list_filter(vector, lambda z: z <> 0)) > 0)"
_TEXT = "coalesce(nullif(name, ''), json_extract_string(properties, '$.text'))"
_E = "e AS (SELECT DISTINCT source_id, target_id, relationship_name FROM graph_edge)"
_KEY = "replace(replace(lower({0}), ' ', '_'), '''', '')"
ORACLE = {
    "lexical_chunks": f"""WITH q AS (SELECT DISTINCT item_id AS query_id, unnest({tokens_sql('text')}) AS token FROM eval_items), d AS (SELECT DISTINCT id, unnest({tokens_sql("json_extract_string(properties, '$.text')")}) AS token FROM graph_node WHERE type = 'DocumentChunk'),
      c AS (SELECT query_id, id, count(*) AS k FROM q JOIN d USING (token) GROUP BY ALL), s AS (SELECT query_id, id, round(coalesce(k, 0) / (m + n - coalesce(k, 0)), 6) AS score FROM (SELECT query_id, count(*) AS m FROM q GROUP BY 1) CROSS JOIN (SELECT id, count(*) AS n FROM d GROUP BY 1) LEFT JOIN c USING (query_id, id))
      SELECT query_id, id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1)::INT AS rank FROM s QUALIFY rank < 10""",
    "memify_triplets": f"WITH {_E}, n AS (SELECT id, {_TEXT} AS text FROM graph_node) SELECT {ids.uuid5_sql(_KEY.format('source_id || relationship_name || target_id'))} AS id, md5(a.text || '-›' || relationship_name || '-›' || b.text) AS digest, 32::INT AS dimensions FROM e JOIN n a ON a.id = source_id JOIN n b ON b.id = target_id WHERE a.text IS NOT NULL AND b.text IS NOT NULL",
    "search_chunks": f"WITH {_V}, s AS (SELECT q.id AS query_id, a.id, round(list_dot_product(a.x, q.x) / greatest(sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(q.x, q.x)), 1.1920929e-07), 6) AS score FROM v a, v q WHERE a.c = 'DocumentChunk_text' AND q.c = 'TextSummary_text' AND q.id::BIGINT % 20 = 0) SELECT query_id, id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1)::INT AS rank FROM s QUALIFY rank < 10",
    "feedback_weights": """WITH RECURSIVE k AS (SELECT DISTINCT x AS id FROM (SELECT unnest(edges) AS x FROM entity_results) WHERE NOT starts_with(x, 'knows')),
      r0 AS (SELECT DISTINCT r.id AS entry, query_no, unnest(edges) AS id FROM entity_results r WHERE query_no % 7 BETWEEN 1 AND 5),
      r AS (SELECT id, ((query_no % 7) - 1) / 4.0::DOUBLE AS rating, row_number() OVER (PARTITION BY id ORDER BY query_no, entry) AS i FROM r0),
      f AS (SELECT id, 0::BIGINT AS i, 0.5::DOUBLE AS weight FROM k UNION ALL SELECT f.id, r.i, floor(greatest(0, least(1, weight + 0.1::DOUBLE * (rating - weight))) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE FROM f JOIN r ON r.id = f.id AND r.i = f.i + 1)
      SELECT id, arg_max(weight, i) AS weight FROM f GROUP BY id""",
    "visual_timeline": "WITH a AS (SELECT id, floor(epoch_us(created_at) / 1000)::BIGINT AS t, lag(floor(epoch_us(created_at) / 1000)::BIGINT) OVER (ORDER BY floor(epoch_us(created_at) / 1000)::BIGINT, id) AS p FROM graph_node), b AS (SELECT *, sum(CASE WHEN t - p > 21600000 THEN 1 ELSE 0 END) OVER (ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS cluster FROM a) SELECT cluster::BIGINT AS cluster, min(t) AS t0, max(t) AS t1, count(*) AS n FROM b GROUP BY cluster",
    "visual_nodes": f"""WITH {_E}, d AS (SELECT id, count(*) AS g FROM (SELECT source_id AS id FROM e UNION ALL SELECT target_id FROM e) GROUP BY id), n AS (SELECT id, CASE type WHEN 'DocumentChunk' THEN 'chunk' WHEN 'TextSummary' THEN 'summary' WHEN 'Entity' THEN 'entity' ELSE 'other' END AS stage, coalesce(g, 0) AS g FROM graph_node LEFT JOIN d USING (id)),
      i AS (SELECT stage, round(ln(1 + g) / ln(1 + greatest((SELECT max(g) FROM n), 1)), 6) AS importance FROM n), t AS (SELECT importance AS th FROM (SELECT importance, row_number() OVER (ORDER BY importance) AS k, count(*) OVER () AS c FROM i) WHERE k = floor(0.75 * (c - 1)) + 1)
      SELECT stage, count(*) AS labelled, max(importance) AS most FROM i, t WHERE th > 0 AND importance >= th GROUP BY stage""",
    "graph_expansion": f"""WITH r AS (SELECT lpad(query_no::VARCHAR, 12, '0') || lpad(hit_no::VARCHAR, 6, '0') || id AS o, name, coalesce(entity_type, 'thing') AS type, edges FROM entity_results WHERE edges IS NOT NULL AND name <> ''),
      x AS (SELECT o, name, unnest(edges) AS x FROM r), y AS (SELECT o, name, trim(split_part(x, '->', 1), ' ') AS rel, trim(split_part(x, '->', 2), ' ') AS t FROM x),
      nn AS (SELECT o, 0 AS p, {_KEY.format('name')} AS k, {_KEY.format('type')} AS ty FROM r UNION ALL SELECT o, 1, {_KEY.format('t')}, 'place' FROM y),
      f AS (SELECT k, arg_min(ty, (o, p)) AS ty FROM nn GROUP BY k),
      g AS (SELECT DISTINCT {_KEY.format('name')} AS s, {_KEY.format('t')} AS t, {_KEY.format('rel')} AS rel FROM y),
      a AS (SELECT s, t, rel FROM g UNION SELECT k, 'type:' || ty, 'is_a' FROM f)
      SELECT 'Entity' AS kind, count(*) AS n FROM f UNION ALL SELECT 'EntityType', count(DISTINCT ty) FROM nn UNION ALL SELECT rel, count(*) FROM a GROUP BY rel""",
}
