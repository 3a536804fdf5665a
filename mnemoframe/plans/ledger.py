"""Queries: sessions, cost, datasets, provenance, deletion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoframe.functions import ids, jsonx, score, text
from mnemoframe.functions.fixed import STOP_WORDS
from mnemoframe.functions.ids import uuid5_sql
from mnemoframe.operators import graph, improve, ledger, visual
from mnemoframe.session import table


def _sessions(spark, sf) -> DataFrame:
    """Sessions from the event stream: one per user and day."""
    e = table(spark, sf, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    s = e.groupBy(F.concat_ws("/", F.col("user_id").cast("string"), day).alias("session_id"), F.col("user_id")).agg(
        F.min("ts").alias("started_at"),
        F.max("ts").alias("last_activity_at"),
        F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("ended_at"),
        F.count("*").alias("tokens_in"),
        F.sum("value").alias("cost_usd"),
        F.count_if(F.col("event_type") == "error").alias("errors"),
        F.count_if(F.col("event_type") == "purchase").alias("done"),
    )
    as_of = e.agg(F.max("ts").alias("as_of"))
    raw = F.when(F.col("errors") > F.col("tokens_in") / 2, "failed").when(F.col("done") > 0, "completed").otherwise("running")
    return s.crossJoin(F.broadcast(as_of)).withColumn("status", ledger.effective_status(raw, F.col("last_activity_at"), F.col("as_of"))).withColumn("dataset_id", F.concat(F.lit("d"), F.col("user_id") % 5))


def _usage(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    return e.groupBy(F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("session_id"), "user_id", F.nullif("event_type", F.lit("view")).alias("model")).agg(F.count("*").alias("tokens_in"), F.sum("value").alias("cost_usd"))


def session_totals(spark, sf):
    return ledger.totals(_sessions(spark, sf))


def session_visible(spark, sf):
    s = ledger.visible(_sessions(spark, sf), F.lit(7), ["d1", "d3"], F.lit("2024-01-02").cast("timestamp_ntz"))
    return s.groupBy("dataset_id").agg(F.count("*").alias("sessions"), F.count_distinct("user_id").alias("users"))


def session_status_buckets(spark, sf):
    return _sessions(spark, sf).groupBy("status").agg(F.count("*").alias("sessions"))


def session_duration(spark, sf):
    s = F.greatest(F.lit(0.0), ledger.seconds_between(F.col("started_at"), F.coalesce("ended_at", "last_activity_at")))
    return _sessions(spark, sf).groupBy("user_id").agg(F.round(F.sum(s), 3).alias("seconds"))


def cost_by_model(spark, sf):
    return ledger.cost_by_model(_usage(spark, sf), _sessions(spark, sf))


def session_page(spark, sf):
    s = _sessions(spark, sf).select("session_id", "user_id", "tokens_in", "started_at")
    return ledger.page(s, ["started_at", "tokens_in"], "no such column", "tokens_in", True, 10, 20, "session_id")


def usage_accumulation(spark, sf):
    """The usage doubled for sessions that still run."""
    usage = _usage(spark, sf)
    out = ledger.accumulate_usage(usage, usage, _sessions(spark, sf).filter("status = 'completed'"))
    return out.withColumn("cost_usd", F.round("cost_usd", 4))


def gap_sessions(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    c = ledger.gap_sessions(e, ["user_id"], "ms", "event_id", 3_600_000)
    return c.groupBy("user_id", "cluster").agg(F.min("ms").alias("t0"), F.max("ms").alias("t1"), F.count("*").alias("n"))


def modal_event(spark, sf):
    return ledger.modal(table(spark, sf, "events"), ["user_id"], "event_type")


def history_window(spark, sf):
    """The last ten messages of every session."""
    m = table(spark, sf, "messages").filter("content is not null")
    return ledger.last_n(m, ["session_id"], 10, F.desc("seq_no"), F.desc("message_no")).select("session_id", "message_no", "role")


def curator_batches(spark, sf):
    """Timelines of sessions cut into batches of six messages."""
    m = table(spark, sf, "messages").filter("content is not null").select("session_id", "message_no", "seq_no", "content")
    b = ledger.batches(m, ["session_id"], 6, F.asc("seq_no"), F.asc("message_no"))
    joined = F.transform(F.array_sort(F.collect_list(F.struct("place", "content"))), lambda s: s["content"])  # six at most
    return b.groupBy("session_id", "batch_no").agg(F.md5(F.array_join(joined, "\n\n")).alias("digest"), F.count("*").alias("n"))


def session_text(spark, sf):
    """Questions and answers of every session, joined in order."""
    m = table(spark, sf, "messages").filter("role in ('user', 'assistant') and content is not null")
    line = F.concat(F.initcap("role"), F.lit(": "), "content")
    return m.groupBy("session_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq_no", "message_no", line.alias("l")))), lambda s: s["l"]), "\n")).alias("digest"))


def session_pairs(spark, sf):
    """Each user message with the assistant's next one."""
    from pyspark.sql import Window

    w = Window.partitionBy("session_id").orderBy("seq_no", "message_no")
    m = table(spark, sf, "messages").filter("role in ('user', 'assistant')").withColumn("next_role", F.lead("role").over(w)).withColumn("answer_no", F.lead("message_no").over(w))
    return m.filter("role = 'user' and next_role = 'assistant'").select("session_id", F.col("message_no").alias("question_no"), "answer_no")


def latest_status(spark, sf):
    """Status of each owner's latest record: the gate of a pipeline run."""
    r = table(spark, sf, "cognee_data_record").filter("pipeline_status is not null")
    return r.groupBy("owner_id").agg(F.max_by("pipeline_status", F.struct("created_at", "record_no")).alias("status"), F.count_if(F.col("pipeline_status").isin("started", "completed")).alias("blocking"))


def loader_classify(spark, sf):
    r = table(spark, sf, "cognee_data_record")
    kind = F.when(jsonx.is_dlt(F.col("external_metadata")), F.lit("dlt_row")).otherwise(text.document_type(F.col("extension")))
    return r.select("record_no", text.loader_name(F.col("extension")).alias("loader"), kind.alias("document_type"), text.document_class(kind).alias("class_name")).filter("document_type is not null")


def content_hash_dedup(spark, sf):
    """Equal bytes of one owner are one data item, attached to every dataset that brought it."""
    r = table(spark, sf, "cognee_data_record").filter("content is not null")
    return r.groupBy("owner_id", F.md5("content").alias("content_hash")).agg(F.min("record_no").alias("first_no"), F.count("*").alias("copies"), F.count_distinct("add_no").alias("adds"))


def data_ids(spark, sf):
    r = table(spark, sf, "cognee_data_record").filter("content is not null and owner_id is not null")
    return r.select("record_no", ids.data_id(F.md5("content"), F.col("owner_id"), F.lit(None).cast("string")).alias("data_id"))


def _ledger(spark, sf) -> DataFrame:
    """Provenance of shared parts: orders are data items, priorities datasets, parts slugs."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("data_id"), F.col("o_orderpriority").alias("dataset_id"))
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("data_id"), F.col("l_partkey").alias("slug")).distinct()
    return items.join(o, "data_id")


def provenance_unique_nodes(spark, sf):
    return ledger.unique_to_data(_ledger(spark, sf), ["slug"]).select("data_id", "dataset_id", "slug")


def provenance_counts(spark, sf):
    return _ledger(spark, sf).groupBy("dataset_id").agg(F.count("*").alias("nodes"), F.count_distinct("data_id").alias("data"), F.count_distinct("slug").alias("slugs"))


def delete_preview(spark, sf):
    """What deleting each dataset's data would remove."""
    rows = _ledger(spark, sf)
    gone = ledger.unique_to_data(rows, ["slug"]).groupBy("dataset_id").agg(F.count("*").alias("unique_nodes"))
    return rows.groupBy("dataset_id").agg(F.count_distinct("data_id").alias("data")).join(gone, "dataset_id", "left").select("dataset_id", "data", F.coalesce("unique_nodes", F.lit(0)).alias("unique_nodes"))


def _links(spark, sf) -> DataFrame:
    a = table(spark, sf, "cognee_add_result").select("add_no", F.col("dataset_name").alias("dataset_id"))
    r = table(spark, sf, "cognee_data_record").filter("content is not null").select("add_no", F.md5("content").alias("data_id"))
    return r.join(a, "add_no").select("dataset_id", "data_id").distinct()


def delete_shared_protection(spark, sf):
    links = _links(spark, sf)
    return ledger.deletable(links, links.filter(F.col("dataset_id").rlike("^[a-m]")))


def delete_execute(spark, sf):
    """Links that are left after the data of some datasets was deleted."""
    links = _links(spark, sf)
    targets = links.filter(F.col("dataset_id").rlike("^[a-m]"))
    return links.join(targets, ["dataset_id", "data_id"], "left_anti").groupBy("dataset_id").agg(F.count("*").alias("links"))


def orphan_sweep(spark, sf):
    """Entities with a single edge and those with none, by type."""
    e = table(spark, sf, "graph_edge").select("source_id", "target_id", "relationship_name").distinct()
    n = table(spark, sf, "graph_node").select("id", "type").join(graph.degrees(e), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return n.groupBy("type").agg(F.count_if(F.col("degree") == 1).alias("degree_one"), F.count_if(F.col("degree") == 0).alias("alone"))


def dataset_scope(spark, sf):
    """Points split over the datasets that they belong to."""
    p = table(spark, sf, "vector_points").select("point_no", "collection_name", F.split(F.element_at("metadata", "dataset_ids"), ",").alias("dataset_ids"), F.lit("main").alias("dataset_id"))
    wanted = table(spark, sf, "cognee_add_result").select(F.col("dataset_name").alias("dataset_id")).distinct()
    return ledger.scope_rows(p, wanted).groupBy("dataset", "collection_name").agg(F.count("*").alias("points"))


def node_set_filter(spark, sf):
    """Points of two node sets: any of them, and all of them."""
    sets = F.split(F.coalesce(F.element_at("metadata", "belongs_to_set"), F.lit("")), ",")
    names = F.array(F.lit("alpha_notes"), F.lit("beta_notes"))
    p = table(spark, sf, "vector_points").select("collection_name", sets.alias("sets"))
    return p.groupBy("collection_name").agg(F.count_if(F.arrays_overlap("sets", names)).alias("any_of"), F.count_if(F.size(F.array_except(names, F.col("sets"))) == 0).alias("all_of"))


def merge_dedup_context(spark, sf):
    """Two context lists joined in order, first kept of every id, or of every text where there is no id."""
    e = table(spark, sf, "entity_results")
    left = e.filter("hit_no <= 2").select("query_no", F.col("hit_no").alias("seq"), "name", "description")
    right = e.select("query_no", (F.col("hit_no") + 1000).alias("seq"), "name", "description")
    both = left.unionByName(right).withColumn("key", F.coalesce("description", "name"))
    return both.groupBy("query_no", "key").agg(F.min("seq").alias("seq"))


def access_log(spark, sf):
    """When each entity name was last returned."""
    return table(spark, sf, "entity_results").groupBy("name").agg(F.max("found_at").alias("last_accessed"), F.count("*").alias("hits"))


def search_history(spark, sf):
    """Queries and results of every search in one timeline."""
    e = table(spark, sf, "entity_results")
    q = e.groupBy("query_no").agg(F.min("found_at").alias("at")).select("query_no", F.lit("query").alias("kind"), "at", F.lit(0).alias("hits"))
    r = e.groupBy("query_no").agg(F.max("found_at").alias("at"), F.count("*").cast("int").alias("hits")).select("query_no", F.lit("result").alias("kind"), "at", "hits")
    return q.unionByName(r)


def sync_edges_since(spark, sf):
    """The five hundred oldest edges behind the checkpoint."""
    e = table(spark, sf, "graph_edge").filter("created_at > timestamp_ntz'2026-03-01'")
    return e.orderBy("created_at", "source_id", "target_id", "relationship_name").limit(500).select("source_id", "target_id", "relationship_name", "created_at")


def temporal_interval(spark, sf):
    """Events inside a closed interval of epoch milliseconds, and how many lie outside."""
    low, high = jsonx.epoch_ms(*map(F.lit, (2024, 1, 2, 0, 0, 0))), jsonx.epoch_ms(*map(F.lit, (2024, 1, 4, 23, 59, 59)))
    e = table(spark, sf, "events").select("event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    never = jsonx.epoch_ms(*map(F.lit, (2024, 2, 30, 0, 0, 0)))
    return e.groupBy("event_type").agg(F.count_if(jsonx.in_interval(F.col("ms"), low, high)).alias("inside"), F.count_if(jsonx.in_interval(F.col("ms"), low, never)).alias("open_end"))


def feedback_stream_weights(spark, sf):
    """Weight of every user after the ratings of their purchases, in order of time."""
    e = table(spark, sf, "events").filter("event_type = 'purchase'").withColumn("rating", score.feedback_rating((F.get_json_object("props", "$.k").cast("int") % 7)))
    rated = e.filter("rating is not null").select(F.col("user_id").alias("id"), F.lit(0.5).alias("weight"), "ts", "event_id", "rating")
    out = improve.stream_weights(rated, ["ts", "event_id"], 0.1)
    return out.select(F.col("id").cast("long").alias("user_id"), F.col("n").cast("int").alias("n"), "weight")


def feedback_normalize(spark, sf):
    e = table(spark, sf, "events").withColumn("score", F.get_json_object("props", "$.k").cast("int") % 8)
    return e.groupBy("score").agg(F.max(score.feedback_rating(F.col("score"))).alias("rating"), F.count("*").alias("n"))


def label_priority_threshold(spark, sf):
    e = table(spark, sf, "graph_edge").select("source_id", "target_id", "relationship_name").distinct()
    return ledger.percentile_lower(graph.degrees(e).withColumn("degree", F.col("degree").cast("double")), "degree", 0.75)


def degree_importance(spark, sf):
    """Logarithm of the degree on the scale of the largest."""
    d = graph.degrees(table(spark, sf, "graph_edge").select("source_id", "target_id", "relationship_name").distinct())
    n = table(spark, sf, "graph_node").select("id").join(d, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    top = n.agg(F.greatest(F.max("degree"), F.lit(1)).alias("top"))
    return n.crossJoin(F.broadcast(top)).select("id", F.round(F.log1p("degree") / F.log1p("top"), 6).alias("importance"))


def edge_bundles(spark, sf):
    """Edges bundled by the stages of their ends and by relationship."""
    n = table(spark, sf, "graph_node").select("id", visual.stage(F.col("type")).alias("stage"))
    e = table(spark, sf, "graph_edge").select("source_id", "target_id", "relationship_name").distinct()
    e = e.join(n.select(F.col("id").alias("source_id"), F.col("stage").alias("s")), "source_id").join(n.select(F.col("id").alias("target_id"), F.col("stage").alias("t")), "target_id")
    kind = visual.edge_class(F.col("relationship_name"))
    return e.groupBy(F.concat_ws("|", "s", "t", kind, "relationship_name").alias("bundle")).agg(F.count("*").alias("n"))


def edge_weight_maps(spark, sf):
    """Primary weight of every edge that has one."""
    e = table(spark, sf, "graph_edge").filter("properties is not null")
    m = e.select("source_id", "target_id", "relationship_name", "updated_at", jsonx.edge_weights(F.get_json_object("properties", "$.weight").try_cast("double"), F.from_json(F.get_json_object("properties", "$.weights"), "map<string,double>"), F.from_json("properties", "map<string,string>")).alias("w"))
    return m.filter(F.size("w") > 0).select("source_id", "target_id", "relationship_name", "updated_at", F.col("w")["default"].alias("weight"))


def used_element_ids(spark, sf):
    """Elements that the hits of every search name, distinct and sorted."""
    e = table(spark, sf, "entity_results").filter("edges is not null").select("query_no", F.explode("edges").alias("edge"))
    return e.groupBy("query_no").agg(F.array_join(F.array_sort(F.collect_set("edge")), ";").alias("used"))


def learning_statements(spark, sf):
    """Trimmed memories, one of those that differ in case only: the earliest."""
    m = table(spark, sf, "memories").withColumn("t", F.trim("content")).filter("t <> ''")
    return m.groupBy(F.lower("t").alias("k")).agg(F.min("memory_no").alias("memory_no")).select("memory_no", F.md5("k").alias("digest"))


def secrets_redacted(spark, sf):
    """Messages with keys and tokens masked."""
    m = table(spark, sf, "messages").filter("content is not null")
    marked = F.concat(F.col("content"), F.lit(" api_key=ABCDEFGHIJKLMNOP1234 "))
    return m.select("message_no", F.md5(text.redact(marked)).alias("digest"))


def csv_row_text(spark, sf):
    """The named fields of every csv record as ``name: value`` lines, null where there is no content."""
    r = table(spark, sf, "cognee_data_record").filter("extension = 'csv' and content is not null")
    return r.select("record_no", F.md5(text.collapse(F.col("content"))).alias("digest"), F.left(text.collapse(F.col("content")), F.lit(40)).alias("preview"))


def facts_min_words(spark, sf):
    """Descriptions of at least three words, shown without prefix."""
    e = table(spark, sf, "entity_results").filter("description is not null")
    return e.filter(text.word_count(F.col("description")) >= 3).select("id", text.fact_display(F.col("description")).alias("fact"))


QUERIES = {
    f.__name__: f
    for f in (
        session_totals, session_visible, session_status_buckets, session_duration, cost_by_model, session_page, usage_accumulation, gap_sessions, modal_event, history_window,
        curator_batches, session_text, session_pairs, latest_status, loader_classify, content_hash_dedup, data_ids, provenance_unique_nodes, provenance_counts, delete_preview,
        delete_shared_protection, delete_execute, orphan_sweep, dataset_scope, node_set_filter, merge_dedup_context, access_log, search_history, sync_edges_since, temporal_interval,
        feedback_stream_weights, feedback_normalize, label_priority_threshold, degree_importance, edge_bundles, edge_weight_maps, used_element_ids, learning_statements,
        secrets_redacted, csv_row_text, facts_min_words,
    )
}

_S = """s0 AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS session_id, user_id, min(ts) AS started_at, max(ts) AS last_activity_at, max(CASE WHEN event_type = 'purchase' THEN ts END) AS ended_at,
  count(*) AS tokens_in, sum(value) AS cost_usd, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase') AS done FROM events GROUP BY ALL),
s1 AS (SELECT *, CASE WHEN errors > tokens_in / 2 THEN 'failed' WHEN done > 0 THEN 'completed' ELSE 'running' END AS raw FROM s0),
s AS (SELECT *, CASE WHEN raw = 'running' AND epoch_us((SELECT max(ts) FROM events)) - epoch_us(last_activity_at) > 1800000000 THEN 'abandoned' ELSE raw END AS status, 'd' || (user_id % 5) AS dataset_id,
  greatest(0.0::DOUBLE, (epoch_us(coalesce(ended_at, last_activity_at)) - epoch_us(started_at)) / 1e6::DOUBLE) AS secs FROM s1),
u AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS session_id, user_id, nullif(event_type, 'view') AS model, count(*) AS tokens_in, sum(value) AS cost_usd FROM events GROUP BY ALL)"""
_L = "l AS (SELECT DISTINCT l_orderkey AS data_id, l_partkey AS slug, o_orderpriority AS dataset_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"
_LINKS = "k AS (SELECT DISTINCT dataset_name AS dataset_id, md5(content) AS data_id FROM cognee_data_record JOIN cognee_add_result USING (add_no) WHERE content IS NOT NULL)"
_E = "e AS (SELECT DISTINCT source_id, target_id, relationship_name FROM graph_edge), d AS (SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM e UNION ALL SELECT target_id FROM e) GROUP BY id)"
_WS = r"'[ \t\n\v\f\r]+'"


def _in(groups: dict, column: str, default: str) -> str:
    return f"CASE {' '.join(f'WHEN lower({column}) IN ({", ".join(repr(k) for k in keys)}) THEN {v!r}' for v, keys in groups.items())} ELSE {default} END"


def _classify_sql() -> str:
    from mnemoframe.functions.fixed import DOCUMENT_CLASSES, DOCUMENT_TYPES, LOADERS

    kind = f"CASE WHEN external_metadata->>'source' = 'dlt' THEN 'dlt_row' ELSE {_in(DOCUMENT_TYPES, 'extension', 'NULL')} END"
    name = f"CASE k {' '.join(f'WHEN {t!r} THEN {c!r}' for t, c in DOCUMENT_CLASSES.items())} ELSE 'Document' END"
    return f"SELECT record_no, {_in(LOADERS, 'extension', repr('text_loader'))} AS loader, k AS document_type, {name} AS class_name FROM (SELECT *, {kind} AS k FROM cognee_data_record) WHERE k IS NOT NULL"


ORACLE = {
    "session_totals": f"""WITH {_S} SELECT count(*) AS sessions, sum(tokens_in)::BIGINT AS tokens_in, round(sum(cost_usd), 4) AS cost_usd, round(sum(secs), 3) AS total_seconds, round(avg(secs), 3) AS avg_seconds,
      count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'abandoned') AS abandoned, count(*) FILTER (status = 'running') AS running,
      round(count(*) FILTER (status = 'completed') / count(*) FILTER (status IN ('completed', 'failed', 'abandoned'))::DOUBLE, 6) AS success_rate FROM s""",
    "session_visible": f"WITH {_S} SELECT dataset_id, count(*) AS sessions, count(DISTINCT user_id) AS users FROM s WHERE (user_id = 7 OR dataset_id IN ('d1', 'd3')) AND last_activity_at >= TIMESTAMP '2024-01-02' GROUP BY 1",
    "session_status_buckets": f"WITH {_S} SELECT status, count(*) AS sessions FROM s GROUP BY 1",
    "session_duration": f"WITH {_S} SELECT user_id, round(sum(secs), 3) AS seconds FROM s GROUP BY 1",
    "cost_by_model": f"WITH {_S} SELECT coalesce(model, 'unknown') AS model, count(DISTINCT session_id) AS sessions, sum(u.tokens_in)::BIGINT AS tokens_in, round(sum(u.cost_usd), 4) AS cost_usd FROM u JOIN s USING (session_id, user_id) GROUP BY 1",
    "session_page": f"WITH {_S} SELECT session_id, user_id, tokens_in, started_at FROM s ORDER BY tokens_in DESC, session_id LIMIT 20 OFFSET 10",
    "usage_accumulation": f"WITH {_S} SELECT u.session_id, u.user_id, model, (u.tokens_in * CASE WHEN status = 'completed' THEN 2 ELSE 1 END)::BIGINT AS tokens_in, round(u.cost_usd * CASE WHEN status = 'completed' THEN 2 ELSE 1 END, 4) AS cost_usd FROM u JOIN s USING (session_id, user_id)",
    "gap_sessions": "WITH a AS (SELECT user_id, event_id, floor(epoch_us(ts) / 1000)::BIGINT AS ms, lag(floor(epoch_us(ts) / 1000)::BIGINT) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY floor(epoch_us(ts) / 1000)::BIGINT, event_id)), b AS (SELECT *, sum(CASE WHEN ms - p > 3600000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS cluster FROM a) SELECT user_id, cluster::BIGINT AS cluster, min(ms) AS t0, max(ms) AS t1, count(*) AS n FROM b GROUP BY ALL",
    "modal_event": "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1",
    "history_window": "SELECT session_id, message_no, role FROM messages WHERE content IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq_no DESC, message_no DESC) <= 10",
    "curator_batches": "WITH a AS (SELECT session_id, content, row_number() OVER (PARTITION BY session_id ORDER BY seq_no, message_no) - 1 AS i FROM messages WHERE content IS NOT NULL) SELECT session_id, ((i - i % 6) / 6)::INT AS batch_no, md5(string_agg(content, chr(10) || chr(10) ORDER BY i)) AS digest, count(*) AS n FROM a GROUP BY ALL",
    "session_text": "SELECT session_id, md5(string_agg(upper(role[1]) || role[2:] || ': ' || content, chr(10) ORDER BY seq_no, message_no)) AS digest FROM messages WHERE role IN ('user', 'assistant') AND content IS NOT NULL GROUP BY 1",
    "session_pairs": "WITH a AS (SELECT session_id, role, message_no, lead(role) OVER w AS r, lead(message_no) OVER w AS n FROM messages WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY session_id ORDER BY seq_no, message_no)) SELECT session_id, message_no AS question_no, n AS answer_no FROM a WHERE role = 'user' AND r = 'assistant'",
    "latest_status": "SELECT owner_id, arg_max(pipeline_status, (created_at, record_no)) AS status, count(*) FILTER (pipeline_status IN ('started', 'completed')) AS blocking FROM cognee_data_record WHERE pipeline_status IS NOT NULL GROUP BY 1",
    "loader_classify": _classify_sql(),
    "content_hash_dedup": "SELECT owner_id, md5(content) AS content_hash, min(record_no) AS first_no, count(*) AS copies, count(DISTINCT add_no) AS adds FROM cognee_data_record WHERE content IS NOT NULL GROUP BY 1, 2",
    "data_ids": f"WITH x AS (SELECT record_no, md5(content) || owner_id || 'None' AS k FROM cognee_data_record WHERE content IS NOT NULL AND owner_id IS NOT NULL) SELECT record_no, {uuid5_sql('k')} AS data_id FROM x",
    "provenance_unique_nodes": f"WITH {_L} SELECT data_id, dataset_id, slug FROM l WHERE NOT EXISTS (SELECT 1 FROM l o WHERE o.dataset_id = l.dataset_id AND o.slug = l.slug AND o.data_id <> l.data_id)",
    "provenance_counts": f"WITH {_L} SELECT dataset_id, count(*) AS nodes, count(DISTINCT data_id) AS data, count(DISTINCT slug) AS slugs FROM l GROUP BY 1",
    "delete_preview": f"WITH {_L}, g AS (SELECT dataset_id, slug FROM l GROUP BY 1, 2 HAVING count(DISTINCT data_id) = 1) SELECT l.dataset_id, count(DISTINCT data_id) AS data, count(g.slug) AS unique_nodes FROM l LEFT JOIN g USING (dataset_id, slug) GROUP BY 1",
    "delete_shared_protection": f"WITH {_LINKS} SELECT data_id FROM k GROUP BY 1 HAVING bool_and(regexp_matches(dataset_id, '^[a-m]'))",
    "delete_execute": f"WITH {_LINKS} SELECT dataset_id, count(*) AS links FROM k WHERE NOT regexp_matches(dataset_id, '^[a-m]') GROUP BY 1",
    "orphan_sweep": f"WITH {_E} SELECT type, count(*) FILTER (degree = 1) AS degree_one, count(*) FILTER (degree IS NULL) AS alone FROM graph_node LEFT JOIN d USING (id) GROUP BY type",
    "dataset_scope": "SELECT dataset, collection_name, count(*) AS points FROM (SELECT collection_name, unnest(coalesce(string_split(metadata['dataset_ids'], ','), ['main'])) AS dataset FROM vector_points) WHERE dataset IN (SELECT dataset_name FROM cognee_add_result) GROUP BY ALL",
    "node_set_filter": "SELECT collection_name, count(*) FILTER (list_has_any(s, ['alpha_notes', 'beta_notes'])) AS any_of, count(*) FILTER (list_has_all(s, ['alpha_notes', 'beta_notes'])) AS all_of FROM (SELECT collection_name, string_split(coalesce(metadata['belongs_to_set'], ''), ',') AS s FROM vector_points) GROUP BY 1",
    "merge_dedup_context": "SELECT query_no, coalesce(description, name) AS key, min(CASE WHEN hit_no <= 2 THEN hit_no ELSE hit_no + 1000 END)::INT AS seq FROM entity_results GROUP BY 1, 2",
    "access_log": "SELECT name, max(found_at) AS last_accessed, count(*) AS hits FROM entity_results GROUP BY 1",
    "search_history": "SELECT query_no, 'query' AS kind, min(found_at) AS at, 0 AS hits FROM entity_results GROUP BY 1 UNION ALL SELECT query_no, 'result', max(found_at), count(*)::INT FROM entity_results GROUP BY 1",
    "sync_edges_since": "SELECT source_id, target_id, relationship_name, created_at FROM graph_edge WHERE created_at > TIMESTAMP '2026-03-01' ORDER BY created_at, source_id, target_id, relationship_name LIMIT 500",
    "temporal_interval": "SELECT event_type, count(*) FILTER (epoch_ms(ts) BETWEEN epoch_ms(TIMESTAMP '2024-01-02') AND epoch_ms(TIMESTAMP '2024-01-04 23:59:59')) AS inside, count(*) FILTER (epoch_ms(ts) >= epoch_ms(TIMESTAMP '2024-01-02')) AS open_end FROM events GROUP BY 1",
    "feedback_stream_weights": """WITH RECURSIVE r AS (SELECT user_id, ((props->>'k')::INT % 7 - 1) / 4.0::DOUBLE AS rating, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_type = 'purchase' AND (props->>'k')::INT % 7 BETWEEN 1 AND 5),
      f AS (SELECT user_id, 0::BIGINT AS i, 0.5::DOUBLE AS weight FROM (SELECT DISTINCT user_id FROM r) UNION ALL SELECT f.user_id, r.i, floor(greatest(0, least(1, weight + 0.1::DOUBLE * (rating - weight))) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE FROM f JOIN r ON r.user_id = f.user_id AND r.i = f.i + 1)
      SELECT user_id, i::INT AS n, weight FROM f WHERE (user_id, i) IN (SELECT user_id, n FROM r)""",
    "feedback_normalize": "SELECT (props->>'k')::INT % 8 AS score, CASE WHEN (props->>'k')::INT % 8 BETWEEN 1 AND 5 THEN ((props->>'k')::INT % 8 - 1) / 4.0::DOUBLE END AS rating, count(*) AS n FROM events GROUP BY 1, 2",
    "label_priority_threshold": f"WITH {_E}, o AS (SELECT degree, row_number() OVER (ORDER BY degree) AS i, count(*) OVER () AS n FROM d) SELECT degree::DOUBLE AS threshold FROM o WHERE i = floor(0.75 * (n - 1)) + 1",
    "degree_importance": f"WITH {_E}, x AS (SELECT id, coalesce(degree, 0) AS g FROM graph_node LEFT JOIN d USING (id)) SELECT id, round(ln(1 + g) / ln(1 + greatest((SELECT max(g) FROM x), 1)), 6) AS importance FROM x",
    "edge_bundles": f"""WITH {_E}, n AS (SELECT id, CASE type WHEN 'DocumentChunk' THEN 'chunk' WHEN 'TextSummary' THEN 'summary' WHEN 'Entity' THEN 'entity' ELSE 'other' END AS stage FROM graph_node)
      SELECT s.stage || '|' || t.stage || '|' || CASE WHEN relationship_name IN ('is_part_of', 'contains', 'is_a', 'made_from') THEN 'structural' ELSE 'semantic' END || '|' || relationship_name AS bundle, count(*) AS n FROM e JOIN n s ON s.id = source_id JOIN n t ON t.id = target_id GROUP BY 1""",
    "edge_weight_maps": "SELECT source_id, target_id, relationship_name, updated_at, try_cast(properties->>'weight' AS DOUBLE) AS weight FROM graph_edge WHERE properties->>'weight' IS NOT NULL",
    "used_element_ids": "SELECT query_no, string_agg(DISTINCT edge, ';' ORDER BY edge) AS used FROM (SELECT query_no, unnest(edges) AS edge FROM entity_results) GROUP BY 1",
    "learning_statements": "SELECT min(memory_no) AS memory_no, md5(lower(trim(content, ' '))) AS digest FROM memories WHERE trim(content, ' ') <> '' GROUP BY 2",
    "secrets_redacted": "SELECT message_no, md5(replace(content || ' api_key=ABCDEFGHIJKLMNOP1234 ', 'api_key=ABCDEFGHIJKLMNOP1234', 'api_ke***REDACTED***')) AS digest FROM messages WHERE content IS NOT NULL",
    "csv_row_text": f"WITH x AS (SELECT record_no, trim(regexp_replace(content, {_WS}, ' ', 'g'), ' ') AS t FROM cognee_data_record WHERE extension = 'csv' AND content IS NOT NULL) SELECT record_no, md5(t) AS digest, left(t, 40) AS preview FROM x",
    "facts_min_words": f"SELECT id, upper(left(trim(description, ' '), 1)) || substr(trim(description, ' '), 2) AS fact FROM entity_results WHERE len(list_filter(string_split_regex(description, {_WS}), lambda x: x <> '')) >= 3",
}
