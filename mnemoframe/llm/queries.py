"""Queries of the training-data problems and, where SQL can say it, their oracle SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.llm import batch_dedup, format_dups, leakage, name_variants, packing, pii, shared_spans, vector_neighbors
from mnemoframe.session import shared_dir, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = vector_neighbors.usable_vectors(table(spark, sf_dir, "vector_points"))
    near = vector_neighbors.nearest(points, k=10, min_similarity=0.8)
    return near.select(F.least("no", "neighbour_no").alias("a_no"), F.greatest("no", "neighbour_no").alias("b_no")).distinct()


def p1_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the true neighbours at 0.80 or more that the index finds, for the points whose number 20 divides."""
    points = vector_neighbors.usable_vectors(table(spark, sf_dir, "vector_points"))
    asked = points.filter("no % 20 = 0")
    true = vector_neighbors.exact_nearest(points, asked, k=10, min_similarity=0.8).select("no", "neighbour_no")
    found = vector_neighbors.nearest(points, k=10, min_similarity=0.8).filter("no % 20 = 0").select("no", "neighbour_no", F.lit(1).alias("hit"))
    return true.join(found, ["no", "neighbour_no"], "left").agg(
        F.count("*").alias("true_pairs"), F.count("hit").alias("found_pairs"), F.round(F.count("hit") / F.count("*"), 4).alias("recall")
    )


def p1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten most similar points, by brute force, of the points whose number 20 divides."""
    points = vector_neighbors.usable_vectors(table(spark, sf_dir, "vector_points"))
    near = vector_neighbors.exact_nearest(points, points.filter("no % 20 = 0"), k=10)
    return near.select("no", "neighbour_no", F.round("similarity", 5).alias("similarity"), "rank")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history goes into a fresh store; then the new batches, as one delivery, are matched against it and appended."""
    records = table(spark, sf_dir, "cognee_data_record").select("record_no", "batch_no", "extension", "content")
    store = batch_dedup.FingerprintStore(spark, f"{shared_dir(spark)}/mnemoframe/store-{uuid.uuid4().hex}")
    store.append(records.filter("batch_no < 1"))
    return store.accept(records.filter("batch_no >= 1"))


def p2_add_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result columns of ``cognee_add_result`` for the new batches."""
    records = table(spark, sf_dir, "cognee_data_record").filter("batch_no >= 1").select("record_no", "id", "add_no")
    found = p2_found(spark, sf_dir).select(F.col("dup_no").alias("record_no"), F.lit(True).alias("dup"))
    marked = records.join(found, "record_no", "left").withColumn("dup", F.coalesce("dup", F.lit(False)))
    # an add call holds a bounded list of records: that list is one value of the result table
    lists = marked.groupBy("add_no").agg(
        F.array_sort(F.collect_list(F.when(~F.col("dup"), F.col("id")))).alias("added"),
        F.array_sort(F.collect_list(F.when(F.col("dup"), F.col("id")))).alias("deduplicated"),
    )
    return lists.select("add_no", "added", F.size("added").alias("added_count"), "deduplicated", F.size("deduplicated").alias("deduplicated_count"))


def _of_texts(spark: SparkSession, sf_dir: str, operator) -> DataFrame:
    """``operator`` over both tables of texts, with a field that knows the usual words of both."""
    tables = {src: table(spark, sf_dir, src) for src in ("memories", "messages")}
    field = pii.fitted(tables["memories"].select("content").unionByName(tables["messages"].select("content")))
    parts = [operator(tables[src], no, field=field).withColumn("src", F.lit(src)) for src, no in (("memories", "memory_no"), ("messages", "message_no"))]
    return parts[0].unionByName(parts[1])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of_texts(spark, sf_dir, pii.find_items).select("src", "row_no", "kind", "start_pos", "end_pos").distinct()


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with typed placeholders in place of its items."""
    return _of_texts(spark, sf_dir, pii.redact).select("src", "row_no", "redacted", "n_items")


def _named_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda key: F.get_json_object("properties", f"$.{key}")
    nodes = table(spark, sf_dir, "graph_node").filter("type = 'Entity'").select("id", "name", of("is_a").alias("kind"), of("place").alias("place"), of("description").alias("description"))
    hits = table(spark, sf_dir, "entity_results").select("id", "name", F.col("entity_type").alias("kind"), F.lit(None).cast("string").alias("place"), "description")
    return nodes.filter("kind in ('person', 'organization')").unionByName(hits)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_variants.same_name_pairs(_named_rows(spark, sf_dir))


def p4_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per named row with the entity that it names."""
    return name_variants.same_names(_named_rows(spark, sf_dir))


def _copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories = format_dups.copy_keys(table(spark, sf_dir, "memories").select("memory_no", "content"))
    records = format_dups.copy_keys(table(spark, sf_dir, "cognee_data_record").select("record_no", "content", "extension"), "content", "extension")
    keys = memories.select(F.lit("memories").alias("src"), F.col("memory_no").alias("no"), "k1", "k2")
    keys = keys.unionByName(records.select(F.lit("cognee_data_record").alias("src"), F.col("record_no").alias("no"), "k1", "k2"))
    return format_dups.group_copies(keys, ["src"], "no")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _copies(spark, sf_dir).filter("keep_no < copy_no").select("src", "keep_no", "copy_no")


def p5_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per distinct content with its number of copies."""
    return _copies(spark, sf_dir).filter("keep_no = copy_no").select("src", "keep_no", "copies")


def p6_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context window of every document, or of every piece of one longer than the capacity."""
    return packing.pack(table(spark, sf_dir, "documents"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(p6_windows(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).filter("edits = 0").select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks with up to one word edited, dropped or added."""
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.shared_spans(table(spark, sf_dir, "documents")).select("doc_id", "word_start", "word_end")


def p8_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.shared_share(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_recall, p1_exact_topk, p2_found, p2_add_results, p3_found, p3_redacted, p4_found, p4_entities, p5_found, p5_distinct, p6_windows, p6_fill, p7_found, p7_leaks, p8_found, p8_share)}


_P5_KEYS = r"""
WITH plain AS (
  SELECT 'memories' AS src, memory_no AS no, regexp_replace(lower(content), '[^\p{L}\p{N}]+', '', 'g') AS form, 1 AS usable FROM memories
  UNION ALL
  SELECT 'cognee_data_record', record_no, regexp_replace(lower(content), '[^\p{L}\p{N}]+', '', 'g'), 1
  FROM cognee_data_record WHERE coalesce(lower(extension), '') NOT IN ('csv', 'json')
), parts AS (
  SELECT record_no AS no, lower(extension) AS ext,
    unnest(string_split_regex(regexp_replace(content, '\s*[,;|\t\n\r]\s*([\p{L}_][\p{L}\p{N}_ -]{0,60}\s*[:=])', chr(1) || '\1', 'g'), chr(1))) AS part
  FROM cognee_data_record WHERE lower(extension) = 'csv'
), csv AS (
  SELECT no, 'csv' || chr(2) || string_agg(DISTINCT f, chr(1) ORDER BY f) AS form FROM (
    SELECT no, regexp_replace(lower(regexp_extract(part, '^([^:=]*)', 1)), '[^\p{L}\p{N}]+', '', 'g') || '=' ||
      regexp_replace(lower(regexp_extract(part, '(?s)^[^:=]*[:=]?(.*)$', 1)), '[^\p{L}\p{N}]+', '', 'g') AS f FROM parts) GROUP BY no
), js AS (
  SELECT record_no AS no, unnest(json_keys(content::JSON)) AS k, content::JSON AS o FROM cognee_data_record WHERE lower(extension) = 'json'
), jsn AS (
  SELECT no, 'json' || chr(2) || string_agg(DISTINCT f, chr(1) ORDER BY f) AS form FROM (
    SELECT no, regexp_replace(lower(k), '[^\p{L}\p{N}]+', '', 'g') || '=' ||
      regexp_replace(lower(coalesce(o->>k, '')), '[^\p{L}\p{N}]+', '', 'g') AS f FROM js) GROUP BY no
), keyed AS (
  SELECT src, no, form FROM plain WHERE form <> ''
  UNION ALL SELECT 'cognee_data_record', no, form FROM csv UNION ALL SELECT 'cognee_data_record', no, form FROM jsn
), grouped AS (SELECT src, no, min(no) OVER (PARTITION BY src, form) AS keep_no, count(*) OVER (PARTITION BY src, form) AS copies FROM keyed)
"""


_P8 = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \t\r\n]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, len(w) AS n, s, md5(array_to_string(w[s:s + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50)),
k AS (SELECT h FROM r GROUP BY h HAVING count(DISTINCT doc_id) > 1),
c AS (SELECT doc_id, n, s, CASE WHEN s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 THEN 1 ELSE 0 END AS cut FROM r JOIN k USING (h)),
g AS (SELECT doc_id, n, s, sum(cut) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM c),
f AS (SELECT doc_id, n, (min(s) - 1)::INT AS word_start, (max(s) + 49)::INT AS word_end FROM g GROUP BY doc_id, n, island)
"""
_P2 = r"""
, grams AS (SELECT DISTINCT record_no, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT record_no, w, unnest(range(1, len(w) - 1)) AS i FROM (SELECT record_no, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS w FROM cognee_data_record) WHERE len(w) > 2)),
size AS (SELECT record_no, count(*) AS n FROM grams GROUP BY 1),
met AS (SELECT a.record_no AS x, b.record_no AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.record_no < b.record_no GROUP BY ALL),
pairs AS (SELECT x AS first_no, y AS dup_no FROM met JOIN size a ON a.record_no = x JOIN size b ON b.record_no = y WHERE 10 * c >= 7 * (a.n + b.n - c)
  UNION ALL SELECT keep_no, no FROM grouped WHERE src = 'cognee_data_record' AND keep_no < no),
firsts AS (SELECT min(first_no) AS first_no, dup_no FROM pairs JOIN cognee_data_record r ON r.record_no = dup_no WHERE batch_no >= 1 GROUP BY dup_no)
"""

def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _P5_KEYS + _P2 + "SELECT first_no, dup_no FROM firsts",
        "p2_add_results": _P5_KEYS + _P2 + """SELECT add_no, list_sort(coalesce(list(id) FILTER (WHERE dup_no IS NULL), [])) AS added, (count(*) FILTER (WHERE dup_no IS NULL))::INT AS added_count,
            list_sort(coalesce(list(id) FILTER (WHERE dup_no IS NOT NULL), [])) AS deduplicated, (count(dup_no))::INT AS deduplicated_count
          FROM cognee_data_record LEFT JOIN firsts ON dup_no = record_no WHERE batch_no >= 1 GROUP BY add_no""",
        "p8_found": _P8 + "SELECT doc_id, word_start, word_end FROM f",
        "p8_share": _P8 + "SELECT doc_id, n::INT AS n_words, sum(word_end - word_start)::BIGINT AS shared_words, round(sum(word_end - word_start) / n::DOUBLE, 6) AS share FROM f GROUP BY doc_id, n",
        "p5_found": _P5_KEYS + "SELECT src, keep_no, no AS copy_no FROM grouped WHERE keep_no < no",
        "p5_distinct": _P5_KEYS + "SELECT src, keep_no, copies FROM grouped WHERE keep_no = no",
    }
