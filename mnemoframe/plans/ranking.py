"""Queries: lexical and vector ranking, fusion, routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.functions import score, text, vector
from mnemoframe.functions.fixed import F32_EPSILON, STOP_WORDS
from mnemoframe.operators import ranking, router
from mnemoframe.session import spread, table

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_TOKENS = r"list_filter(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'), lambda t: t NOT IN ({1}))"


def tokens_sql(column: str) -> str:
    return _TOKENS.format(column, _STOP)


def _corpus(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "eval_items").select(F.col("item_id").alias("query_id"), "text")


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All embeddings, and as queries those whose id 20 divides."""
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label"), e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def corpus_stats(spark, sf):
    return ranking.corpus_stats(_corpus(spark, sf)).withColumn("avg_length", F.round("avg_length", 6))


def token_df(spark, sf):
    return ranking.token_df(_corpus(spark, sf))


def bm25_topk(spark, sf):
    return ranking.bm25(_corpus(spark, sf), _queries(spark, sf))


def lexical_jaccard_topk(spark, sf):
    return ranking.lexical(_corpus(spark, sf), _queries(spark, sf))


def lexical_multiset_jaccard(spark, sf):
    return ranking.lexical(_corpus(spark, sf), _queries(spark, sf), multiset=True)


def vector_topk_cosine(spark, sf):
    points, queries = _vectors(spark, sf)
    return ranking.nearest(points, queries)


def vector_metrics_dot_l2(spark, sf):
    points, queries = _vectors(spark, sf)
    dot = ranking.nearest(points, queries, 5, "dot").withColumn("metric", F.lit("dot"))
    return dot.unionByName(ranking.nearest(points, queries, 5, "euclidean").withColumn("metric", F.lit("euclidean")))


def vector_filtered_topk(spark, sf):
    """Filter before limit: only points whose node sets hold the wanted one are ranked."""
    points, queries = _vectors(spark, sf)
    tagged = points.withColumn("sets", F.array(F.concat(F.lit("set_"), F.col("label") % 3), F.lit("all")))
    return ranking.nearest(tagged.filter(F.array_contains("sets", "set_1")), queries)


def vector_limit_then_filter(spark, sf):
    """Limit before filter: what an index without filters gives, from the 64 nearest of each query."""
    points, queries = _vectors(spark, sf)
    return ranking.limit_then_filter(points, queries, F.col("label") % 3 == 1, window=64)


def vector_batch_knn(spark, sf):
    """In every collection the points nearest to each point whose number 20 divides, all in one plan."""
    p = table(spark, sf, "vector_points").filter("vector is not null and size(vector) = dimension")
    p = p.filter(~F.exists("vector", lambda x: F.isnan(x)) & F.exists("vector", lambda x: x != 0))
    points = spread(p.select(F.col("point_no").alias("id"), F.col("collection_name").alias("collection"), "vector"))
    return ranking.nearest(points, p.filter("point_no % 20 = 0").select(F.col("point_no").alias("query_id"), "vector"), 10, by=("collection",))


def _lanes(spark, sf):
    """Two lanes over one index of the corpus."""
    corpus, queries = _corpus(spark, sf), _queries(spark, sf)
    index = ranking.token_index(corpus)
    return {"bm25": ranking.bm25(corpus, queries, 20, index=index), "lexical": ranking.lexical(corpus, queries, 20, index=index)}


def hybrid_rrf(spark, sf):
    return ranking.fuse(_lanes(spark, sf), 10)


def hybrid_rrf_importance(spark, sf):
    weights = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("lang").isNotNull(), (F.col("n_chars") % 100) / 100.0).alias("importance_weight"))
    return ranking.fuse(_lanes(spark, sf), 10, weights)


def importance_weighting(spark, sf):
    m = table(spark, sf, "memories")
    return m.select("memory_no", F.round(score.importance_factor(F.col("importance_weight")), 6).alias("factor"))


def router_scores(spark, sf):
    messages = table(spark, sf, "messages").filter("role = 'user' and content is not null")
    return router.route(messages.select(F.col("message_no").alias("query_id"), F.col("content").alias("text")))


def recall_overlap(spark, sf):
    """Session recall: messages that share words with each test question."""
    entries = table(spark, sf, "messages").filter("content is not null").select(F.col("message_no").alias("id"), F.col("seq_no").alias("seq"), F.col("content").alias("text"))
    return ranking.recall(entries, _queries(spark, sf))


def token_count(spark, sf):
    return _corpus(spark, sf).select(F.col("id").alias("doc_id"), text.word_count(F.coalesce("text", F.lit(""))).alias("n_words"))


def frequent_words(spark, sf):
    """Title parts: the three most frequent words of each memory, ties by word."""
    words = table(spark, sf, "memories").filter("content is not null").select("memory_no", F.explode(F.split(F.lower("content"), r"\s+")).alias("w"))
    words = words.select("memory_no", F.regexp_replace("w", r"^[\p{Punct}]+|[\p{Punct}]+$", "").alias("word")).filter((F.col("word") != "") & ~F.col("word").isin(*STOP_WORDS))
    return ranking.top_k(words.groupBy("memory_no", "word").agg(F.count("*").alias("n")), ["memory_no"], 3, F.desc("n"), F.asc("word"))


def truth_coords(spark, sf):
    """Coordinates of every vector against the label means as basis."""
    e = table(spark, sf, "embeddings")
    dims = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    basis = dims.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("s")).select(F.col("label").alias("slot"), F.transform("s", lambda z: z["m"]).alias("basis"))
    return e.crossJoin(F.broadcast(basis)).select("vec_id", F.col("label").alias("own"), "slot", F.round(vector.cosine_or_zero(F.col("embedding"), F.col("basis")), 5).alias("coordinate"))


def truth_factors(spark, sf):
    """Truth factor of every vector against the mean of all."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    means = e.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    mean = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda z: z["m"]).alias("q"))  # as many rows as dimensions
    return e.crossJoin(F.broadcast(mean)).select("vec_id", F.round(vector.truth_factor(F.col("v"), F.col("q")), 5).alias("factor"))


QUERIES = {
    f.__name__: f
    for f in (
        corpus_stats, token_df, bm25_topk, lexical_jaccard_topk, lexical_multiset_jaccard, vector_topk_cosine, vector_metrics_dot_l2, vector_filtered_topk,
        vector_limit_then_filter, vector_batch_knn, hybrid_rrf, hybrid_rrf_importance, importance_weighting, router_scores, recall_overlap, token_count, frequent_words, truth_coords, truth_factors,
    )
}

_BM25 = f"""
tok AS (SELECT doc_id AS id, {tokens_sql('text')} AS t FROM documents WHERE text IS NOT NULL),
kept AS (SELECT id, t, len(t) AS length FROM tok WHERE len(t) > 0),
st AS (SELECT count(*) AS n, avg(length) AS av FROM kept),
asked AS (SELECT DISTINCT item_id AS query_id, unnest({tokens_sql('text')}) AS token FROM eval_items),
tf AS (SELECT id, length, token, count(*) AS tf FROM (SELECT id, length, unnest(t) AS token FROM kept) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
bm AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * length / av))), 6) AS score
  FROM asked JOIN tf USING (token) JOIN df USING (token), st GROUP BY query_id, id)
"""
_JACCARD = f"""
q AS (SELECT item_id AS query_id, token, @N@ AS n FROM (SELECT item_id, unnest({tokens_sql('text')}) AS token FROM eval_items) GROUP BY ALL),
d AS (SELECT id, token, @N@ AS n FROM (SELECT doc_id AS id, unnest({tokens_sql('text')}) AS token FROM documents) GROUP BY ALL),
jc AS (SELECT query_id, id, sum(least(q.n, d.n)) AS common FROM q JOIN d USING (token) GROUP BY ALL),
ja AS (SELECT query_id, id, round(coalesce(common, 0) / (qs + ds - coalesce(common, 0)), 6) AS score FROM (SELECT query_id, sum(n) AS qs FROM q GROUP BY 1)
  CROSS JOIN (SELECT id, sum(n) AS ds FROM d GROUP BY 1) LEFT JOIN jc USING (query_id, id))
"""
_RANK = "(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1)::INT AS rank"
_FUSED = f"""
WITH {_BM25}, {_JACCARD.replace('@N@', '1')},
a AS (SELECT query_id, id, {_RANK} FROM bm QUALIFY rank < 20), b AS (SELECT query_id, id, {_RANK} FROM ja QUALIFY rank < 20),
u AS (SELECT query_id, id, min(x) AS x, min(y) AS y FROM (SELECT query_id, id, rank AS x, NULL AS y FROM a UNION ALL SELECT query_id, id, NULL, rank FROM b) GROUP BY ALL),
r AS (SELECT query_id, id, coalesce(1.0::DOUBLE / (40 + x + 1), 0) + coalesce(1.0::DOUBLE / (40 + y + 1), 0) AS raw, least(x, y) AS best FROM u),
s AS (SELECT query_id, id, round(raw * @FACTOR@, 8) AS score, round(raw, 8) AS rrf, best FROM r @JOIN@)
SELECT query_id, id, score, rrf, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rrf DESC, best, id) - 1)::INT AS rank FROM s QUALIFY rank < 10
"""
_COS = f"list_dot_product({{0}}::DOUBLE[], {{1}}::DOUBLE[]) / greatest(sqrt(list_dot_product({{0}}::DOUBLE[], {{0}}::DOUBLE[])) * sqrt(list_dot_product({{1}}::DOUBLE[], {{1}}::DOUBLE[])), {F32_EPSILON})"
_FIRST = "q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 20 = 0)"

ORACLE = {
    "corpus_stats": f"SELECT count(*) AS n_chunks, round(coalesce(avg(n), 0), 6) AS avg_length FROM (SELECT len({tokens_sql('text')}) AS n FROM documents) WHERE n > 0",
    "token_df": f"SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({tokens_sql('text')}) AS token FROM documents) GROUP BY token",
    "bm25_topk": f"WITH {_BM25} SELECT query_id, id, score, {_RANK} FROM bm WHERE score > 0 QUALIFY rank < 10",
    "lexical_jaccard_topk": f"WITH {_JACCARD.replace('@N@', '1')} SELECT query_id, id, score, {_RANK} FROM ja QUALIFY rank < 10",
    "lexical_multiset_jaccard": f"WITH {_JACCARD.replace('@N@', 'count(*)')} SELECT query_id, id, score, {_RANK} FROM ja QUALIFY rank < 10",
    "vector_topk_cosine": f"WITH {_FIRST}, s AS (SELECT query_id, vec_id AS id, round({_COS.format('embedding', 'v')}, 6) AS score FROM embeddings, q) SELECT query_id, id, score, {_RANK} FROM s QUALIFY rank < 10",
    "vector_metrics_dot_l2": f"""WITH {_FIRST}, s AS (SELECT query_id, vec_id AS id, round(list_dot_product(embedding::DOUBLE[], v::DOUBLE[]), 6) AS score FROM embeddings, q),
      e AS (SELECT query_id, vec_id AS id, round(-list_distance(embedding::DOUBLE[], v::DOUBLE[]), 6) AS score FROM embeddings, q)
      (SELECT query_id, id, score, {_RANK}, 'dot' AS metric FROM s QUALIFY rank < 5) UNION ALL (SELECT query_id, id, score, {_RANK}, 'euclidean' AS metric FROM e QUALIFY rank < 5)""",
    "vector_filtered_topk": f"WITH {_FIRST}, s AS (SELECT query_id, vec_id AS id, round({_COS.format('embedding', 'v')}, 6) AS score FROM embeddings, q WHERE label % 3 = 1) SELECT query_id, id, score, {_RANK} FROM s QUALIFY rank < 10",
    "vector_batch_knn": f"""WITH p AS (SELECT point_no AS id, collection_name AS collection, vector AS w FROM vector_points WHERE len(vector) = dimension
        AND len(list_filter(vector, lambda x: isnan(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
      s AS (SELECT b.id AS query_id, a.collection, a.id, round({_COS.format('a.w', 'b.w')}, 6) AS score FROM p a, p b WHERE b.id % 20 = 0 AND len(a.w) = len(b.w))
      SELECT query_id, collection, id, score, (row_number() OVER (PARTITION BY query_id, collection ORDER BY score DESC, id) - 1)::INT AS rank FROM s QUALIFY rank < 10""",
    "vector_limit_then_filter": f"""WITH {_FIRST}, s AS (SELECT query_id, vec_id AS id, label, round({_COS.format('embedding', 'v')}, 6) AS score FROM embeddings, q), w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM s QUALIFY r <= 64)
      SELECT query_id, id, score, {_RANK} FROM w WHERE label % 3 = 1 QUALIFY rank < 10""",
    "hybrid_rrf": _FUSED.replace("@FACTOR@", "1.0::DOUBLE").replace("@JOIN@", ""),
    "hybrid_rrf_importance": _FUSED.replace("@FACTOR@", "(0.75::DOUBLE + 0.5::DOUBLE * greatest(0, least(1, coalesce(w, 0.5::DOUBLE))))").replace(
        "@JOIN@",
        "LEFT JOIN (SELECT doc_id AS id, CASE WHEN lang IS NOT NULL THEN (n_chars % 100) / 100.0::DOUBLE END AS w FROM documents) USING (id)",
    ),
    "importance_weighting": "SELECT memory_no, round(0.75::DOUBLE + 0.5::DOUBLE * greatest(0, least(1, coalesce(importance_weight, 0.5::DOUBLE))), 6) AS factor FROM memories",
    "recall_overlap": r"""WITH e AS (SELECT DISTINCT message_no AS id, seq_no AS seq, unnest(list_filter(string_split_regex(lower(content), '[^\p{L}\p{N}]+'), lambda t: strlen(t) >= 2)) AS token FROM messages),
      q AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda t: strlen(t) >= 2)) AS token FROM eval_items),
      s AS (SELECT query_id, id, seq, count(*) AS score FROM e JOIN q USING (token) GROUP BY ALL)
      SELECT query_id, id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq, id) - 1)::INT AS rank FROM s QUALIFY rank < 10""",
    "token_count": r"SELECT doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda t: t <> ''))::INT AS n_words FROM documents",
    "frequent_words": rf"""WITH w AS (SELECT memory_no, regexp_replace(u, '^[[:punct:]]+|[[:punct:]]+$', '', 'g') AS word FROM (SELECT memory_no, unnest(string_split_regex(lower(content), '[ \t\n\v\f\r]+')) AS u FROM memories)),
      c AS (SELECT memory_no, word, count(*) AS n FROM w WHERE word <> '' AND word NOT IN ({_STOP}) GROUP BY ALL)
      SELECT memory_no, word, n, (row_number() OVER (PARTITION BY memory_no ORDER BY n DESC, word) - 1)::INT AS rank FROM c QUALIFY rank < 3""",
    "truth_coords": """WITH d AS (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL),
      b AS (SELECT label AS slot, list(m ORDER BY i) AS basis FROM d GROUP BY label)
      SELECT vec_id, label AS own, slot, round(list_dot_product(embedding::DOUBLE[], basis) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(basis, basis))), 5) AS coordinate
      FROM embeddings, b""",
    "truth_factors": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT i, greatest(avg(x), 0) AS m FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) GROUP BY i), q AS (SELECT list(m ORDER BY i) AS w FROM m)
      SELECT vec_id, round(0.75::DOUBLE + 0.5::DOUBLE * CASE WHEN list_sum(w) > 0 THEN greatest(0, least(1, list_dot_product(v, w) / list_sum(w))) ELSE 0.5::DOUBLE END, 5) AS factor FROM e, q""",
}
