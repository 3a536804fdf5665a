"""Ranking of texts and vectors against a DataFrame of queries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemoframe.functions import score, text
from mnemoframe.functions.fixed import F32_EPSILON
from mnemoframe.session import hinted, materialize


def top_k(df: DataFrame, by: list[str], k: int, *order: Column) -> DataFrame:
    """First ``k`` rows of each group with their 0-based ``rank``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).filter(F.col("rank") < k)


def corpus_stats(corpus: DataFrame) -> DataFrame:
    """One row ``(n_chunks, avg_length)`` over texts that have a token left; 0 for an empty corpus."""
    sizes = corpus.select(F.size(text.content_tokens(F.col("text"))).alias("n")).filter("n > 0")
    return sizes.agg(F.count("*").alias("n_chunks"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("avg_length"))


def token_df(corpus: DataFrame) -> DataFrame:
    """``(token, df)``: in how many texts each token occurs."""
    return corpus.select(F.explode(F.array_distinct(text.content_tokens(F.col("text")))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def token_index(corpus: DataFrame) -> DataFrame:
    """``(id, length, token, tf)`` of every text with a token: what all lexical rankings read, so that texts are split once."""
    tokens = corpus.select("id", text.content_tokens(F.col("text")).alias("tokens")).filter(F.size("tokens") > 0)
    counts = tokens.select("id", F.size("tokens").alias("length"), F.explode("tokens").alias("token")).groupBy("id", "length", "token").agg(F.count("*").alias("tf"))
    return materialize(counts, "tokens")


def _asked(queries: DataFrame) -> DataFrame:
    """``(query_id, token, n)``, written once as every ranking reads it several times."""
    tokens = queries.select("query_id", F.explode(text.content_tokens(F.col("text"))).alias("token"))
    return materialize(tokens.groupBy("query_id", "token").agg(F.count("*").alias("n")), "asked")


def bm25(corpus: DataFrame, queries: DataFrame, k: int = 10, index: DataFrame | None = None) -> DataFrame:
    """Top ``k`` texts ``(query_id, id, score, rank)`` of each query; texts that score nothing are left out.

    ``corpus`` has ``id, text``, ``queries`` has ``query_id, text``; ``index``
    is the corpus' ``token_index`` if there is one.  Only tokens that some
    query asks for leave the index's scan.
    """
    index = token_index(corpus) if index is None else index
    asked = _asked(queries).select("query_id", "token")
    tf = index.join(hinted(asked.select("token").distinct()), "token", "left_semi")
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    stats = index.groupBy("id").agg(F.first("length").alias("n")).agg(F.count("*").alias("n_chunks"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("avg_length"))
    weights = df.crossJoin(F.broadcast(stats)).select("token", score.idf(F.col("n_chunks"), F.col("df")).alias("idf"), "avg_length")
    weighted = asked.join(weights, "token")
    terms = tf.join(hinted(materialize(weighted, "weighted")), "token").select("query_id", "id", score.bm25_term(F.col("idf"), F.col("tf"), F.col("length"), F.col("avg_length")).alias("part"))
    scored = terms.groupBy("query_id", "id").agg(F.round(F.sum("part"), 6).alias("score"))
    return top_k(scored, ["query_id"], k, F.desc("score"), F.asc("id")).filter("score > 0")


def lexical(corpus: DataFrame, queries: DataFrame, k: int = 10, multiset: bool = False, index: DataFrame | None = None) -> DataFrame:
    """Top ``k`` texts by the Jaccard similarity of token sets, or of multisets.

    Where fewer than ``k`` texts share a token with a query that has any, the
    first others by id follow with a score of zero; texts without a token are
    no candidates.
    """
    index = token_index(corpus) if index is None else index
    q, d = _asked(queries), index.select("id", "length", "token", F.col("tf").alias("m"))
    if not multiset:
        q, d = q.withColumn("n", F.lit(1)), d.withColumn("m", F.lit(1))
    q_size = q.groupBy("query_id").agg(F.sum("n").alias("q_size"))
    d_size = index.select("id", F.col("length").alias("d_size")).distinct() if multiset else index.groupBy("id").agg(F.count("*").alias("d_size"))
    both = d.join(hinted(q), "token").groupBy("query_id", "id").agg(F.sum(F.least("n", "m")).alias("common"))
    scored = both.join(hinted(q_size), "query_id").join(d_size, "id").withColumn("score", F.round(F.col("common") / (F.col("q_size") + F.col("d_size") - F.col("common")), 6))
    best = top_k(scored.select("query_id", "id", "score"), ["query_id"], k, F.desc("score"), F.asc("id")).drop("rank")
    best = materialize(best, "best")
    # at most k zeros a query are needed, and the first 2 k texts hold them: k at most are among the best already
    few = q_size.join(best.groupBy("query_id").count(), "query_id", "left").filter(F.coalesce("count", F.lit(0)) < k).select("query_id")
    first = index.select("id").distinct().orderBy("id").limit(2 * k)
    zeros = few.crossJoin(F.broadcast(first)).join(best, ["query_id", "id"], "left_anti").withColumn("score", F.lit(0.0))
    return top_k(best.unionByName(zeros), ["query_id"], k, F.desc("score"), F.asc("id"))


#: Query vectors that are sent to every executor at once; more are taken in blocks of about half as many.
QUERY_BLOCK = 4096
#: Scores that a task computes at a time.
SCORES = 1 << 22


def _scores(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Rounded scores (queries x points) of two matrices."""
    if metric == "euclidean":
        out = -np.sqrt(np.maximum((q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None, :] - 2 * (q @ x.T), 0))
    else:
        out = q @ x.T
        if metric == "cosine":
            out /= np.maximum(np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :], F32_EPSILON)
    return np.where(np.isnan(out), -np.inf, np.round(out, 6) + 0.0)


def _scan(shared, metric: str, k: int, groups: int):
    """Of each batch of points the ``k`` best of every query in each group, with all that tie with the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, asked = shared.value
        for batch in batches:
            vectors = batch.column(groups + 1)
            sizes = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
            names = list(zip(*(batch.column(i).to_pylist() for i in range(groups)))) if groups else [()] * batch.num_rows
            numbers = {n: i for i, n in enumerate(dict.fromkeys(names))}
            code = np.array([numbers[n] for n in names], np.int64)
            for d, (places, q) in asked.items():
                of_size = np.flatnonzero(sizes == d)
                for g in np.unique(code[of_size]):
                    rows = of_size[code[of_size] == g]
                    step = max(1, SCORES // len(places))
                    for low in range(0, len(rows), step):
                        mine = rows[low : low + step]
                        score = _scores(metric, flat[starts[mine][:, None] + np.arange(d)], q)
                        last = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(score), -np.inf)
                        i, j = np.nonzero((score >= last[:, None]) & (score > -np.inf))
                        at = pa.array(mine[j])
                        yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(places[i])), *(batch.column(c).take(at) for c in range(groups + 1)), pa.array(score[i, j])], names=["query_id", *batch.schema.names[: groups + 1], "score"])

    return run


def nearest(points: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", by: tuple[str, ...] = ()) -> DataFrame:
    """Exact top ``k`` points ``(query_id, id, score, rank)`` of each query vector, in each group of the columns ``by``.

    ``points`` has ``id, vector``, ``queries`` has ``query_id, vector``; the
    stated queries are sent to the points in blocks of bounded size, and each
    batch of points meets a block in one matrix product.  Null vectors, those
    of another length and scores that are no number find nothing.
    """
    spark = points.sparkSession
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("asked")).filter("asked is not null")
    first = asked.limit(QUERY_BLOCK + 1).toArrow()
    blocks = [first]
    if first.num_rows > QUERY_BLOCK:
        asked = materialize(asked, "queries")
        n = -(-2 * asked.count() // QUERY_BLOCK)
        blocks = (asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i).toArrow() for i in range(n))
    held = points.select(*by, "id", F.col("vector").cast("array<double>").alias("vector"))
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), *(T.StructField(c, points.schema[c].dataType) for c in (*by, "id")), T.StructField("score", T.DoubleType())])
    parts = []
    for block in blocks:
        lists = block["asked"].to_pylist()
        by_size: dict[int, list[int]] = {}
        for i, v in enumerate(lists):
            by_size.setdefault(len(v), []).append(i)
        matrices = {d: (np.array(at), np.array([[np.nan if x is None else x for x in lists[i]] for i in at], float).reshape(len(at), d)) for d, at in by_size.items()}
        shared = spark.sparkContext.broadcast((block["query_id"].combine_chunks(), matrices))
        parts.append(top_k(held.mapInArrow(_scan(shared, metric, k, len(by)), schema), ["query_id", *by], k, F.desc("score"), F.asc("id")))
    return reduce(DataFrame.unionByName, parts).select("query_id", *by, "id", "score", "rank")


def limit_then_filter(points: DataFrame, queries: DataFrame, keep: Column, k: int = 10, window: int = 4096) -> DataFrame:
    """The ``window`` nearest points of each query, of which those that ``keep`` holds for, the first ``k``.

    An index that cannot filter answers so; points behind the window are not
    seen.  ``keep`` is a condition on the columns of ``points``.
    """
    near = nearest(points, queries, max(window, k)).drop("rank")
    return top_k(near.join(points.filter(keep).select("id"), "id", "left_semi").select("query_id", "id", "score"), ["query_id"], k, F.desc("score"), F.asc("id"))


def fuse(lanes: dict[str, DataFrame], k: int, weights: DataFrame | None = None, truth: DataFrame | None = None) -> DataFrame:
    """Reciprocal-rank fusion of lanes ``(query_id, id, rank)``; the first rank of a row in a lane counts.

    ``weights`` (``id, importance_weight``) multiplies by the importance factor,
    ``truth`` (``query_id, id, truth_factor``) by its factor, 1 where there is none.
    """
    width = score.rrf_k(k)
    tagged = None
    for name, lane in lanes.items():
        part = lane.select("query_id", "id", "rank", F.lit(name).alias("lane"))
        tagged = part if tagged is None else tagged.unionByName(part)
    ranks = tagged.groupBy("query_id", "id").agg(*(F.min(F.when(F.col("lane") == n, F.col("rank"))).alias(n) for n in lanes))
    total = sum((score.reciprocal_rank(F.col(n), width) for n in lanes), F.lit(0.0))
    fused = ranks.withColumn("raw", total).withColumn("rrf", F.round("raw", 8)).withColumn("best", F.least(*(F.col(n) for n in lanes)) if len(lanes) > 1 else F.col(next(iter(lanes))))
    factor = F.lit(1.0)
    if weights is not None:
        fused, factor = fused.join(weights, "id", "left"), score.importance_factor(F.col("importance_weight"))
    if truth is not None:
        fused, factor = fused.join(truth, ["query_id", "id"], "left"), factor * F.coalesce("truth_factor", F.lit(1.0))
    fused = fused.withColumn("score", F.round(F.col("raw") * factor, 8))
    return top_k(fused, ["query_id"], k, F.desc("score"), F.desc("rrf"), F.asc("best"), F.asc("id")).select("query_id", "id", "score", "rrf", "rank")


def recall(entries: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Entries that share tokens with a query, by the number of shared tokens, then in stored order ``seq``."""
    asked = queries.select("query_id", F.explode(text.recall_tokens(F.col("text"))).alias("token"))
    held = entries.select("id", "seq", F.explode(text.recall_tokens(F.col("text"))).alias("token"))
    shared = held.join(hinted(asked), "token").groupBy("query_id", "id", "seq").agg(F.count("*").alias("score"))
    return top_k(shared, ["query_id"], k, F.desc("score"), F.asc("seq"), F.asc("id")).select("query_id", "id", "score", "rank")
