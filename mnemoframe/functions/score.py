"""Scores and weights as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemoframe.functions.fixed import BM25_B, BM25_K1, TRIPLET_PENALTY


def idf(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))


def bm25_term(weight: Column, tf: Column, length: Column, average: Column) -> Column:
    return weight * (tf * (BM25_K1 + 1)) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / average))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def rrf_k(top_k: int) -> int:
    return min(60, max(30, 20 + 2 * top_k))


def reciprocal_rank(rank: Column, k: int) -> Column:
    """Contribution of a 0-based rank, 0 where the lane lacks the row."""
    return F.coalesce(F.lit(1.0) / (F.lit(k) + rank + 1), F.lit(0.0))


def importance_factor(weight: Column) -> Column:
    return F.lit(0.75) + F.lit(0.5) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(weight, F.lit(0.5))))


def clean_score(score: Column) -> Column:
    return F.when(F.isnan(score) | (score < 0) | score.isNull(), F.lit(0.0)).otherwise(score)


def feedback_rating(score: Column) -> Column:
    """A score of 1 to 5 on the scale from 0 to 1; null outside."""
    return F.when(score.between(1, 5), (score - 1) / 4.0)


def stream_weight(start: Column, ratings: Column, alpha: float) -> Column:
    """Weight after folding in the ratings in their order, rounded to four places each time."""
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    step = lambda w, r: F.floor(clip(w + alpha * (r - w)) * 10000.0 + 0.5).cast("double") / 10000.0
    return F.aggregate(ratings, start, step)


def effective_score(score: Column, feedback: Column, influence: float) -> Column:
    return score if influence == 0 else (1 - influence) * score + influence * F.coalesce(feedback, F.lit(0.5))


def triplet_distance(source: Column, target: Column, edge: Column) -> Column:
    miss = F.lit(TRIPLET_PENALTY)
    return F.coalesce(source, miss) + F.coalesce(target, miss) + F.coalesce(edge, miss)
