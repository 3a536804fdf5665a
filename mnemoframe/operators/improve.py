"""Self-improvement: feedback weights, truth centroids, triplet index, session sync."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemoframe.functions import ids, score, vector
from mnemoframe.operators import graph
from mnemoframe.session import hinted

SLOTS = 8


def eligible(entries: DataFrame) -> DataFrame:
    """Entries with a score of 1 to 5 that were not applied and name at least one element."""
    named = F.exists(F.concat(F.coalesce("node_ids", F.array().cast("array<string>")), F.coalesce("edge_ids", F.array().cast("array<string>"))), lambda x: F.trim(x) != "")
    return entries.filter(F.col("feedback_score").between(1, 5) & ~F.coalesce("applied", F.lit(False)) & named)


def apply_feedback(weights: DataFrame, entries: DataFrame, alpha: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """New weights ``(id, weight)`` and, per entry, whether every element it names was known.

    ``weights`` is ``(id, weight)``, ``entries`` ``(entry_id, seq, feedback_score, node_ids, edge_ids, applied)``.
    """
    use = eligible(entries).withColumn("rating", score.feedback_rating(F.col("feedback_score")))
    named = use.select("entry_id", "seq", "rating", F.explode(F.array_distinct(F.concat(F.coalesce("node_ids", F.array().cast("array<string>")), F.coalesce("edge_ids", F.array().cast("array<string>"))))).alias("id"))
    rated = weights.join(named, "id", "left").select("id", F.coalesce("weight", F.lit(0.5)).alias("weight"), "seq", "entry_id", "rating")
    folded = stream_weights(rated, ["seq", "entry_id"], alpha)
    flags = named.join(weights.select("id", F.lit(1).alias("known")), "id", "left").groupBy("entry_id").agg((F.count("known") == F.count("*")).alias("applied"))
    return folded.select("id", "weight"), flags


def stream_weights(rated: DataFrame, order: list[str], alpha: float) -> DataFrame:
    """``(id, weight, n)``: the weight of each id after its ratings, applied in order and rounded each time.

    ``rated`` has ``id, weight`` (the weight before) and ``rating`` (null for
    none).  Rows are sorted and read as a stream, so an id with very many
    ratings needs no more memory than one with a single rating.
    """
    rows = rated.withColumn("id", F.col("id").cast("string")).repartition("id").sortWithinPartitions("id", *order).select("id", "weight", "rating")

    def fold(batches):
        key, weight, n = None, 0.0, 0
        for batch in batches:
            done = []
            for i, start, r in zip(batch.id, batch.weight, batch.rating):
                if i != key:
                    if key is not None:
                        done.append((key, weight, n))
                    key, weight, n = i, start, 0
                if not np.isnan(r):
                    weight, n = float(np.floor(min(1.0, max(0.0, weight + alpha * (r - weight))) * 10000.0 + 0.5) / 10000.0), n + 1
            yield pd.DataFrame(done, columns=["id", "weight", "n"])
        if key is not None:
            yield pd.DataFrame([(key, weight, n)], columns=["id", "weight", "n"])

    return rows.mapInPandas(fold, "id string, weight double, n long")


def edge_key(edge_id: Column) -> Column:
    """Source, relationship and target of an edge identifier with triple bars; null if it has not three parts."""
    parts = F.split(edge_id, r"\|\|\|", 3)
    return F.when(F.size(parts) == 3, F.struct(parts[0].alias("source_id"), parts[1].alias("relationship_name"), parts[2].alias("target_id")))


def fold_centroids(vectors: list[tuple[str, np.ndarray]], slots: list[dict] | None = None, k: int = SLOTS) -> list[dict]:
    """Ordered fold: fill the slots, then move the nearest one (the first of equals) towards each new vector."""
    unit = lambda v: v / n if (n := float(np.linalg.norm(v))) else v

    def cosine(a: np.ndarray, b: np.ndarray) -> float:
        m = min(len(a), len(b))
        size = float(np.linalg.norm(a[:m]) * np.linalg.norm(b[:m]))
        return float(a[:m] @ b[:m]) / size if size else 0.0

    out = [dict(s, learning_ids=list(s["learning_ids"])) for s in (slots or [])[:k]]
    seen = {i for s in out for i in s["learning_ids"]}
    for key, v in vectors:
        if key in seen:
            continue
        seen.add(key)
        v = unit(np.asarray(v, float))
        if not out or len(out) < k:
            out.append({"centroid": v, "count": 1, "learning_ids": [key]})
            continue
        best = max(range(len(out)), key=lambda i: (cosine(v, out[i]["centroid"]), -i))
        s = out[best]
        s["centroid"] = unit((np.asarray(s["centroid"]) * s["count"] + v) / (s["count"] + 1))
        s["count"] += 1
        s["learning_ids"].append(key)
    return out


def truth_centroids(learnings: DataFrame, k: int = SLOTS) -> DataFrame:
    """Centroids ``(dataset_id, slot, count, centroid, learning_ids)`` of ``(dataset_id, seq, statement, vector)``.

    Statements that differ in case or white space only are one learning, the
    last vector wins; learnings come in the order of their ids.
    """
    keyed = learnings.withColumn("key", ids.learning_id(F.col("statement"))).groupBy("dataset_id", "key").agg(F.max_by("vector", "seq").alias("vector"))

    columns = ["dataset_id", "slot", "count", "centroid", "learning_ids"]
    state = lambda d, slots: pd.DataFrame([(d, i, s["count"], s["centroid"].tolist(), s["learning_ids"]) for i, s in enumerate(slots)], columns=columns)

    def fold(batches):
        dataset, slots = None, []
        for batch in batches:
            for d, part in batch.groupby("dataset_id", sort=False):
                if d != dataset and slots:
                    yield state(dataset, slots)
                    slots = []
                dataset = d
                # the stream has every learning once, so nothing known needs to be looked for
                slots = fold_centroids([(key, np.asarray(v, float)) for key, v in zip(part.key, part.vector)], slots, k)
        if slots:
            yield state(dataset, slots)

    ordered = keyed.repartition("dataset_id").sortWithinPartitions("dataset_id", "key").select("dataset_id", "key", "vector")
    return ordered.mapInPandas(fold, "dataset_id string, slot int, count int, centroid array<double>, learning_ids array<string>")


def centroids_changed(old: DataFrame, new: DataFrame, tolerance: float = 1e-6) -> Column | bool:
    """Whether two centroid sets differ in slots, counts, learnings or any number by more than the tolerance."""
    pair = old.alias("o").join(new.alias("n"), ["dataset_id", "slot"], "full")
    apart = F.exists(F.zip_with("o.centroid", "n.centroid", lambda x, y: F.coalesce(F.abs(x - y) > tolerance, F.lit(True))), lambda x: x)
    same = F.col("o.count").eqNullSafe(F.col("n.count")) & F.col("o.learning_ids").eqNullSafe(F.col("n.learning_ids")) & F.coalesce(~apart, F.lit(False))
    return not pair.filter(~same).isEmpty()


def align_chunks(chunks: DataFrame, centroids: DataFrame, k: int = SLOTS) -> DataFrame:
    """``(id, alignment)``: cosine of every chunk vector with each centroid of its dataset, padded to ``k`` numbers."""
    basis = centroids.groupBy("dataset_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "centroid"))), lambda s: s["centroid"]).alias("basis"))
    return chunks.join(hinted(basis), "dataset_id", "left").select("id", "dataset_id", vector.pad(F.coalesce(vector.coordinates(F.col("vector"), F.col("basis")), F.array().cast("array<double>")), k).alias("alignment"))


def truth_factors(states: DataFrame, queries: DataFrame, epoch: int) -> DataFrame:
    """``(query_id, id, truth_factor)`` of node states ``(id, alignment, truth_epoch)`` of the current epoch.

    ``queries`` is ``(query_id, q_coords)``; queries without coordinates have no factor.
    """
    asked = queries.filter(F.size("q_coords") > 0)
    now = states.filter(F.col("truth_epoch") == epoch)
    return now.join(hinted(asked), F.size("q_coords") > 0).select("query_id", "id", vector.truth_factor(F.col("alignment"), F.col("q_coords")).alias("truth_factor"))


def memify(nodes: DataFrame, edges: DataFrame, dimensions: int = 32) -> DataFrame:
    """Triplets of the graph with identifiers and (offline) vectors, ready for the index."""
    t = graph.triplets(nodes, edges)
    return t.select(ids.triplet_slug(F.col("source_id"), F.col("relationship_name"), F.col("target_id")).alias("id"), "text", vector.deterministic_vector(F.col("text"), dimensions).alias("vector"))


def embed_with_reuse(rows: DataFrame, known: DataFrame, embed) -> DataFrame:
    """Vectors ``(id, vector)`` of ``(id, text)``: stored ones where there are, computed ones for the rest."""
    missing = rows.join(known.select("id"), "id", "left_anti").select("id", embed(F.col("text")).alias("vector"))
    return rows.select("id").join(known, "id").unionByName(missing)
