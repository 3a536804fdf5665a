"""Problem 1: the most similar vectors of every vector, by multi-index hashing.

Binary codes come from rotations learned on a bounded sample (iterative
quantisation, one model per dimension).  A code is cut into ``tables``
substrings of ``bits`` bits; each substring is a key of its own table.  Two
codes that differ in fewer than ``tables`` bits agree in some substring
(pigeonhole), so equal keys retrieve every code within that radius for
certain, and codes at the wanted cosine with the probability ``recall``.
Inside a table's bucket, codes are compared by Hamming distance on 256 bits,
and the pairs that stay are reranked by the cosine of the float vectors.

Vectors with the same direction form one class, so copies are never compared
with each other: a class needs only its smallest numbers.

Defined results: a vector is usable if it is not null, has ``dimension``
finite elements and is not all zero; others take no part.  Ties go to the
smaller number.  A row repeated under the same number counts once.  Empty
tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.session import materialize

#: The index is fitted on at most so many vectors of each dimension; every row is indexed.
SAMPLE = 8192
#: Average number of rows wanted in a bucket, and the substring lengths allowed.
BUCKET, MIN_BITS, MAX_BITS = 1000, 6, 24
#: A bucket that is expected to hold more rows than this is compared in tiles of about so many, so that no dense cluster is one task.
SPLIT = 16_000
#: Wanted probability that a pair at exactly the smallest similarity shares a bucket.
RECALL = 0.98
#: Bits of the code that is compared inside a bucket, and the deviations from the expected difference that are let through.
CODE, SLACK = 256, 2.5
#: Entries of overfull buckets in one batch at most (or those of one row).
TILE_ENTRIES = 500_000
#: Bytes that one task of the bucket comparison should read.
TASK_BYTES = 48 << 20


def _matrix(batch: pa.RecordBatch, column: int, dims: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Usable vectors by dimension: their rows in the batch and the matrix."""
    vectors = batch.column(column)
    sizes = np.array(vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False))
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    starts = np.concatenate(([0], np.cumsum(np.maximum(sizes, 0))))[:-1]
    out = {}
    for d in np.unique(dims[(sizes == dims) & (dims > 0)]):
        rows = np.flatnonzero((sizes == dims) & (dims == d))
        x = flat[starts[rows][:, None] + np.arange(d)]
        good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        out[int(d)] = rows[good], x[good]
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def learn_rotation(sample: np.ndarray, bits: int, seed: int = 7, rounds: int = 20) -> np.ndarray:
    """Directions (d x bits) whose signs are the code: as many learned rotations as the bits need."""
    d = sample.shape[1]
    rng = np.random.default_rng(seed)
    scatter = sample.T @ sample / max(1, len(sample))
    axes = np.linalg.eigh(scatter + 1e-9 * np.eye(d))[1]
    parts = []
    for _ in range(math.ceil(bits / d)):
        rotation = np.linalg.qr(rng.normal(size=(d, d)))[0]
        data = sample @ axes
        for _ in range(rounds if len(sample) > d else 0):
            u, _, vt = np.linalg.svd(np.sign(data @ rotation).T @ data)
            rotation = (u @ vt).T
        parts.append(axes @ rotation)
    return np.concatenate(parts, axis=1)[:, :bits].astype(np.float32)


_USABLE = "coll string, no long, dim int, cls long, vector array<float>"


def usable_vectors(points: DataFrame, no: str = "point_no", collection: str = "collection_name", dimension: str = "dimension", vector: str = "vector") -> DataFrame:
    """Usable points as unit vectors ``(coll, no, dim, cls, vector)``; ``cls`` hashes the direction."""
    schema = pa.schema([("coll", pa.string()), ("no", pa.int64()), ("dim", pa.int32()), ("cls", pa.int64()), ("vector", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).fill_null(-1).to_numpy(zero_copy_only=False)
            for d, (rows, x) in _matrix(batch, 3, dims).items():
                unit = _unit(x)
                # directions that agree to six decimals are copies
                same = np.round(unit, 6) + 0.0
                names = batch.column(0).take(pa.array(rows)).to_pylist()
                cls = np.array([int.from_bytes(hashlib.blake2b(v.tobytes(), digest_size=8, key=str(name).encode()[:64]).digest(), "little", signed=True) for v, name in zip(same, names)], np.int64)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, len(rows) * d + 1, d), pa.int32()), pa.array(unit.astype(np.float32).ravel()))
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.full(len(rows), d, np.int32)), pa.array(cls), flat], schema=schema)

    rows = points.select(F.coalesce(F.col(collection), F.lit("")).alias("coll"), F.col(no).cast("long").alias("no"), F.col(dimension).cast("int").alias("dim"), F.col(vector).cast("array<float>").alias("vector"))
    return rows.filter("no is not null and vector is not null").mapInArrow(run, _USABLE)


def plan_tables(rows: int, min_similarity: float, recall: float = RECALL) -> tuple[int, int]:
    """Substring length and number of tables for the largest collection."""
    bits = int(min(MAX_BITS, max(MIN_BITS, round(math.log2(max(2, rows) / BUCKET)))))
    agree = (1 - math.acos(min_similarity) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def deeper_keys(code: np.ndarray, bits: int, tables: int, rows: int, split: int = SPLIT) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Buckets that a sample's ``code`` shows to be overfull among ``rows`` rows: per table their keys and the number of groups they are parted in.

    Every two groups of a bucket are compared as one tile, so a pair is found
    or not whatever the number of groups.  A bucket that eight rows of the
    sample do not show holds at most about ``8 * rows / SAMPLE`` rows.
    """
    weights, out = (1 << np.arange(bits)).astype(np.int64), {}
    for t in range(tables):
        keys, n = np.unique(code[:, t * bits : (t + 1) * bits] @ weights, return_counts=True)
        share = n * (rows / max(1, len(code)))
        hot = (n >= 8) & (share > split)
        if hot.any():
            out[t] = keys[hot], np.ceil(2 * share[hot] / split).astype(np.int64)
    return out


def _tiles(rows: np.ndarray, own: np.ndarray, groups: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of overfull buckets, with a tile number from 1 for each of the tiles they lie in: one for each other group of the bucket."""
    for low in range(0, len(rows), step := max(1, TILE_ENTRIES // max(1, int(groups.max(initial=1))))):
        r, g = rows[low : low + step], groups[low : low + step]
        group = (own[low : low + step].view(np.uint64) % g.astype(np.uint64)).astype(np.int64)
        times = g - 1
        other = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        r, g, group = np.repeat(r, times), np.repeat(g, times), np.repeat(group, times)
        other += other >= group
        yield r, np.minimum(group, other) * g + np.maximum(group, other)


def _entries(models, bits: int, tables: int):
    schema = pa.schema([("bucket", pa.int64()), ("cls", pa.int64()), *((f"f{i}", pa.int64()) for i in range(CODE // 64))])
    weights = (1 << np.arange(bits)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies inside the partition are sent once
        for batch in batches:
            dims = batch.column(2).to_numpy(zero_copy_only=False)
            space, own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(1).to_numpy(zero_copy_only=False)
            for d, (rows, x) in _matrix(batch, 3, dims).items():
                new = [i for i, c in enumerate(own[rows].tolist()) if not (c in seen or seen.add(c))]
                rows, x = rows[new], x[new]
                rotation, deeper = models.value[d]
                code = x @ rotation > 0
                keys = code[:, : bits * tables].reshape(len(rows), tables, bits) @ weights
                keys = keys.astype(np.uint64) + (np.arange(tables, dtype=np.uint64) << np.uint64(32))
                f = np.packbits(code[:, -CODE:], axis=1).view(np.int64)
                cls, salt, whole = own[rows], space[rows], np.ones(keys.shape, bool)

                def entries(at: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
                    key = (key * np.uint64(0x9E3779B97F4A7C15) ^ salt[at]).view(np.int64)
                    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(cls[at]), *(pa.array(f[at, i]) for i in range(f.shape[1]))], schema=schema)

                for t, (hot, groups) in deeper.items():
                    own_key = (keys[:, t] & np.uint64(0xFFFFFFFF)).astype(np.int64)
                    near = np.minimum(np.searchsorted(hot, own_key), len(hot) - 1)
                    full = np.flatnonzero(hot[near] == own_key)
                    whole[full, t] = False
                    for at, tile in _tiles(full, cls[full], groups[near[full]]):
                        yield entries(at, keys[at, t] + tile.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                at, t = np.nonzero(whole)
                yield entries(at, keys[at, t])

    return run


def _compare(p: float):
    """Pairs of a bucket whose codes differ in about the share ``p`` of the bits or less."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    limit = lambda n, slack: math.floor(n * p + slack * math.sqrt(n * p * (1 - p)))
    coarse, fine = limit(64, SLACK + 1), limit(CODE, SLACK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        bucket, own, *f = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in parts]) for i in range(2 + CODE // 64))
        parts.clear()
        order = np.lexsort((own, bucket))
        bucket, own, f = bucket[order], own[order], np.stack(f, axis=1)[order].view(np.uint64)
        new = np.ones(len(own), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (own[1:] != own[:-1])
        bucket, own, f = bucket[new], own[new], f[new]
        head = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        held, count = [], 0

        def flush() -> pa.RecordBatch:
            pair = np.unique(np.concatenate(held, axis=1), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], schema=schema)

        for a, b in zip(head, np.append(head[1:], len(own))):
            first = np.ascontiguousarray(f[a:b, 0])
            step = max(1, min(b - a, (1 << 18) // max(1, b - a)))
            for low in range(0, b - a - 1, step):
                i, j = np.nonzero(np.bitwise_count(first[low : low + step, None] ^ first[None, low:]) <= coarse)
                later = j > i
                i, j = a + low + i[later], a + low + j[later]
                near = np.bitwise_count(f[i] ^ f[j]).sum(axis=1) <= fine
                if near.any():
                    held.append(np.stack([own[i[near]], own[j[near]]]))
                    count += held[-1].shape[1]
                    if count >= 500_000:
                        yield flush()
                        held, count = [], 0
        if held:
            yield flush()

    return run


def _cosine(floor: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            dims = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            x, y = _matrix(batch, 2, dims), _matrix(batch, 3, dims)
            for d, (rows, m) in x.items():
                cos = np.einsum("ij,ij->i", _unit(m), _unit(y[d][1]))
                keep = np.flatnonzero(cos >= floor - 1e-7)
                at = pa.array(rows[keep])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(cos[keep])], schema=schema)

    return run


def similar_pairs(points: DataFrame, min_similarity: float = 0.8, recall: float = RECALL, split: int = SPLIT) -> tuple[DataFrame, DataFrame]:
    """Pairs of direction classes ``(a, b, similarity)`` and the members ``(cls, no)`` of every class.

    ``points`` is the result of ``usable_vectors``.  ``split`` bounds a task,
    not the result: a bucket of more rows is compared whole, in tiles, at a cost
    that grows with the square of its rows.
    """
    spark = points.sparkSession
    rows = materialize(points.groupBy("no").agg(F.min("coll").alias("coll"), F.min("dim").alias("dim"), F.min("cls").alias("cls")), "classes")
    members = rows.select("cls", "no")
    sizes = rows.groupBy("coll", "dim").agg(F.count("*").alias("n")).groupBy("dim").agg(F.max("n").alias("largest"), F.sum("n").alias("rows")).collect()
    if not sizes:
        return spark.createDataFrame([], "a long, b long, similarity double"), members
    largest, total = max(r.largest for r in sizes), sum(r.rows for r in sizes)
    bits, tables = plan_tables(largest, min_similarity, recall)
    models, entries = {}, total * tables
    for r in sizes:
        share = F.pmod(F.xxhash64("no"), F.lit(1_000_000)) < min(1_000_000, math.ceil(1_000_000 * SAMPLE / r.rows))
        sample = points.filter((F.col("dim") == r.dim) & share).select("vector").limit(SAMPLE).toArrow()["vector"].combine_chunks()
        x = sample.flatten().to_numpy(zero_copy_only=False).reshape(-1, r.dim).astype(np.float64)
        rotation = learn_rotation(x, max(CODE, bits * tables))
        models[r.dim] = rotation, deeper_keys(x @ rotation > 0, bits, tables, r.rows, split)
        entries += sum(int((groups * (groups - 2)).sum()) * split // 2 for _, groups in models[r.dim][1].values())
    shared = spark.sparkContext.broadcast(models)  # as many matrices as there are dimensions
    fields = ", ".join(f"f{i} long" for i in range(CODE // 64))
    coded = points.select(F.xxhash64("coll", "dim").alias("space"), "cls", "dim", "vector").mapInArrow(_entries(shared, bits, tables), f"bucket long, cls long, {fields}")
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(entries * 56 / TASK_BYTES))
    pairs = materialize(coded.repartition(tasks, "bucket").mapInArrow(_compare(math.acos(min_similarity) / math.pi), "a long, b long"), "pairs").distinct()
    vectors = points.groupBy("cls").agg(F.first("vector").alias("vector"))
    both = pairs.join(vectors.select(F.col("cls").alias("a"), F.col("vector").alias("x")), "a").join(vectors.select(F.col("cls").alias("b"), F.col("vector").alias("y")), "b")
    similar = both.select("a", "b", "x", "y").mapInArrow(_cosine(min_similarity), "a long, b long, similarity double")
    return similar, members


def nearest(points: DataFrame, k: int = 10, min_similarity: float = 0.8, recall: float = RECALL, split: int = SPLIT) -> DataFrame:
    """``(no, neighbour_no, similarity, rank)``: up to ``k`` most similar points at ``min_similarity`` or more."""
    similar, members = similar_pairs(points, min_similarity, recall, split)
    similar = materialize(similar, "similar")
    both = similar.select(F.col("a").alias("cls"), F.col("b").alias("other"), "similarity").unionByName(similar.select(F.col("b").alias("cls"), F.col("a").alias("other"), "similarity"))
    # of a class only the smallest k + 1 numbers can be among the k nearest of any point
    first = members.withColumn("r", F.row_number().over(Window.partitionBy("cls").orderBy("no"))).filter(F.col("r") <= k + 1).select(F.col("cls").alias("other"), F.col("no").alias("neighbour_no"))
    copied = first.groupBy("other").count().filter("count > 1").select(F.col("other").alias("cls"))
    own = copied.select("cls", F.col("cls").alias("other"), F.lit(1.0).alias("similarity"))
    near = both.unionByName(own).join(first, "other")
    order = (F.desc("similarity"), F.asc("neighbour_no"))
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("cls").orderBy(*order))).filter(F.col("r") <= k + 1).select("cls", "neighbour_no", "similarity")
    spread = members.join(best, "cls").filter("no <> neighbour_no")
    ranked = spread.withColumn("rank", F.row_number().over(Window.partitionBy("no").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k).select("no", "neighbour_no", "similarity", "rank")


QUERY_BLOCK = 4096


def exact_nearest(points: DataFrame, queries: DataFrame, k: int = 10, min_similarity: float = -2.0) -> DataFrame:
    """Brute force for a stated query set, in blocks of ``QUERY_BLOCK`` queries against all rows."""
    spark = points.sparkSession
    schema = pa.schema([("no", pa.int64()), ("neighbour_no", pa.int64()), ("similarity", pa.float64())])

    def scan(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = shared.value
            for batch in batches:
                dims, own = batch.column(2).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
                spaces = np.array(batch.column(0).to_pylist(), object)
                for d, (rows, x) in _matrix(batch, 3, dims).items():
                    x = _unit(x)
                    for space in set(spaces[rows]) & {s for s, e in asked if e == d}:
                        mine = np.flatnonzero(spaces[rows] == space)
                        numbers, q = asked[space, d]
                        cos = q @ x[mine].T
                        cos[numbers[:, None] == own[rows[mine]][None, :]] = -3.0
                        top = np.argpartition(-cos, min(k, cos.shape[1]) - 1, axis=1)[:, :k] if cos.shape[1] > k else np.broadcast_to(np.arange(cos.shape[1]), cos.shape)
                        # everything that ties with the last one stays, so that ties go to the smaller number
                        last = np.take_along_axis(cos, top, axis=1).min(axis=1)
                        i, j = np.nonzero(cos >= np.maximum(last, min_similarity)[:, None])
                        ok = cos[i, j] > -2.5
                        i, j = i[ok], j[ok]
                        yield pa.RecordBatch.from_arrays([pa.array(numbers[i]), pa.array(own[rows[mine[j]]]), pa.array(cos[i, j])], schema=schema)

        return run

    parts, block = [], []

    def flush() -> None:
        asked = {}
        for key in {(r.coll, r.dim) for r in block}:
            mine = [r for r in block if (r.coll, r.dim) == key]
            asked[key] = np.array([r.no for r in mine], np.int64), _unit(np.array([r.vector for r in mine], np.float32))
        parts.append(points.select("coll", "no", "dim", "vector").mapInArrow(scan(spark.sparkContext.broadcast(asked)), "no long, neighbour_no long, similarity double"))
        block.clear()

    for row in queries.toLocalIterator():
        block.append(row)
        if len(block) == QUERY_BLOCK:
            flush()
    if block or not parts:
        flush()
    found = reduce(DataFrame.unionByName, parts)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("no").orderBy(F.desc("similarity"), "neighbour_no")))
    return ranked.filter(F.col("rank") <= k)
