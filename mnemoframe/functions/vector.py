"""Vector arithmetic as column expressions, in double precision."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemoframe.functions.fixed import F32_EPSILON


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_double(a), F.lit(0.0), lambda s, x: s + x * x))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine with the norm product held above the single-precision epsilon; null if the lengths differ."""
    return F.when(F.size(a) == F.size(b), dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(F32_EPSILON)))


def cosine_or_zero(a: Column, b: Column) -> Column:
    """Cosine over the common length, 0 if either vector is zero there."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, 1, n), F.slice(b, 1, n)
    size = norm(x) * norm(y)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(x, y) / size)


def l2_normalize(v: Column) -> Column:
    size = norm(v)
    return F.when(size == 0, _double(v)).otherwise(F.transform(_double(v), lambda x: x / size))


def coordinates(v: Column, basis: Column) -> Column:
    """Cosine of ``v`` against every vector of an array of vectors."""
    return F.transform(basis, lambda b: cosine_or_zero(v, b))


def pad(v: Column, k: int) -> Column:
    """Exactly ``k`` numbers: cut behind, filled up with zeros."""
    return F.slice(F.concat(_double(v), F.array_repeat(F.lit(0.0), k)), 1, k)


def truth_score(node: Column, query: Column) -> Column:
    """Mean of the node coordinates weighted by the positive query coordinates, within 0 and 1; 0.5 if undefined."""
    weight = F.transform(_double(query), lambda q: F.greatest(q, F.lit(0.0)))
    total = F.aggregate(weight, F.lit(0.0), lambda s, x: s + x)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(node, weight) / total))
    return F.when(total > 0, score).otherwise(F.lit(0.5))


def truth_factor(node: Column, query: Column) -> Column:
    return F.lit(0.75) + F.lit(0.5) * truth_score(node, query)


def deterministic_vector(text: Column, dimensions: int) -> Column:
    """Offline stand-in for an embedding: windows of the SHA-256 digest read as small floats, scaled and clamped."""

    def one(t: str | None) -> list[float] | None:
        if t is None:
            return None
        digest = hashlib.sha256(t.encode()).digest()
        raw = np.array(struct.unpack("<8f", digest), np.float32)
        with np.errstate(all="ignore"):
            scaled = raw / np.float32(1e38)
        scaled = np.where(np.isfinite(scaled), np.clip(scaled, -1.0, 1.0), 0.0).astype(np.float32)
        return np.resize(scaled, dimensions).tolist()

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(one)

    return vectors(text)


def hashed_vector(text: Column, dimensions: int = 4) -> Column:
    """Offline stand-in for an embedding that any SQL engine can repeat: groups of four hex digits of the MD5, scaled to -1 to 1; at most 8 numbers."""
    return F.when(text.isNotNull(), F.array(*((F.conv(F.substring(F.md5(text), 4 * i + 1, 4), 16, 10).cast("double") - 32768) / 32768 for i in range(dimensions))))


def hashed_vector_sql(text: str, dimensions: int = 4) -> str:
    """The same in DuckDB's SQL."""
    return "[" + ", ".join(f"(('0x' || substr(md5({text}), {4 * i + 1}, 4))::INT - 32768) / 32768.0::DOUBLE" for i in range(dimensions)) + "]"


def mean_pool(rows: Column, mask: Column, dimensions: int) -> Column:
    """Masked mean of a sequence of vectors; the divisor is at least one."""
    kept = F.filter(F.arrays_zip(rows.alias("v"), mask.alias("m")), lambda z: z["m"] > 0)
    total = F.aggregate(kept, F.array_repeat(F.lit(0.0), dimensions), lambda s, z: F.zip_with(s, z["v"].cast("array<double>"), lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.greatest(F.size(kept), F.lit(1)))
