"""Problem 6: documents packed into context windows of one fixed capacity.

Sizes are tokens of a public tokenizer.  A document longer than the capacity is
cut into full windows and a rest; nothing else is ever cut.  The histogram of
sizes (at most ``capacity`` numbers, whatever the corpus) goes to the driver,
where dynamic programming chooses the bucket boundaries that minimise the
padding of every piece up to its bucket's boundary.  Token-budget batches are
then planned on the histogram: the largest boundary left opens a window, and
the largest boundaries that still fit fill it.  (Batches that stay inside one
bucket leave the whole remainder of ``capacity / boundary`` empty; filling it
from smaller buckets is what the plan adds.)  A plan has about as many distinct
patterns as buckets, so the windows of billions of pieces follow from a piece's
rank inside its bucket and a small table of patterns.

Ranks come from counts per (bucket, shard) and a rank inside the shard, so no
bucket is ordered in one task.

Defined results: a document without tokens (null or empty text) takes no room
and is given window 0; rows that repeat a ``doc_id`` are separate pieces in
number order; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.session import materialize

CAPACITY, BUCKETS = 2048, 256
#: Rows that one shard of a bucket should have.
SHARD_ROWS = 200_000


#: Where the public tokenizer files are, if no path is given.
TOKENIZER = os.environ.get("TOKENIZER_PATH", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def default_tokenizer() -> str:
    """Path of the vocabulary file that is used if none is named."""
    if not os.path.exists(TOKENIZER):
        raise FileNotFoundError(f"no vocabulary at {TOKENIZER}: pass tokenizer=PATH or set TOKENIZER_PATH")
    return TOKENIZER


class TokenCounter:
    """Counts tokens with the tokenizer whose file is named; loaded once per Python worker."""

    def __init__(self, path: str) -> None:
        self.path, self._count = path, None

    def __getstate__(self) -> dict:
        return {"path": self.path, "_count": None}

    def _load(self):
        if self.path.endswith(".tiktoken"):
            import base64

            import tiktoken

            with open(self.path, "rb") as f:
                ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]
        if self.path.endswith(".model"):
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_file=self.path)
            return lambda texts: [len(x) for x in processor.encode(texts, num_threads=1)]
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.encode_special_tokens = True
        return lambda texts: [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[int]:
        self._count = self._count or self._load()
        return self._count(texts)


def token_sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens)``; null text has none."""
    counter = TokenCounter(tokenizer or default_tokenizer())
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counter(texts) if texts else [], pa.int64())], schema=schema)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null").mapInArrow(run, "doc_id long, n_tokens long")


def bucket_bounds(sizes: np.ndarray, counts: np.ndarray, buckets: int) -> np.ndarray:
    """Upper bounds of at most ``buckets`` buckets with the least total padding.

    The padding of a bucket satisfies the quadrangle inequality, so the best
    cut moves right with the end: each layer is filled by divide and conquer,
    a level at a time, in ``n log n`` steps and no more than ``n`` numbers of
    room besides the cuts.
    """
    n = len(sizes)
    if n <= buckets:
        return sizes
    rows, tokens = np.concatenate(([0], np.cumsum(counts))).astype(float), np.concatenate(([0], np.cumsum(counts * sizes))).astype(float)
    bound = np.concatenate(([0], sizes)).astype(float)

    def layer(before: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Least padding of the first j sizes in k buckets, and where the last of them begins."""
        best, came = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        low, high, left, right = (np.array([x]) for x in (k, n, k - 1, n - 1))
        while len(low):
            j = (low + high) // 2
            many = np.minimum(right, j - 1) - left + 1
            start = np.cumsum(many) - many
            i = np.arange(many.sum()) - np.repeat(start - left, many)
            end = np.repeat(j, many)
            cost = before[i] + bound[end] * (rows[end] - rows[i]) - (tokens[end] - tokens[i])
            best[j] = np.minimum.reduceat(cost, start)
            came[j] = at = np.minimum.reduceat(np.where(cost == np.repeat(best[j], many), i, n), start)
            go = np.concatenate((low < j, j < high))
            low, high, left, right = (np.concatenate(x)[go] for x in ((low, j + 1), (j - 1, high), (left, at), (at, right)))
        return best, came

    best = bound * rows - tokens
    best[0], cuts = np.inf, []
    for k in range(2, buckets + 1):
        best, came = layer(best, k)
        cuts.append(came)
    bounds, j = [], n
    for came in reversed(cuts):
        bounds.append(sizes[j - 1])
        j = int(came[j])
    return np.array([sizes[j - 1], *reversed(bounds)])


def plan_windows(bounds: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[int, int, dict[int, int]]]:
    """Patterns ``(first window, windows, {bucket: pieces per window})`` that use up all pieces."""
    left, patterns, window = counts.astype(object).copy(), [], 0
    for k in range(len(bounds) - 1, -1, -1):
        while left[k]:
            room, used = capacity, {}
            for b in range(k, -1, -1):
                fit = min(room // int(bounds[b]), left[b])
                if fit:
                    used[b] = int(fit)
                    room -= int(fit) * int(bounds[b])
            times = min(left[b] // n for b, n in used.items())
            for b, n in used.items():
                left[b] -= n * times
            patterns.append((window, int(times), used))
            window += int(times)
    return patterns


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, buckets: int = BUCKETS, tokenizer: str | None = None) -> DataFrame:
    """``(doc_id, piece_no, token_start, n_tokens, window_no)``."""
    spark = docs.sparkSession
    sizes = materialize(token_sizes(docs, doc_id, text, tokenizer), "sizes")
    whole = sizes.withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n_tokens") / capacity).cast("int") - 1))))
    pieces = whole.select("doc_id", "piece_no", (F.col("piece_no").cast("long") * capacity).alias("token_start"), F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - F.col("piece_no").cast("long") * capacity).alias("n_tokens"))
    filled = pieces.filter("n_tokens > 0")
    histogram = filled.groupBy("n_tokens").count().orderBy("n_tokens").collect()  # at most ``capacity`` rows
    nothing = pieces.filter("n_tokens = 0").withColumn("window_no", F.lit(0).cast("long"))
    if not histogram:
        return nothing
    size, count = np.array([r.n_tokens for r in histogram]), np.array([r["count"] for r in histogram])
    bounds = bucket_bounds(size, count, buckets)
    bucket = np.searchsorted(bounds, size)
    patterns = plan_windows(bounds, np.bincount(bucket, count, len(bounds)).astype(np.int64), capacity)
    # for each bucket, the ranges of ranks that the patterns take one after the other
    spans, taken = [], [0] * len(bounds)
    for window, times, used in patterns:
        for b, n in used.items():
            spans.append((b, taken[b], taken[b] + n * times, n, window))
            taken[b] += n * times
    # sorted by bucket and rank, so that the span of a piece is one binary search; as many as patterns times their buckets
    order = sorted(spans)
    first, low, each, window = (np.array([r[i] for r in order], np.int64) for i in (0, 1, 3, 4))
    table = spark.sparkContext.broadcast((first, low, each, window))

    @F.pandas_udf("long")
    def seat(bucket: pd.Series, at: pd.Series) -> pd.Series:
        first, low, each, window = table.value
        b, r = bucket.to_numpy(np.int64), at.to_numpy(np.int64)
        out = np.empty(len(b), np.int64)
        for k in np.unique(b):
            a, z = np.searchsorted(first, [k, k + 1])
            mine = b == k
            s = a + np.searchsorted(low[a:z], r[mine], side="right") - 1
            out[mine] = window[s] + (r[mine] - low[s]) // each[s]
        return pd.Series(out)

    chosen = spark.createDataFrame([(int(s), int(b)) for s, b in zip(size, bucket)], "n_tokens long, bucket int")
    shards = max(1, -(-int(count.sum()) // SHARD_ROWS))
    placed = filled.join(F.broadcast(chosen), "n_tokens").withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(shards)).cast("int"))
    per_shard = placed.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    before = per_shard.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inner = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("doc_id", "piece_no")) - 1
    ranked = placed.withColumn("inner", inner).join(before, ["bucket", "shard"]).withColumn("at", F.col("inner") + F.col("before"))
    windows = ranked.withColumn("window_no", seat("bucket", "at"))
    return windows.select("doc_id", "piece_no", "token_start", "n_tokens", "window_no").unionByName(nothing)


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: windows, pieces, tokens, the fullest window and the share of the room that is used."""
    used = packed.groupBy("window_no").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("n"))
    return used.agg(
        F.count("*").alias("windows"),
        F.sum("n").alias("pieces"),
        F.sum("used").alias("tokens"),
        F.max("used").alias("fullest"),
        F.round(F.sum("used") / (F.count("*") * F.lit(capacity)), 6).alias("used_share"),
    )
