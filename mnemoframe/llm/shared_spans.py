"""Problem 8: long passages that documents share word for word.

Rabin-Karp hashes of runs of ``span`` words are counted in Spark; runs seen in
two different documents merge into maximal intervals.  Counting every run
would shuffle one row per word, so runs are selected first, without loss: each
run of ``span`` words contains ``span - gram + 1`` shorter runs of ``gram``
words, and its *anchor* is the one with the smallest hash.  Equal runs have
equal anchors, so a run whose anchor occurs in one text only cannot repeat.
Anchors come about every 16 words; only runs around repeated anchors are
hashed in full (128 bits) and counted.

Documents with byte-identical text are one class: their whole text is shared,
and one of them stands for all in the counting.

Defined results: null, blank and short texts share nothing; repeats inside one
document do not count; an empty table gives an empty result; rows that repeat
a ``doc_id`` with another text are treated as parts of the same document and
get no intervals against each other; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.llm.tokenhash import inside, mix, windows, words
from mnemoframe.session import materialize

SPAN, GRAM = 50, 20


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest value of each run of ``width`` values."""
    best = np.arange(len(values))
    size = 1
    while size < width:
        step = min(size, width - size)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(values[right] < values[left], right, left)
        size += step
    return best


def _anchors(span: int, gram: int):
    width = span - gram + 1
    schema = pa.schema([("doc_id", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("h", pa.int64()), ("s1", pa.int32()), ("s2", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            texts = batch.column(1).to_pylist()
            for part in words(texts, "blank"):
                n = len(part.bounds) - 1
                own = slice(part.first, part.first + n)
                digest = np.frombuffer(b"".join(hashlib.blake2b((t or "").encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts[own]), np.int64).reshape(-1, 2)
                long = np.flatnonzero(np.diff(part.bounds) >= span)
                # one row without anchor for each document that is long enough to share a run
                yield pa.RecordBatch.from_arrays([pa.array(ids[own][long]), pa.array(digest[long, 0]), pa.array(digest[long, 1]), pa.nulls(len(long), pa.int64()), pa.array(part.bounds[long + 1].astype(np.int32) - part.bounds[long].astype(np.int32)), pa.nulls(len(long), pa.int32())], schema=schema)
                start = inside(part, span)
                if not len(start):
                    continue
                grams = windows(part.hashes, gram)
                anchor = _lowest(grams, width)[start]
                owner = part.owner()[start]
                new = np.ones(len(start), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
                head = np.flatnonzero(new)
                tail = np.append(head[1:], len(start)) - 1
                doc = owner[head]
                base = part.bounds[doc]
                yield pa.RecordBatch.from_arrays([pa.array(ids[own][doc]), pa.array(digest[doc, 0]), pa.array(digest[doc, 1]), pa.array(mix(grams[anchor[head]]).view(np.int64)), pa.array((start[head] - base).astype(np.int32)), pa.array((start[tail] - base).astype(np.int32))], schema=schema)

    return run


def _runs(span: int):
    schema = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("start", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, spots = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_pylist()
            for part in words(batch.column(1).to_pylist(), "blank"):
                if len(part.hashes) < span:
                    continue
                wanted = np.zeros(len(part.hashes), bool)
                for i in range(len(part.bounds) - 1):
                    base = part.bounds[i]
                    for spot in spots[part.first + i]:
                        wanted[base + spot["s1"] : base + spot["s2"] + 1] = True
                at = np.flatnonzero(wanted[: len(wanted) - span + 1])
                owner = part.owner()[at]
                yield pa.RecordBatch.from_arrays([pa.array(ids[part.first + owner]), pa.array(windows(part.hashes, span)[at].view(np.int64)), pa.array(windows(part.hashes, span, salt=1)[at].view(np.int64)), pa.array((at - part.bounds[owner]).astype(np.int32))], schema=schema)

    return run


def shared_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Maximal stretches of shared words: ``(doc_id, word_start, word_end, n_words)``."""
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null and text is not null")
    seen = materialize(texts.mapInArrow(_anchors(span, gram), "doc_id long, c1 long, c2 long, h long, s1 int, s2 int"), "anchors")
    sizes = seen.filter("h is null").select("doc_id", "c1", "c2", F.col("s1").alias("n_words"))
    classes = sizes.groupBy("c1", "c2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    sizes = sizes.join(classes, ["c1", "c2"])
    whole = sizes.filter("first <> last").groupBy("doc_id").agg(F.max("n_words").alias("n_words"))
    # anchors of different texts; which document stands for a class does not matter here
    anchors = seen.filter("h is not null")
    repeated = anchors.groupBy("h").agg(F.min("c1").alias("a"), F.max("c1").alias("b")).filter("a <> b").select("h")
    stands = classes.select("c1", "c2", F.col("first").alias("doc_id"))
    spots = (
        anchors.join(repeated, "h", "left_semi")
        .join(stands, ["c1", "c2", "doc_id"], "left_semi")
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("s1", "s2")).alias("spots"))  # at most one per word of the document
    )
    near = texts.join(spots, "doc_id").select("doc_id", "text", "spots")
    runs = materialize(near.mapInArrow(_runs(span), "doc_id long, h1 long, h2 long, start int"), "runs")
    shared = runs.groupBy("h1", "h2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a <> b").select("h1", "h2")
    starts = runs.join(shared, ["h1", "h2"], "left_semi").join(whole.select("doc_id"), "doc_id", "left_anti")
    by_doc = Window.partitionBy("doc_id").orderBy("start")
    islands = starts.withColumn("cut", F.coalesce(F.col("start") > F.lag("start").over(by_doc) + span, F.lit(True)).cast("int")).withColumn("island", F.sum("cut").over(by_doc))
    stretches = islands.groupBy("doc_id", "island").agg(F.min("start").alias("word_start"), (F.max("start") + span).cast("int").alias("word_end")).drop("island")
    stretches = stretches.unionByName(whole.select("doc_id", F.lit(0).alias("word_start"), F.col("n_words").alias("word_end")))
    return stretches.join(sizes.groupBy("doc_id").agg(F.max("n_words").alias("n_words")), "doc_id").select("doc_id", "word_start", "word_end", "n_words")


def shared_share(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """Per document with shared words: ``(doc_id, n_words, shared_words, share)``."""
    found = shared_spans(docs, doc_id, text, span)
    return found.groupBy("doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.sum(F.col("word_end") - F.col("word_start")).alias("shared_words"),
        F.round(F.sum(F.col("word_end") - F.col("word_start")) / F.max("n_words"), 6).alias("share"),
    )
