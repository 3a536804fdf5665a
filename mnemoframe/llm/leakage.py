"""Problem 7: evaluation items that leak into training documents.

Pigeonhole edit matching on words.  A leak is a run of ``run`` consecutive
words of an item (all its words if it has fewer) that occurs in a document with
at most ``errors`` word edits.  Items are cut into aligned pieces so short that
every run contains ``errors + 1`` whole pieces; as each edit spoils one piece,
some piece occurs exactly.  Documents are scanned once, whatever the size of the
test set: a filter of all pieces, ``FILTER_BITS`` large at most, lets the places
through that may hold one, each with the words around it.  Hits join the pieces
by their hash, and each pair is verified with Myers' bit-parallel distance over
words.  A run with at most ``errors`` edits keeps all but ``2 * errors`` of its
pairs of neighbouring words, so a second filter, of all pairs of the items, drops
places without enough of them around, whatever piece they hold.  The pieces are
sent to the places if they are few (``session.hinted``); else both are shuffled,
and many places of one piece are left to Spark's skew join.

Defined results: null or wordless texts and items leak nothing; an item listed
twice is reported once per distinct id; empty tables give an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoframe.llm.tokenhash import inside, windows, words
from mnemoframe.session import hinted, materialize

RUN = 12
#: Bits of the filters of pieces and of pairs (2 MB each when sent); 16 a piece, and above that size more places pass and are dropped by the join.
FILTER_BITS, BITS_PER_PIECE = 1 << 24, 16


def myers(pattern: dict[int, int], size: int, text: list[int]) -> int:
    """Smallest number of word edits between the pattern and any part of ``text``.

    ``pattern`` maps a word to the bit mask of its places; ``size`` words fit a
    Python integer of any length, so there is no limit of 64.
    """
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score = full, 0, size
    best = score
    for word in text:
        eq = pattern.get(word, 0)
        diagonal = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus = down | (full & ~(diagonal | up))
        minus = up & diagonal
        best = min(best, score)
    return best


def piece_length(run: int, errors: int) -> int:
    """Longest piece such that a run of ``run`` words holds ``errors + 1`` whole aligned pieces."""
    return max(1, (run + 1) // (errors + 2))


_PIECES = "h long, size int, item_id long, place int, run int, around array<long>"


def _pieces(run: int, errors: int):
    """Aligned pieces of items, each with the words of the runs that hold it."""
    schema = pa.schema([("h", pa.int64()), ("size", pa.int32()), ("item_id", pa.int64()), ("place", pa.int32()), ("run", pa.int32()), ("around", pa.list_(pa.int64()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for part in words(batch.column(1).to_pylist(), "nfkc"):
                for i, (a, b) in enumerate(zip(part.bounds[:-1], part.bounds[1:])):
                    w = part.hashes[a:b]
                    if not len(w):
                        continue
                    wide = min(run, len(w))
                    size = piece_length(wide, min(errors, len(w) - 1))
                    for at in range(0, len(w) - size + 1, size):
                        low, high = max(0, at + size - wide), min(len(w), at + wide)
                        h = int(windows(w[at : at + size], size).view(np.int64)[0])
                        rows.append((h, size, ids[part.first + i], at - low, wide, w[low:high].view(np.int64).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 6, schema)], schema=schema)

    return cut


def _holds(wanted: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash is in a filter; its size is a power of two."""
    spot = hashes & np.uint64(8 * len(wanted) - 1)
    return ((wanted[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def _places(shortest: dict[int, int], shared, run: int, errors: int):
    """Places of documents whose piece may be one of the items', with the words around them."""
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("size", pa.int32()), ("at", pa.int32()), ("near", pa.list_(pa.int64()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, wanted_pairs = (np.frombuffer(f, np.uint8) for f in shared.value)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for part in words(batch.column(1).to_pylist(), "nfkc"):
                owner = part.owner()
                pairs = np.concatenate(([0], np.cumsum(_holds(wanted_pairs, windows(part.hashes, 2)))))
                for size, width in sorted(shortest.items()):
                    at = inside(part, size)
                    if not len(at):
                        continue
                    grams = windows(part.hashes, size)[at]
                    hit = np.flatnonzero(_holds(wanted, grams))
                    if len(hit):  # some run around must keep its pairs, of the shortest that has such a piece
                        most = np.zeros(len(hit), np.int64)
                        for start in range(size - run - errors, 1):
                            low = np.clip(at[hit] + start, 0, len(pairs) - 1)
                            most = np.maximum(most, pairs[np.minimum(low + run - 1 + errors, len(pairs) - 1)] - pairs[low])
                        hit = hit[most >= width - 1 - 2 * errors]
                    if not len(hit):
                        continue
                    at, grams = at[hit], grams[hit]
                    doc = owner[at]
                    low = np.maximum(part.bounds[doc], at + size - run - errors)
                    high = np.minimum(part.bounds[doc + 1], at + run + errors)
                    width = high - low
                    ends = np.concatenate(([0], np.cumsum(width)))
                    flat = part.hashes[np.arange(ends[-1]) - np.repeat(ends[:-1] - low, width)].view(np.int64)
                    near = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[part.first + doc]), pa.array(grams.view(np.int64)), pa.array(np.full(len(at), size, np.int32)), pa.array((at - low).astype(np.int32)), near], schema=schema)

    return scan


def _verify(errors: int):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best: dict[tuple[int, int], int] = {}
            doc, item, at, near, place, wide, around = (batch.column(i).to_pylist() for i in range(7))
            for d, i, p, text, q, width, item_words in zip(doc, item, at, near, place, wide, around):
                known = best.get((d, i), errors + 1)
                if not known:
                    continue
                size = len(item_words)
                # the stretch on both sides of the piece that agrees word for word
                left = 0
                while left < min(p, q) and text[p - left - 1] == item_words[q - left - 1]:
                    left += 1
                right = 0
                while right < min(len(text) - p, size - q) and text[p + right] == item_words[q + right]:
                    right += 1
                if left + right >= width:
                    best[d, i] = 0
                    continue
                for start in range(0, size - width + 1):
                    masks: dict[int, int] = {}
                    for j, word in enumerate(item_words[start : start + width]):
                        masks[word] = masks.get(word, 0) | 1 << j
                    low = max(0, p - (q - start) - errors)
                    edits = myers(masks, width, text[low : p + width - (q - start) + errors])
                    known = min(known, edits)
                if known <= min(errors, width - 1):
                    best[d, i] = known
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in best], pa.int64()), pa.array([k[1] for k in best], pa.int64()), pa.array(best.values(), pa.int32())], schema=schema)

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the neighbouring words of the items."""
    for batch in batches:
        for part in words(batch.column(1).to_pylist(), "nfkc"):
            found = windows(part.hashes, 2)[inside(part, 2)] if len(part.hashes) > 1 else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(found).view(np.int64))], names=["h"])


def _filter(hashes: DataFrame, rows: int) -> bytes:
    """A filter of ``hashes(h)``, put together in the JVM: ``FILTER_BITS / 8`` bytes at most come back."""
    bits = min(FILTER_BITS, 1 << max(10, (rows * BITS_PER_PIECE).bit_length()))
    byte = F.shiftright(F.col("h").bitwiseAND(F.lit(bits - 1)), 3).cast("int").alias("byte")
    parts = hashes.select(byte, F.expr("shiftleft(1, cast(h & 7 as int))").alias("bit")).groupBy("byte").agg(F.bit_or("bit").alias("bits"))
    wanted = np.zeros(bits // 8, np.uint8)
    for r in parts.toLocalIterator():
        wanted[r.byte] = r.bits
    return wanted.tobytes()


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", run: int = RUN, errors: int = 1) -> DataFrame:
    """``(doc_id, item_id, edits)``: the fewest word edits with which a run of the item occurs in the document."""
    spark = docs.sparkSession
    corpus = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null and text is not null")
    tests = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).filter("item_id is not null and text is not null").distinct()
    pieces = materialize(tests.mapInArrow(_pieces(run, errors), _PIECES).distinct(), "pieces")
    known = pieces.groupBy("size").agg(F.count_distinct("h").alias("n"), F.min("run").alias("shortest")).collect()  # a row for each length of a piece, ``run`` at most
    total = sum(r.n for r in known)
    shared = spark.sparkContext.broadcast((_filter(pieces.select("h"), total), _filter(tests.mapInArrow(_pairs, "h long"), total * run)))
    places = corpus.mapInArrow(_places({r.size: r.shortest for r in known}, shared, run, errors), "doc_id long, h long, size int, at int, near array<long>")
    hits = places.join(hinted(pieces), ["h", "size"])
    checked = hits.select("doc_id", "item_id", "at", "near", "place", "run", "around").mapInArrow(_verify(errors), "doc_id long, item_id long, edits int")
    return checked.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))
