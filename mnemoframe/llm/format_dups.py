"""Problem 5: records that differ only in formatting.

Two texts are copies if they hold the same letters and digits in the same
order whatever their case; csv and json records if they have the same
extension and the same set of fields, in any order, names and values compared
that way.  Canonical keys are built by JVM expressions.  Each input partition
then records which key positions it saw once and which repeatedly in a sparse
Bloom filter; the filters are merged block by block, and only keys all of
whose positions were seen twice ("possible repeats") are shuffled for exact
grouping, everything else leaves as a singleton without a shuffle.

The filter has the same density at every size: the space of keys is cut into
ranges whose filters hold ``FILTER_BITS`` bits each, and one range after the
other is sketched, merged, sent out and tested.  The key table is sorted by
key inside its files, so a range reads its own pages only: all ranges
together read the table once, whatever their number.

Defined results: null content and content without any letter or digit has no
key and is no case; an empty table gives an empty result; repeated rows are
copies of each other; csv or json that cannot be parsed is compared as text
within its extension; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemoframe.session import materialize

#: Bits of the merged filter per key, and the size of one range's filter (the broadcast bound: 64 MB).
BITS_PER_KEY, FILTER_BITS = 16, 1 << 29
BLOCK_BITS = 1 << 20


def letters(text: Column) -> Column:
    """Lower-cased letters and digits of ``text``, nothing else."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def _fields(text: Column, extension: Column) -> Column:
    """Canonical ``name=value`` strings of a csv or json record, as a sorted set."""
    # a field starts at the text's begin or after a separator, with a name and a colon
    parts = F.split(text, r"\s*[,;|\t\n\r]\s*(?=[\p{L}_][\p{L}\p{N}_ -]{0,60}\s*[:=])")
    csv = F.transform(
        parts,
        lambda p: F.concat(letters(F.regexp_extract(p, r"(?s)^([^:=]*)[:=]?(.*)$", 1)), F.lit("="), letters(F.regexp_extract(p, r"(?s)^([^:=]*)[:=]?(.*)$", 2))),
    )
    parsed = F.from_json(F.when(extension == "json", text), "map<string,string>")
    json = F.transform(F.map_entries(parsed), lambda e: F.concat(letters(e["key"]), F.lit("="), letters(F.coalesce(e["value"], F.lit("")))))
    fields = F.when(extension == "csv", csv).when((extension == "json") & (F.size(parsed) > 0), json)
    fields = F.filter(fields, lambda f: f != "=")
    return F.array_sort(F.array_distinct(fields))


def copy_keys(df: DataFrame, content: str = "content", extension: str | None = None) -> DataFrame:
    """Add ``k1, k2`` (128 bits of the canonical form); both null where there is no letter or digit."""
    text = F.col(content)
    plain = letters(text)
    if extension is None:
        form = plain
    else:
        ext = F.lower(F.col(extension))
        kind = F.when(ext.isin("csv", "json"), ext).otherwise("")
        fields = F.array_join(_fields(text, kind), "\u0001")
        form = F.when(kind != "", F.concat(kind, F.lit("\u0002"), F.coalesce(fields, plain))).otherwise(plain)
    usable = plain != ""
    return df.withColumn("k1", F.when(usable, F.xxhash64(form))).withColumn("k2", F.when(usable, F.xxhash64(F.lit("second"), form)))


def _positions(k1: np.ndarray, k2: np.ndarray, bits: int) -> np.ndarray:
    a = k1.astype(np.int64).view(np.uint64)
    b = k2.astype(np.int64).view(np.uint64)
    return np.stack([a % np.uint64(bits), b % np.uint64(bits)])


def repeat_filter(keys: DataFrame, bits: int) -> dict[int, bytes]:
    """Bitmap blocks of the positions that at least two rows set.

    The result holds at most ``bits / 8`` bytes, ``bits`` being bounded by the
    filter of one range; partitions send sparse positions, not whole bitmaps.
    """

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = [np.concatenate([p.k1.to_numpy(np.int64), p.k2.to_numpy(np.int64)]).reshape(2, -1) for p in batches if len(p)]
        if not seen:
            return
        k1, k2 = np.concatenate(seen, axis=1)
        # a key that repeats inside the partition counts as seen twice at once
        order = np.lexsort((k2, k1))
        k1, k2 = k1[order], k2[order]
        new = np.ones(len(k1), bool)
        new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        head = np.flatnonzero(new)
        times = np.diff(np.append(head, len(k1)))
        pos = _positions(k1[head], k2[head], bits)
        flat = np.concatenate([np.unique(p) for p in (pos.ravel(),)])
        again = np.unique(pos[:, times > 1].ravel())
        for block in np.unique(flat // np.uint64(BLOCK_BITS)):
            low, high = block * np.uint64(BLOCK_BITS), (block + np.uint64(1)) * np.uint64(BLOCK_BITS)
            cut = lambda x: (x[(x >= low) & (x < high)] - low).astype(np.uint32).tobytes()  # noqa: B023, E731
            yield pd.DataFrame({"block": [int(block)], "once": [cut(flat)], "again": [cut(again)]})

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        once, repeated = np.zeros(BLOCK_BITS, bool), np.zeros(BLOCK_BITS, bool)
        for a, b in zip(rows.once, rows.again):
            at = np.frombuffer(a, np.uint32)
            repeated[at[once[at]]] = True
            once[at] = True
            repeated[np.frombuffer(b, np.uint32)] = True
        return pd.DataFrame({"block": [key[0]], "bitmap": [np.packbits(repeated).tobytes()]})

    parts = keys.select("k1", "k2").mapInPandas(sketch, "block long, once binary, again binary")
    merged = parts.groupBy("block").applyInPandas(merge, "block long, bitmap binary")
    return {r.block: bytes(r.bitmap) for r in merged.collect()}


def _marked(keys: DataFrame, bits: int) -> DataFrame:
    """``keys`` with a flag ``maybe``: false where no other row can have the same key."""
    blocks = keys.sparkSession.sparkContext.broadcast(repeat_filter(keys, bits))

    @F.pandas_udf("boolean")
    def possible_repeat(k1: pd.Series, k2: pd.Series) -> pd.Series:
        found = np.ones(len(k1), bool)
        for pos in _positions(k1.to_numpy(), k2.to_numpy(), bits):
            at = pos % np.uint64(BLOCK_BITS)
            block = (pos // np.uint64(BLOCK_BITS)).astype(np.int64)
            hit = np.zeros(len(k1), bool)
            for b in np.unique(block):
                if b in blocks.value:
                    mine = block == b
                    bitmap = np.frombuffer(blocks.value[b], np.uint8)
                    hit[mine] = (bitmap[at[mine] >> np.uint64(3)] >> (7 - (at[mine] & np.uint64(7))).astype(np.uint8)) & 1
            found &= hit
        return pd.Series(found)

    marked = materialize(keys.withColumn("maybe", possible_repeat("k1", "k2")), "copies")
    blocks.unpersist()
    return marked


def group_copies(keys: DataFrame, by: list[str], row: str, filter_bits: int = FILTER_BITS) -> DataFrame:
    """``(by..., keep_no, copy_no, copies)`` for every keyed row.

    ``keep_no`` is the smallest number among the row's copies, ``copies`` how
    many rows share its form (1 for a singleton).
    """
    keys = keys.filter("k1 is not null")
    if by:  # copies are looked for inside these groups
        keys = keys.withColumn("k1", F.xxhash64("k1", *by))
    keys = materialize(keys.sortWithinPartitions("k1"), "keys")
    rows = keys.count()
    ranges = max(1, -(-rows * BITS_PER_KEY // filter_bits))
    bits = min(filter_bits, max(BLOCK_BITS, 1 << int(np.ceil(np.log2(max(1, rows / ranges) * BITS_PER_KEY)))))
    cuts = [-(2**63) + (i * 2**64) // ranges for i in range(ranges)] + [2**63]
    between = lambda a, b: (F.col("k1") >= a) & (F.col("k1") <= b - 1)
    marked = reduce(DataFrame.unionByName, [_marked(keys.filter(between(a, b)) if ranges > 1 else keys, bits) for a, b in zip(cuts[:-1], cuts[1:])])
    maybe = marked.filter("maybe")
    # map-side combination comes first, so a form that a third of the rows share is no hot task
    groups = maybe.groupBy("k1", "k2").agg(F.min(row).alias("keep_no"), F.count("*").alias("copies")).filter("copies > 1")
    repeats = maybe.join(groups, ["k1", "k2"], "left")
    columns = [*by, F.coalesce("keep_no", F.col(row)).alias("keep_no"), F.col(row).alias("copy_no"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies")]
    alone = marked.filter("not maybe").withColumn("keep_no", F.col(row)).withColumn("copies", F.lit(1).cast("long"))
    return repeats.select(*columns).unionByName(alone.select(*columns))
