"""Problem 2: new batches checked against everything accepted before.

A record's fingerprint is a bit string of min-wise hashes, ``BANDS * ROWS``
hashes of ``BITS`` bits each, over the runs of three words of its lower-cased
content.  Two records agree in a hash with the probability of their set
overlap, so the number of differing bits measures how unlike they are.  (A
plain sum-of-signs fingerprint needs a Hamming radius of about 20 in 64 bits at
the overlap of 70 % asked for, which no block table can serve.)

The fingerprint is stored in one table per rotation, keyed by its leading
block of ``ROWS * BITS`` bits.  Records that share a block exactly are
compared by Hamming distance, and the few that stay by their text.
``FingerprintStore`` keeps these tables; a new batch looks its own blocks up
and is then appended.  History is never fingerprinted again, and of its tables
only the cells that the batch's blocks, keys and candidates fall into are read.

Copies in the sense of problem 5 are found by its canonical keys, of which the
store keeps the first holder only; of records with the same set of runs it
keeps the blocks of the first only.

Defined results: null or empty content has no runs and is near nothing, as is
content of fewer than three words (it can still be a copy); equal content
counts; among several earlier partners the smallest number is reported; an
empty batch or history gives an empty result; further columns are ignored.
Batches arrive in the order of ``record_no``: a number already accepted or
smaller than one accepted is still compared, but only with smaller numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.llm.format_dups import copy_keys
from mnemoframe.llm.tokenhash import inside, mix, windows, words
from mnemoframe.session import materialize

GRAM, OVERLAP = 3, 0.70
#: P(miss) at an overlap of exactly 0.70 is (1 - 0.7**4)**30 = 0.03 %.
BANDS, ROWS, BITS = 30, 4, 8
#: Largest accepted number of differing bits among the lowest bits of all hashes: expected 18 of 120 at 0.70, deviation 3.9.
MAX_BITS = 36
#: Partners that one look-up of a block returns at once; the rest of an overfull block is searched exactly afterwards,
#: in tiles of about ``TILE`` asking rows against ``TILE`` members, each a task of its own.
FIRST, TILE = 64, 4096

_RECORDS = "record_no long, content string, k1 long, k2 long, set_hash long, f0 long, f1 long, blocks array<int>"
_FIELDS = [("set_hash", pa.int64()), ("f0", pa.int64()), ("f1", pa.int64()), ("blocks", pa.list_(pa.int32()))]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rng = np.random.default_rng(20240607)
    salts = rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for batch in batches:
        schema = pa.schema([*batch.schema, *_FIELDS])
        for part in words(batch.column(1).to_pylist(), "lower"):
            own = batch.slice(part.first, len(part.bounds) - 1)
            at = inside(part, GRAM)
            if not len(at):
                yield pa.RecordBatch.from_arrays([*own.columns, *(pa.nulls(own.num_rows, t) for _, t in _FIELDS)], schema=schema)
                continue
            grams, owner = windows(part.hashes, GRAM)[at], part.owner()[at]
            order = np.lexsort((grams, owner))
            grams, owner = grams[order], owner[order]
            new = np.ones(len(grams), bool)
            new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
            grams, owner = grams[new], owner[new]
            head = np.flatnonzero(np.diff(owner, prepend=-1))
            lows = np.empty((len(head), BANDS * ROWS), np.uint64)
            for k, salt in enumerate(salts):
                x = (grams ^ salt) * np.uint64(0xFF51AFD7ED558CCD)
                x ^= x >> np.uint64(32)
                x *= salt
                lows[:, k] = np.minimum.reduceat(x, head)
            small = (mix(lows) >> np.uint64(40)).astype(np.uint8)
            blocks = np.ascontiguousarray(small).view(np.int32)  # ROWS hashes of BITS bits are one block
            low = np.zeros((len(head), 128), np.uint8)
            low[:, : BANDS * ROWS] = small & 1
            finger = np.packbits(low, axis=1).view(np.int64)
            size = np.diff(np.append(head, len(grams)))
            sets = np.add.reduceat(mix(grams), head) ^ mix(size.astype(np.uint64))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, blocks.size + 1, BANDS), pa.int32()), pa.array(blocks.ravel()))
            # texts without a run keep their row, with nulls
            back = np.full(own.num_rows, -1)
            back[owner[head]] = np.arange(len(head))
            spread = pa.array(np.maximum(back, 0), mask=back < 0)
            prints = [pa.array(sets.view(np.int64)), pa.array(finger[:, 0]), pa.array(finger[:, 1]), flat]
            yield pa.RecordBatch.from_arrays([*own.columns, *(c.take(spread) for c in prints)], schema=schema)


def fingerprints(records: DataFrame) -> DataFrame:
    """``records(record_no, content, extension)`` with canonical keys and fingerprint; texts without a run of three words have no fingerprint."""
    return copy_keys(records, "content", "extension").select("record_no", "content", "k1", "k2").mapInArrow(_sign, _RECORDS)


def block_entries(prints: DataFrame) -> DataFrame:
    """One row per rotation of each fingerprint: ``(block, record_no, f0, f1)``; the rotation is in the high half of ``block``."""
    turns = prints.select(F.posexplode("blocks").alias("turn", "bits"), "record_no", "f0", "f1")
    return turns.select((F.shiftleft(F.col("turn").cast("long"), 32) + F.col("bits")).alias("block"), "record_no", "f0", "f1")


def _look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by block and number; pairs each new one with the first members of its block.

    A new row behind ``FIRST`` members also gets a marker with ``first_no`` null
    and the number of the last member it was held against.
    """
    key, kept = None, []
    for batch in batches:
        if batch.empty:
            continue
        block, no, new = batch.block.to_numpy(), batch.record_no.to_numpy(), batch.new.to_numpy()
        f = np.stack([batch.f0.to_numpy(), batch.f1.to_numpy()], axis=1).view(np.uint64)
        head = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        tail = np.append(head[1:], len(no))
        some = tail - head > 1
        some[[0, -1]] = True  # a block may go on in the batch before or behind
        out: list[tuple] = []
        for a, b in zip(head[some].tolist(), tail[some].tolist()):
            if key != block[a]:
                key, kept = block[a], []
            for i in range(a, b):
                if kept and new[i]:
                    members = np.array([m[1] for m in kept], np.uint64).reshape(-1, 2)
                    near = np.bitwise_count(members ^ f[i]).sum(axis=1) <= MAX_BITS
                    out += [(m[0], no[i], block[i], None) for m, ok in zip(kept, near) if ok and m[0] < no[i]]
                if len(kept) < FIRST:
                    kept.append((no[i], f[i]))
                elif new[i]:
                    out.append((None, no[i], block[i], kept[-1][0]))
        yield pd.DataFrame(out, columns=["first_no", "dup_no", "block", "beyond"]).astype({"first_no": "Int64", "beyond": "Int64"})


def _tile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by tile; every asking row against every member of its tile by Hamming distance."""
    held, key = [], None

    def close(rows: pd.DataFrame) -> pd.DataFrame:
        ask, give = rows[rows.asks], rows[~rows.asks]
        x, y = (np.stack([d.f0.to_numpy(), d.f1.to_numpy()], axis=1).view(np.uint64) for d in (ask, give))
        own, other, low, high = ask.record_no.to_numpy(), give.record_no.to_numpy(), ask.beyond.to_numpy(), ask.known.to_numpy()
        found = []
        for i in range(len(own)):
            near = (np.bitwise_count(y ^ x[i]).sum(axis=1) <= MAX_BITS) & (other > low[i]) & (other < high[i])
            found += [(n, own[i]) for n in other[near].tolist()]
        return pd.DataFrame(found, columns=["first_no", "dup_no"], dtype="int64")

    for batch in batches:
        names = list(zip(batch.block, batch.i, batch.j))
        cuts = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1]), len(names)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            if held and key != names[a]:
                yield close(pd.concat(held))
                held = []
            key = names[a]
            held.append(batch.iloc[a:b])
    if held:
        yield close(pd.concat(held))


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def sets(texts: list) -> list[np.ndarray]:
        out = []
        for part in words(texts, "lower"):
            out += [np.unique(windows(part.hashes[a:b], GRAM)) for a, b in zip(part.bounds[:-1], part.bounds[1:])]
        return out

    for batch in batches:
        a, b = sets(batch.column(2).to_pylist()), sets(batch.column(3).to_pylist())
        common = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b)], np.int64)
        union = np.array([len(x) + len(y) for x, y in zip(a, b)], np.int64) - common
        keep = pa.array((union > 0) & (common * 100 >= union * round(OVERLAP * 100)))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["first_no", "dup_no"])


def _verified(pairs: DataFrame, texts) -> DataFrame:
    """Those of ``pairs`` whose texts overlap; ``texts`` gives the texts of a frame of numbers."""
    pairs = pairs.select("first_no", "dup_no").distinct()
    found = texts(pairs.select(F.explode(F.array("first_no", "dup_no")).alias("record_no")).distinct())
    a, b = found.select(F.col("record_no").alias("first_no"), F.col("content").alias("a")), found.select(F.col("record_no").alias("dup_no"), F.col("content").alias("b"))
    return pairs.join(a, "first_no").join(b, "dup_no").select("first_no", "dup_no", "a", "b").mapInArrow(_overlap, "first_no long, dup_no long")


def near_pairs(entries: DataFrame, texts) -> DataFrame:
    """Each new number with the smallest earlier number whose text overlaps: ``(first_no, dup_no)``.

    ``entries`` are block entries with a flag ``new``; ``texts`` gives
    ``(record_no, content)`` of a frame of numbers.  A block that very many
    rows share is split into tiles, so it is neither one task nor one join key.
    """
    ordered = entries.select("block", "record_no", "f0", "f1", "new").repartition("block").sortWithinPartitions("block", "record_no")
    found = materialize(ordered.mapInPandas(_look_up, "first_no long, dup_no long, block long, beyond long"), "candidates")
    checked = materialize(_verified(found.filter("first_no is not null"), texts), "verified")
    best = checked.groupBy("dup_no").agg(F.min("first_no").alias("first_no"))
    # overfull blocks: members behind the first ones can matter only below the partner found so far
    if found.filter("beyond is not null").isEmpty():
        return best.select("first_no", "dup_no")
    left = found.filter("beyond is not null").drop("first_no").join(best, "dup_no", "left").filter("first_no is null or first_no > beyond")
    left = materialize(left.select("block", F.col("dup_no").alias("record_no"), "beyond", F.coalesce("first_no", "dup_no").alias("known")), "left")
    if left.isEmpty():
        return best.select("first_no", "dup_no")
    own = ["block"]
    members = materialize(entries.join(left.select(*own).distinct(), own, "left_semi"), "members")
    grid = left.groupBy(*own).agg(F.ceil(F.count("*") / TILE).cast("int").alias("rows")).join(members.groupBy(*own).agg(F.ceil(F.count("*") / TILE).cast("int").alias("columns")), own)
    prints = members.groupBy(*own, "record_no").agg(F.first("f0").alias("f0"), F.first("f1").alias("f1"))
    place = lambda of: F.pmod(F.xxhash64("record_no"), F.col(of)).cast("int")
    all_of = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    asks = left.join(prints, [*own, "record_no"]).join(grid, own).withColumn("i", place("rows")).withColumn("j", all_of("columns")).withColumn("asks", F.lit(True))
    nobody = F.lit(0).cast("long")
    gives = members.select(*own, "record_no", "f0", "f1", nobody.alias("beyond"), nobody.alias("known")).join(grid, own).withColumn("j", place("columns")).withColumn("i", all_of("rows")).withColumn("asks", F.lit(False))
    columns = [*own, "i", "j", "record_no", "f0", "f1", "beyond", "known", "asks"]
    tiles = asks.select(*columns).unionByName(gives.select(*columns)).repartition(*own, "i", "j").sortWithinPartitions(*own, "i", "j")
    rest = _verified(tiles.mapInPandas(_tile, "first_no long, dup_no long"), texts)
    return checked.unionByName(rest).groupBy("dup_no").agg(F.min("first_no").alias("first_no")).select("first_no", "dup_no")


class FingerprintStore:
    """Accepted records on disk: texts, keys, sets and block tables, one folder per accepted batch.

    ``match(batch)`` names the records of a batch that repeat an accepted one
    or an earlier one of the batch; ``append(batch)`` accepts a batch;
    ``accept(batch)`` does both with one fingerprinting.  What is accepted is
    what lies under the path, so a store can be opened again; a folder once
    written is never replaced.

    Each table is cut into ``cells`` by the hash of what it is looked up by,
    and sorted inside: a small batch reads the cells that it asks for, no more.
    Choose ``cells`` so that a cell of a batch is a file of usual size.
    """

    #: Records of a batch that sends its look-up keys (``BANDS`` long numbers each, at most 600,000) to every executor; a larger one joins by shuffle.
    SMALL = 20_000
    TABLES = ("texts", "firsts", "entries")
    _KEY = {"texts": ["record_no"], "firsts": ["h1", "h2"], "entries": ["block"]}
    _SCHEMAS = {
        "texts": "record_no long, content string, cell int",
        "firsts": "h1 long, h2 long, record_no long, cell int",
        "entries": "block long, record_no long, f0 long, f1 long, cell int",
    }

    def __init__(self, spark: SparkSession, path: str, cells: int = 16) -> None:
        self.spark, self.path, self.cells = spark, path.rstrip("/"), cells

    def _folders(self, name: str) -> dict[int, bool]:
        """Numbers of the batch folders of a table, each with whether its writing was finished."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        root = path(f"{self.path}/{name}")
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
        return {int(n.removeprefix("part=")): fs.exists(path(root, f"{n}/_SUCCESS")) for n in found if n.startswith("part=")}

    def parts(self) -> list[int]:
        """Accepted batches: those whole in every table; an append that broke off accepted nothing."""
        held = [self._folders(name) for name in self.TABLES]
        return [n for n in sorted(held[0]) if all(h.get(n) for h in held)]

    def _cell(self, name: str):
        return F.pmod(F.xxhash64(*self._KEY[name]), F.lit(self.cells)).cast("int")

    def read(self, name: str, parts: list[int], asked: DataFrame | None = None, size: int = 1 << 60, exact: bool = True) -> DataFrame:
        """Accepted rows of a table, those that ``asked`` (distinct look-up keys) names if it is given.

        ``size`` is the number of records of the batch that asks.  Only cells
        that are asked for are read, and a batch of up to ``SMALL`` sends its
        keys to the history, which then is not shuffled.  Rows that nobody asks
        for may stay if not ``exact``: who groups by the key anyway can drop them.
        """
        held = self.spark.read.schema(self._SCHEMAS[name]).option("basePath", f"{self.path}/{name}")
        held = held.parquet(*[f"{self.path}/{name}/part={i}" for i in parts]) if parts else self.spark.createDataFrame([], self._SCHEMAS[name])
        if asked is not None and parts:
            if size < 20 * self.cells:  # else no cell is left out
                cells = [r.cell for r in asked.select(self._cell(name).alias("cell")).distinct().collect()]  # at most ``cells`` numbers
                held = held.filter(F.col("cell").isin(cells))
            if size <= self.SMALL:
                held = held.join(F.broadcast(asked), self._KEY[name], "left_semi")
            elif exact:
                held = held.join(asked, self._KEY[name], "left_semi")
        return held.drop("cell", "part")

    @staticmethod
    def _prepare(batch: DataFrame) -> DataFrame:
        return materialize(fingerprints(batch.select(F.col("record_no").cast("long").alias("record_no"), "extension", "content").filter("record_no is not null")), "batch")

    def _firsts(self, new: DataFrame, parts: list[int], size: int) -> tuple[DataFrame, DataFrame]:
        """What the batch's records can be equal in, ``(h1, h2, record_no)``, and the first holder of each, in the store or the batch."""
        same = F.array(F.struct(F.col("k1").alias("h1"), F.col("k2").alias("h2")), F.struct(F.col("set_hash").alias("h1"), F.lit(0).cast("long").alias("h2")))
        held = new.select("record_no", F.explode(same).alias("h")).select("h.h1", "h.h2", "record_no").filter("h1 is not null")
        here = held.groupBy("h1", "h2").agg(F.min("record_no").alias("first_here"))
        before = self.read("firsts", parts, here.select("h1", "h2"), size, exact=False).groupBy("h1", "h2").agg(F.min("record_no").alias("first_before"))
        return held, materialize(here.join(before, ["h1", "h2"], "left"), "firsts")

    def _match(self, new: DataFrame, held: DataFrame, firsts: DataFrame, parts: list[int], size: int) -> DataFrame:
        equal = held.join(firsts, ["h1", "h2"]).select(F.least("first_here", "first_before").alias("first_no"), F.col("record_no").alias("dup_no"))
        # one record of each set of runs asks for all of them
        lead = firsts.filter("h2 = 0").select(F.col("h1").alias("set_hash"), F.col("first_here").alias("lead_no"))
        entries = block_entries(new.join(lead.select(F.col("lead_no").alias("record_no")), "record_no", "left_semi")).withColumn("new", F.lit(True))
        before = self.read("entries", parts, entries.select("block").distinct(), size, exact=False)
        entries = entries.unionByName(before.withColumn("new", F.lit(False)))
        texts = lambda numbers: new.select("record_no", "content").join(numbers, "record_no", "left_semi").unionByName(self.read("texts", parts, numbers, size))
        near = near_pairs(entries, texts).withColumnRenamed("dup_no", "lead_no")
        alike = new.select("set_hash", F.col("record_no").alias("dup_no")).join(lead.join(near, "lead_no"), "set_hash").select("first_no", "dup_no")
        both = equal.unionByName(alike).filter("first_no < dup_no")
        return materialize(both.groupBy("dup_no").agg(F.min("first_no").alias("first_no")).select("first_no", "dup_no"), "repeats")

    def _append(self, new: DataFrame, firsts: DataFrame) -> None:
        part = max((n for name in self.TABLES for n in self._folders(name)), default=-1) + 1
        first = firsts.filter("first_before is null").select("h1", "h2", F.col("first_here").alias("record_no"))
        lead = first.filter("h2 = 0").select("record_no")
        tables = {"texts": new.select("record_no", "content"), "firsts": first, "entries": block_entries(new.join(lead, "record_no", "left_semi"))}

        def write(name: str) -> None:
            cut = tables[name].withColumn("cell", self._cell(name)).hint("rebalance", "cell").sortWithinPartitions("cell", *self._KEY[name])
            cut.write.mode("error").partitionBy("cell").parquet(f"{self.path}/{name}/part={part}")

        self._together(*(lambda name=name: write(name) for name in self.TABLES))

    def _do(self, batch: DataFrame, match: bool, append: bool) -> DataFrame | None:
        new, parts = self._prepare(batch), self.parts()
        size = new.count() if parts else 0
        held, firsts = self._firsts(new, parts, size)
        # the match reads the parts accepted before, so the append may run beside it
        jobs = [lambda: self._match(new, held, firsts, parts, size)] if match else []
        return self._together(*jobs, *([lambda: self._append(new, firsts)] if append else []))[0]

    def _together(self, *jobs) -> list:
        """Results of jobs that Spark runs side by side; all have ended when this returns."""
        with ThreadPoolExecutor(len(jobs)) as pool:
            return [f.result() for f in [pool.submit(inheritable_thread_target(self.spark)(job)) for job in jobs]]

    def append(self, batch: DataFrame) -> None:
        self._do(batch, match=False, append=True)

    def match(self, batch: DataFrame) -> DataFrame:
        """``(first_no, dup_no)`` for the records of the batch that repeat an earlier one."""
        return self._do(batch, match=True, append=False)

    def accept(self, batch: DataFrame) -> DataFrame:
        """``match`` followed by ``append``, with one fingerprinting."""
        return self._do(batch, match=True, append=True)
