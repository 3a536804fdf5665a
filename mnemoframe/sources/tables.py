"""Table sinks: upserts into folders of Parquet, without ever overwriting what is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.operators.graph import upsert


class Store:
    """Versioned tables under a root; a table is its newest finished version.

    Versions are numbered folders; Spark's ``_SUCCESS`` says that one is
    finished, so a store can be opened again by anyone and a write that broke
    off changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _versions(self, name: str) -> dict[int, bool]:
        """Numbers of the versions, each with whether it is finished."""
        fs, p = self._fs(f"{self.root}/{name}")
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        return {int(n): fs.exists(self._fs(f"{self.root}/{name}/{n}/_SUCCESS")[1]) for n in names if n.isdigit()}

    def collections(self) -> list[str]:
        """Tables that have a finished version."""
        fs, p = self._fs(self.root)
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(n for n in names if any(self._versions(n).values()))

    def read(self, name: str) -> DataFrame | None:
        done = [n for n, finished in self._versions(name).items() if finished]
        return self.spark.read.parquet(f"{self.root}/{name}/{max(done)}") if done else None

    def write(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> None:
        path = f"{self.root}/{name}/{max(self._versions(name), default=-1) + 1}"
        writer = df.write.mode("error")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)

    def drop(self, name: str) -> None:
        fs, p = self._fs(f"{self.root}/{name}")
        fs.delete(p, True)

    def retrieve(self, name: str, keys: DataFrame) -> DataFrame:
        """Rows whose key is listed."""
        return self.read(name).join(keys, keys.columns, "left_semi")

    def merge(self, name: str, new: DataFrame, key: list[str], keep_from_old: tuple[str, ...] = (), partition_by: list[str] | None = None) -> None:
        old = self.read(name)
        self.write(name, new if old is None else upsert(old, new.select(*old.columns), key, keep_from_old), partition_by)

    def delete(self, name: str, keys: DataFrame) -> None:
        """Rows whose key is listed go; a table that does not exist stays so."""
        old = self.read(name)
        if old is not None:
            self.write(name, old.join(keys, keys.columns, "left_anti"))


def index_points(store: Store, collection: str, points: DataFrame, dimension: int) -> None:
    """Upsert points ``(id, vector, metadata, dataset_ids)``; datasets of a known point are united."""
    bad = points.filter(F.size("vector") != dimension).limit(1).count()
    if bad:
        raise ValueError(f"a vector of {collection} does not have {dimension} numbers")
    new = points.select(F.lit(collection).alias("collection"), "id", "vector", "metadata", "dataset_ids")
    old = store.read("vectors")
    if old is not None:
        known = old.filter(F.col("collection") == collection).select("id", F.col("dataset_ids").alias("before"))
        new = new.join(known, "id", "left").withColumn("dataset_ids", F.array_distinct(F.concat(F.coalesce("before", F.array().cast("array<string>")), "dataset_ids"))).drop("before").select("collection", "id", "vector", "metadata", "dataset_ids")
    store.merge("vectors", new, ["collection", "id"], partition_by=["collection"])


def add_nodes(store: Store, nodes: DataFrame) -> None:
    """Upsert by id; the time of creation stays."""
    store.merge("nodes", nodes, ["id"], keep_from_old=("created_at",))


def add_edges(store: Store, edges: DataFrame) -> None:
    """Upsert by source, target and relationship."""
    store.merge("edges", edges, ["source_id", "target_id", "relationship_name"])


def delete_nodes(store: Store, ids: DataFrame) -> None:
    """Nodes and every edge that touches them."""
    store.delete("nodes", ids.select("id"))
    store.delete("edges", ids.select(F.col("id").alias("source_id")))
    store.delete("edges", ids.select(F.col("id").alias("target_id")))
