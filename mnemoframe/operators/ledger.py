"""Sessions, datasets, provenance and deletion over relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.functions.fixed import ABANDON_SECONDS, RUN_GAP_MS
from mnemoframe.session import materialize


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6


def effective_status(status: Column, last: Column, as_of: Column) -> Column:
    """A running session idle for longer than the threshold counts as abandoned."""
    return F.when((status == "running") & (seconds_between(last, as_of) > ABANDON_SECONDS), F.lit("abandoned")).otherwise(status)


def visible(sessions: DataFrame, user: Column, datasets: list[str] | None = None, since: Column | None = None) -> DataFrame:
    """A user's own sessions and those of permitted datasets, active since a time."""
    test = F.col("user_id") == user
    if datasets:
        test = test | F.col("dataset_id").isin(*datasets)
    out = sessions.filter(test)
    return out if since is None else out.filter(F.col("last_activity_at") >= since)


def totals(sessions: DataFrame) -> DataFrame:
    """One row: sessions, tokens, cost, durations, status counts and success rate."""
    seconds = F.greatest(F.lit(0.0), seconds_between(F.col("started_at"), F.coalesce("ended_at", "last_activity_at")))
    count = lambda s: F.count_if(F.col("status") == s)
    decided = count("completed") + count("failed") + count("abandoned")
    return sessions.agg(
        F.count("*").alias("sessions"),
        F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"),
        F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 4).alias("cost_usd"),
        F.round(F.sum(seconds), 3).alias("total_seconds"),
        F.round(F.avg(seconds), 3).alias("avg_seconds"),
        count("completed").alias("completed"),
        count("failed").alias("failed"),
        count("abandoned").alias("abandoned"),
        count("running").alias("running"),
        F.round(F.when(decided > 0, count("completed") / decided).otherwise(1.0), 6).alias("success_rate"),
    )


def cost_by_model(usage: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions, tokens and cost of each model; a null model is ``unknown``."""
    joined = usage.join(sessions.select("session_id", "user_id"), ["session_id", "user_id"])
    return joined.groupBy(F.coalesce("model", F.lit("unknown")).alias("model")).agg(
        F.count_distinct("session_id").alias("sessions"), F.sum("tokens_in").alias("tokens_in"), F.round(F.sum("cost_usd"), 4).alias("cost_usd")
    )


def accumulate_usage(usage: DataFrame, deltas: DataFrame, running: DataFrame) -> DataFrame:
    """Add the deltas of running sessions to the usage per session, user and model; all-zero deltas change nothing."""
    live = deltas.join(running.select("session_id", "user_id").distinct(), ["session_id", "user_id"], "left_semi").filter("tokens_in <> 0 or cost_usd <> 0")
    return usage.unionByName(live.select(*usage.columns)).groupBy("session_id", "user_id", "model").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("cost_usd").alias("cost_usd"))


def page(df: DataFrame, allowed: list[str], order_by: str, default: str, descending: bool, offset: int, limit: int, tie: str) -> DataFrame:
    """One page of a listing; an unknown sort column falls back to the default."""
    column = F.col(order_by if order_by in allowed else default)
    return df.orderBy(column.desc() if descending else column.asc(), tie).offset(offset).limit(limit)


def last_n(df: DataFrame, by: list[str], n: int, *newest: Column) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*newest))).filter(F.col("_r") <= n).drop("_r")


def batches(df: DataFrame, by: list[str], size: int, *order: Column) -> DataFrame:
    """Fixed-size batches of a timeline: adds ``batch_no`` and ``place``."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return df.withColumn("_at", at).withColumn("batch_no", F.floor(F.col("_at") / size).cast("int")).withColumn("place", F.col("_at") % size).drop("_at")


def gap_sessions(df: DataFrame, by: list[str], at_ms: str, tie: str, gap_ms: int = RUN_GAP_MS) -> DataFrame:
    """Clusters of rows whose distance to the member before is at most the gap; rows without a time join cluster 0."""
    w = Window.partitionBy(*by).orderBy(F.asc_nulls_last(at_ms), tie)
    new = F.when(F.col(at_ms) - F.lag(at_ms).over(w) > gap_ms, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("cluster", F.when(F.col(at_ms).isNull(), F.lit(0)).otherwise(F.sum("_new").over(w))).drop("_new")


def modal(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Most frequent value of each group, of equals the first by name."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("n"), value)).alias(value), F.max("n").alias("n"))


def unique_to_data(rows: DataFrame, key: list[str]) -> DataFrame:
    """Ledger rows of a data item whose slug no other item of the dataset has."""
    owners = rows.groupBy("dataset_id", *key).agg(F.min("data_id").alias("_a"), F.max("data_id").alias("_b"))
    return rows.join(owners.filter("_a = _b").drop("_a", "_b"), ["dataset_id", *key], "left_semi")


def deletable(links: DataFrame, targets: DataFrame) -> DataFrame:
    """Data of the targets ``(dataset_id, data_id)`` that no dataset outside the targets still links."""
    rest = links.join(targets, ["dataset_id", "data_id"], "left_anti")
    return targets.select("data_id").distinct().join(rest.select("data_id").distinct(), "data_id", "left_anti")


def scope_rows(rows: DataFrame, datasets: DataFrame) -> DataFrame:
    """Rows with a membership list ``dataset_ids`` (or one ``dataset_id``) split over the wanted datasets."""
    member = F.explode(F.coalesce("dataset_ids", F.array("dataset_id")))
    return rows.withColumn("dataset", member).join(datasets.select(F.col("dataset_id").alias("dataset")), "dataset", "left_semi")


def _ranges(df: DataFrame, *order: str) -> DataFrame:
    """``df`` written in range partitions of an order, with the partition's number ``_p``; later partitions hold larger keys."""
    return materialize(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")


def _before(parts: DataFrame, amount: str) -> DataFrame:
    """``(_p, _before)``: sum of the amounts of all earlier partitions; one row a partition."""
    return parts.select("_p", F.coalesce(F.sum(amount).over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))


def percentile_lower(df: DataFrame, value: str, p: float) -> DataFrame:
    """Value at the index ``floor(p * (n - 1))`` of the sorted finite numbers, 0 if there is none.

    Values are counted and range partitioned; only sums per partition are
    brought together, so neither values nor rows meet in one task.
    """
    finite = df.filter(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    counts = _ranges(finite.groupBy(value).agg(F.count("*").alias("c")), value)
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
    before = _before(counts.groupBy("_p").agg(F.sum("c").alias("c")), "c")
    upto = counts.join(F.broadcast(before), "_p").withColumn("upto", F.sum("c").over(Window.partitionBy("_p").orderBy(value)) + F.col("_before"))
    at = F.floor(F.lit(p) * (F.col("n") - 1)) + 1
    return upto.crossJoin(F.broadcast(total)).filter(F.col("upto") >= at).agg(F.coalesce(F.min(value), F.lit(0.0)).alias("threshold"))


def gap_clusters(df: DataFrame, at_ms: str, tie: str, gap_ms: int = RUN_GAP_MS) -> DataFrame:
    """Like ``gap_sessions`` over all rows at once: ranges of time are clustered apart and then numbered through."""
    timed = _ranges(df.filter(F.col(at_ms).isNotNull()), at_ms, tie)
    ends = timed.groupBy("_p").agg(F.max(at_ms).alias("hi")).select("_p", F.lag("hi").over(Window.orderBy("_p")).alias("_last"))
    w = Window.partitionBy("_p").orderBy(at_ms, tie)
    new = F.when(F.col(at_ms) - F.coalesce(F.lag(at_ms).over(w), F.col("_last")) > gap_ms, 1).otherwise(0)
    marked = timed.join(F.broadcast(ends), "_p").withColumn("_new", new)
    before = _before(marked.groupBy("_p").agg(F.sum("_new").alias("k")), "k")
    out = marked.join(F.broadcast(before), "_p").withColumn("cluster", F.sum("_new").over(w) + F.col("_before"))
    return out.select(*df.columns, "cluster").unionByName(df.filter(F.col(at_ms).isNull()).withColumn("cluster", F.lit(0).cast("long")))
