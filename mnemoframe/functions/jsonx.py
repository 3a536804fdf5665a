"""JSON and time helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def display_value(json: Column, path: str) -> Column:
    """A scalar as trimmed text; null for null, blank, arrays and objects."""
    value = F.trim(F.get_json_object(json, path))
    return F.when(~value.rlike(r"^[\[{]"), F.nullif(value, F.lit("")))


def is_dlt(metadata: Column, depth: int = 4) -> Column:
    """``source`` is ``dlt`` at the top or under nested item metadata."""
    path, out = "$", F.lit(False)
    for _ in range(depth):
        out = out | (F.coalesce(F.get_json_object(metadata, f"{path}.source"), F.lit("")) == "dlt")
        path += ".data_item_external_metadata"
    return out


def indexed_fields(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def drop_status(status: Column, dataset: str) -> Column:
    """A JSON status map without one dataset's key."""
    return F.to_json(F.map_filter(F.from_json(status, "map<string,string>"), lambda k, _: k != dataset))


def edge_weights(weight: Column, weights: Column, properties: Column) -> Column:
    """Weight map of an edge: the plain weight as ``default``, the map, and ``weight_*`` properties."""
    plain = F.when(weight.isNotNull(), F.map_from_arrays(F.array(F.lit("default")), F.array(weight)))
    extra = F.map_filter(F.transform_values(properties, lambda k, v: v.try_cast("double")), lambda k, v: k.startswith("weight_") & v.isNotNull())
    extra = F.transform_keys(extra, lambda k, v: F.substring(k, 8, 1000))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    parts = [F.map_entries(F.coalesce(m, empty)) for m in (plain, weights, extra)]
    merged = F.concat(*parts)
    return F.map_from_entries(F.filter(merged, lambda e, i: ~F.exists(F.slice(merged, i + 2, F.size(merged)), lambda later: later["key"] == e["key"])))


def epoch_ms(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """Milliseconds since 1970 in UTC; null for a date that does not exist."""
    return F.unix_millis(F.try_make_timestamp(year, month, day, hour, minute, second))


def audit_timestamp(value: Column) -> Column:
    """A number of epoch milliseconds, or an ISO time; null for anything else."""
    return F.coalesce(F.timestamp_millis(value.try_cast("bigint")), F.try_to_timestamp(value))


def in_interval(at: Column, low: Column, high: Column) -> Column:
    """Closed at both ends, open where a bound is null."""
    return (low.isNull() | (at >= low)) & (high.isNull() | (at <= high))
