"""Deterministic identifiers as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemoframe.functions.fixed import OID_NAMESPACE


def uuid5(text: Column, namespace: str = OID_NAMESPACE) -> Column:
    """Version-5 UUID of a string; null for null."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(text, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def uuid5_sql(text: str) -> str:
    """The same in DuckDB's SQL."""
    h = f"sha1(unhex('{OID_NAMESPACE}') || encode({text}))"
    variant = f"CASE substr({h}, 17, 1) WHEN '0' THEN '8' WHEN '4' THEN '8' WHEN '8' THEN '8' WHEN 'c' THEN '8' WHEN '1' THEN '9' WHEN '5' THEN '9' WHEN '9' THEN '9' WHEN 'd' THEN '9' WHEN '2' THEN 'a' WHEN '6' THEN 'a' WHEN 'a' THEN 'a' WHEN 'e' THEN 'a' ELSE 'b' END"
    return f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || {variant} || substr({h}, 18, 3) || '-' || substr({h}, 21, 12))"


def normalize_identifier(text: Column) -> Column:
    return F.replace(F.replace(F.lower(text), F.lit(" "), F.lit("_")), F.lit("'"), F.lit(""))


def node_name(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("'"), F.lit(""))


edge_name = normalize_identifier


def node_id(text: Column) -> Column:
    return uuid5(normalize_identifier(text))


def data_point_id(class_name: str, *values: Column) -> Column:
    """Identifier of a typed data point: its class and its normalised values."""
    joined = reduce(lambda a, b: F.concat(a, F.lit("|"), b), [normalize_identifier(v) for v in values])
    return uuid5(F.concat(F.lit(f"{class_name}:"), joined))


def data_id(content_hash: Column, user: Column, tenant: Column) -> Column:
    return uuid5(F.concat(content_hash, user, F.coalesce(tenant, F.lit("None"))))


dataset_id = data_id


def provenance_node_id(tenant: Column, user: Column, dataset: Column, data: Column, node: Column) -> Column:
    return uuid5(F.concat(F.coalesce(tenant, F.lit("None")), user, dataset, data, node))


def provenance_edge_id(tenant: Column, user: Column, dataset: Column, source: Column, text: Column, target: Column) -> Column:
    return uuid5(F.concat(F.coalesce(tenant, F.lit("None")), user, dataset, source, text, target))


def triplet_slug(source: Column, relationship: Column, target: Column) -> Column:
    return uuid5(normalize_identifier(F.concat(source, relationship, target)))


def web_page_id(url: Column) -> Column:
    return uuid5(F.concat(F.lit("WebPage:"), url))


def web_site_id(domain: Column) -> Column:
    return uuid5(F.concat(F.lit("WebSite:"), domain))


def learning_id(statement: Column) -> Column:
    return uuid5(F.concat(F.lit("TruthLearning:"), F.trim(F.regexp_replace(F.lower(statement), r"\s+", " "))))


def stable_signature(ids: Column) -> Column:
    """SHA-256 of ids joined by a vertical bar, in the order given."""
    return F.sha2(F.array_join(ids, "|"), 256)


def uri_to_key(uri: Column) -> Column:
    return F.replace(F.lower(F.regexp_extract(uri, r"([^#/]*)$", 1)), F.lit(" "), F.lit("_"))
