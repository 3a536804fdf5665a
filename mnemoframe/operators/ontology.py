"""Ontologies as triples ``(s, p, o)``: reading, look-up, fuzzy match, attached subgraph."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemoframe.functions import ids
from mnemoframe.functions.fixed import MATCH_THRESHOLD
from mnemoframe.session import hinted, materialize

RDF, RDFS, OWL = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#"
_TOKEN = re.compile(r'"""(?:.|\n)*?"""|"(?:[^"\\]|\\.)*"(?:@[A-Za-z-]+|\^\^\S+)?|<[^>]*>|@prefix|@base|#[^\n]*|[;,.](?=\s|$)|[^\s;,<>"]+(?<![.;,])')


def parse_turtle(text: str) -> list[tuple[str, str, str]]:
    """Triples of a Turtle text: prefixes, ``a``, ``;`` and ``,`` lists; blank node brackets are not read."""
    prefixes, out, parts = {}, [], []
    subject = predicate = None
    tokens = [t for t in _TOKEN.findall(text) if not t.startswith("#")]

    def name(t: str) -> str:
        if t.startswith("<"):
            return t[1:-1]
        if t.startswith('"'):
            return t
        if t == "a":
            return RDF + "type"
        prefix, _, local = t.partition(":")
        return prefixes.get(prefix, prefix + ":") + local

    i = 0
    while i < len(tokens):
        t = tokens[i]
        if t.lower() in ("@prefix", "prefix"):
            prefixes[tokens[i + 1].rstrip(":")] = tokens[i + 2][1:-1]
            i += 4 if i + 3 < len(tokens) and tokens[i + 3] == "." else 3
            continue
        if t == ".":
            subject = predicate = None
        elif t == ";":
            predicate = None
        elif t != ",":
            if subject is None:
                subject = name(t)
            elif predicate is None:
                predicate = name(t)
            else:
                out.append((subject, predicate, name(t)))
        i += 1
    return out


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """Triples of all Turtle files under a path."""
    files = spark.read.text(path, wholetext=True)

    def run(batches):
        for batch in batches:
            yield pd.DataFrame([t for text in batch.value for t in parse_turtle(text)], columns=["s", "p", "o"])

    return files.mapInPandas(run, "s string, p string, o string")


def lookup(triples: DataFrame) -> DataFrame:
    """``(key, uri, category)``: classes, and individuals of any class."""
    kind = triples.filter(F.col("p") == RDF + "type")
    classes = kind.filter(F.col("o") == OWL + "Class").select(F.col("s").alias("uri")).unionByName(triples.filter(F.col("p") == RDFS + "subClassOf").select(F.explode(F.array("s", "o")).alias("uri"))).distinct()
    individuals = kind.join(hinted(classes.withColumnRenamed("uri", "o")), "o", "left_semi").select(F.col("s").alias("uri")).distinct().join(classes, "uri", "left_anti")
    both = classes.withColumn("category", F.lit("Classes")).unionByName(individuals.withColumn("category", F.lit("Individuals")))
    return both.select(ids.uri_to_key(F.col("uri")).alias("key"), "uri", "category")


def _matching(a: bytes, b: bytes) -> int:
    """Characters in the longest common block, and in those before and behind it."""
    total, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        size = start_a = start_b = 0
        lengths: dict[int, int] = {}
        for i in range(a0, a1):
            row: dict[int, int] = {}
            for j in range(b0, b1):
                if a[i] == b[j]:
                    k = row[j] = lengths.get(j - 1, 0) + 1
                    first = (i - k + 1, j - k + 1)
                    # of equally long blocks the first in a, then in b
                    if k > size or (k == size and first < (start_a, start_b)):
                        size, start_a, start_b = k, *first
            lengths = row
        if size:
            total += size
            todo += [(a0, start_a, b0, start_b), (start_a + size, a1, start_b + size, b1)]
    return total


def ratio(a: str, b: str) -> float:
    """Gestalt similarity over bytes: twice the matched characters over all characters."""
    x, y = a.encode(), b.encode()
    return 2.0 * _matching(x, y) / (len(x) + len(y)) if x or y else 1.0


def gestalt(a: Column, b: Column) -> Column:
    @F.pandas_udf(T.DoubleType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else ratio(p.lower(), q.lower()) for p, q in zip(x, y)], dtype="float64")

    return run(a, b)


def closest(names: DataFrame, candidates: DataFrame, threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """``(name, candidate, similarity)``: the exact match without case, else the most similar at the threshold or above.

    ``candidates`` is ``(candidate, seq)``: an ontology's look-up, of equals the first wins.
    """
    exact = names.join(candidates, F.lower("name") == F.lower("candidate")).groupBy("name").agg(F.min_by("candidate", "seq").alias("candidate")).withColumn("similarity", F.lit(1.0))
    # two texts can only reach the threshold if their lengths are near each other
    a, b = F.octet_length("name"), F.octet_length("candidate")
    near = names.join(exact, "name", "left_anti").join(hinted(candidates), 2.0 * F.least(a, b) >= threshold * (a + b))
    scored = near.withColumn("similarity", gestalt(F.col("name"), F.col("candidate"))).filter(F.col("similarity") >= threshold)
    scored = materialize(scored, "scored")
    top = scored.groupBy("name").agg(F.max("similarity").alias("similarity"))
    best = scored.join(top, ["name", "similarity"]).groupBy("name").agg(F.min_by("candidate", "seq").alias("candidate"), F.max("similarity").alias("similarity"))
    return exact.unionByName(best)


def attached(triples: DataFrame, starts: DataFrame, directed: bool = True, most: int = 50) -> DataFrame:
    """Edges ``(source, relationship, target)`` reachable from the start URIs.

    Types and super-classes are followed as ``is_a``; object properties by
    their name, against their direction as well if ``directed`` is false.
    """
    properties = triples.filter((F.col("p") == RDF + "type") & (F.col("o") == OWL + "ObjectProperty")).select(F.col("s").alias("p"))
    up = triples.filter(F.col("p").isin(RDF + "type", RDFS + "subClassOf")).filter(~F.col("o").startswith('"')).select("s", F.lit("is_a").alias("rel"), "o", F.lit(True).alias("forward"))
    links = triples.join(hinted(properties), "p", "left_semi").filter(~F.col("o").startswith('"')).select("s", ids.uri_to_key(F.col("p")).alias("rel"), "o", F.lit(True).alias("forward"))
    steps = up.unionByName(links)
    moves = steps.select(F.col("s").alias("at"), F.col("o").alias("to"), "s", "rel", "o")
    if not directed:
        moves = moves.unionByName(links.select(F.col("o").alias("at"), F.col("s").alias("to"), "s", "rel", "o"))
    moves = materialize(moves, "moves")
    seen = materialize(starts.select("uri").distinct(), "seen")
    border = seen
    for _ in range(most):
        border = materialize(moves.join(border.select(F.col("uri").alias("at")), "at", "left_semi").select(F.col("to").alias("uri")).distinct().join(seen, "uri", "left_anti"), "border")
        if border.isEmpty():
            break
        seen = materialize(seen.unionByName(border), "seen")
    used = moves.join(seen.select(F.col("uri").alias("at")), "at", "left_semi")
    return used.select(ids.uri_to_key(F.col("s")).alias("source"), F.col("rel").alias("relationship"), ids.uri_to_key(F.col("o")).alias("target")).distinct()


def canonical(nodes: DataFrame, matches: DataFrame) -> DataFrame:
    """Nodes renamed to their match, with the identifier that follows from the new name."""
    joined = nodes.join(matches.select("name", "candidate"), "name", "left")
    return joined.select(F.when(F.col("candidate").isNotNull(), ids.data_point_id("Entity", F.col("candidate"))).otherwise(F.col("id")).alias("id"), F.coalesce("candidate", "name").alias("name"), F.col("candidate").isNotNull().alias("ontology_valid"))
