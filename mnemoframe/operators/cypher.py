"""A reading subset of Cypher, compiled into joins of the node and edge tables.

``MATCH (a:Type {key: 'value'})-[r:REL]->(b), ... WHERE a.x = 'v' AND b.y > 3
RETURN [DISTINCT] a.name AS n, r.relationship_name, count(*) AS k
ORDER BY n [DESC] SKIP 2 LIMIT 5``

Patterns are chains of any length in any direction, several by commas; a
variable that occurs twice joins.  Conditions are SQL expressions over
properties of the variables.  Anything that writes is refused.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WRITES = re.compile(r"(?i)\b(create|merge|delete|detach|set|remove|drop|call|load|foreach)\b")
_NODE = re.compile(r"\(\s*(\w*)\s*(?::\s*(\w+))?\s*(?:\{([^}]*)\})?\s*\)")
_EDGE = re.compile(r"(<?)-(?:\[\s*(\w*)\s*(?::\s*(\w+))?\s*\])?-(>?)")
_CLAUSES = re.compile(r"(?is)^\s*match\s+(?P<match>.+?)(?:\s+where\s+(?P<where>.+?))?\s+return\s+(?P<distinct>distinct\s+)?(?P<items>.+?)(?:\s+order\s+by\s+(?P<order>.+?))?(?:\s+skip\s+(?P<skip>\d+))?(?:\s+limit\s+(?P<limit>\d+))?\s*;?\s*$")
_COUNTS = re.compile(r"(?i)\b(count|sum|avg|min|max|collect)\s*\(")


def _named(df: DataFrame, name: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{name}__{c}") for c in df.columns))


def _property(expression: str) -> str:
    """``a.b`` outside of quotes as the column that holds it."""
    parts = re.split(r"('(?:[^'\\]|\\.)*')", expression)
    return "".join(p if p.startswith("'") else re.sub(r"\b([A-Za-z_]\w*)\.(\w+)\b", r"`\1__\2`", p).replace("<>", "!=") for p in parts)


def _split(text: str) -> list[str]:
    """Parts between commas that stand in no bracket and no quotes."""
    out, depth, quoted, last = [], 0, False, 0
    for i, c in enumerate(text):
        if c == "'":
            quoted = not quoted
        elif not quoted:
            depth += (c in "([{") - (c in ")]}")
            if c == "," and not depth:
                out.append(text[last:i])
                last = i + 1
    return [p.strip() for p in [*out, text[last:]] if p.strip()]


def _pattern(text: str, nodes: DataFrame, edges: DataFrame, number: int) -> tuple[DataFrame, list[str]]:
    """Rows of one chain, with the node variables that it binds."""
    at, found, bound, k = 0, None, [], 0
    previous = edge = None
    while at < len(text):
        m = _NODE.match(text, at)
        if not m:
            raise ValueError(f"not a node pattern: {text[at:]!r}")
        name = m[1] or f"_n{number}_{k}"
        own = nodes.filter(F.col("type") == m[2]) if m[2] else nodes
        for part in _split(m[3] or ""):
            key, value = part.split(":", 1)
            own = own.filter(F.expr(f"`{key.strip()}` = {value.strip()}"))
        own = _named(own, name)
        if found is None:
            found = own
        else:
            near, far = ("source_id", "target_id") if edge[0] == ">" else ("target_id", "source_id")
            ways = edges.filter(F.col("relationship_name") == edge[2]) if edge[2] else edges
            if edge[0] == "-":  # either way
                back = ways.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), *(c for c in ways.columns if c not in ("source_id", "target_id")))
                ways, near, far = ways.unionByName(back.filter("source_id <> target_id")), "source_id", "target_id"
            r = edge[1] or f"_e{number}_{k}"
            found = found.join(_named(ways, r), F.col(f"{previous}__id") == F.col(f"{r}__{near}"))
            if name in bound:
                found = found.filter(F.col(f"{name}__id") == F.col(f"{r}__{far}")).join(own.select(f"{name}__id"), f"{name}__id", "left_semi")
            else:
                found = found.join(own, F.col(f"{name}__id") == F.col(f"{r}__{far}"))
        bound.append(name)
        previous, at, k = name, m.end(), k + 1
        if at < len(text):
            e = _EDGE.match(text, at)
            if not e:
                raise ValueError(f"not an edge pattern: {text[at:]!r}")
            edge = ("<" if e[1] else ">" if e[4] else "-", e[2], e[3])
            at = e.end()
    return found, bound


def query(nodes: DataFrame, edges: DataFrame, cypher: str) -> DataFrame:
    """Result of a reading query over ``nodes(id, type, ...)`` and ``edges(source_id, target_id, relationship_name, ...)``."""
    if _WRITES.search(re.sub(r"'(?:[^'\\]|\\.)*'", "", cypher)):
        raise ValueError("only reading queries are allowed")
    m = _CLAUSES.match(cypher)
    if not m:
        raise ValueError("expected MATCH ... RETURN ...")
    chains = [_pattern(re.sub(r"\s*(<?-|->?|-)\s*(?=[\[\(])|(?<=[\]\)])\s*(?=[-<])", lambda x: x[0].strip(), p), nodes, edges, i) for i, p in enumerate(_split(m["match"]))]

    def together(a: tuple[DataFrame, list[str]], b: tuple[DataFrame, list[str]]) -> tuple[DataFrame, list[str]]:
        same = [n for n in dict.fromkeys(b[1]) if n in a[1]]
        if not same:
            raise ValueError("patterns without a common variable would be a cross join")
        again = b[0].select(*(F.col(c).alias(f"_again_{c}") if c.split("__")[0] in same else F.col(c) for c in b[0].columns))
        on = reduce(lambda x, y: x & y, (F.col(f"{n}__id") == F.col(f"_again_{n}__id") for n in same))
        return a[0].join(again, on).drop(*(c for c in again.columns if c.startswith("_again_"))), [*a[1], *b[1]]

    found = reduce(together, chains)[0]
    if m["where"]:
        found = found.filter(F.expr(_property(m["where"])))
    items = []
    for part in _split(m["items"]):
        body, _, alias = re.match(r"(?is)^(.+?)(\s+as\s+(\w+))?$", part).groups()
        items.append((_property(body.strip()), alias or re.sub(r"\W+", "_", body.strip()).strip("_"), bool(_COUNTS.search(body))))
    column = lambda e, n: F.expr(re.sub(r"(?i)\bcollect\s*\(", "collect_list(", e)).alias(n)
    plain, counted = [column(e, n) for e, n, c in items if not c], [column(e, n) for e, n, c in items if c]
    out = found.groupBy(*plain).agg(*counted).select(*(n for _, n, _ in items)) if counted else found.select(*plain)
    if m["distinct"]:
        out = out.distinct()
    if m["order"]:
        names = {e: n for e, n, _ in items}
        keys = [re.match(r"(?is)^(.+?)(\s+desc|\s+asc)?$", k).groups() for k in _split(m["order"])]
        out = out.orderBy(*((F.desc if (way or "").strip().lower() == "desc" else F.asc)(names.get(_property(k.strip()), k.strip())) for k, way in keys))
    if m["skip"]:
        out = out.offset(int(m["skip"]))
    return out.limit(int(m["limit"])) if m["limit"] else out
