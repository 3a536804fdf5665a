"""Runs a query on Spark and its SQL on DuckDB and compares the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings graph_node graph_edge entity_results memories messages cognee_data_record cognee_add_result vector_points vector_collections eval_items".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)):
        return None if math.isnan(v) else float(v) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def compare(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty if the results agree, else what differs."""
    df = query(spark, sf_dir)
    ours = df.collect()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    theirs = Counter(tuple(plain(dict(zip(names, r))[n]) for n in order) for r in cur.fetchall())
    mine = Counter(tuple(plain(r[n]) for n in order) for r in ours)
    if mine != theirs:
        return f"{sum(mine.values())} and {sum(theirs.values())} rows; only ours {list((mine - theirs).items())[:4]}; only theirs {list((theirs - mine).items())[:4]}"
    return ""


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from mnemoframe.session import get_session

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    spark = get_session("oracle")
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle, bad = connect(sf), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        began = time.time()
        try:
            said = compare(spark, con, query, oracle[name], sf) if name in oracle else f"(no SQL) {query(spark, sf).count()} rows"
        except Exception as e:  # noqa: BLE001
            said = f"ERROR {str(e)[:600]}"
        bad += bool(said) and not said.startswith("(no SQL)")
        print(f"{name}: {said or 'equal'} [{time.time() - began:.1f} s]", flush=True)
    print(f"{bad} differ")
