"""Compare registered queries with their SQL: column names, row count and rounded values."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(out, key=repr)


def check(spark, con, name, query, sql, sf_dir):
    """None if both sides agree, else a short text."""
    df = query(spark, sf_dir)
    mine = canonical(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    theirs = canonical([c[0] for c in rel.description], rel.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} != {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"rows {len(mine[1])} != {len(theirs[1])}"
    bad = [(a, b) for a, b in zip(mine[1], theirs[1]) if a != b]
    if bad:
        return f"{len(bad)} of {len(mine[1])} rows differ\n   spark {bad[0][0]!r:.900}\n   sql   {bad[0][1]!r:.900}"
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    sql_types = {c[0]: str(c[1]) for c in con.execute(sql).description}
    odd = [n for n, t in types.items() if (t in ("int", "bigint", "double", "string", "boolean")) and
           {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}[t] != sql_types[n]]
    return f"TYPES {[(n, types[n], sql_types[n]) for n in odd]}" if odd else None


def main(sf_dir, names):
    sys.path.insert(0, str(__import__("pathlib").Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from tests.conftest import make_session

    spark, con = make_session(), connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or queries:
        start = time.time()
        try:
            if name in oracle:
                problem = check(spark, con, name, queries[name], oracle[name], sf_dir)
                n = ""
            else:
                n = queries[name](spark, sf_dir).count()
                problem = None
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:600]}"
            n = ""
        failed += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.1f}s {n} {problem or ''}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
