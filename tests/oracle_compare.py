"""Run catalogue queries next to their SQL: python tests/oracle_compare.py [root] [name ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(root: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{root}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=lambda row: [(v is None, str(v)) for v in row])


def differences(df, con, sql) -> list[str]:
    rel = con.sql(sql)
    if sorted(rel.columns) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(rel.columns)}"]
    mine = canonical([tuple(r) for r in df.collect()], df.columns)
    theirs = canonical(rel.fetchall(), rel.columns)
    if len(mine) != len(theirs):
        return [f"{len(mine)} rows != {len(theirs)}"]
    found = [f"{a} != {b}" for a, b in zip(mine, theirs) if a != b or str(a) != str(b)]
    types = dict(zip(rel.columns, map(str, rel.types)))
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    found += [f"type of {n}: {t} != {types[n]}" for n, t in df.dtypes if kinds.get(t) != types[n]]
    return found


def main() -> None:
    import __spark_entry__ as entry
    from tidepanel.session import local_session

    root = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    queries, sql = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(root), []
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, root)
            found = differences(df, con, sql[name]) if name in sql else []
            note = "" if name in sql else f"(rows only: {df.count()})"
        except Exception as error:  # noqa: BLE001
            found, note = [f"{type(error).__name__}: {str(error)[:1500]}"], ""
        bad += [name] if found else []
        print(f"{'FAIL' if found else 'ok  '} {name} {time.time() - start:.1f}s {note}", flush=True)
        for line in found[:4]:
            print("     ", line[:600])
    print("failed:", bad)


if __name__ == "__main__":
    main()
