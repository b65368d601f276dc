"""Compare a Spark result with its SQL twin; also a command-line check.

    python tests/compare.py [--sf 0.01 | --dir folder] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN",
}


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


def differences(df, con, sql: str) -> list[str]:
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    kinds = {d[0]: str(d[1]) for d in rel.description}
    rows = rel.fetchall()
    errs = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    for name, kind in df.dtypes:
        want = TYPES.get(kind, kind)
        if kinds[name] != want and rows:
            errs.append(f"type {name}: spark {kind}, sql {kinds[name]}")
    order = sorted(names)
    ours = Counter(tuple(_cell(r[c]) for c in order) for r in df.collect())
    theirs = Counter(tuple(_cell(v) for _, v in sorted(zip(names, r, strict=True))) for r in rows)
    if sum(ours.values()) != sum(theirs.values()):
        errs.append(f"rows: spark {sum(ours.values())}, sql {sum(theirs.values())}")
    if ours != theirs:
        errs.append(f"columns {order}")
        errs += [f"only spark: {r}" for r in list((ours - theirs).elements())[:3]]
        errs += [f"only sql:   {r}" for r in list((theirs - ours).elements())[:3]]
    return errs


def main() -> int:
    import __spark_entry__ as entry
    from marketlens.session import build_session

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--dir", help="an input folder instead of a test scale")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    folder = args.dir or f"/root/testdata/sf{args.sf}"
    spark = build_session(
        "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    picked = [q for q in queries if not args.names or any(q == n or (n.endswith("*") and q.startswith(n[:-1])) for n in args.names)]
    bad, slow = [], []
    for name in picked:
        t = time.time()
        try:
            df = queries[name](spark, folder)
            if name not in oracle:
                n = df.count()
                errs = [] if n else ["no rows (no SQL twin)"]
                kind = f"rows only: {n}"
            else:
                errs = differences(df, con, oracle[name])
                kind = "ok"
        except Exception as e:  # report every query
            errs = [f"{type(e).__name__}: {str(e)[:600]}"]
        took = time.time() - t
        slow.append((took, name))
        if errs:
            bad.append(name)
            print(f"FAIL {name} ({took:.2f}s)", *errs, sep="\n    ")
        elif args.names:
            print(f"{kind} {name} ({took:.2f}s)")
    missing = sorted(set(oracle) - set(queries))
    print(f"{len(picked) - len(bad)}/{len(picked)} agree on {folder}; unregistered SQL: {missing}")
    print("slowest:", [(n, round(t, 1)) for t, n in sorted(slow, reverse=True)[:8]])
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
