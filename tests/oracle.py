"""Compare registered queries with their SQL in DuckDB: `python tests/oracle.py [sf_dir] [name ...]`."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.10g}")
    return value


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    body = [tuple(_cell(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(body, key=lambda r: tuple((v is None, str(type(v)), v) for v in r))


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    theirs = rows_of([d[0] for d in result.description], result.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} != {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        extra = [r for r in mine[1] if r not in set(theirs[1])][:3] if len(mine[1]) < 20000 else []
        missing = [r for r in theirs[1] if r not in set(mine[1])][:3] if len(mine[1]) < 20000 else []
        return f"rows {len(mine[1])} != {len(theirs[1])}; only here {extra}; only there {missing}"
    for a, b in zip(mine[1], theirs[1], strict=True):
        if a != b:
            return f"{a} != {b}"
    return None


def main() -> int:
    from quarry.catalogue import ORACLES, QUERIES
    from quarry.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, con, bad = local_session(), connect(folder), 0
    for name in names:
        begun = time.time()
        try:
            df = QUERIES[name](spark, folder)
            if name in ORACLES:
                problem = compare(df, con, ORACLES[name])
                n = ""
            else:
                problem, n = None, f"{df.count()} rows only"
        except Exception as error:  # noqa: BLE001
            problem, n = f"{type(error).__name__}: {str(error)[:1500]}", ""
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok':5}{name:28}{time.time() - begun:7.2f}s {n} {problem or ''}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(main())
