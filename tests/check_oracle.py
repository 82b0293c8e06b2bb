"""Compare registered queries with their DuckDB texts: python tests/check_oracle.py DIR [names]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from boxoffice.plans.queries import QUERIES  # noqa: E402
from boxoffice.session import local_session  # noqa: E402
from duckdb_texts.queries import ORACLE  # noqa: E402


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted((tuple(map(str, r)) for r in df.select(*names).collect()))


def rows_of_duckdb(con, text):
    cur = con.execute(text)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    rows = sorted(tuple(str(r[i]) for i in order) for r in cur.fetchall())
    return [names[i] for i in order], rows


def compare(spark, con, name: str, sf_dir: str) -> str | None:
    """None when both agree, else what differs."""
    names, got = rows_of_spark(QUERIES[name](spark, sf_dir))
    want_names, want = rows_of_duckdb(con, ORACLE[name])
    if names != want_names:
        return f"columns {names} != {want_names}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:2]
        missing = [r for r in want if r not in set(got)][:2]
        return f"{len(got)} rows, expected {len(want)}; extra {extra}; missing {missing}"
    return None


if __name__ == "__main__":
    sf_dir, picked = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark, con = local_session(), connect(sf_dir)
    for name in picked:
        start = time.time()
        try:
            problem = compare(spark, con, name, sf_dir)
        except Exception as error:  # noqa: BLE001 - a report, not a program
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s", flush=True)
        if problem:
            print("     ", problem, flush=True)
