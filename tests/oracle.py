"""Compare registered queries with their SQL; also a command: ``python tests/oracle.py [dir] [names]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def expected(sql: str, sf_dir: str) -> pd.DataFrame:
    with duckdb.connect() as connection:
        for name in TABLES:
            connection.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
        return connection.execute(sql).df()


def _canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].astype(object)
    rows = [tuple(None if pd.isna(v) else v for v in row) for row in frame.itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def difference(found: pd.DataFrame, wanted: pd.DataFrame) -> str | None:
    """``None`` if both hold the same rows, else the first difference."""
    if sorted(found.columns) != sorted(wanted.columns):
        return f"columns {sorted(found.columns)} instead of {sorted(wanted.columns)}"
    if len(found) != len(wanted):
        return f"{len(found)} rows instead of {len(wanted)}"
    names = sorted(found.columns)
    for name in names:
        kinds = found[name].dtype.kind, wanted[name].dtype.kind
        if len(found) and kinds[0] != kinds[1]:
            return f"{name} is {found[name].dtype} instead of {wanted[name].dtype}"
    for a, b in zip(_canonical(found), _canonical(wanted)):
        if a != b:
            return f"{a} instead of {b} in {names}"
    return None


def main() -> int:
    from tests.conftest import make_session

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = make_session()
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in sys.argv[2:] or list(queries):
        start = time.time()
        try:
            found = queries[name](spark, sf_dir).toPandas()
            if name in oracles:
                problem = difference(found, expected(oracles[name], sf_dir))
            else:
                problem = None if len(found) else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        checked = "sql " if name in oracles else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {checked} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
