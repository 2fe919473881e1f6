"""Run registered queries and their SQL side by side: ``python tests/compare.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations"]
SPARK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "tinyint": "TINYINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _key(row):
    return tuple((v is None, "" if v is None else repr(v)) for v in row)


def difference(df, con, sql: str) -> str | None:
    """None if columns, types and rows agree; else what differs."""
    got_columns = sorted((f.name, SPARK_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString())) for f in df.schema)
    relation = con.sql(sql)
    want_columns = sorted(zip(relation.columns, [str(t) for t in relation.types]))
    if got_columns != want_columns:
        return f"columns {set(got_columns) ^ set(want_columns)}"
    names = [n for n, _ in got_columns]
    got = sorted((tuple(r[n] for n in names) for r in df.collect()), key=_key)
    want = sorted(relation.select(*[duckdb.ColumnExpression(n) for n in names]).fetchall(), key=_key)
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    for g, w in zip(got, want):
        if g != w and not all(a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, abs_tol=0)) for a, b in zip(g, w)):
            return f"row {dict(zip(names, g))}, expected {dict(zip(names, w))}"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from gatewatch.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = connect(sf_dir), oracle_sql(), 0
    for name, run in queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            if name in sqls:
                verdict = difference(run(spark, sf_dir), con, sqls[name])
            else:
                rows = run(spark, sf_dir).count()
                verdict = None if rows else "no rows"
        except Exception as error:  # noqa: BLE001
            verdict = f"{type(error).__name__}: {str(error)[:300]}"
        failed += verdict is not None
        print(f"{'ok  ' if verdict is None else 'FAIL'} {name:45s} {'sql ' if name in sqls else 'rows'} {time.time() - start:6.1f}s {verdict or ''}", flush=True)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
