"""Run registered queries against their SQL: ``python tests/compare.py [folder] [names...]``."""

from __future__ import annotations

import math
import sys
import tempfile
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ["customer", "orders", "events", "documents", "embeddings", "pages", "benchmark", "labels"]


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        files = f"{path}/*.parquet" if path.is_dir() else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{files}')")
    return con


def normal(value):
    """Python value of either engine in one form; floats by their exact digits."""
    if value is None:
        return None
    if isinstance(value, bool):
        return int(value)
    if hasattr(value, "is_integer") and not isinstance(value, int):
        number = float(value)
        return "nan" if math.isnan(number) else number
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        ([normal(row[i]) for i in order] for row in rows), key=lambda row: [(v is None, str(type(v)), v if v is not None else 0) for v in row]
    )


def difference(spark_df, con, sql) -> str | None:
    """None if rows, names and values agree, else the first difference."""
    result = con.execute(sql)
    sql_names = [d[0] for d in result.description]
    sql_types = {d[0]: str(d[1]) for d in result.description}
    expected = rows_of(sql_names, result.fetchall())
    actual = rows_of(spark_df.columns, [tuple(row) for row in spark_df.collect()])
    if sorted(sql_names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(sql_names)}"
    if len(actual) != len(expected):
        return f"{len(actual)} rows, expected {len(expected)}"
    bad = [(a, e) for a, e in zip(actual, expected) if a != e]
    if bad:
        return f"{len(bad)} rows differ, first {bad[0][0]} != {bad[0][1]}"
    kinds = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}
    odd = {n: (t, sql_types[n]) for n, t in spark_df.dtypes if kinds.get(t) != sql_types[n]}
    return f"types {odd}" if odd else None


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from patronlens.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con, sql = local_session(tempfile.mkdtemp(prefix="compare-"), 8), connect(folder), oracle_sql()
    for name, query in queries().items():
        if wanted and name not in wanted:
            continue
        started = time.monotonic()
        try:
            df = query(spark, folder)
            if name in sql:
                found = difference(df, con, sql[name]) or "ok"
            else:
                found = f"no SQL, {len(df.collect())} rows"
        except Exception as error:  # noqa: BLE001
            found = f"FAILED {type(error).__name__}: {str(error)[:600]}"
        print(f"{name:28s} {time.monotonic() - started:6.2f}s  {found}", flush=True)


if __name__ == "__main__":
    main()
