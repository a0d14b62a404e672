"""Runs registered queries in Spark and their SQL in DuckDB and compares the rows."""

from __future__ import annotations

import math
import sys
import tempfile
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute(f"SET temp_directory = '{tempfile.mkdtemp(prefix='duckdb-')}'")
    con.execute("SET max_temp_directory_size = '8GB'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, bool) or value is None:
        return value
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if type(value).__name__ == "Decimal":
        return float(value)
    return value


def compare(df, con, sql: str) -> str:
    """Empty text when the rows agree, otherwise what differs."""
    left_cols = sorted(df.columns)
    left = [tuple(plain(r[c]) for c in left_cols) for r in df.collect()]
    rel = con.sql(sql)
    at = {c: i for i, c in enumerate(rel.columns)}
    if sorted(at) != left_cols:
        return f"columns {left_cols} != {sorted(at)}"
    right = [tuple(plain(r[at[c]]) for c in left_cols) for r in rel.fetchall()]
    kinds = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    odd = [c for c in left_cols if not _same_kind(df.schema[c].dataType.simpleString(), kinds[c])]
    if odd:
        return "types " + ", ".join(f"{c}: {df.schema[c].dataType.simpleString()} / {kinds[c]}" for c in odd)
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    a, b = sorted(left, key=repr), sorted(right, key=repr)
    bad = [(x, y) for x, y in zip(a, b) if repr(x) != repr(y)]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, first {left_cols}\n   spark {bad[0][0]}\n   duck  {bad[0][1]}"
    return ""


def _same_kind(spark: str, duck: str) -> bool:
    same = {
        "int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
        "date": "DATE", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT",
    }
    return same.get(spark, duck) == duck


def main() -> None:
    import __spark_entry__ as entry
    from corvane.session import build_session

    sf, names = sys.argv[1], sys.argv[2:]
    spark = build_session(
        master="local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/{sf}"
    con = connect(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in sql:
                why = compare(df, con, sql[name])
                n = len(con.sql(sql[name]).fetchall()) if why == "" else -1
            else:
                n, why = df.count(), ""
        except Exception as exc:
            n, why = -1, f"{type(exc).__name__}: {str(exc)[:1500]}"
        failed += bool(why)
        kind = "sql " if name in sql else "rows"
        print(f"{'FAIL' if why else 'ok  '} {kind} {name:24s} rows={n:<8d} {time.time() - start:6.2f}s {why}", flush=True)
        spark.catalog.clearCache()
    print("failed", failed)


if __name__ == "__main__":
    main()
