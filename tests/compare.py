"""Run registered queries and their SQL twins on the same parquet and compare all values.

    python tests/compare.py /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("set threads to 4")
    for name in TABLES:
        connection.execute(
            f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')"
        )
    return connection


def _plain(value):
    if value is None or isinstance(value, (str, bool)):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 4)
    if isinstance(value, int):
        return value
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def differences(spark_frame, connection, sql: str) -> str | None:
    """What differs between a Spark result and a SQL result; None if nothing does."""
    left_columns, left = rows_of(spark_frame.columns, [tuple(r) for r in spark_frame.collect()])
    cursor = connection.execute(sql)
    names = [column[0] for column in cursor.description]
    right_columns, right = rows_of(names, cursor.fetchall())
    if left_columns != right_columns:
        return f"columns {left_columns} != {right_columns}"
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)} rows"
    for mine, other in zip(left, right):
        if [type(v) for v in mine] != [type(v) for v in other] or mine != other:
            return f"{mine} != {other}"
    return None


def main(sf_dir: str, only: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from tests.conftest import local_session

    spark = local_session()
    connection = oracle_connection(sf_dir)
    sql = oracle_sql()
    bad = 0
    for name, query in queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            frame = query(spark, sf_dir)
            if name in sql:
                found = differences(frame, connection, sql[name])
            else:
                found = f"no SQL ({frame.count()} rows)"
        except Exception as error:  # report and go on with the next query
            found = f"{type(error).__name__}: {str(error)[:600]}"
        bad += found is not None
        print(f"{name:32s} {time.time() - start:6.2f}s  {found or 'ok'}", flush=True)
    print(f"{bad} not equal")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
