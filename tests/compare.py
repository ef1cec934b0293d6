"""Run registered queries beside their SQL and compare the rows.

``python tests/compare.py [data folder] [query ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def normal(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return repr(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


KINDS = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
    "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz",
}


def spark_rows(df):
    names = sorted(df.columns)
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    rows = Counter(tuple(normal(v) for v in row) for row in df.select(*names).collect())
    return names, [types[n] for n in names], rows


def sql_rows(connection, sql):
    result = connection.execute(sql)
    described = {d[0]: str(d[1]) for d in result.description}
    names = sorted(described)
    order = [list(described).index(n) for n in names]
    rows = Counter(tuple(normal(row[i]) for i in order) for row in result.fetchall())
    return names, [KINDS.get(described[n], described[n].lower()) for n in names], rows


def difference(spark_result, sql_result) -> str | None:
    """None when equal, else what differs."""
    names, types, rows = spark_result
    sql_names, sql_types, expected = sql_result
    if names != sql_names:
        return f"columns {names} vs {sql_names}"
    if types != sql_types:
        return f"types {list(zip(names, types, sql_types))}"
    if rows != expected:
        return (f"rows {sum(rows.values())} vs {sum(expected.values())}; "
                f"only Spark {list((rows - expected).items())[:3]}; "
                f"only SQL {list((expected - rows).items())[:3]}")
    return None


def main(folder: str, names: list[str]) -> None:
    from __spark_entry__ import oracle_sql, queries
    from flowtables.session import build_session
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8",
                          spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    connection = database(folder)
    oracles = oracle_sql()
    bad = 0
    for name, function in queries().items():
        if names and name not in names:
            continue
        started = ended = time.time()
        try:
            result = spark_rows(function(spark, folder))
            ended = time.time()
            problem = (difference(result, sql_rows(connection, oracles[name]))
                       if name in oracles else f"(no SQL) {sum(result[2].values())} rows")
        except Exception as error:  # noqa: BLE001  (report and go on)
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None and not problem.startswith("(no SQL)")
        print(f"{name:28s} Spark {ended - started:6.2f}s  SQL {time.time() - ended:6.2f}s  "
              f"{problem or 'equal'}", flush=True)
    print("different:", bad)


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:])
