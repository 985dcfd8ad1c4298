"""Run registered queries against their SQL and report differences.

    python -m catalog.check SF_DIR [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

SPARK_TO_SQL = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value.hex()
    return value


def bag(rows, columns, order):
    at = [columns.index(c) for c in order]
    return sorted((tuple(normal(r[i]) for i in at) for r in rows), key=repr)


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def differences(spark, con, sf_dir: str, query, sql: str) -> list[str]:
    """Empty when the query and the SQL agree in columns, types and every value."""
    result = query(spark, sf_dir)
    rows = [tuple(r) for r in result.collect()]
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    expected = cursor.fetchall()
    if sorted(columns) != sorted(result.columns):
        return [f"columns {result.columns} but SQL has {columns}"]
    found = []
    for field in result.schema.fields:
        wanted = SPARK_TO_SQL.get(field.dataType.simpleString())
        if wanted != types[field.name]:
            found.append(f"{field.name}: {field.dataType.simpleString()} / {types[field.name]}")
    order = sorted(columns)
    ours, theirs = bag(rows, result.columns, order), bag(expected, columns, order)
    if len(ours) != len(theirs):
        found.append(f"{len(ours)} rows but SQL has {len(theirs)}")
    pairs = [(a, b) for a, b in zip(ours, theirs, strict=False) if a != b]
    if pairs:
        found.append(f"{len(pairs)} rows differ, e.g. {order}: {pairs[0][0]} / {pairs[0][1]}")
    return found


def main(argv: list[str]) -> int:
    from catalog.oracles import all_oracles
    from catalog.queries import all_queries
    from stepwell import get_spark

    sf_dir, wanted = argv[0], argv[1:]
    spark = get_spark("check", master="local[8]", spark__sql__shuffle__partitions="8")
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, failed = connect(sf_dir), all_oracles(), 0
    for name, query in all_queries().items():
        if wanted and name not in wanted:
            continue
        start = time.perf_counter()
        found = differences(spark, con, sf_dir, query, oracles[name])
        failed += bool(found)
        print(f"{'FAIL' if found else 'ok':4} {time.perf_counter() - start:6.2f}s {name}", *found)
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
