"""Run catalog queries against their SQL in DuckDB: python tests/oracle_check.py SF_DIR [name ...]"""

import datetime
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    if isinstance(value, bool):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, connection, sf_dir, query, sql):
    """Problem text or None, with the row count."""
    df = query(spark, sf_dir)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    want = normal(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}", len(got)
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    same |= {"date": "DATE", "timestamp_ntz": "TIMESTAMP"}
    relation = connection.sql(sql)
    kinds = dict(zip(relation.columns, map(str, relation.types)))
    off = {n: (t, kinds[n]) for n, t in df.dtypes if same.get(t) != kinds[n]}
    if off:
        return f"types differ: {off}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first:\n  {bad[0][0]}\n  {bad[0][1]}", len(got)
    return None, len(got)


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    import logging

    logging.disable(logging.CRITICAL)
    spark.sparkContext.setLogLevel("OFF")
    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    connection = connect(sf_dir)
    oracles, failed = entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in oracles:
                problem, rows = compare(spark, connection, sf_dir, query, oracles[name])
            else:
                problem, rows = None, len(query(spark, sf_dir).collect())
        except Exception as error:
            problem, rows = f"{type(error).__name__}: {str(error)[:1500]}", 0
        failed += problem is not None
        kind = "sql" if name in oracles else "rows only"
        print(f"{'ok ' if problem is None else 'BAD'} {name} {rows} {kind} {time.time() - start:.1f}s", flush=True)
        if problem:
            print("   ", problem, flush=True)
    print("failed:", failed)
