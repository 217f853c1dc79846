"""Comparing a Spark result with the DuckDB result of the same question."""

import glob
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    return round(value, 6) if isinstance(value, float) else value


def rows(columns, records):
    """Rows with columns in name order, sorted by their text."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in records), key=repr)


def difference(df, con, sql):
    """None when equal, else a short account of the difference."""
    spark_rows = rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    sql_rows = rows(columns, result.fetchall())
    if spark_rows == sql_rows:
        return None
    only_spark = [r for r in spark_rows if r not in set(sql_rows)][:2]
    only_sql = [r for r in sql_rows if r not in set(spark_rows)][:2]
    return (
        f"{sorted(columns)}\n{len(spark_rows)} vs {len(sql_rows)} rows\n"
        f"spark {only_spark!r}\nsql   {only_sql!r}"
    )
