"""Running a registered query beside its SQL and comparing the rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, Row, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def plain(x: object) -> object:
    if isinstance(x, Row | dict):
        return tuple((k, plain(v)) for k, v in sorted((x.asDict() if isinstance(x, Row) else x).items()))
    if isinstance(x, list | tuple):
        return tuple(plain(v) for v in x)
    if isinstance(x, bytearray | bytes):
        return bytes(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if type(x).__name__ == "Decimal":
        return float(f"{float(x):.9g}")
    return x


def spark_rows(df: DataFrame) -> tuple[list[str], Counter]:
    cols = sorted(df.columns)
    return cols, Counter(tuple(plain(r[c]) for c in cols) for r in df.select(*cols).collect())


def duck_rows(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = Path(f"{sf_dir}/{t}.parquet")
        if p.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{f'{p}/*.parquet' if p.is_dir() else p}')")
    rel = con.sql(sql)
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    return sorted(rel.columns), Counter(tuple(plain(r[i]) for i in order) for r in rel.fetchall())


def differences(df: DataFrame, sql: str, sf_dir: str) -> str:
    """Empty if the rows agree, else the first ones that don't."""
    (a_cols, a), (b_cols, b) = spark_rows(df), duck_rows(sql, sf_dir)
    if a_cols != b_cols:
        return f"columns: {a_cols} against {b_cols}"
    only_a, only_b = a - b, b - a
    if not only_a and not only_b:
        return ""
    show = lambda c: sorted(map(repr, c))[:3]
    return f"{sum(a.values())} and {sum(b.values())} rows; {sum(only_a.values())} and {sum(only_b.values())} differ: {show(only_a)} | {show(only_b)}"


def session() -> SparkSession:
    return (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
