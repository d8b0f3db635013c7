"""Shared pieces of queries: tables, rounding, Wilson bounds in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order give the same values."""
    return df.select(*[F.round(c, places).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes])


def wilson_sql(k: str, n: str, sign: str) -> str:
    p = f"(CAST({k} AS DOUBLE) / nullif({n}, 0))"
    bound = f"({p} + 3.8416e0 / (2 * {n}) {sign} 1.96e0 * sqrt({p} * (1 - {p}) / {n} + 3.8416e0 / (4 * CAST({n} AS DOUBLE) * {n}))) / (1 + 3.8416e0 / {n})"
    return f"coalesce(greatest(0e0, least(1e0, {bound})), 0e0)"


def rate_sql(k: str, n: str) -> str:
    """n, a, rate, lo, hi."""
    return (
        f"CAST({n} AS BIGINT) AS n, CAST({k} AS BIGINT) AS a, round(coalesce(CAST({k} AS DOUBLE) / nullif({n}, 0), 0e0), 5) AS rate, "
        f"round({wilson_sql(k, n, '-')}, 5) AS lo, round({wilson_sql(k, n, '+')}, 5) AS hi"
    )
