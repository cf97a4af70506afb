"""Profiles of a result: one pass for all columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile(df: DataFrame) -> DataFrame:
    """One row per column: type, nulls, approximate distinct values, least and greatest."""
    stats = []
    for c in df.columns:
        x = F.col(f"`{c}`").cast("string")
        stats.append(F.struct(F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("type"), F.count("*").alias("rows"), F.count(F.when(x.isNull(), 1)).alias("nulls"), F.approx_count_distinct(x).alias("distinct_values"), F.min(x).alias("min"), F.max(x).alias("max")))
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("value").asc_nulls_last()).limit(k)


def schema_context(tables: dict[str, DataFrame], samples: int = 0) -> str:
    """Tables as text, for a prompt or a page: name, rows, columns with types, and a few rows if asked."""
    out = []
    for name, df in sorted(tables.items()):
        out.append(f"{name} ({df.count()} rows): " + ", ".join(f"{c} {k}" for c, k in df.dtypes))
        out += ["  " + " | ".join("null" if v is None else str(v) for v in r) for r in df.limit(samples).collect()] if samples else []
    return "\n".join(out)
