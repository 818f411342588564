"""Order-free content fingerprints of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fingerprint(df: DataFrame, name: str) -> DataFrame:
    """(table_name, n_rows, fingerprint): row count and the exact sum of 60-bit row hash parts.

    A sum needs no sort and merges in partial aggregates; equal multisets of rows
    give equal fingerprints on any partitioning.
    """
    row = F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    part = F.conv(F.substring(F.sha2(row, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.select(part.alias("h")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum("h"), F.lit(0)).cast("decimal(38,0)").cast("string").alias("fingerprint")
    ).select(F.lit(name).alias("table_name"), "n_rows", "fingerprint")


def catalog_fingerprint(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [fingerprint(df, name) for name, df in sorted(tables.items())]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def parity(left: dict[str, DataFrame], right: dict[str, DataFrame]) -> DataFrame:
    """Tables that differ between two catalogs, by schema, row count or content."""
    a, b = catalog_fingerprint(left), catalog_fingerprint(right)
    joined = a.join(b.select("table_name", F.col("n_rows").alias("other_rows"), F.col("fingerprint").alias("other")), on="table_name", how="full_outer")
    schema_differs = [n for n in set(left) & set(right) if left[n].dtypes != right[n].dtypes]
    problem = (
        F.when(F.col("other_rows").isNull() | F.col("n_rows").isNull(), "table missing")
        .when(F.col("table_name").isin(*schema_differs) if schema_differs else F.lit(False), "schema differs")
        .when(F.col("n_rows") != F.col("other_rows"), "row count differs")
        .when(F.col("fingerprint") != F.col("other"), "content differs")
    )
    return joined.withColumn("problem", problem).where(F.col("problem").isNotNull()).select("table_name", "n_rows", "other_rows", "problem")
