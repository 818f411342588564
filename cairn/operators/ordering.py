"""Exact positions at scale.

``row_number`` over a window sends a whole key to one task; a key that holds a
third of the rows then sorts a third of the rows in one place.  The operator
below spreads every key over range partitions instead:

1. range-partition by (keys, order) and cut the lineage, so that the partition
   number of a row is stored data and survives a retry unchanged;
2. number the rows inside each (partition, key);
3. keys that span several partitions get the row counts of their earlier
   partitions added.  Each range border can split one key only, so this offset
   table never has more rows than twice the number of partitions, which bounds
   the broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import cut_lineage

SLICE = "__slice"


def position_within(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "ordinal"
) -> DataFrame:
    """Add the 0-based position of each row inside its key; ``order`` must be total.

    With no keys this is the global rank.
    """
    sort_cols = [*keys, *order]
    # No fixed count: adaptive execution merges neighbouring ranges by size, which keeps their order.
    ranged = df.repartitionByRange(*[F.col(c) for c in sort_cols])
    sliced = cut_lineage(ranged.withColumn(SLICE, F.spark_partition_id()))

    local = Window.partitionBy(SLICE, *keys).orderBy(*order)
    numbered = sliced.withColumn("__local", F.row_number().over(local) - 1)

    sizes = sliced.groupBy(SLICE, *keys).agg(F.count(F.lit(1)).alias("__n"))
    if keys:
        spread = sizes.groupBy(*keys).agg(F.count(F.lit(1)).alias("__slices")).where("__slices > 1")
        same = [sizes[k].eqNullSafe(spread[k]) for k in keys]
        sizes = sizes.join(spread, on=same, how="left_semi")
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col(SLICE).alias("__o_slice"),
        *[F.col(k).alias(f"__o_{k}") for k in keys],
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
    )
    match = [numbered[SLICE] == offsets["__o_slice"]]
    match += [numbered[k].eqNullSafe(offsets[f"__o_{k}"]) for k in keys]
    joined = numbered.join(F.broadcast(offsets), on=match, how="left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        (F.col("__local") + F.coalesce(F.col("__before"), F.lit(0))).cast("long").alias(name),
    )


def page(df: DataFrame, order: Sequence, limit: int, offset: int = 0) -> DataFrame:
    """One ordered page; Spark plans this as a top-k, not as a full sort."""
    return df.orderBy(*order).offset(offset).limit(limit)
