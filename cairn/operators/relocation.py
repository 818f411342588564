"""Validate that a candidate root holds what the inventory expects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import paths
from cairn.operators.inventory import INVENTORY_STATUSES, MISSING, PRESENT

# Outcomes and blocker wording.
OUTCOMES = (
    "matched", "missing", "non_regular", "size_mismatch", "mtime_mismatch", "unsafe_path", "error", "invalid",
)
BLOCKER_TEXT = {
    "missing": "candidate is missing",
    "non_regular": "candidate is not a regular file",
    "size_mismatch": "size mismatch",
    "mtime_mismatch": "mtime mismatch",
    "unsafe_path": "unsafe_path: candidate path is unsafe",
    "error": "error: metadata inspection failed",
    "invalid": "invalid inventory record",
}
MAX_PROBLEMS = 100


def outcomes(records: DataFrame, listing: DataFrame, compare_mtime: bool = False) -> DataFrame:
    """Outcome of every present record against the candidate listing.

    ``listing`` may carry ``is_regular`` and ``read_error``; both default to a
    readable regular file.
    """
    regular = F.col("is_regular") if "is_regular" in listing.columns else F.lit(True)
    failed = F.col("read_error") if "read_error" in listing.columns else F.lit(False)
    actual = listing.select(
        "relative_path", F.col("size_bytes").alias("actual_size"), F.col("mtime_ns").alias("actual_mtime"),
        regular.alias("__regular"), failed.alias("__failed"), F.lit(True).alias("__there"),
    )
    present = records.where(F.col("inventory_status") == PRESENT)
    joined = present.join(actual, on="relative_path", how="left")
    invalid = F.coalesce((F.col("size_bytes") < 0) | (F.col("mtime_ns") < 0), F.lit(True))
    outcome = (
        F.when(invalid, "invalid")
        .when(paths.path_error(F.col("relative_path")).isNotNull(), "unsafe_path")
        .when(F.col("__there").isNull(), "missing")
        .when(F.col("__failed"), "error")
        .when(~F.col("__regular"), "non_regular")
        .when(F.col("actual_size") != F.col("size_bytes"), "size_mismatch")
        .when(F.lit(compare_mtime) & (F.col("actual_mtime") != F.col("mtime_ns")), "mtime_mismatch")
        .otherwise("matched")
    )
    return joined.select(
        "relative_path",
        F.col("size_bytes").alias("expected_size"), "actual_size",
        F.col("mtime_ns").alias("expected_mtime"), "actual_mtime",
        outcome.alias("outcome"),
    )


def summary(records: DataFrame, checked: DataFrame) -> DataFrame:
    """One row of exact totals; the counters cover every checked row."""

    def n(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0))

    status, outcome = F.col("inventory_status"), F.col("outcome")
    known = records.select(F.lit(True).alias("known"), "inventory_status")
    tested = checked.select(F.lit(False).alias("known"), "outcome")
    joined = known.unionByName(tested, allowMissingColumns=True).agg(
        n(F.col("known")).alias("total_records"),
        n(status == PRESENT).alias("present_records"),
        n(status == MISSING).alias("missing_records"),
        n(~F.col("known")).alias("validated"),
        *[n(outcome == o).alias(f"n_{o}") for o in OUTCOMES],
        n(outcome != "matched").alias("problems"),
    )
    remaining = F.col("present_records") - F.col("validated")
    return joined.withColumn("remaining", remaining).withColumn(
        "complete", (remaining == 0) & (F.col("n_invalid") == 0)
    )


def problems(checked: DataFrame, limit: int = MAX_PROBLEMS) -> DataFrame:
    """First problem rows by path; the counters stay exact."""
    if isinstance(limit, bool) or not isinstance(limit, int) or limit < 0:
        raise ValueError("limit must be a non-negative integer")
    return checked.where(F.col("outcome") != "matched").orderBy("relative_path").limit(limit)


def unknown_statuses(records: DataFrame) -> DataFrame:
    status = F.col("inventory_status")
    return records.where(status.isNull() | ~status.isin(*INVENTORY_STATUSES)).select("inventory_status").distinct()


def blockers(records: DataFrame, checked: DataFrame, limit: int = MAX_PROBLEMS) -> DataFrame:
    """Blocking lines: unknown statuses, the listed problems, one line for the omitted rest."""
    table = F.create_map(*[F.lit(x) for pair in BLOCKER_TEXT.items() for x in pair])
    listed = problems(checked, limit).select(
        F.concat(F.col("relative_path"), F.lit(": "), F.try_element_at(table, F.col("outcome"))).alias("blocker")
    )
    statuses = unknown_statuses(records).select(
        F.concat(F.lit("inventory record has unknown status: "), F.coalesce("inventory_status", F.lit("None"))).alias("blocker")
    )
    omitted = checked.where(F.col("outcome") != "matched").agg((F.count(F.lit(1)) - limit).alias("n")).where("n > 0").select(
        F.concat(F.col("n").cast("string"), F.lit(" additional relocation problems omitted from details")).alias("blocker")
    )
    return listed.unionByName(statuses).unionByName(omitted).distinct()


def bounded(records: DataFrame, max_records: int | None) -> DataFrame:
    """First present records by path, for a deliberately partial check."""
    present = records.where(F.col("inventory_status") == PRESENT)
    return present if max_records is None else present.orderBy("relative_path").limit(max_records)
