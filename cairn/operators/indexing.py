"""Metadata indexing: which records to read again, and what came of it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import paths
from cairn.operators.inventory import FAILED, INDEXED, MISSING, PENDING, STALE, needs_indexing


def check_parser_version(version: str | None) -> None:
    if version is None:
        return
    if not isinstance(version, str) or not version.strip() or re.search(r"[\x00-\x1f\x7f]", version):
        raise ValueError("parser_version must be a non-empty safe string")


def plan(records: DataFrame, include_failed: bool = False, parser_version: str | None = None) -> DataFrame:
    """Add ``choice``: selected, parser_stale, skipped_indexed, skipped_missing, skipped_failed.

    A null parser version is stale as soon as a version is requested.
    """
    check_parser_version(parser_version)
    status = F.col("metadata_status")
    choice = F.when(F.col("inventory_status") == MISSING, "skipped_missing")
    choice = choice.when(status.isin(PENDING, STALE), "selected")
    choice = choice.when(status == FAILED, "selected" if include_failed else "skipped_failed")
    if parser_version is None:
        choice = choice.when(status == INDEXED, "skipped_indexed")
    else:
        current = F.col("parser_version").eqNullSafe(F.lit(parser_version))
        choice = choice.when(status == INDEXED, F.when(current, "skipped_indexed").otherwise("parser_stale"))
    return records.withColumn("choice", choice)


def selected(planned: DataFrame) -> DataFrame:
    """Chosen paths with the unit that has to be scanned again.

    The unit is the top path component, the smallest folder that still holds all
    roles of a measurement.
    """
    chosen = planned.where(F.col("choice").isin("selected", "parser_stale"))
    return chosen.withColumn("scanner_unit", paths.first_component(F.col("relative_path")))


def units(planned: DataFrame) -> DataFrame:
    """One row per unit with its size; the paths are the rows of ``selected``."""
    return selected(planned).groupBy("scanner_unit").agg(
        F.count(F.lit(1)).alias("record_count"),
        F.min("relative_path").alias("first_path"),
        F.max("relative_path").alias("last_path"),
    )


def plan_counts(planned: DataFrame) -> DataFrame:
    def n(condition):
        return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0))

    choice = F.col("choice")
    taken = choice.isin("selected", "parser_stale")
    return planned.agg(
        n(taken).alias("selected_count"),
        n(choice == "selected").alias("ordinary_selected_count"),
        n((choice == "selected") & (F.col("metadata_status") == FAILED)).alias("selected_failed_count"),
        n(choice == "parser_stale").alias("parser_stale_count"),
        F.count_distinct(F.when(taken, paths.first_component(F.col("relative_path")))).alias("unit_count"),
        n(choice == "skipped_indexed").alias("skipped_indexed"),
        n(choice == "skipped_missing").alias("skipped_missing"),
        n(choice == "skipped_failed").alias("skipped_failed"),
    )


def outcome(selected_rows: DataFrame, files: DataFrame, proposals: DataFrame, unclassified: DataFrame) -> DataFrame:
    """Per selected path: indexed, failed, or unchanged (ambiguous proposal).

    ``files`` and ``proposals`` are keyed by (scanner_unit, group_key).  A path in
    any clean proposal is indexed, else a path in an ambiguous one stays as it is.
    """
    keys = ["scanner_unit", "group_key"]
    placed = files.select(*keys, "relative_path").join(proposals.select(*keys, "needs_review"), on=keys)
    per_path = placed.groupBy("relative_path").agg(F.bool_or(~F.col("needs_review")).alias("clean"))
    lost = unclassified.select("relative_path").distinct().withColumn("lost", F.lit(True))
    joined = selected_rows.select("scanner_unit", "relative_path").join(per_path, on="relative_path", how="left").join(
        lost, on="relative_path", how="left"
    )
    result = (
        F.when(F.col("clean"), INDEXED)
        .when(F.col("clean").isNull() & F.col("lost"), FAILED)
        .otherwise("unchanged")
    )
    return joined.select("scanner_unit", "relative_path", result.alias("result"))


def status_changes(outcomes: DataFrame, parser_version: str | None = None) -> DataFrame:
    """Rows for ``inventory.update_status``; the parser version goes with indexed rows only."""
    done = outcomes.where(F.col("result") != "unchanged").select("relative_path", F.col("result").alias("metadata_status"))
    return done.withColumn(
        "parser_version", F.when(F.col("metadata_status") == INDEXED, F.lit(parser_version))
    )


def readiness(records: DataFrame, parser_version: str | None = None) -> DataFrame:
    return plan_counts(plan(records, parser_version=parser_version))


__all__ = [
    "check_parser_version", "needs_indexing", "outcome", "plan", "plan_counts", "readiness", "selected",
    "status_changes", "units",
]
