"""Documents as one dataset keyed by proposal and target path.

``write_archives`` writes every job exactly once: a row holds either the document or
the reason it was refused, so outputs and failures come from one write and cannot
disagree.  Documents are read back from what was written, and a row that
cannot be read, or does not say what its proposal says, is a failure too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import documents as build

DUPLICATE, UNKNOWN = "collision: duplicate output target", "missing experiment for proposal"
BROKEN = "archive read-back failed"


@dataclass(frozen=True)
class Generated:
    """Verified outputs (proposal_id, output_path, output_relative_path), failures (proposal_id, problem), and the documents read."""

    outputs: DataFrame
    failures: DataFrame
    documents: DataFrame

    def counts(self) -> DataFrame:
        """One row: jobs requested, succeeded, failed."""
        both = self.outputs.select(F.lit(1).alias("good")).unionByName(self.failures.select(F.lit(0).alias("good")))
        return both.agg(
            F.count(F.lit(1)).alias("jobs_requested"),
            F.coalesce(F.sum("good"), F.lit(0)).alias("jobs_succeeded"),
            F.coalesce(F.sum(1 - F.col("good")), F.lit(0)).alias("jobs_failed"),
        )


def source_path(folder: str) -> Column:
    return F.concat(F.lit(folder.rstrip("/") + "/"), F.col("output_relative_path"))


def write_archives(documents: DataFrame, jobs: DataFrame, folder: str, existing: DataFrame | None = None) -> None:
    """Write all jobs below ``folder``, which must not exist.

    A job is refused when its target is claimed by an earlier proposal id, is already
    in the listing ``existing`` of the output root, or its proposal has no document.
    Rows are clustered by target path.
    """
    first = jobs.groupBy("output_relative_path").agg(F.min("proposal_id").alias("__first"))
    named = jobs.select("proposal_id", "output_relative_path").distinct().join(first, on="output_relative_path")
    if existing is None:
        named = named.withColumn("__taken", F.lit(False))
    else:
        taken = existing.select(F.col("relative_path").alias("output_relative_path"), F.lit(True).alias("__taken")).distinct()
        named = named.join(taken, on="output_relative_path", how="left")
    joined = named.join(documents.select("proposal_id", "data"), on="proposal_id", how="left")
    problem = (
        F.when(F.col("__taken"), "collision: output target already exists")
        .when(F.col("proposal_id") != F.col("__first"), DUPLICATE)
        .when(F.col("data").isNull(), UNKNOWN)
    )
    rows = joined.select("output_relative_path", "proposal_id", F.when(problem.isNull(), F.col("data")).alias("data"), problem.alias("problem"))
    rows.repartitionByRange("output_relative_path").write.mode("errorifexists").option("ignoreNullFields", "false").json(folder)


def read_archives(spark: SparkSession, folder: str, data_type: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with ``source_path``, refused rows, unreadable lines) of a written dataset."""
    schema = f"output_relative_path string, proposal_id string, data {data_type}, problem string, _corrupt_record string"
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").json(folder).withColumn("source_path", source_path(folder))
    broken = F.col("_corrupt_record").isNotNull() | F.col("proposal_id").isNull()
    read = rows.where(~broken & F.col("problem").isNull())
    refused = rows.where(~broken & F.col("problem").isNotNull()).select("proposal_id", "problem")
    return read.drop("problem"), refused, rows.where(broken).select("_corrupt_record")


def generate(documents: DataFrame, jobs: DataFrame, proposals: DataFrame, folder: str, existing: DataFrame | None = None) -> Generated:
    """Write, read back and verify; a job counts as done only when its document says what its proposal says."""
    write_archives(documents, jobs, folder, existing)
    return verify(jobs.sparkSession, jobs, proposals, folder, documents.schema["data"].dataType.simpleString())


def verify(spark: SparkSession, jobs: DataFrame, proposals: DataFrame, folder: str, data_type: str) -> Generated:
    """Outputs and failures of what lies in ``folder``; a job without a readable row failed its read-back."""
    read, refused, _ = read_archives(spark, folder, data_type)
    expected = proposals.join(read.select("proposal_id"), on="proposal_id", how="left_semi")
    differs = build.readback_problems(read, expected)
    told = refused.unionByName(differs)
    asked = jobs.select("proposal_id").distinct()
    lost = asked.join(read.select("proposal_id"), on="proposal_id", how="left_anti").join(
        refused.select("proposal_id"), on="proposal_id", how="left_anti"
    )
    failures = told.unionByName(lost.withColumn("problem", F.lit(BROKEN)))
    good = read.join(differs.select("proposal_id"), on="proposal_id", how="left_anti")
    outputs = good.select("proposal_id", F.col("source_path").alias("output_path"), "output_relative_path")
    return Generated(outputs, failures, read)
