"""Batch manifests and experiment documents as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.batches import STAGES
from cairn.schemas import MANIFEST

# Manifest file names.
BATCH_FILE = r"^batch-(\d+)((?:\.[^.]+)*)\.json$"


def _named(df: DataFrame) -> DataFrame:
    name = F.url_decode(F.substring_index(F.col("_metadata.file_path"), "/", -1))
    number = F.regexp_extract(name, BATCH_FILE, 1)
    suffix = F.ltrim(F.regexp_extract(name, BATCH_FILE, 2), F.lit("."))
    stage = F.when(number == "", F.lit(None).cast("string")).when(suffix == "", "base").when(suffix.isin(*STAGES), suffix)
    return df.select(
        "*", name.alias("file_name"), F.nullif(number, F.lit("")).cast("long").alias("file_number"), stage.alias("stage")
    )


def read_manifests(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(manifest rows with ``stage`` and the number of the file name, malformed files with a reason)."""
    raw = (
        spark.read.schema(f"{MANIFEST}, _corrupt_record string")
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("pathGlobFilter", "batch-*.json")
        .json(folder)
    )
    named = _named(raw)
    problem = (
        F.when(F.col("file_number").isNull(), "unrecognized batch artifact name")
        .when(F.col("stage").isNull(), "unrecognized lifecycle artifact suffix")
        .when(F.col("_corrupt_record").isNotNull() | F.col("batch_id").isNull(), "invalid batch manifest")
    )
    marked = named.withColumn("problem", problem)
    good = marked.where(F.col("problem").isNull()).withColumn("batch_number", F.col("file_number"))
    bad = marked.where(F.col("problem").isNotNull()).select("file_name", "problem")
    return good.drop("_corrupt_record", "file_name", "file_number", "problem"), bad


def write_manifests(manifests: DataFrame, folder: str) -> None:
    """Write manifests once; an existing target fails."""
    manifests.write.mode("errorifexists").option("ignoreNullFields", "false").json(folder)


def write_documents(documents: DataFrame, folder: str) -> None:
    """One JSON line per document, never overwriting."""
    documents.write.mode("errorifexists").option("ignoreNullFields", "false").json(folder)


def read_documents(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Documents with unreadable lines kept in ``_corrupt_record``."""
    return (
        spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(folder)
    )
