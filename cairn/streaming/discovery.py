"""Resumable first-time discovery of files.

Each run handles at most ``max_files`` files per micro-batch and remembers its
place in the stream checkpoint, so an interrupted run goes on where it stopped.
A micro-batch writes to a folder named by generation and batch id; a retry of the
same batch overwrites its own output and never doubles a row.

The file source reports a path once and leaves out empty files.  Changed, restored and missing files need
the full comparison in ``operators.inventory``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairn.operators import inventory, sessions
from cairn.schemas import INVENTORY
from cairn.sources.listing import relative_to

BINARY_FILES = "path string, modificationTime timestamp, length long, content binary"


def discovered_files(spark: SparkSession, root: str, max_files: int) -> DataFrame:
    """Stream of (relative_path, size_bytes, mtime_ns); contents are not read."""
    if isinstance(max_files, bool) or not isinstance(max_files, int) or max_files <= 0:
        raise ValueError("max_files must be a positive integer")
    files = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILES)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files)
        .load(root)
    )
    return files.select(
        relative_to(F.col("path"), root).alias("relative_path"),
        F.col("length").alias("size_bytes"),
        (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"),
    )


def batch_records(batch: DataFrame, session_id: str, generation: int, now_utc: str, prior: DataFrame | None = None) -> DataFrame:
    """Inventory rows of the files of one batch, compared with the stored records of the same paths."""
    known = batch.sparkSession.createDataFrame([], INVENTORY) if prior is None else prior
    own = known.join(batch.select("relative_path"), on="relative_path", how="left_semi")
    return inventory.reconcile(own, batch, session_id, generation, now_utc, complete=False)


def write_batch(
    batch: DataFrame, batch_id: int, output: str, session_id: str, generation: int, now_utc: str, prior: DataFrame | None = None
) -> None:
    """Write the rows of one batch to the folder of its generation and id; a replay overwrites it with the same rows."""
    rows = batch_records(batch, session_id, generation, now_utc, prior)
    rows.write.mode("overwrite").parquet(f"{output}/generation={generation}/batch={batch_id}")


def start_discovery(
    spark: SparkSession,
    root: str,
    output: str,
    checkpoint: str,
    session_id: str,
    generation: int,
    now_utc: str,
    max_files: int,
    prior: DataFrame | None = None,
) -> StreamingQuery:
    """Run until the present files are handled, then stop by itself.

    ``prior`` must be a stored table that the run does not change.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, batch_id, output, session_id, generation, now_utc, prior)

    return (
        discovered_files(spark, root, max_files)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _written(spark: SparkSession, output: str, generation: int | str) -> DataFrame:
    return spark.read.schema(f"{INVENTORY}, outcome string").parquet(f"{output}/generation={generation}/batch=*")


def discovered_counters(spark: SparkSession, output: str, generation: int) -> DataFrame:
    """Counters of a session over all its batches, from what they wrote; a replayed batch counts once."""
    rows = _written(spark, output, generation).withColumn("__batch", F.regexp_extract(F.input_file_name(), r"/batch=(\d+)/", 1))
    return inventory.scan_counters(rows, F.count_distinct("__batch").alias("batches"))


def finish(spark: SparkSession, prior: DataFrame, output: str, generation: int, now_utc: str, errors: int = 0) -> DataFrame:
    """The whole inventory after a session: its rows over the prior ones, and missing files if nothing went wrong."""
    fresh = _written(spark, output, generation)
    kept = prior.join(fresh.select("relative_path"), on="relative_path", how="left_anti").withColumn("outcome", F.lit("still_absent"))
    both = fresh.unionByName(kept)
    return (both if errors else sessions.mark_unseen(both, generation, now_utc)).drop("outcome")


def read_discovered(spark: SparkSession, output: str) -> DataFrame:
    """All discovered records, newest generation of a path first come first kept."""
    return inventory.latest_records(_written(spark, output, "*"))
