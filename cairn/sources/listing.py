"""File listings.

The primary source is a listing table (path, size, mtime in ns), as an object
store inventory or a file server dump gives it.  ``list_folder`` builds one with
Spark's own distributed listing where no such table exists.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import paths


def list_folder(spark: SparkSession, root: str) -> DataFrame:
    """List regular files below ``root`` without reading them.

    Only path, length and modification time are selected, so contents are pruned
    from the scan.  Modification times have millisecond precision here, and empty
    files and names that start with ``_`` or ``.`` are skipped; a listing table has
    none of these limits.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return found.select(
        relative_to(F.col("path"), root).alias("relative_path"),
        F.col("length").alias("size_bytes"),
        (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"),
    )


def relative_to(path, root: str):
    """Path below ``root`` of a file URI."""
    plain = F.url_decode(F.replace(F.regexp_replace(path, r"^[a-z0-9]+:/*(?=/)", ""), F.lit("+"), F.lit("%2B")))
    base = root.split("://", 1)[-1].rstrip("/")
    if base.startswith("file:"):
        base = base[len("file:") :]
    at = F.locate(base + "/", plain)
    return F.substring(plain, at + F.lit(len(base) + 1), F.length(plain))


def canonical_listing(listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with canonical paths, rejected rows with their reason)."""
    error = paths.path_error(F.col("relative_path"))
    good = listing.where(error.isNull()).withColumn("relative_path", paths.canonical_path(F.col("relative_path")))
    return good, listing.where(error.isNotNull()).withColumn("problem", error)


def pick(listing: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Listing rows of the requested paths, and requested paths the listing lacks.

    Requests are canonicalized and deduplicated first; the caller fails on a
    non-empty second result.
    """
    asked = wanted.select(paths.canonical_path(F.col("relative_path")).alias("relative_path")).distinct()
    found = listing.join(asked, on="relative_path", how="left_semi")
    return found, asked.join(listing.select("relative_path"), on="relative_path", how="left_anti")


def contents(spark: SparkSession, root: str, extensions: Sequence[str], max_bytes: int) -> DataFrame:
    """(relative_path, length, content) of files by extension; larger files keep a null content.

    The length filter is evaluated on the listing, so large files are never opened.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = relative_to(F.col("path"), root)
    ext = F.substring(paths.suffix(F.col("path")), 2, 100)
    wanted = found.where(ext.isin(*extensions))
    small = wanted.where(F.col("length") <= max_bytes).select(path.alias("relative_path"), "length", "content")
    large = wanted.where(F.col("length") > max_bytes).select(
        path.alias("relative_path"), "length", F.lit(None).cast("binary").alias("content")
    )
    return small.unionByName(large)
