"""Versioned catalog store.

Each rebuild writes all tables below a folder of its own and then commits a version
number that names the folder.  Readers take the highest committed version, so they
see a whole rebuild or none of it, and a failed rebuild leaves nothing visible.
Writers are optimistic: each works from the version it has read, and of two that
reach the same number one commits and the other has to start over from the new
version.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from cairn.operators.lineage import with_file_id
from cairn.schemas import CATALOG, CLUSTER_BY

COMMIT_SCHEMA = "version long, folder string, note string"
# Tables that catalogs written before them lack.
ADDED_LATER = ("derivations", "unresolved_links")


def _commits(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema(COMMIT_SCHEMA).json(f"{root}/commits/*")
    except AnalysisException as error:
        # Anything else must not look like an empty catalog: the next write would start over.
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def current_version(spark: SparkSession, root: str) -> int:
    """Highest committed version, 0 when there is none."""
    commits = _commits(spark, root)
    return 0 if commits is None else commits.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]


def shape(df: DataFrame, table: str) -> DataFrame:
    """Project to the table's schema; missing columns become null."""
    if table in ("experiment_files", "artifacts"):
        df = with_file_id(df)
    fields = [f.strip() for f in _split_schema(CATALOG[table])]
    pairs = [f.split(" ", 1) for f in fields]
    return df.select(
        *[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in pairs]
    )


def _split_schema(text: str) -> list[str]:
    depth, start, out = 0, 0, []
    for i, ch in enumerate(text):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]


@dataclass(frozen=True)
class Staged:
    """A written but invisible version: the number it may take and the folder it lies in."""

    version: int
    folder: str


class CommitConflict(RuntimeError):
    """Another writer has committed this version number first."""


def stage_catalog(spark: SparkSession, root: str, tables: dict[str, DataFrame], base: int | None = None) -> Staged:
    """Write all tables as the version after ``base`` without making it visible.

    ``base`` is the version the tables were made from (default: the current one).
    Every attempt has a folder of its own, so writers never touch each other's
    files.  Rows are range-clustered by the lookup column, so point lookups prune row groups.
    """
    missing = set(CATALOG) - set(tables)
    if missing:
        raise ValueError(f"catalog tables missing: {', '.join(sorted(missing))}")
    version = (current_version(spark, root) if base is None else base) + 1
    staged = Staged(version, f"versions/{version}-{uuid.uuid4().hex}")
    for name in CATALOG:
        key = CLUSTER_BY[name]
        shaped = shape(tables[name], name)
        shaped.repartitionByRange(F.col(key)).sortWithinPartitions(key).write.parquet(f"{root}/{staged.folder}/{name}")
    return staged


def commit_catalog(spark: SparkSession, root: str, staged: Staged, note: str = "") -> None:
    """Make a staged version the current one.

    The record's name is the version number and it is created only if absent, so of
    two writers of one number the second gets ``CommitConflict`` and changes nothing.
    """
    record = json.dumps({"version": staged.version, "folder": staged.folder, "note": note})
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(f"{root}/commits/{staged.version}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(path):
        raise CommitConflict(f"version {staged.version} of {root} is taken")
    try:
        out = files.create(path, False)
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in error.java_exception.getClass().getName():
            raise
        raise CommitConflict(f"version {staged.version} of {root} is taken") from None
    out.write(bytearray(record.encode()))
    out.close()


def _folder(spark: SparkSession, root: str, version: int) -> str:
    commits = _commits(spark, root)
    found = None if commits is None else commits.where(F.col("version") == version).first()
    if found is None:
        raise FileNotFoundError(f"version {version} is not committed below {root}")
    return found["folder"] or f"versions/{version}"


def read_folder(spark: SparkSession, root: str, folder: str) -> dict[str, DataFrame]:
    """The tables in one folder; a table younger than the folder is empty."""
    out = {}
    for name, schema in CATALOG.items():
        try:
            out[name] = spark.read.schema(schema).parquet(f"{root}/{folder}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND" or name not in ADDED_LATER:
                raise
            out[name] = spark.createDataFrame([], schema)
    return out


def read_catalog(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """All tables of one committed version."""
    chosen = current_version(spark, root) if version is None else version
    if chosen == 0:
        raise FileNotFoundError(f"no committed catalog below {root}")
    return read_folder(spark, root, _folder(spark, root, chosen))
