"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"

# Settings a deployment is expected to run with; a session that already chose
# other values keeps them.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Checkpoint files go when the plan that reads them is gone.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Call-site capture triples the cost of building large expressions in Python.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "cairn", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Checkpoint folder the cluster names; below the warehouse only where none is named.

    The fallback serves local runs.  On a cluster the setting must point at
    storage every executor reaches, so a lost executor never loses a stage cut.
    """
    context = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_SETTING, None) or context.getConf().get(CHECKPOINT_SETTING)
    if context.getCheckpointDir() is None:
        if not named and not context.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_SETTING} to a folder all executors share")
        context.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialize ``df`` in the shared folder; later plans start from the files."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
