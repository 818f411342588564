"""Edges: touching entities, resolved to paths, grouped per experiment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import ids
from cairn.functions.binding import computed

FILE = "file"
UPSTREAM, DOWNSTREAM = "upstream", "downstream"
EDGE_COLUMNS = (
    "relationship_id", "source_type", "source_id", "predicate", "target_type", "target_id", "provenance_source", "review_state",
)


def with_file_id(df: DataFrame) -> DataFrame:
    """Add ``file_id`` unless the table was stored with it."""
    if "file_id" in df.columns:
        return df
    digest = ids.file_id(F.col("storage_source_id"), F.col("relative_path"))
    return computed(df, F.struct(digest.alias("file_id")))


def with_relationship_id(edges: DataFrame) -> DataFrame:
    parts = ("source_type", "source_id", "predicate", "target_type", "target_id", "provenance_source")
    digest = ids.relationship_id(*[F.col(c) for c in parts])
    return computed(edges, F.struct(digest.alias("relationship_id")))


def file_edges(pairs: DataFrame, storage_source: str, predicate_col: str = "relation") -> DataFrame:
    """Lineage pairs of paths (``source``, ``target``) as typed relationship rows."""
    source = F.lit(storage_source)
    return with_relationship_id(
        pairs.select(
            F.lit(FILE).alias("source_type"),
            ids.file_id(source, F.col("source")).alias("source_id"),
            F.col(predicate_col).alias("predicate"),
            F.lit(FILE).alias("target_type"),
            ids.file_id(source, F.col("target")).alias("target_id"),
            F.lit(None).cast("string").alias("provenance_source"),
            F.lit("unknown").alias("review_state"),
        )
    )


def pair_edges(pairs: DataFrame) -> DataFrame:
    """``derived_from`` rows of distinct (source_id, target_id) file pairs."""
    return with_relationship_id(
        pairs.select("source_id", "target_id").distinct().select(
            F.lit(FILE).alias("source_type"), "source_id", F.lit("derived_from").alias("predicate"),
            F.lit(FILE).alias("target_type"), "target_id",
            F.lit(None).cast("string").alias("provenance_source"), F.lit("unknown").alias("review_state"),
        )
    )


def expand_members(members: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """``derived_from`` edges that member rows (experiment_id, side, file_id) stand for.

    Every upstream file of an experiment feeds every downstream one.  With ``files``
    (file_id) only edges with such an end are made, so the output follows the question
    and not the square of an experiment; without it all pairs are written out.
    """

    def side(name: str, column: str) -> DataFrame:
        return members.where(F.col("side") == name).select("experiment_id", F.col("file_id").alias(column))

    up, down = side(UPSTREAM, "source_id"), side(DOWNSTREAM, "target_id")
    if files is None:
        return pair_edges(up.join(down, on="experiment_id"))
    named = files.select("file_id").distinct()
    from_named = up.join(named.withColumnRenamed("file_id", "source_id"), on="source_id", how="left_semi").join(down, on="experiment_id")
    into_named = down.join(named.withColumnRenamed("file_id", "target_id"), on="target_id", how="left_semi").join(up, on="experiment_id")
    return pair_edges(from_named.select("source_id", "target_id").unionByName(into_named.select("source_id", "target_id")))


def edges_of_files(relationships: DataFrame, members: DataFrame, files: DataFrame) -> DataFrame:
    """Stored and member edges that touch one of ``files`` (file_id), each edge once."""
    entities = files.select(F.lit(FILE).alias("entity_type"), F.col("file_id").alias("entity_id"))
    stored = edges_touching(relationships, entities).select(*EDGE_COLUMNS)
    return stored.unionByName(expand_members(members, files).select(*EDGE_COLUMNS)).dropDuplicates(["relationship_id"])


def file_references(experiment_files: DataFrame, artifacts: DataFrame) -> DataFrame:
    """file_id -> storage reference over both file tables; the artifact row overrides."""

    def side(df: DataFrame, rank: int) -> DataFrame:
        return with_file_id(df).where(F.col("file_id").isNotNull()).select(
            "file_id", "storage_source_id", "relative_path", F.lit(rank).alias("__rank")
        )

    both = side(experiment_files, 0).unionByName(side(artifacts, 1))
    return both.groupBy("file_id").agg(
        F.max_by(F.struct("storage_source_id", "relative_path"), "__rank").alias("r")
    ).select("file_id", "r.storage_source_id", "r.relative_path")


def edges_touching(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with an end in ``entities(entity_type, entity_id)``, one row per (entity, edge).

    Two equality joins and a union instead of one join on OR, which could only be
    planned as a nested loop.  A self-edge is reported once.
    """
    wanted = entities.select("entity_type", "entity_id").distinct()

    def side(kind: str) -> DataFrame:
        keyed = relationships.withColumn("entity_type", F.col(f"{kind}_type")).withColumn(
            "entity_id", F.col(f"{kind}_id")
        )
        return keyed.join(wanted, on=["entity_type", "entity_id"])

    self_edge = (F.col("source_type") == F.col("target_type")) & (
        F.col("source_id") == F.col("target_id")
    )
    return side("source").unionByName(side("target").where(~self_edge))


def lineage_of(relationships: DataFrame, entity_type: str, entity_id: str) -> DataFrame:
    """Edges touching one entity; a plain filter, pushed to the scan."""

    def ends(kind: str):
        return (F.col(f"{kind}_type") == entity_type) & (F.col(f"{kind}_id") == entity_id)

    return relationships.where(ends("source") | ends("target"))


def resolve_edges(edges: DataFrame, references: DataFrame) -> DataFrame:
    """Add ``source_path`` and ``target_path`` where the file id is known."""
    src = references.select(F.col("file_id").alias("source_id"), F.col("relative_path").alias("source_path"))
    dst = references.select(F.col("file_id").alias("target_id"), F.col("relative_path").alias("target_path"))
    return edges.join(src, on="source_id", how="left").join(dst, on="target_id", how="left")


def experiment_lineage(experiment_files: DataFrame, relationships: DataFrame) -> DataFrame:
    """File edges with both ends in the same experiment, as (experiment, source, target, relation)."""
    files = with_file_id(experiment_files).select("experiment_id", "file_id", "relative_path").distinct()
    edges = relationships.where((F.col("source_type") == FILE) & (F.col("target_type") == FILE))
    src = files.select("experiment_id", F.col("file_id").alias("source_id"), F.col("relative_path").alias("source"))
    dst = files.select("experiment_id", F.col("file_id").alias("target_id"), F.col("relative_path").alias("target"))
    return (
        edges.join(src, on="source_id")
        .join(dst, on=["experiment_id", "target_id"])
        .select("experiment_id", "source", "target", F.col("predicate").alias("relation"))
    )


def related_files(
    experiment_files: DataFrame, lineage: DataFrame, role: str | None = None
) -> DataFrame:
    """Files of experiments with each lineage edge that contains them (null edge if none)."""
    files = experiment_files.select("experiment_id", "role", F.col("relative_path").alias("path"))
    if role is not None:
        files = files.where(F.col("role") == role)
    by_source = lineage.withColumn("path", F.col("source"))
    by_target = lineage.where(F.col("source") != F.col("target")).withColumn("path", F.col("target"))
    edges = by_source.unionByName(by_target)
    return files.join(edges, on=["experiment_id", "path"], how="left")


def artifact_derivations(
    artifacts: DataFrame, relationships: DataFrame, references: DataFrame, few: bool = False
) -> DataFrame:
    """Distinct resolved ``derived_from`` pairs per artifact; both ends must resolve.

    For whole tables each edge is resolved once and then handed to both of its
    ends.  ``few`` is for a page of artifacts: the edges are reduced to those that
    touch the page before anything is resolved.
    """
    owned = with_file_id(artifacts).where(F.col("file_id").isNotNull()).select("artifact_id", "file_id")
    edges = relationships.where(F.col("predicate") == "derived_from")
    if few:
        entities = owned.select(F.lit(FILE).alias("entity_type"), F.col("file_id").alias("entity_id"))
        edges = edges_touching(edges, entities).select(*relationships.columns).distinct()
    resolved = resolve_edges(edges, references).where(
        F.col("source_path").isNotNull() & F.col("target_path").isNotNull()
    )
    ends = F.array_compact(F.array(*[F.when(F.col(f"{s}_type") == FILE, F.col(f"{s}_id")) for s in ("source", "target")]))
    pairs = resolved.select(
        F.explode(F.array_distinct(ends)).alias("file_id"),
        F.col("source_path").alias("source"),
        F.col("target_path").alias("target"),
    ).distinct()
    return owned.join(pairs, on="file_id").drop("file_id")


def device_experiment_ids(relationships: DataFrame, device_id: str | None = None) -> DataFrame:
    """Distinct experiments measured on one device, or (device, experiment) for all."""
    edges = relationships.where(
        (F.col("source_type") == "experiment")
        & (F.col("predicate") == "measured_on")
        & (F.col("target_type") == "device")
    )
    if device_id is not None:
        edges = edges.where(F.col("target_id") == device_id)
    return edges.select(F.col("target_id").alias("device_id"), F.col("source_id").alias("experiment_id")).distinct()


def measured_on(experiments: DataFrame, relationships: DataFrame, claims: DataFrame) -> DataFrame:
    """First ``measured_on`` edge of each experiment with its first linkage claim.

    First means lowest ordinal; both sides are reduced to one row per experiment
    by ``min_by`` before the joins.
    """
    touching = relationships.where(F.col("predicate") == "measured_on")
    ends = touching.where(F.col("source_type") == "experiment").select(
        F.col("source_id").alias("experiment_id"), "*"
    ).unionByName(
        touching.where(F.col("target_type") == "experiment").select(
            F.col("target_id").alias("experiment_id"), "*"
        )
    )
    edge = ends.groupBy("experiment_id").agg(
        F.min_by(F.struct("target_id", "provenance_source", "review_state"), F.struct("ordinal", "relationship_id")).alias("e")
    )
    claim = claims.where(
        (F.col("subject_type") == "experiment") & (F.col("field") == "measured_on_device")
    ).groupBy(F.col("subject_id").alias("experiment_id")).agg(
        F.min_by(
            F.struct("evidence", "source_reference", "extraction_method", "review_status"), "ordinal"
        ).alias("c")
    )
    has_claim = F.col("c").isNotNull()
    joined = experiments.select("experiment_id").join(edge, on="experiment_id").join(claim, on="experiment_id", how="left")
    return joined.select(
        "experiment_id",
        F.col("e.target_id").alias("device_id"),
        F.when(has_claim & (F.size("c.evidence") > 0), F.array_join("c.evidence", "; "))
        .otherwise(F.lit("explicit device-directory context"))
        .alias("evidence"),
        F.when(has_claim, F.col("c.source_reference")).otherwise(F.col("e.provenance_source")).alias("source_reference"),
        F.col("c.extraction_method").alias("extraction_method"),
        F.when(has_claim, F.col("c.review_status")).otherwise(F.col("e.review_state")).alias("review_status"),
    )


def claims_of(claims: DataFrame, subject_type: str | None = None, subject_id: str | None = None, field: str | None = None) -> DataFrame:
    """Provenance claims of a subject, optionally of one field."""
    out = claims
    for name, value in (("subject_type", subject_type), ("subject_id", subject_id), ("field", field)):
        if value is not None:
            out = out.where(F.col(name) == value)
    return out


def review_evidence(claims: DataFrame, field: str = "measured_on_raw_match") -> DataFrame:
    """Human-review claims of experiments in recording order, one row per claim."""
    chosen = claims_of(claims, subject_type="experiment", field=field)
    return chosen.select(
        F.col("subject_id").alias("experiment_id"),
        "ordinal", "field", "value_json", "source_type", "source_reference", "extraction_method",
        "category", "evidence", "review_status",
    )


def latest_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
