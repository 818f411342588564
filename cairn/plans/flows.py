"""End-to-end flows: listing to catalog, catalog linkage, indexing, documents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import paths
from cairn.functions.filename import METADATA_FIELDS
from cairn.functions.gates import ELECTRICAL_SCALARS
from cairn.operators import fingerprint, indexing, inventory, lineage, linkage, proposals, quality
from cairn.operators.devices import append_absent
from cairn.operators.merging import ROLES
from cairn.operators.ordering import position_within
from cairn.session import cut_lineage
from cairn.sources.catalog import CommitConflict, commit_catalog, current_version, read_catalog, read_folder, shape, stage_catalog

PROPOSAL_KEYS = (
    *METADATA_FIELDS, *ELECTRICAL_SCALARS, "fixed_gate_values", "gate_constraints", "electrical_connections",
    "metadata_provenance", "unresolved_metadata", "unresolved_relationships", "needs_review",
)


def assemble_catalog(
    listing: DataFrame,
    experiment_ids: DataFrame,
    storage_source: str,
    parser_version: str | None = None,
    devices: DataFrame | None = None,
    artifacts: DataFrame | None = None,
    device_claims: DataFrame | None = None,
    relationships: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Catalog tables from a scan and explicit experiment ids.

    ``experiment_ids(group_key, experiment_id)`` names every proposal; ids are
    never inferred, and proposals without one are left out (``missing_ids``).
    """
    spark = listing.sparkSession
    result = proposals.scan(listing)
    edges, unresolved = proposals.lineage(result.files)
    named = cut_lineage(proposals.import_proposals(result, unresolved).join(experiment_ids, on="group_key"))
    experiments = named.withColumns(
        {
            "metadata_keys": F.array(*[F.lit(k) for k in PROPOSAL_KEYS]),
            "roles": F.array(*[F.lit(r) for r in ROLES]),
            "review_state": F.lit("unknown"),
            "parser_version": F.lit(parser_version),
        }
    )
    rank = F.coalesce(*[F.when(F.col("role") == r, i) for i, r in enumerate(ROLES)])
    owned = result.files.join(experiment_ids, on="group_key").select(
        "experiment_id", rank.alias("role_rank"), "role", F.lit(storage_source).alias("storage_source_id"), "relative_path"
    )
    files = position_within(owned, ["experiment_id"], ["role_rank", "relative_path"]).drop("role_rank")
    claims = proposals.provenance(named, ["experiment_id"]).select(
        F.lit("experiment").alias("subject_type"), F.col("experiment_id").alias("subject_id"), F.col("ordinal").cast("long"),
        "field", "value_json", "source_type", F.col("source").alias("source_reference"), F.col("method").alias("extraction_method"),
        F.array().cast("array<string>").alias("evidence"), F.lit("unknown").alias("review_status"),
    )
    chosen = edges.join(experiment_ids, on="group_key", how="left_semi").select("source", "target", "relation")
    open_links = proposals.unresolved_candidates(result.files, unresolved).join(experiment_ids, on="group_key")
    own_edges = lineage.file_edges(chosen, storage_source).withColumn("ordinal", F.lit(None).cast("long"))

    def given(df: DataFrame | None, table: str) -> DataFrame:
        from cairn.schemas import CATALOG

        return spark.createDataFrame([], CATALOG[table]) if df is None else shape(df, table)

    return {
        "experiments": shape(experiments, "experiments"),
        "experiment_files": shape(files, "experiment_files"),
        "devices": given(devices, "devices"),
        "artifacts": given(artifacts, "artifacts"),
        "metadata_claims": shape(claims, "metadata_claims").unionByName(given(device_claims, "metadata_claims")),
        "relationships": number_edges(shape(own_edges, "relationships").unionByName(given(relationships, "relationships"))),
        "derivations": given(None, "derivations"),
        "unresolved_links": shape(open_links, "unresolved_links"),
    }


def missing_ids(listing: DataFrame, experiment_ids: DataFrame) -> DataFrame:
    """Proposals of a listing that no explicit id names."""
    groups = proposals.classified_files(listing).select("group_key").distinct()
    return groups.join(experiment_ids, on="group_key", how="left_anti")


def number_edges(relationships: DataFrame) -> DataFrame:
    """Edge ordinals in id order, ranked over range partitions."""
    return position_within(relationships.drop("ordinal"), [], ["relationship_id"])


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """All catalog rules as (entity, entity_id, rule); commit only when this is empty."""
    t = tables
    known = quality.endpoints(t["experiments"], t["devices"], t["artifacts"], t["experiment_files"])
    parts = [
        quality.experiment_violations(t["experiments"]), quality.device_violations(t["devices"]),
        quality.artifact_violations(t["artifacts"]), quality.claim_violations(t["metadata_claims"]),
        quality.relationship_violations(t["relationships"]),
    ]
    for table, key in (("experiments", "experiment_id"), ("devices", "device_id"), ("artifacts", "artifact_id"), ("relationships", "relationship_id")):
        twice = quality.duplicate_ids(t[table], key, table)
        parts.append(twice.select("entity", "entity_id", F.lit("duplicate id").alias("rule")))
    pairs = quality.duplicate_device_pairs(t["devices"])
    parts.append(
        pairs.select(
            F.lit("devices").alias("entity"), F.concat_ws("/", "maker_namespace", "local_device_id").alias("entity_id"),
            F.lit("duplicate qualified identity").alias("rule"),
        )
    )
    ends = quality.dangling_endpoints(t["relationships"], known)
    parts.append(ends.select(F.lit("relationship").alias("entity"), F.col("relationship_id").alias("entity_id"), F.concat("side", F.lit(" end is "), "problem").alias("rule")))
    lost = quality.dangling_artifacts(t["artifacts"], t["devices"], t["experiments"])
    parts.append(lost.select(F.lit("artifact").alias("entity"), F.col("artifact_id").alias("entity_id"), F.concat("reference", F.lit(" does not exist")).alias("rule")))
    foreign = quality.foreign_claims(t["metadata_claims"], known)
    parts.append(foreign.select(F.lit("claim").alias("entity"), F.concat_ws("/", "subject_type", "subject_id").alias("entity_id"), F.lit("subject does not exist").alias("rule")))
    unowned = t["derivations"].join(t["experiments"].select("experiment_id"), on="experiment_id", how="left_anti")
    stray = t["unresolved_links"].join(t["experiments"].select("experiment_id"), on="experiment_id", how="left_anti")
    parts.append(stray.select(F.lit("unresolved link").alias("entity"), F.col("source").alias("entity_id"), F.lit("experiment does not exist").alias("rule")))
    parts.append(unowned.select(F.lit("derivation").alias("entity"), F.col("file_id").alias("entity_id"), F.lit("experiment does not exist").alias("rule")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def replace_catalog(spark: SparkSession, root: str, tables: dict[str, DataFrame], note: str = "", base: int | None = None) -> int:
    """Write the version after ``base``, validate what was written, then commit it.

    The rules read the staged files instead of computing the tables again; a
    version that breaks a rule stays invisible and its violations are raised by rule.
    """
    staged = stage_catalog(spark, root, tables, base)
    bad = violations(read_folder(spark, root, staged.folder)).groupBy("entity", "rule").agg(
        F.count(F.lit(1)).alias("n"), F.min("entity_id").alias("first")
    ).sort("entity", "rule").collect()
    if bad:
        told = "; ".join(f"{r['n']} {r['entity']} ({r['rule']}), first {r['first']}" for r in bad)
        raise ValueError(f"catalog is not valid: {told}")
    commit_catalog(spark, root, staged, note)
    return staged.version


def update_catalog(
    spark: SparkSession, root: str, change: Callable[[dict[str, DataFrame]], dict[str, DataFrame]], note: str = "", attempts: int = 3
) -> int:
    """Apply ``change`` to the current version and commit the result.

    A writer that loses the race reads the winner's version, applies the change to
    it, and validates again; after ``attempts`` losses the conflict is raised.
    """
    for left in range(attempts, 0, -1):
        base = current_version(spark, root)
        try:
            return replace_catalog(spark, root, change(read_catalog(spark, root, base)), note, base)
        except CommitConflict:
            if left == 1:
                raise
    raise ValueError("attempts must be positive")


@dataclass(frozen=True)
class Applied:
    tables: dict[str, DataFrame]
    counts: DataFrame


def apply_linkage(tables: dict[str, DataFrame], linked: linkage.Linked, reviewed: DataFrame | None = None) -> Applied:
    """Replace all derived rows of a catalog by a new linkage.

    Rows derived earlier are recognized by their parser version, their plain edges by
    being made again from the files they hold; rows of other origin win over new
    rows with the same key.  Applying twice gives the same catalog.
    """
    old = tables["experiments"].where(F.col("parser_version").startswith(linkage.PARSER_PREFIX)).select("experiment_id")
    old_files = lineage.with_file_id(tables["experiment_files"]).join(old, on="experiment_id", how="left_semi")
    old_parents = linkage.parent_edges(old_files.withColumn("stem", paths.stem(F.col("relative_path"))))

    def without(df: DataFrame, column: str, gone: DataFrame) -> DataFrame:
        named = gone.select(F.col(gone.columns[0]).alias(column))
        return df.join(named, on=column, how="left_anti")

    base_experiments = without(tables["experiments"], "experiment_id", old)
    base_files = without(tables["experiment_files"], "experiment_id", old)
    claims = tables["metadata_claims"]
    base_claims = claims.where(F.col("subject_type") != "experiment").unionByName(
        without(claims.where(F.col("subject_type") == "experiment"), "subject_id", old)
    )
    edges = tables["relationships"]
    is_file_edge = (F.col("predicate") == "derived_from") & (F.col("source_type") == "file") & (F.col("target_type") == "file")
    file_edges = without(edges.where(is_file_edge), "relationship_id", old_parents.select("relationship_id"))
    measured = without(edges.where(F.col("predicate") == "measured_on"), "source_id", old)
    other = edges.where(~is_file_edge & (F.col("predicate") != "measured_on"))
    base_edges = other.unionByName(measured).unionByName(file_edges)

    keys = F.array(*[F.lit(k) for k in (*METADATA_FIELDS, *ELECTRICAL_SCALARS, "fixed_gate_values", "gate_constraints", "electrical_connections", "device_id", "directory_context")])
    present = F.array_compact(F.array(*[F.when(F.col(f"n_{r}") > 0, F.lit(r)) for r in ROLES]))
    new_experiments = shape(linked.experiments.withColumns({"metadata_keys": keys, "roles": present}), "experiments")
    rank = F.coalesce(*[F.when(F.col("role") == r, i) for i, r in enumerate(ROLES)])
    ordered = position_within(
        linked.files.withColumn("role_rank", rank), ["experiment_id"], ["role_rank", "relative_path", "storage_source_id"]
    )
    new_files = shape(ordered.withColumn("ordinal", F.col("ordinal") + 1), "experiment_files")
    new_claims = linkage.measured_on_claims(linked.experiments).withColumn("__rank", F.lit(1))
    if reviewed is not None:
        new_claims = new_claims.unionByName(linkage.reviewed_claims(linked, reviewed).withColumn("__rank", F.lit(2)))
    last = base_claims.groupBy("subject_type", "subject_id").agg(F.max("ordinal").alias("__last"))
    # Positions, not ranks: an experiment may hold several reviewed raw files.
    placed = position_within(new_claims.drop("ordinal"), ["subject_type", "subject_id"], ["__rank", "field", "value_json", "source_reference"])
    numbered = placed.withColumnRenamed("ordinal", "__place").join(last, on=["subject_type", "subject_id"], how="left").withColumn(
        "ordinal", (F.coalesce("__last", F.lit(0)) + F.col("__place") + 1).cast("long")
    )
    new_edges = shape(
        linkage.measured_on_edges(linked.experiments).unionByName(linkage.parent_edges(linked.files)), "relationships"
    )
    fresh_edges = new_edges.join(base_edges.select("relationship_id"), on="relationship_id", how="left_anti")
    out = dict(tables)
    out["experiments"] = append_absent(base_experiments, new_experiments, "experiment_id")
    out["experiment_files"] = base_files.unionByName(
        new_files.join(base_files.select("experiment_id", "ordinal"), on=["experiment_id", "ordinal"], how="left_anti")
    )
    out["metadata_claims"] = base_claims.unionByName(shape(numbered, "metadata_claims"))
    out["relationships"] = number_edges(base_edges.unionByName(fresh_edges))
    out["unresolved_links"] = without(tables["unresolved_links"], "experiment_id", old)
    out["derivations"] = without(tables["derivations"], "experiment_id", old).unionByName(
        shape(linkage.derivation_members(linked), "derivations")
    )
    counts = fresh_edges.groupBy("predicate").agg(F.count(F.lit(1)).alias("inserted"))
    return Applied(out, counts)


def link_catalog(spark: SparkSession, root: str, reviewed: DataFrame | None = None) -> int:
    """Read the current version, derive device experiments, write the next version."""

    def change(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        linked = linkage.derive_experiments(tables["devices"], tables["artifacts"], reviewed)
        return apply_linkage(tables, linked, reviewed).tables

    return update_catalog(spark, root, change, "device linkage")


def run_indexing(records: DataFrame, listing: DataFrame, parser_version: str, now_utc: str, include_failed: bool = False) -> DataFrame:
    """Scan the units that need it and return the updated inventory.

    Only files of selected units are scanned (a semi join on the top folder), and
    only selected paths change their status.
    """
    chosen = cut_lineage(indexing.selected(indexing.plan(records, include_failed, parser_version)))
    picked = listing.join(chosen.select("relative_path"), on="relative_path", how="left_semi")
    units = picked.withColumn("scanner_unit", F.substring_index("relative_path", "/", 1))
    result = proposals.scan(units, ["scanner_unit"])
    _, unresolved = proposals.lineage(result.files, ["scanner_unit"])
    imported = proposals.import_proposals(result, unresolved, ["scanner_unit"])
    outcome = indexing.outcome(chosen, result.files, imported, result.unclassified)
    changes = indexing.status_changes(outcome, parser_version)
    indexed = changes.where(F.col("metadata_status") == inventory.INDEXED)
    failed = changes.where(F.col("metadata_status") == inventory.FAILED)
    once = inventory.update_status(records, indexed, now_utc, ("metadata_status", "parser_version"))
    return inventory.update_status(once, failed.select("relative_path", "metadata_status"), now_utc)


def compare_catalogs(left: dict[str, DataFrame], right: dict[str, DataFrame]) -> DataFrame:
    """Tables in which two catalogs differ."""
    return fingerprint.parity(left, right)
