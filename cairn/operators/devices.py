"""Device folders: recognition, artifacts, edges, human identity decisions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import ids, paths
from cairn.operators.lineage import with_relationship_id

# Device folder pattern and messages.
DEVICE_FOLDER = r"^D(\d+)((?s).*)$"
NOT_A_DEVICE = "basename does not begin with a standalone D followed by digits"
DUPLICATE_PREFIX = "ambiguous duplicate identity: multiple top-level folders resolve to candidate device "
LEGACY_DECK = "legacy PPT extraction unsupported: "


@dataclass(frozen=True)
class DeviceScan:
    """Result tables of one device folder scan."""

    devices: DataFrame
    claims: DataFrame
    artifacts: DataFrame
    relationships: DataFrame
    unresolved: DataFrame
    warnings: DataFrame


def top_folders(listing: DataFrame) -> DataFrame:
    """Distinct first components that are folders."""
    nested = listing.where(paths.component_count(F.col("relative_path")) > 1)
    return nested.select(paths.first_component(F.col("relative_path")).alias("folder_name")).distinct()


def folder_device(folder: Column) -> Column:
    digits = F.regexp_extract(folder, DEVICE_FOLDER, 1)
    return F.when(digits != "", F.concat(F.lit("D"), digits))


def folder_remainder(folder: Column) -> Column:
    return F.regexp_extract(folder, DEVICE_FOLDER, 2)


def folder_tokens(remainder: Column) -> Column:
    return F.filter(F.split(remainder, r"[_\s]+"), lambda t: t != "")


def classify_folders(folders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(recognized, unresolved): a device id named by several folders stays unresolved."""
    named = folders.withColumn("candidate_device_id", folder_device(F.col("folder_name")))
    counts = named.where(F.col("candidate_device_id").isNotNull()).groupBy("candidate_device_id").agg(
        F.count(F.lit(1)).alias("n_folders")
    )
    joined = named.join(counts, on="candidate_device_id", how="left")
    recognized = joined.where(F.col("n_folders") == 1).select(
        F.col("candidate_device_id").alias("local_id"), "folder_name"
    )
    unresolved = joined.where(F.col("n_folders").isNull() | (F.col("n_folders") > 1)).select(
        "folder_name",
        F.when(F.col("n_folders").isNull(), F.lit(NOT_A_DEVICE))
        .otherwise(F.concat(F.lit(DUPLICATE_PREFIX), F.col("candidate_device_id")))
        .alias("reason"),
        F.when(F.col("n_folders") > 1, F.col("candidate_device_id")).alias("candidate_device_id"),
    )
    return recognized, unresolved


def ambiguous_devices(folders: DataFrame) -> DataFrame:
    """Device ids claimed by more than one folder."""
    named = folders.select(folder_device(F.col("folder_name")).alias("device_id"), "folder_name")
    return (
        named.where(F.col("device_id").isNotNull())
        .groupBy("device_id")
        .agg(
            F.count(F.lit(1)).alias("n_folders"),
            F.min("folder_name").alias("first_folder"),
            F.max("folder_name").alias("last_folder"),
        )
        .where(F.col("n_folders") > 1)
    )


def build_devices(recognized: DataFrame, namespace: str | None = None, storage_source: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Device rows (one folder each, hence one alias) and their candidate claims."""
    local = F.col("local_id")
    internal = local if namespace is None else ids.device_id(F.lit(namespace), local)
    base = recognized.withColumn("device_id", internal)
    devices = base.select(
        "device_id",
        F.lit(paths.UNKNOWN).alias("device_type"),
        F.array("folder_name").alias("aliases"),
        F.lit("unknown").alias("review_state"),
        F.lit("{}").alias("metadata_json"),
        F.lit(namespace).cast("string").alias("maker_namespace"),
        (local if namespace is not None else F.lit(None).cast("string")).alias("local_device_id"),
        local.alias("display_label"),
    )
    tokens = base.select(
        "device_id", "folder_name", F.posexplode(folder_tokens(folder_remainder(F.col("folder_name")))).alias("ordinal", "token")
    )
    token_claims = tokens.select(
        F.lit("device").alias("subject_type"),
        F.col("device_id").alias("subject_id"),
        F.col("ordinal").cast("long").alias("ordinal"),
        F.lit("folder_token").alias("field"),
        _json_string(F.col("token")).alias("value_json"),
        F.lit("folder_name").alias("source_type"),
        F.col("folder_name").alias("source_reference"),
        F.lit("folder_token").alias("extraction_method"),
        F.lit(0.5).alias("confidence"),
        F.lit("candidate").alias("category"),
        F.array(F.concat(F.lit("folder_name="), F.col("folder_name"))).alias("evidence"),
        F.lit("unknown").alias("review_status"),
        F.lit(None).cast("string").alias("reviewed_value_json"),
    )
    if namespace is None:
        return devices, token_claims
    identity = base.select(
        F.lit("device").alias("subject_type"),
        F.col("device_id").alias("subject_id"),
        F.size(folder_tokens(folder_remainder(F.col("folder_name")))).cast("long").alias("ordinal"),
        F.lit("device_identity").alias("field"),
        F.to_json(F.struct(local.alias("local_device_id"), F.lit(namespace).alias("namespace"))).alias("value_json"),
        F.lit("scan_context").alias("source_type"),
        F.lit(storage_source).cast("string").alias("source_reference"),
        F.lit("maker_namespace").alias("extraction_method"),
        F.lit(1.0).alias("confidence"),
        F.lit("candidate").alias("category"),
        F.array(F.concat(F.lit("folder_name="), F.col("folder_name"))).alias("evidence"),
        F.lit("unknown").alias("review_status"),
        F.lit(None).cast("string").alias("reviewed_value_json"),
    )
    return devices, token_claims.unionByName(identity)


def _json_string(value: Column) -> Column:
    return F.regexp_extract(F.to_json(F.array(value)), r"(?s)^\[(.*)\]$", 1)


def build_artifacts(listing: DataFrame, recognized: DataFrame, storage_source: str, namespace: str | None = None) -> DataFrame:
    """One artifact per listed file, bound to the device of its top folder if recognized."""
    local = F.col("local_id")
    owner = local if namespace is None else ids.device_id(F.lit(namespace), local)
    bound = listing.withColumn("folder_name", paths.first_component(F.col("relative_path"))).join(
        recognized.select("folder_name", owner.alias("device_id")), on="folder_name", how="left"
    )
    path, ext = F.col("relative_path"), F.col("extension")
    nested = paths.component_count(path) > 1
    return bound.withColumn("extension", paths.extension(path)).select(
        ids.artifact_id(path).alias("artifact_id"),
        F.lit(paths.UNKNOWN).alias("role"),
        F.lit(paths.UNKNOWN).alias("category"),
        ext,
        paths.media_type(ext).alias("media_type"),
        F.when(nested, F.col("device_id")).alias("device_id"),
        F.lit(None).cast("string").alias("experiment_id"),
        F.lit(storage_source).alias("storage_source_id"),
        path,
        "size_bytes",
        "mtime_ns",
        F.lit("unknown").alias("review_state"),
        F.when(ext == "ppt", F.lit('{"deterministic_extraction":"unsupported"}')).otherwise(F.lit("{}")).alias("metadata_json"),
    )


def slide_artifacts(slides: DataFrame, decks: DataFrame) -> DataFrame:
    """One artifact per extracted slide, bound like its deck."""
    path = F.col("deck_relative_path")
    joined = slides.join(
        decks.select(F.col("relative_path").alias("deck_relative_path"), "device_id", "storage_source_id"),
        on="deck_relative_path",
    )
    details = F.struct("image_refs", "labels", "notes", "slide_index", "text_runs", "title")
    return joined.select(
        ids.slide_id(path, F.col("slide_index")).alias("artifact_id"),
        F.lit(paths.UNKNOWN).alias("role"),
        F.lit("slide").alias("category"),
        F.lit("pptx").alias("extension"),
        F.lit(paths.MEDIA_TYPES["pptx"]).alias("media_type"),
        "device_id",
        F.lit(None).cast("string").alias("experiment_id"),
        "storage_source_id",
        path.alias("relative_path"),
        F.lit(None).cast("long").alias("size_bytes"),
        F.lit(None).cast("long").alias("mtime_ns"),
        F.lit("unknown").alias("review_state"),
        F.to_json(details, {"ignoreNullFields": "false"}).alias("metadata_json"),
    )


def _edge(df: DataFrame, source: str, predicate: str, target_type: str, target: Column, provenance: Column, review: str = "unknown") -> DataFrame:
    return with_relationship_id(
        df.select(
            F.lit("artifact").alias("source_type"),
            F.col(source).alias("source_id"),
            F.lit(predicate).alias("predicate"),
            F.lit(target_type).alias("target_type"),
            target.alias("target_id"),
            provenance.alias("provenance_source"),
            F.lit(review).alias("review_state"),
        )
    )


def describes_edges(artifacts: DataFrame) -> DataFrame:
    owned = artifacts.where(F.col("device_id").isNotNull())
    return _edge(owned, "artifact_id", "describes", "device", F.col("device_id"), F.col("relative_path"))


def part_of_edges(slides: DataFrame) -> DataFrame:
    deck = ids.artifact_id(F.col("relative_path"))
    return _edge(slides, "artifact_id", "part_of", "artifact", deck, F.col("relative_path"))


def scan_warnings(recognized: DataFrame, unresolved: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Distinct warning rows.

    A duplicate identity gives one row per folder, so the rows together name all
    folders without joining them into one unbounded string.
    """
    unknown = unresolved.where(F.col("candidate_device_id").isNull()).select(
        F.concat(F.lit("unresolved candidate folder: "), F.col("folder_name")).alias("warning")
    )
    duplicate = unresolved.where(F.col("candidate_device_id").isNotNull()).select(
        F.concat(
            F.lit("ambiguous duplicate device identity "), F.col("candidate_device_id"), F.lit(": "), F.col("folder_name")
        ).alias("warning")
    )
    compact = recognized.where(folder_remainder(F.col("folder_name")).rlike(r"^[^_ \t]")).select(
        F.concat(F.lit("ambiguous compact device candidate "), F.col("local_id"), F.lit(": "), F.col("folder_name")).alias("warning")
    )
    legacy = artifacts.where(F.col("extension") == "ppt").select(
        F.concat(F.lit(LEGACY_DECK), F.col("relative_path")).alias("warning")
    )
    return unknown.unionByName(duplicate).unionByName(compact).unionByName(legacy).distinct()


def scan_devices(
    listing: DataFrame,
    storage_source: str,
    namespace: str | None = None,
    slides: DataFrame | None = None,
) -> DeviceScan:
    """Device folder scan of a listing; ``slides`` are rows of the slide reader."""
    if not storage_source:
        raise ValueError("storage_source must be a non-empty string")
    recognized, unresolved = classify_folders(top_folders(listing))
    devices, claims = build_devices(recognized, namespace, storage_source)
    artifacts = build_artifacts(listing, recognized, storage_source, namespace)
    edges = describes_edges(artifacts)
    warnings = scan_warnings(recognized, unresolved, artifacts)
    if slides is not None:
        decks = artifacts.where(F.col("extension") == "pptx")
        slide_rows = slide_artifacts(slides, decks)
        edges = edges.unionByName(describes_edges(slide_rows)).unionByName(part_of_edges(slide_rows))
        artifacts = artifacts.unionByName(slide_rows)
    return DeviceScan(devices, claims, artifacts, edges, unresolved, warnings)


def decision_problems(decisions: DataFrame, unresolved: DataFrame, devices: DataFrame) -> DataFrame:
    """Violation rows for human identity decisions; apply only when this is empty."""
    d = F.col("relative_folder")

    def bad(name: str) -> Column:
        return F.when(F.coalesce(F.col(name), F.lit("")) == "", F.lit(f"{name} must be a non-empty string"))

    empty = F.array().cast("array<string>")
    rules = F.array_compact(
        F.array(
            bad("relative_folder"), bad("maker_namespace"), bad("local_device_id"), bad("display_label"), bad("provenance_source"),
            F.when(d.rlike(r"[/\\]") | d.isin(".", ".."), F.lit("relative_folder must identify one canonical folder")),
            F.when(F.exists(F.coalesce("aliases", empty), lambda a: F.coalesce(a, F.lit("")) == ""), F.lit("aliases must contain non-empty strings")),
            F.when(F.exists(F.coalesce("evidence", empty), lambda a: F.coalesce(a, F.lit("")) == ""), F.lit("evidence must contain strings")),
        )
    )
    own = decisions.select(d, F.explode(rules).alias("problem"))
    repeated = decisions.groupBy("relative_folder").count().where("count > 1").select(
        "relative_folder", F.lit("duplicate identity decisions are not allowed").alias("problem")
    )
    unknown = decisions.join(
        unresolved.select(F.col("folder_name").alias("relative_folder")), on="relative_folder", how="left_anti"
    ).select("relative_folder", F.lit("unknown unresolved folder").alias("problem"))
    target = decisions.select(
        "relative_folder", "maker_namespace", "local_device_id",
        ids.device_id(F.col("maker_namespace"), F.col("local_device_id")).alias("device_id"),
    )
    held = devices.select("device_id", F.col("maker_namespace").alias("h_ns"), F.col("local_device_id").alias("h_local"))
    same = F.col("h_ns").eqNullSafe(F.col("maker_namespace")) & F.col("h_local").eqNullSafe(F.col("local_device_id"))
    adoptable = F.col("h_ns").isNull() & F.col("h_local").isNull() & (F.col("maker_namespace") == "YZ")
    collision = target.join(held, on="device_id").where(~same & ~adoptable).select(
        "relative_folder", F.lit("identity/internal ID collision").alias("problem")
    )
    return own.unionByName(repeated).unionByName(unknown).unionByName(collision)


@dataclass(frozen=True)
class Resolved:
    devices: DataFrame
    claims: DataFrame
    artifacts: DataFrame
    relationships: DataFrame
    unresolved: DataFrame


def append_absent(base: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """Rows of ``base`` plus the rows of ``extra`` whose key is new."""
    fresh = extra.join(base.select(key), on=key, how="left_anti")
    return base.unionByName(fresh.select(*base.columns))


def apply_decisions(scan: DeviceScan, decisions: DataFrame) -> Resolved:
    """Resolve folders by human decisions.

    A decided folder is one path component, so "below this folder" is an equality
    join on the first component.  Decisions on the same device merge: aliases are
    united, the last decision in folder order names the label.
    """
    targeted = decisions.withColumn(
        "device_id", ids.device_id(F.col("maker_namespace"), F.col("local_device_id"))
    )
    empty = F.array().cast("array<string>")
    named = targeted.select(
        "device_id", "maker_namespace", "local_device_id", "display_label", "relative_folder",
        F.explode(F.array_append(F.coalesce("aliases", empty), F.col("relative_folder"))).alias("alias"),
    )
    per_device = named.groupBy("device_id").agg(
        F.max("maker_namespace").alias("d_namespace"),
        F.max("local_device_id").alias("d_local"),
        F.max_by("display_label", "relative_folder").alias("d_label"),
        F.collect_set("alias").alias("d_aliases"),
    )
    merged = scan.devices.join(per_device, on="device_id", how="full_outer").select(
        "device_id",
        F.coalesce("device_type", F.lit(paths.UNKNOWN)).alias("device_type"),
        F.array_sort(F.array_union(F.coalesce("aliases", empty), F.coalesce("d_aliases", empty))).alias("aliases"),
        F.coalesce("review_state", F.lit("unknown")).alias("review_state"),
        F.coalesce("metadata_json", F.lit("{}")).alias("metadata_json"),
        F.coalesce("d_namespace", "maker_namespace").alias("maker_namespace"),
        F.coalesce("d_local", "local_device_id").alias("local_device_id"),
        F.coalesce("d_label", "display_label").alias("display_label"),
    )

    held = scan.claims.groupBy(F.col("subject_id").alias("device_id")).agg(F.max("ordinal").alias("last"))
    reasons = scan.unresolved.select(F.col("folder_name").alias("relative_folder"), "reason", "candidate_device_id")
    rank = F.row_number().over(_by_device())
    claims = targeted.join(reasons, on="relative_folder").join(held, on="device_id", how="left").select(
        F.lit("device").alias("subject_type"),
        F.col("device_id").alias("subject_id"),
        (F.coalesce(F.col("last"), F.lit(-1)) + rank).cast("long").alias("ordinal"),
        F.lit("device_identity").alias("field"),
        F.to_json(
            F.struct("candidate_device_id", F.col("relative_folder").alias("folder_name"), "reason"), {"ignoreNullFields": "false"}
        ).alias("value_json"),
        F.lit("human_review").alias("source_type"),
        F.col("provenance_source").alias("source_reference"),
        F.lit("human_decision").alias("extraction_method"),
        F.lit(None).cast("double").alias("confidence"),
        F.lit(None).cast("string").alias("category"),
        F.when(F.size(F.coalesce("evidence", empty)) > 0, F.col("evidence"))
        .otherwise(F.array(F.concat(F.lit("folder_name="), F.col("relative_folder"))))
        .alias("evidence"),
        F.lit("corrected").alias("review_status"),
        F.to_json(
            F.struct(
                F.coalesce("aliases", empty).alias("aliases"), "display_label", F.coalesce("evidence", empty).alias("evidence"),
                "local_device_id", F.col("maker_namespace").alias("namespace"),
            )
        ).alias("reviewed_value_json"),
    )

    owner = targeted.select(F.col("relative_folder").alias("__folder"), F.col("device_id").alias("__owner"))
    rebound = scan.artifacts.withColumn("__folder", paths.first_component(F.col("relative_path"))).join(
        owner, on="__folder", how="left"
    )
    artifacts = rebound.withColumn("device_id", F.coalesce("__owner", "device_id")).select(*scan.artifacts.columns)
    # All decisions on one device share the first decision's source in their edges.
    sources = targeted.groupBy("device_id").agg(F.min_by("provenance_source", "relative_folder").alias("source"))
    moved = rebound.where(F.col("__owner").isNotNull()).select("artifact_id", F.col("__owner").alias("target_id"))
    present = scan.relationships.where(
        (F.col("source_type") == "artifact") & (F.col("predicate") == "describes") & (F.col("target_type") == "device")
    ).select(F.col("source_id").alias("artifact_id"), "target_id")
    missing = moved.join(present, on=["artifact_id", "target_id"], how="left_anti").join(
        sources.withColumnRenamed("device_id", "target_id"), on="target_id"
    )
    new_edges = _edge(missing, "artifact_id", "describes", "device", F.col("target_id"), F.col("source"), "accepted")
    remaining = scan.unresolved.join(
        decisions.select(F.col("relative_folder").alias("folder_name")), on="folder_name", how="left_anti"
    )
    return Resolved(
        merged,
        scan.claims.unionByName(claims),
        artifacts,
        scan.relationships.unionByName(new_edges),
        remaining,
    )


def _by_device():
    from pyspark.sql import Window

    return Window.partitionBy("device_id").orderBy("relative_folder")


def device_violation_ids(devices: DataFrame, names: Sequence[str] = ("maker_namespace", "local_device_id")) -> DataFrame:
    """Qualified devices whose id does not follow from their namespace pair."""
    ns, local = (F.col(n) for n in names)
    return devices.where(ns.isNotNull() & local.isNotNull() & (F.col("device_id") != ids.device_id(ns, local)))
