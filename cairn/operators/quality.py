"""Data-quality operators; each returns violation rows and is empty on clean input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import ids, paths
from cairn.operators.inventory import INVENTORY_STATUSES, METADATA_STATUSES
from cairn.operators.lineage import with_file_id

# States and endpoint types.
REVIEW_STATES = ("unknown", "accepted", "corrected", "rejected")
ENDPOINT_TYPES = ("experiment", "device", "artifact", "file")
MANIFEST_STATUSES = (
    "planned", "preflight_passed", "upload_created", "processing", "success", "processing_failed", "verification_failed",
)


def _violations(df: DataFrame, entity: str, key: str, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """One row per broken rule: (entity, entity_id, rule)."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules]))
    return df.select(F.lit(entity).alias("entity"), F.col(key).cast("string").alias("entity_id"), F.explode(broken).alias("rule"))


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) == ""


def _empty_if_set(name: str) -> Column:
    return F.col(name) == ""


def _not_finite(name: str) -> Column:
    value = F.col(name).cast("double")
    return F.isnan(value) | (F.abs(value) == F.lit(float("inf")))


def _bad_state(name: str, allowed: Sequence[str]) -> Column:
    return F.col(name).isNull() | ~F.col(name).isin(*allowed)


def duplicate_ids(df: DataFrame, key: str, entity: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1").select(
        F.lit(entity).alias("entity"), F.col(key).cast("string").alias("entity_id"), "n_rows"
    )


def duplicate_device_pairs(devices: DataFrame) -> DataFrame:
    pairs = devices.where(F.col("maker_namespace").isNotNull()).groupBy("maker_namespace", "local_device_id").agg(
        F.count(F.lit(1)).alias("n_rows")
    )
    return pairs.where("n_rows > 1")


def endpoints(experiments: DataFrame, devices: DataFrame, artifacts: DataFrame, experiment_files: DataFrame) -> DataFrame:
    """Every entity a relationship may point at."""

    def side(df: DataFrame, kind: str, column: str) -> DataFrame:
        return df.select(F.lit(kind).alias("entity_type"), F.col(column).alias("entity_id")).where(F.col("entity_id").isNotNull())

    return (
        side(experiments, "experiment", "experiment_id")
        .unionByName(side(devices, "device", "device_id"))
        .unionByName(side(artifacts, "artifact", "artifact_id"))
        .unionByName(side(with_file_id(experiment_files), "file", "file_id"))
        .unionByName(side(with_file_id(artifacts), "file", "file_id"))
        .distinct()
    )


def dangling_endpoints(relationships: DataFrame, known: DataFrame) -> DataFrame:
    """Relationship ends whose type is unsupported or whose entity does not exist."""
    ends = relationships.select(
        "relationship_id",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(s).alias("side"), F.col(f"{s}_type").alias("entity_type"), F.col(f"{s}_id").alias("entity_id"))
                    for s in ("source", "target")
                ]
            )
        ),
    )
    missing = ends.join(known, on=["entity_type", "entity_id"], how="left_anti")
    problem = F.when(F.col("entity_type").isin(*ENDPOINT_TYPES), "dangling").otherwise("unsupported type")
    return missing.select("relationship_id", "side", "entity_type", "entity_id", problem.alias("problem"))


def dangling_artifacts(artifacts: DataFrame, devices: DataFrame, experiments: DataFrame) -> DataFrame:
    """Artifacts whose device or experiment does not exist."""

    def side(column: str, owner: DataFrame) -> DataFrame:
        bound = artifacts.where(F.col(column).isNotNull()).select("artifact_id", column)
        lost = bound.join(owner.select(column), on=column, how="left_anti")
        return lost.select("artifact_id", F.lit(column).alias("reference"), F.col(column).alias("entity_id"))

    return side("device_id", devices).unionByName(side("experiment_id", experiments))


def claim_violations(claims: DataFrame) -> DataFrame:
    """Required strings, review state, corrected exactly when a reviewed value exists, finite confidence."""
    corrected = F.col("review_status") == "corrected"
    has_value = F.col("reviewed_value_json").isNotNull()
    keyed = claims.withColumn("__key", F.concat_ws("/", "subject_type", "subject_id", F.col("ordinal").cast("string")))
    return _violations(
        keyed, "claim", "__key",
        [
            *[(f"{c} is empty", _blank(c)) for c in ("subject_type", "subject_id", "field", "source_type", "extraction_method")],
            *[(f"{c} is empty", _empty_if_set(c)) for c in ("source_reference", "category")],
            ("invalid review state", _bad_state("review_status", REVIEW_STATES)),
            ("corrected without reviewed value", corrected & ~has_value),
            ("reviewed value without correction", ~corrected & has_value),
            ("confidence is not finite", _not_finite("confidence")),
        ],
    )


def foreign_claims(claims: DataFrame, known: DataFrame) -> DataFrame:
    """Claims whose subject does not exist."""
    subjects = known.select(F.col("entity_type").alias("subject_type"), F.col("entity_id").alias("subject_id"))
    return claims.join(subjects, on=["subject_type", "subject_id"], how="left_anti")


def device_violations(devices: DataFrame) -> DataFrame:
    ns, local = F.col("maker_namespace"), F.col("local_device_id")
    both = ns.isNotNull() & local.isNotNull()
    return _violations(
        devices, "device", "device_id",
        [
            ("device_id is empty", _blank("device_id")),
            ("device_type is empty", _blank("device_type")),
            ("display_label is empty", _empty_if_set("display_label")),
            ("invalid review state", _bad_state("review_state", REVIEW_STATES)),
            ("namespace pair is incomplete", ns.isNull() != local.isNull()),
            ("id does not follow from the pair", both & (F.col("device_id") != ids.device_id(ns, local))),
            ("empty alias", F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.coalesce(a, F.lit("")) == "")),
        ],
    )


def artifact_violations(artifacts: DataFrame) -> DataFrame:
    return _violations(
        artifacts, "artifact", "artifact_id",
        [
            *[(f"{c} is empty", _blank(c)) for c in ("artifact_id", "role", "category", "extension", "media_type")],
            *[(f"{c} is empty", _empty_if_set(c)) for c in ("device_id", "experiment_id")],
            ("invalid review state", _bad_state("review_state", REVIEW_STATES)),
            ("negative size", F.col("size_bytes") < 0),
            ("negative mtime", F.col("mtime_ns") < 0),
            ("path is not canonical", F.col("relative_path").isNotNull() & ~F.col("relative_path").eqNullSafe(paths.canonical_path(F.col("relative_path")))),
        ],
    )


def experiment_violations(experiments: DataFrame) -> DataFrame:
    return _violations(
        experiments, "experiment", "experiment_id",
        [
            ("experiment_id is empty", _blank("experiment_id")),
            ("parser_version is empty", _empty_if_set("parser_version")),
            ("invalid review state", _bad_state("review_state", REVIEW_STATES)),
            ("needs_review is missing", F.col("needs_review").isNull()),
            ("confidence is not finite", F.col("confidence").isNull() | _not_finite("confidence")),
        ],
    )


def relationship_violations(relationships: DataFrame) -> DataFrame:
    return _violations(
        relationships, "relationship", "relationship_id",
        [
            *[(f"{c} is empty", _blank(c)) for c in ("source_type", "source_id", "predicate", "target_type", "target_id", "relationship_id")],
            ("provenance_source is empty", _empty_if_set("provenance_source")),
            ("invalid review state", _bad_state("review_state", REVIEW_STATES)),
        ],
    )


def inventory_violations(records: DataFrame) -> DataFrame:
    path = F.col("relative_path")
    return _violations(
        records, "inventory", "relative_path",
        [
            ("path is unsafe", paths.path_error(path).isNotNull()),
            ("size is negative or missing", F.col("size_bytes").isNull() | (F.col("size_bytes") < 0)),
            ("mtime is negative or missing", F.col("mtime_ns").isNull() | (F.col("mtime_ns") < 0)),
            ("invalid inventory status", _bad_state("inventory_status", INVENTORY_STATUSES)),
            ("invalid metadata status", _bad_state("metadata_status", METADATA_STATUSES)),
            ("negative generation", F.col("last_seen_generation") < 0),
            *[(f"{c} is empty", _empty_if_set(c)) for c in ("content_hash", "parser_version", "file_kind", "sample_hint")],
        ],
    )


def _bad_utc(name: str) -> Column:
    text = F.col(name)
    return text.isNull() | ~text.rlike(r"(?:Z|\+00:?00)$") | F.try_to_timestamp(text).isNull()


def manifest_violations(manifests: DataFrame) -> DataFrame:
    file_rule = lambda f: (
        (F.coalesce(f["source_path"], F.lit("")) == "")
        | (F.coalesce(f["role"], F.lit("")) == "")
        | (F.coalesce(f["relative_path"], f["destination_path"], F.lit("")) == "")
        | (f["relative_path"].isNotNull() & f["destination_path"].isNotNull())
    )
    return _violations(
        manifests, "manifest", "batch_id",
        [
            ("batch_id is empty", _blank("batch_id")),
            ("unsupported manifest version", ~F.col("manifest_version").eqNullSafe(F.lit(1))),
            ("batch_number must be positive", F.col("batch_number").isNull() | (F.col("batch_number") < 1)),
            ("invalid status", _bad_state("status", MANIFEST_STATUSES)),
            ("expected counts must be non-negative", F.coalesce(F.least("expected_entry_count", "expected_file_count"), F.lit(-1)) < 0),
            ("publish is missing", F.col("publish").isNull()),
            ("null proposal id", F.exists("proposal_ids", lambda p: p.isNull())),
            ("incomplete file entry", F.exists(F.concat("archive_files", "companion_files"), file_rule)),
            ("entry pair is incomplete", F.exists("entry_ids", lambda e: e["proposal_id"].isNull() | e["entry_id"].isNull())),
            ("created_utc is not UTC", _bad_utc("created_utc")),
            ("updated_utc is not UTC", _bad_utc("updated_utc")),
        ],
    )


def preflight_problems(manifests: DataFrame, existing: DataFrame, documents: DataFrame) -> DataFrame:
    """Why a planned batch may not be uploaded: counts, uniqueness, paths, document review flags.

    ``existing(relative_path, is_regular)`` lists the source files; ``documents``
    has ``source_path``, ``data`` and the reader's ``_corrupt_record``.
    """
    n_files = F.size("archive_files") + F.size("companion_files")
    counts = F.array_compact(
        F.array(
            F.when(F.col("status") != "planned", F.concat(F.lit("manifest status is not planned: "), F.col("status"))),
            F.when(F.col("expected_entry_count") != F.size("proposal_ids"), F.lit("expected entry count does not match proposal count")),
            F.when(F.size("proposal_ids") == 0, F.lit("batch contains no proposals")),
            F.when(F.size(F.array_distinct("proposal_ids")) != F.size("proposal_ids"), F.lit("proposal IDs are not unique")),
            F.when(F.size("archive_files") != F.col("expected_entry_count"), F.lit("archive count does not match expected entry count")),
            F.when(F.col("expected_file_count") != n_files, F.lit("expected file count does not match represented file count")),
        )
    )
    own = manifests.select("batch_id", F.explode(counts).alias("problem"))
    files = manifests.select("batch_id", F.explode(F.concat("archive_files", "companion_files")).alias("f")).select(
        "batch_id", "f.source_path", "f.destination_path",
        F.coalesce("f.relative_path", "f.destination_path").alias("target"),
    )
    present = existing.select(F.col("relative_path").alias("source_path"), F.coalesce("is_regular", F.lit(True)).alias("regular"))
    located = files.join(present, on="source_path", how="left")
    source = F.when(F.col("regular").isNull(), F.concat(F.lit("missing source file: "), F.col("source_path"))).when(
        ~F.col("regular"), F.concat(F.lit("source is not a regular file: "), F.col("source_path"))
    )
    row_rules = F.array_compact(
        F.array(
            source,
            paths.unsafe_path_reason(F.col("target")),
            F.when(F.col("destination_path").isNotNull(), F.replace(paths.unsafe_path_reason(F.col("destination_path")), F.lit("relative path"), F.lit("transport destination"))),
        )
    )
    rows = located.select("batch_id", F.explode(row_rules).alias("problem"))

    def repeated(column: str, text: str) -> DataFrame:
        slashed = paths.forward_slashes(F.col(column))
        return files.where(F.col(column).isNotNull()).groupBy("batch_id", slashed.alias("p")).agg(
            F.count(F.lit(1)).alias("n")
        ).where("n > 1").select("batch_id", F.concat(F.lit(text), F.col("p")).alias("problem"))

    archives = manifests.select("batch_id", F.explode("archive_files.source_path").alias("source_path"))
    read = archives.join(documents, on="source_path", how="left")
    review = F.col("data.ingestion_review")
    unread = F.col("data").isNull() | F.col("_corrupt_record").isNotNull()

    def flagged(condition: Column, text: str) -> Column:
        return F.when(~unread & F.coalesce(condition, F.lit(False)), F.concat(F.lit(text), F.col("source_path")))

    doc_rules = F.array_compact(
        F.array(
            F.when(unread, F.concat(F.lit("archive read-back failed: "), F.col("source_path"))),
            flagged(review.isNull(), "missing ingestion review: "),
            flagged(review.isNotNull() & ~review["needs_review"].eqNullSafe(F.lit(False)), "archive needs review: "),
            flagged(F.size(review["warnings"]) > 0, "archive has review warnings: "),
        )
    )
    docs = read.select("batch_id", F.explode(doc_rules).alias("problem"))
    return (
        own.unionByName(rows)
        .unionByName(repeated("target", "duplicate canonical relative path: "))
        .unionByName(repeated("destination_path", "duplicate transport destination: "))
        .unionByName(docs)
        .distinct()
    )


def job_violations(jobs: DataFrame) -> DataFrame:
    return _violations(
        jobs, "job", "proposal_id",
        [
            ("proposal_id is empty", _blank("proposal_id")),
            ("sample_id is empty", _empty_if_set("sample_id")),
            ("output path is unusable", F.col("output_relative_path").isNull() | paths.path_error(F.col("output_relative_path")).isNotNull()),
        ],
    )


def assembly_problems(jobs: DataFrame, outputs: DataFrame, failures: DataFrame, allow_partial: bool = False) -> DataFrame:
    """Why written documents do not make a complete batch, as (proposal_id, problem)."""
    def tag(df: DataFrame, text: str) -> DataFrame:
        return df.select("proposal_id", F.lit(text).alias("problem"))

    def repeated(df: DataFrame, key: str, text: str) -> DataFrame:
        many = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("proposal_id").alias("p")).where("n > 1")
        return many.select(F.col("p").alias("proposal_id"), F.lit(text).alias("problem"))

    done = outputs.select("proposal_id").distinct()
    lost = jobs.join(done, on="proposal_id", how="left_anti").join(failures.select("proposal_id"), on="proposal_id", how="left_anti")
    out = (
        repeated(jobs, "proposal_id", "duplicate proposal ids")
        .unionByName(repeated(outputs, "output_path", "duplicate output paths in execution result"))
        .unionByName(repeated(failures, "proposal_id", "execution result contains duplicate failure records"))
        .unionByName(tag(lost, "output path count does not match expected count"))
    )
    return out if allow_partial else out.unionByName(tag(failures.select("proposal_id").distinct(), "batch is incomplete: failed proposal"))


def embedding_violations(vectors: DataFrame, key: str = "vec_id", values: str = "embedding") -> DataFrame:
    """Vectors that are empty, missing, or hold a null or non-finite number."""
    v = F.col(values)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    optional = [c for c in ("model_id", "embedding_space_id", "version") if c in vectors.columns]
    rules = [("values are empty", v.isNull() | (F.size(v) == 0)), ("values are not finite", bad)]
    if "provider_id" in vectors.columns:
        rules.append(("provider_id is empty", _blank("provider_id")))
    rules += [(f"{c} is empty", _empty_if_set(c)) for c in optional]
    return _violations(vectors, "embedding", key, rules)


def _rate(name: str) -> tuple[str, Column]:
    return f"{name} is outside 0..1", _not_finite(name) | (F.col(name) < 0) | (F.col(name) > 1)


def _amount(name: str) -> tuple[str, Column]:
    return f"{name} is negative", _not_finite(name) | (F.col(name) < 0)


def inference_evaluation_violations(rows: DataFrame) -> DataFrame:
    return _violations(
        rows, "evaluation", "benchmark_case_id",
        [
            ("benchmark_case_id is empty", _blank("benchmark_case_id")), ("provider_id is empty", _blank("provider_id")),
            ("model_id is empty", _empty_if_set("model_id")), _amount("latency_ms"), _amount("token_count"), _amount("cost"),
        ],
    )


def search_evaluation_violations(rows: DataFrame) -> DataFrame:
    rates = ("recall", "ranking_quality", "interpretation_quality", "false_positive_rate")
    return _violations(
        rows, "evaluation", "benchmark_question_id",
        [
            ("benchmark_question_id is empty", _blank("benchmark_question_id")), ("provider_id is empty", _blank("provider_id")),
            ("model_id is empty", _empty_if_set("model_id")),
            *[_rate(r) for r in rates if r in rows.columns], _amount("latency_ms"), _amount("cost"),
        ],
    )


def suggestion_violations(rows: DataFrame, items: str = "suggestions") -> DataFrame:
    """Suggestion or candidate results: non-empty implies review, abstained implies empty."""
    filled = F.size(items) > 0
    rules = [
        ("provider_id is empty", _blank("provider_id")),
        ("model_id is empty", _empty_if_set("model_id")),
        (f"non-empty {items} must require review", filled & ~F.col("requires_review")),
        (f"abstained results cannot contain {items}", F.col("abstained") & filled),
    ]
    if "validation_errors" in rows.columns:
        passed = F.coalesce("deterministic_validation_passed", F.lit(False))
        rules.append(("validation passed with errors", passed & (F.size("validation_errors") > 0)))
    return _violations(rows, "suggestion", "result_id", rules)


def candidate_violations(candidates: DataFrame) -> DataFrame:
    return _violations(
        candidates, "candidate", "candidate_id",
        [("field is empty", _blank("field")), ("confidence is not finite", _not_finite("confidence")), ("category is empty", _empty_if_set("category"))],
    )


def preview_cap_violations(packages: DataFrame, policy) -> DataFrame:
    """Slide packages beyond the preview caps; the row says which cap."""
    return _violations(
        packages, "package", "relative_path",
        [
            ("source exceeds the size cap", F.col("length") > policy.source_bytes),
            ("member count exceeds the cap", F.col("members") > policy.package_members),
            ("uncompressed size exceeds the cap", F.col("uncompressed") > policy.package_bytes),
            ("compression ratio exceeds the cap", F.col("max_ratio") > policy.package_ratio),
            ("XML member exceeds the cap", F.col("max_xml") > policy.package_xml_bytes),
            ("slide count exceeds the cap", F.col("slides") > policy.slides),
        ],
    )
