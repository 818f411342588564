"""Registered queries: referential integrity, contracts, violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import documents, quality
from cairn.plans.projections import Views
from cairn.plans.registry import query


@query(
    """
SELECT r.relationship_id, 'source' AS side, r.source_id AS entity_id FROM fx_relationships r
 WHERE r.source_type = 'experiment' AND NOT EXISTS (SELECT 1 FROM fx_experiments x WHERE x.experiment_id = r.source_id)
UNION ALL SELECT r.relationship_id, 'target', r.target_id FROM fx_relationships r
 WHERE r.target_type = 'device' AND NOT EXISTS (SELECT 1 FROM fx_devices d WHERE d.device_id = r.target_id AND d.display_label <> 'red widget')
UNION ALL SELECT r.relationship_id, 'target', r.target_id FROM fx_relationships r
 WHERE r.target_type = 'file' AND NOT EXISTS (SELECT 1 FROM fx_files f WHERE f.file_id = r.target_id)""",
    "fx_relationships", "fx_experiments", "fx_devices", "fx_files",
)
def integrity_dangling(v: Views) -> DataFrame:
    """Relationship ends that do not exist when one kind of device is left out."""
    some = v.devices.where(F.col("display_label") != "red widget")
    known = quality.endpoints(v.experiments, some, v.artifacts, v.files)
    return quality.dangling_endpoints(v.relationships, known).select("relationship_id", "side", "entity_id")


@query(
    """
SELECT a.artifact_id, 'device_id' AS reference, a.device_id AS entity_id FROM fx_artifacts a
WHERE NOT EXISTS (SELECT 1 FROM fx_devices d WHERE d.device_id = a.device_id AND d.display_label <> 'red widget')""",
    "fx_artifacts", "fx_devices",
)
def integrity_artifacts(v: Views) -> DataFrame:
    some = v.devices.where(F.col("display_label") != "red widget")
    return quality.dangling_artifacts(v.artifacts, some, v.experiments)


@query(
    """
SELECT 'file' AS entity, k AS entity_id, count(*) AS n_rows FROM (
  SELECT split_part(experiment_id, '_', 1) || '|' || role AS k FROM fx_files) GROUP BY k HAVING count(*) > 1""",
    "fx_files",
)
def integrity_duplicates(v: Views) -> DataFrame:
    """Keys used more than once: several files of one role below a device."""
    keyed = v.files.select(F.concat_ws("|", F.split_part("experiment_id", F.lit("_"), F.lit(1)), "role").alias("key"))
    return quality.duplicate_ids(keyed, "key", "file")


@query(
    """
SELECT entity_id, rule FROM (
  SELECT subject_type || '/' || subject_id || '/' || CAST(ordinal AS VARCHAR) AS entity_id, unnest([
    CASE WHEN source_type = '' THEN 'source_type is empty' END,
    CASE WHEN review_status NOT IN ('unknown', 'accepted', 'corrected', 'rejected') THEN 'invalid review state' END,
    CASE WHEN review_status = 'corrected' AND reviewed_value_json IS NULL THEN 'corrected without reviewed value' END,
    CASE WHEN review_status <> 'corrected' AND reviewed_value_json IS NOT NULL THEN 'reviewed value without correction' END]) AS rule
  FROM fx_claims) WHERE rule IS NOT NULL""",
    "fx_claims",
)
def claim_violations(v: Views) -> DataFrame:
    return quality.claim_violations(v.claims).select("entity_id", "rule")


@query(
    """
SELECT c.subject_id, count(*) AS n_claims FROM fx_claims c
WHERE NOT EXISTS (SELECT 1 FROM fx_experiments x WHERE x.experiment_id = c.subject_id AND x.needs_review) GROUP BY c.subject_id""",
    "fx_claims", "fx_experiments",
)
def foreign_claims(v: Views) -> DataFrame:
    """Claims without a subject among the experiments under review."""
    known = v.experiments.where("needs_review").select(F.lit("experiment").alias("entity_type"), F.col("experiment_id").alias("entity_id"))
    lost = quality.foreign_claims(v.claims, known)
    return lost.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n_claims"))


@query(
    "SELECT device_id AS entity_id, 'id does not follow from the pair' AS rule FROM fx_devices WHERE maker_namespace IS NOT NULL",
    "fx_devices",
)
def device_violations(v: Views) -> DataFrame:
    return quality.device_violations(v.devices).select("entity_id", "rule")


@query(
    """
SELECT relative_path AS entity_id, rule FROM (SELECT relative_path, unnest([CASE WHEN size_bytes - 10 < 0 THEN 'size is negative or missing' END,
  CASE WHEN file_kind = '' THEN 'file_kind is empty' END]) AS rule FROM fx_prior) WHERE rule IS NOT NULL""",
    "fx_prior",
)
def inventory_violations(v: Views) -> DataFrame:
    shifted = v.prior.withColumn("size_bytes", F.col("size_bytes") - 10)
    return quality.inventory_violations(shifted).select("entity_id", "rule")


@query(
    "SELECT CAST(vec_id AS VARCHAR) AS entity_id, 'values are not finite' AS rule FROM fx_vectors WHERE len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) > 0",
    "fx_vectors",
)
def embedding_contract(v: Views) -> DataFrame:
    return quality.embedding_violations(v.vectors).select("entity_id", "rule")


@query(
    """
SELECT case_id AS entity_id, rule FROM (SELECT case_id, unnest([CASE WHEN provider_id = '' THEN 'provider_id is empty' END,
  CASE WHEN recall < 0 OR recall > 1 THEN 'recall is outside 0..1' END, CASE WHEN latency_ms < 0 THEN 'latency_ms is negative' END]) AS rule FROM fx_evaluations)
WHERE rule IS NOT NULL""",
    "fx_evaluations",
)
def evaluation_contract(v: Views) -> DataFrame:
    return quality.search_evaluation_violations(v.evaluations).select("entity_id", "rule")


@query(
    """
SELECT 'archives/' || o_clerk || '.archive.json' AS output_relative_path, 'collision: duplicate output target' AS problem
FROM (SELECT 'C' || CAST(o_custkey AS VARCHAR) AS o_clerk FROM orders) GROUP BY o_clerk HAVING count(*) > 1""",
)
def job_collisions(v: Views) -> DataFrame:
    """Archive jobs that claim one target, with customers as proposal ids of their orders."""
    named = v.table("orders").select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("proposal_id"), F.lit("D1").alias("sample_id"))
    return documents.job_collisions(documents.plan_jobs(named))
