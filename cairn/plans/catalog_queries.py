"""Registered queries: retrieval, identities, edges and claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import ids, paths
from cairn.operators import fingerprint, lineage, retrieval
from cairn.operators.ordering import position_within
from cairn.plans.projections import Views
from cairn.plans.registry import query

_DATA = "lower(trim(extension, '.')) IN ('csv','tsv','dat','xlsx','xls','mat','spe','phu','asc','sif','json','jsonl','m','npy','npz','h5','hdf5')"
_DOC = "lower(trim(extension, '.')) IN ('pdf','ppt','pptx','doc','docx','txt','md','ipynb')"
_IMG = (
    "(lower(trim(extension, '.')) IN ('png','jpg','jpeg','gif','bmp','tif','tiff','webp','svg','fig') "
    "OR lower(media_type) LIKE 'image/%')"
)


@query(
    f"""
SELECT artifact_id, device_id, extension, relative_path, split_part(relative_path, '/', -1) AS filename, size_bytes, mtime_ns
FROM fx_artifacts WHERE {_DATA} AND (lower(artifact_id) LIKE '%_t_600nm%' OR lower(relative_path) LIKE '%_t_600nm%')
ORDER BY artifact_id LIMIT 50 OFFSET 10""",
    "fx_artifacts",
)
def artifact_page(v: Views) -> DataFrame:
    """One page of data files whose path matches a pattern, in id order."""
    found = retrieval.search_artifacts(v.artifacts, q="_T_600nm", kind="data", limit=50, offset=10)
    return found.items.select("artifact_id", "device_id", "extension", "relative_path", "filename", "size_bytes", "mtime_ns")


@query(
    f"""
SELECT 'image' AS kind, count(*) AS n_artifacts FROM fx_artifacts WHERE {_IMG} HAVING count(*) > 0
UNION ALL SELECT 'document', count(*) FROM fx_artifacts WHERE {_DOC} HAVING count(*) > 0
UNION ALL SELECT 'data', count(*) FROM fx_artifacts WHERE {_DATA} HAVING count(*) > 0
UNION ALL SELECT 'other', count(*) FROM fx_artifacts WHERE NOT {_IMG} AND NOT {_DOC} AND NOT {_DATA} HAVING count(*) > 0""",
    "fx_artifacts",
)
def artifact_count_by_kind(v: Views) -> DataFrame:
    return retrieval.kind_counts(v.artifacts)


@query(
    """
SELECT device_id, count(*) AS n_artifacts, sum(size_bytes) AS total_bytes FROM fx_artifacts
WHERE lower(relative_path) LIKE '%processed data/d%5k_2t%' GROUP BY device_id""",
    "fx_artifacts",
)
def artifact_text_like(v: Views) -> DataFrame:
    """Wildcards in the artifact text filter, over the whole table."""
    hits = retrieval.filter_artifacts(v.artifacts, q="Processed Data/D%5K_2T")
    return hits.groupBy("device_id").agg(F.count(F.lit(1)).alias("n_artifacts"), F.sum("size_bytes").alias("total_bytes"))


@query(
    """
SELECT artifact_id, relative_path, extension FROM fx_artifacts
WHERE device_id = 'D121' AND lower(trim(extension, '.')) IN ('pdf','ppt','pptx') AND lower(category) <> 'slide'
ORDER BY artifact_id LIMIT 200""",
    "fx_artifacts",
)
def device_documents(v: Views) -> DataFrame:
    found = retrieval.device_documents(v.artifacts, "D121", limit=200)
    return found.items.select("artifact_id", "relative_path", "extension")


@query(
    """
SELECT device_id, count(*) AS n_documents FROM fx_artifacts
WHERE lower(trim(extension, '.')) IN ('pdf','ppt','pptx') AND lower(category) <> 'slide' GROUP BY device_id""",
    "fx_artifacts",
)
def document_counts(v: Views) -> DataFrame:
    """Documents of every device, slides left out."""
    docs = retrieval.filter_artifacts(v.artifacts, extensions=paths.DEVICE_DOCUMENT_EXTENSIONS, exclude_slides=True)
    return docs.groupBy("device_id").agg(F.count(F.lit(1)).alias("n_documents"))


@query(
    """
SELECT 'device' AS entity_type, device_id AS entity_id FROM fx_devices
 WHERE contains(lower(device_id), 'd15') OR contains(lower(display_label), 'd15') OR contains(lower(coalesce(local_device_id, '')), 'd15')
    OR contains(lower(alias), 'd15') OR contains(lower(folder_alias), 'd15')
UNION ALL SELECT 'experiment', experiment_id FROM fx_experiments
 WHERE contains(lower(experiment_id), 'd15') OR contains(lower(coalesce(sample_id, '')), 'd15')
UNION ALL SELECT 'artifact', artifact_id FROM fx_artifacts WHERE lower(artifact_id) LIKE '%d15%' OR lower(relative_path) LIKE '%d15%'""",
    "fx_devices", "fx_experiments", "fx_artifacts",
)
def federated_search(v: Views) -> DataFrame:
    return retrieval.federated_hits(v.devices, v.experiments, v.artifacts, " D15 ")


@query(
    """
SELECT device_id, device_type, display_label FROM fx_devices
WHERE device_type = 'ECONOMY' AND maker_namespace IS NULL AND (contains(lower(display_label), 'e') OR contains(lower(alias), 'e'))
ORDER BY device_id LIMIT 100""",
    "fx_devices",
)
def device_search(v: Views) -> DataFrame:
    found = retrieval.search_devices(v.devices, filters={"device_type": "ECONOMY", "maker_namespace": None}, q="E", limit=100)
    return found.items.select("device_id", "device_type", "display_label")


@query(
    """
SELECT local_device_id, maker_namespace, 'dev-' || sha256(to_json([maker_namespace, local_device_id])) AS qualified_id
FROM fx_devices WHERE maker_namespace IS NOT NULL""",
    "fx_devices",
)
def device_identity(v: Views) -> DataFrame:
    named = v.devices.where(F.col("maker_namespace").isNotNull())
    return named.select("local_device_id", "maker_namespace", ids.device_id(F.col("maker_namespace"), F.col("local_device_id")).alias("qualified_id"))


@query(
    "SELECT experiment_id, sample_id, confidence FROM fx_experiments WHERE measurement_type = 'photoluminescence' AND needs_review AND confidence = 0.25",
    "fx_experiments",
)
def experiment_exact(v: Views) -> DataFrame:
    hits = retrieval.filter_experiments(
        v.experiments, {"measurement_type": "photoluminescence", "needs_review": True, "confidence": 0.25}
    )
    return hits.select("experiment_id", "sample_id", "confidence")


@query("SELECT experiment_id FROM fx_experiments WHERE temperature_K IS NULL AND has_temperature", "fx_experiments")
def experiment_present_null(v: Views) -> DataFrame:
    """A null filter matches records that carry the key with null, not records without it."""
    return retrieval.filter_experiments(v.experiments, {"temperature_K": None}).select("experiment_id")


@query(
    "SELECT experiment_id, temperature_K FROM fx_experiments WHERE has_temperature AND temperature_K > 2.5 AND temperature_K <= 7.25",
    "fx_experiments",
)
def experiment_range(v: Views) -> DataFrame:
    wanted = retrieval.NumericRange(2.5, 7.25, include_minimum=False)
    return retrieval.filter_experiments(v.experiments, {"temperature_K": wanted}).select("experiment_id", "temperature_K")


@query(
    "SELECT experiment_id, sample_id FROM fx_experiments WHERE contains(lower(experiment_id), '77') OR contains(lower(coalesce(sample_id, '')), '77')",
    "fx_experiments",
)
def experiment_text(v: Views) -> DataFrame:
    return retrieval.filter_experiments(v.experiments, q=" 77 ").select("experiment_id", "sample_id")


@query(
    """
SELECT experiment_id, sample_id, measurement_type FROM fx_experiments
ORDER BY coalesce(sample_id, ''), coalesce(measurement_type, ''), experiment_id LIMIT 200 OFFSET 400""",
    "fx_experiments",
)
def experiment_canonical_page(v: Views) -> DataFrame:
    found = retrieval.search_experiments(v.experiments, limit=200, offset=400)
    return found.items.select("experiment_id", "sample_id", "measurement_type")


@query(
    """
SELECT experiment_id, row_number() OVER (ORDER BY coalesce(sample_id, ''), coalesce(measurement_type, ''), experiment_id) - 1 AS ordinal
FROM fx_experiments""",
    "fx_experiments",
)
def canonical_ordinals(v: Views) -> DataFrame:
    """Canonical position of every experiment, ranked over range partitions."""
    blank = F.lit("")
    keyed = v.experiments.select(
        "experiment_id", F.coalesce("sample_id", blank).alias("s"), F.coalesce("measurement_type", blank).alias("m")
    )
    return position_within(keyed, [], ["s", "m", "experiment_id"]).select("experiment_id", "ordinal")


@query("SELECT storage_source_id, relative_path, file_id FROM fx_files", "fx_files")
def file_ids(v: Views) -> DataFrame:
    return v.files.select("storage_source_id", "relative_path", "file_id")


@query("SELECT source_id, predicate, target_id, relationship_id FROM fx_relationships", "fx_relationships")
def relationship_ids(v: Views) -> DataFrame:
    return v.relationships.select("source_id", "predicate", "target_id", "relationship_id")


@query("SELECT artifact_id, relative_path FROM fx_artifacts", "fx_artifacts")
def artifact_ids(v: Views) -> DataFrame:
    return v.artifacts.select("artifact_id", "relative_path")


@query(
    """
SELECT a.experiment_id, a.relative_path AS source, b.relative_path AS target, r.predicate AS relation
FROM fx_relationships r JOIN fx_files a ON r.source_id = a.file_id JOIN fx_files b ON r.target_id = b.file_id
WHERE r.source_type = 'file' AND r.target_type = 'file' AND a.experiment_id = b.experiment_id""",
    "fx_relationships", "fx_files",
)
def experiment_lineage(v: Views) -> DataFrame:
    return lineage.experiment_lineage(v.files, v.relationships)


@query(
    """
SELECT f.experiment_id, f.relative_path AS path, count(e.relationship_id) AS n_edges
FROM fx_files f LEFT JOIN fx_relationships e ON e.source_type = 'file' AND (e.source_id = f.file_id OR e.target_id = f.file_id)
WHERE f.role = 'processed' GROUP BY f.experiment_id, f.relative_path""",
    "fx_files", "fx_relationships",
)
def related_files(v: Views) -> DataFrame:
    """Processed files with the number of lineage edges that contain them."""
    inner = lineage.experiment_lineage(v.files, v.relationships)
    rows = lineage.related_files(v.files, inner, role="processed")
    return rows.groupBy("experiment_id", "path").agg(F.count("source").alias("n_edges"))


@query(
    """
SELECT 'device' AS entity_type, d.device_id AS entity_id, count(*) AS n_edges
FROM fx_devices d JOIN fx_relationships r ON (r.target_type = 'device' AND r.target_id = d.device_id) OR (r.source_type = 'device' AND r.source_id = d.device_id)
GROUP BY d.device_id""",
    "fx_devices", "fx_relationships",
)
def entity_edges(v: Views) -> DataFrame:
    """Edges touching each device: two equality joins, no join on OR."""
    wanted = v.devices.select(F.lit("device").alias("entity_type"), F.col("device_id").alias("entity_id"))
    edges = lineage.edges_touching(v.relationships, wanted)
    return edges.groupBy("entity_type", "entity_id").agg(F.count(F.lit(1)).alias("n_edges"))


@query(
    """
SELECT r.relationship_id, r.predicate, a.relative_path AS source_path, b.relative_path AS target_path
FROM fx_relationships r LEFT JOIN fx_files a ON r.source_id = a.file_id LEFT JOIN fx_files b ON r.target_id = b.file_id""",
    "fx_relationships", "fx_files",
)
def resolved_edges(v: Views) -> DataFrame:
    refs = lineage.file_references(v.files, v.artifacts)
    return lineage.resolve_edges(v.relationships, refs).select("relationship_id", "predicate", "source_path", "target_path")


@query(
    """
SELECT DISTINCT a.artifact_id, s.relative_path AS source, t.relative_path AS target
FROM fx_relationships r JOIN fx_files s ON r.source_id = s.file_id JOIN fx_files t ON r.target_id = t.file_id
JOIN fx_files f ON f.file_id IN (r.source_id, r.target_id) JOIN fx_artifacts a ON a.relative_path = f.relative_path
WHERE r.predicate = 'derived_from'""",
    "fx_relationships", "fx_files", "fx_artifacts",
)
def artifact_derived_from(v: Views) -> DataFrame:
    refs = lineage.file_references(v.files, v.artifacts)
    return lineage.artifact_derivations(v.artifacts, v.relationships, refs).select("artifact_id", "source", "target")


@query(
    """
SELECT r.target_id AS device_id, count(DISTINCT r.source_id) AS n_experiments, count(DISTINCT x.sample_id) AS n_samples
FROM fx_relationships r JOIN fx_experiments x ON x.experiment_id = r.source_id
WHERE r.source_type = 'experiment' AND r.predicate = 'measured_on' AND r.target_type = 'device' GROUP BY r.target_id""",
    "fx_relationships", "fx_experiments",
)
def device_experiments(v: Views) -> DataFrame:
    """Experiments measured on each device."""
    linked = lineage.device_experiment_ids(v.relationships).join(v.experiments.select("experiment_id", "sample_id"), on="experiment_id")
    return linked.groupBy("device_id").agg(
        F.count(F.lit(1)).alias("n_experiments"), F.count_distinct("sample_id").alias("n_samples")
    )


@query(
    """
SELECT x.experiment_id, x.sample_id FROM fx_experiments x
WHERE x.experiment_id IN (SELECT source_id FROM fx_relationships WHERE predicate = 'measured_on' AND target_id = 'D142')
ORDER BY coalesce(x.sample_id, ''), coalesce(x.measurement_type, ''), x.experiment_id LIMIT 200""",
    "fx_experiments", "fx_relationships",
)
def device_experiment_page(v: Views) -> DataFrame:
    found = retrieval.device_experiments(v.experiments, v.relationships, "D142", limit=200)
    return found.items.select("experiment_id", "sample_id")


@query(
    """
SELECT x.experiment_id, e.target_id AS device_id,
       CASE WHEN c.has_evidence THEN 'first; second' ELSE 'explicit device-directory context' END AS evidence,
       CASE WHEN c.ordinal IS NULL THEN e.provenance_source ELSE c.source_reference END AS source_reference,
       c.extraction_method, coalesce(c.review_status, 'unknown') AS review_status
FROM fx_experiments x
JOIN (SELECT * FROM fx_relationships WHERE predicate = 'measured_on' QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY relationship_id) = 1) e
  ON e.source_id = x.experiment_id
LEFT JOIN (SELECT * FROM fx_claims WHERE field = 'measured_on_device' QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY ordinal) = 1) c
  ON c.subject_id = x.experiment_id""",
    "fx_experiments", "fx_relationships", "fx_claims",
)
def measured_on(v: Views) -> DataFrame:
    return lineage.measured_on(v.experiments, v.relationships, v.claims)


@query(
    """
SELECT subject_id, count(*) AS n_claims, count(DISTINCT field) AS n_fields, min(ordinal) AS first_ordinal
FROM fx_claims WHERE subject_type = 'experiment' GROUP BY subject_id""",
    "fx_claims",
)
def claims_by_subject(v: Views) -> DataFrame:
    own = lineage.claims_of(v.claims, subject_type="experiment")
    return own.groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("n_claims"), F.count_distinct("field").alias("n_fields"), F.min("ordinal").alias("first_ordinal")
    )


@query(
    """
SELECT subject_id AS experiment_id, ordinal, value_json, source_reference, CASE WHEN has_evidence THEN 'first; second' ELSE '' END AS evidence, review_status
FROM fx_claims WHERE field = 'measured_on_raw_match'""",
    "fx_claims",
)
def review_evidence(v: Views) -> DataFrame:
    rows = lineage.review_evidence(v.claims)
    return rows.select(
        "experiment_id", "ordinal", "value_json", "source_reference", F.array_join("evidence", "; ").alias("evidence"), "review_status"
    )


@query(
    """
SELECT storage_source_id, relative_path FROM fx_page_refs UNION SELECT storage_source_id, relative_path FROM fx_files
UNION SELECT 'src', relative_path FROM fx_artifacts""",
    "fx_page_refs", "fx_files", "fx_artifacts",
)
def storage_references(v: Views) -> DataFrame:
    """Distinct storage references of page files, experiment files and artifacts."""
    files = v.files.select("storage_source_id", "relative_path").unionByName(v.page_refs.select("storage_source_id", "relative_path"))
    return retrieval.storage_references(files, v.artifacts)


def _fingerprint_sql(name: str, table: str, columns: list[str]) -> str:
    record = ", ".join(f"{c} := {c}" for c in sorted(columns))
    return (
        f"SELECT '{name}' AS table_name, count(*) AS n_rows, "
        f"CAST(sum(CAST('0x' || substr(sha256(to_json(struct_pack({record}))), 1, 15) AS HUGEINT)) AS VARCHAR) AS fingerprint FROM {table}"
    )


_PRINTED = {
    "artifacts": ("fx_artifacts", ["artifact_id", "device_id", "relative_path", "extension", "size_bytes", "mtime_ns"]),
    "experiment_files": ("fx_files", ["experiment_id", "role", "relative_path", "file_id"]),
    "relationships": ("fx_relationships", ["relationship_id", "source_id", "predicate", "target_id"]),
}


@query(
    "\nUNION ALL ".join(_fingerprint_sql(n, t, c) for n, (t, c) in _PRINTED.items()),
    "fx_artifacts", "fx_files", "fx_relationships",
)
def catalog_fingerprint(v: Views) -> DataFrame:
    tables = {"artifacts": v.artifacts, "experiment_files": v.files, "relationships": v.relationships}
    return fingerprint.catalog_fingerprint({n: tables[n].select(*_PRINTED[n][1]) for n in _PRINTED})
