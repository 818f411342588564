"""Registered queries: device folders and derived experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators import devices, linkage
from cairn.plans.projections import Views, view
from cairn.plans.registry import query

# Matching by stem: every derived file of the projection reduces to its base.
view(
    "fx_linked",
    """
SELECT a.device_id, a.base, a.relative_path, split_part(a.relative_path, '/', 2) AS folder,
       regexp_replace(split_part(a.relative_path, '/', -1), '\\.[^.]+$', '') AS stem
FROM fx_artifacts a JOIN fx_devices d ON a.device_id = d.device_id AND split_part(a.relative_path, '/', 1) = d.folder_alias
WHERE split_part(a.relative_path, '/', 2) IN ('Initial Data', 'Initial data after processing', 'Processed Data')""",
    "fx_artifacts", "fx_devices",
)
view(
    "fx_canonical",
    """
SELECT f.*, CASE WHEN folder <> 'Processed Data' OR r.base IS NOT NULL THEN f.base ELSE f.stem END AS canonical,
       folder = 'Processed Data' AND r.base IS NULL AS unresolved,
       CASE WHEN folder <> 'Processed Data' THEN 'raw' WHEN f.relative_path LIKE '%.png' THEN 'figure' ELSE 'processed' END AS role
FROM fx_linked f LEFT JOIN (SELECT DISTINCT device_id, base FROM fx_linked WHERE folder <> 'Processed Data') r
  ON f.device_id = r.device_id AND f.base = r.base""",
    "fx_linked",
)
view(
    "fx_derived",
    """
SELECT g.*, g.device_id || '-' || CASE WHEN ordinal < 10000 THEN lpad(CAST(ordinal AS VARCHAR), 4, '0') ELSE CAST(ordinal AS VARCHAR) END AS experiment_id
FROM (SELECT device_id, canonical, unresolved, sum(CASE WHEN role = 'raw' THEN 1 ELSE 0 END) AS n_raw, count(*) AS n_files,
             row_number() OVER (PARTITION BY device_id ORDER BY unresolved, canonical) - 1 AS ordinal
      FROM fx_canonical GROUP BY device_id, canonical, unresolved) g""",
    "fx_canonical",
)


@query(
    """
SELECT 'D' || regexp_extract(folder_name, '^D([0-9]+)', 1) AS device_id, count(*) AS n_folders, min(folder_name) AS first_folder, max(folder_name) AS last_folder
FROM fx_folders WHERE regexp_matches(folder_name, '^D[0-9]+') GROUP BY 1 HAVING count(*) > 1""",
    "fx_folders",
)
def ambiguous_devices(v: Views) -> DataFrame:
    return devices.ambiguous_devices(v.folders)


@query(
    """
SELECT folder_name, CASE WHEN n IS NULL THEN 'basename does not begin with a standalone D followed by digits'
   ELSE 'ambiguous duplicate identity: multiple top-level folders resolve to candidate device ' || d END AS reason
FROM (SELECT folder_name, CASE WHEN regexp_matches(folder_name, '^D[0-9]+') THEN 'D' || regexp_extract(folder_name, '^D([0-9]+)', 1) END AS d,
             CASE WHEN regexp_matches(folder_name, '^D[0-9]+') THEN count(*) OVER (PARTITION BY CASE WHEN regexp_matches(folder_name, '^D[0-9]+')
                THEN regexp_extract(folder_name, '^D([0-9]+)', 1) END) END AS n FROM fx_folders)
WHERE n IS NULL OR n > 1""",
    "fx_folders",
)
def unresolved_folders(v: Views) -> DataFrame:
    _, unresolved = devices.classify_folders(v.folders)
    return unresolved.select("folder_name", "reason")


@query(
    """
SELECT min(folder_name) AS alias, 'D' || regexp_extract(folder_name, '^D([0-9]+)', 1) AS device_id,
       'dev-' || sha256(to_json(['QC', 'D' || regexp_extract(folder_name, '^D([0-9]+)', 1)])) AS qualified_id, 'chip' AS token
FROM fx_folders WHERE regexp_matches(folder_name, '^D[0-9]+') GROUP BY regexp_extract(folder_name, '^D([0-9]+)', 1) HAVING count(*) = 1""",
    "fx_folders",
)
def device_aliases(v: Views) -> DataFrame:
    """Recognized devices with alias, namespace-qualified id and folder token claim."""
    recognized, _ = devices.classify_folders(v.folders)
    rows, claims = devices.build_devices(recognized, "QC", "src")
    tokens = claims.where(F.col("field") == "folder_token").select(
        F.col("subject_id").alias("device_id"), F.get_json_object("value_json", "$").alias("token")
    )
    joined = rows.join(tokens, on="device_id")
    return joined.select(
        F.get("aliases", 0).alias("alias"), F.col("local_device_id").alias("device_id"), F.col("device_id").alias("qualified_id"), "token"
    )


@query(
    """
SELECT a.artifact_id, CASE WHEN CAST(substr(a.device_id, 2) AS BIGINT) % 10 <> 0 THEN a.device_id END AS device_id,
       CASE WHEN a.extension = 'ppt' THEN '{"deterministic_extraction":"unsupported"}' ELSE '{}' END AS metadata_json
FROM fx_artifacts a""",
    "fx_artifacts",
)
def device_scan_artifacts(v: Views) -> DataFrame:
    """Artifacts of a folder scan; files of ambiguous folders stay unbound."""
    recognized, _ = devices.classify_folders(v.folders)
    return devices.build_artifacts(v.listing, recognized, "src").select("artifact_id", "device_id", "metadata_json")


@query(
    """
SELECT folder_name AS relative_folder, 'dev-' || sha256(to_json(['QC', 'D' || substr(regexp_extract(folder_name, '[0-9]+'), 1)])) AS device_id,
       count(*) AS n_artifacts
FROM (SELECT f.folder_name FROM fx_folders f JOIN fx_artifacts a ON split_part(a.relative_path, '/', 1) = f.folder_name
      WHERE CAST(regexp_extract(f.folder_name, '[0-9]+') AS BIGINT) % 10 = 0)
GROUP BY folder_name""",
    "fx_folders", "fx_artifacts",
)
def identity_decisions(v: Views) -> DataFrame:
    """Human decisions on every ambiguous folder applied to the scan: artifacts bound per decided folder."""
    recognized, unresolved = devices.classify_folders(v.folders)
    rows, claims = devices.build_devices(recognized)
    artifacts = devices.build_artifacts(v.listing, recognized, "src")
    scan = devices.DeviceScan(rows, claims, artifacts, devices.describes_edges(artifacts), unresolved, unresolved)
    decided = unresolved.where(F.col("candidate_device_id").isNotNull()).select(
        F.col("folder_name").alias("relative_folder"), F.lit("QC").alias("maker_namespace"),
        F.col("candidate_device_id").alias("local_device_id"), F.col("candidate_device_id").alias("display_label"),
        F.lit("review").alias("provenance_source"), F.array().cast("array<string>").alias("aliases"), F.array().cast("array<string>").alias("evidence"),
    )
    result = devices.apply_decisions(scan, decided)
    bound = result.relationships.where(F.col("review_state") == "accepted").select(
        F.col("source_id").alias("artifact_id"), F.col("target_id").alias("device_id")
    )
    named = result.artifacts.select("artifact_id", F.split_part("relative_path", F.lit("/"), F.lit(1)).alias("relative_folder"))
    return bound.join(named, on="artifact_id").groupBy("relative_folder", "device_id").agg(F.count(F.lit(1)).alias("n_artifacts"))


@query(
    """
SELECT experiment_id, device_id, canonical, unresolved AS needs_review, CAST(n_raw AS BIGINT) AS n_raw, CAST(n_files AS BIGINT) AS n_files
FROM fx_derived""",
    "fx_derived",
)
def linkage_experiments(v: Views) -> DataFrame:
    found = linkage.derive_experiments(v.devices, v.artifacts).experiments
    total = F.col("n_raw") + F.col("n_processed") + F.col("n_figure") + F.col("n_intermediate")
    return found.select("experiment_id", "device_id", "canonical", "needs_review", "n_raw", total.alias("n_files"))


@query("SELECT device_id, max(ordinal) AS last_ordinal, count(*) AS n_experiments FROM fx_derived GROUP BY device_id", "fx_derived")
def experiment_ordinals(v: Views) -> DataFrame:
    found = linkage.derive_experiments(v.devices, v.artifacts).experiments
    return found.groupBy("device_id").agg(F.max("ordinal").alias("last_ordinal"), F.count(F.lit(1)).alias("n_experiments"))


@query(
    """
SELECT DISTINCT 'file-' || sha256(to_json(['src', s.relative_path])) AS source_id, 'file-' || sha256(to_json(['src', t.relative_path])) AS target_id
FROM fx_canonical s JOIN fx_canonical t ON s.device_id = t.device_id AND s.canonical = t.canonical AND s.unresolved = t.unresolved
WHERE (s.role = 'raw' AND (t.role = 'processed' OR (t.role = 'figure' AND NOT EXISTS (
         SELECT 1 FROM fx_canonical p WHERE p.device_id = t.device_id AND p.canonical = t.canonical AND p.unresolved = t.unresolved AND p.role = 'processed'
           AND p.stem = regexp_replace(t.stem, '_(linear|log)$', '')))))
   OR (s.role = 'processed' AND t.role = 'figure' AND s.stem = regexp_replace(t.stem, '_(linear|log)$', '') AND EXISTS (
         SELECT 1 FROM fx_canonical p WHERE p.device_id = t.device_id AND p.canonical = t.canonical AND p.unresolved = t.unresolved AND p.role = 'raw'))""",
    "fx_canonical",
)
def linkage_edges(v: Views) -> DataFrame:
    edges = linkage.derived_from_edges(linkage.derive_experiments(v.devices, v.artifacts))
    return edges.select("source_id", "target_id")


view(
    "fx_fed",
    """
  SELECT t.* FROM fx_canonical t WHERE t.role = 'processed' OR (t.role = 'figure' AND NOT EXISTS (
    SELECT 1 FROM fx_canonical p WHERE p.device_id = t.device_id AND p.canonical = t.canonical AND p.unresolved = t.unresolved AND p.role = 'processed'
      AND p.stem = regexp_replace(t.stem, '_(linear|log)$', '')))""",
    "fx_canonical",
)


@query(
    """
SELECT d.experiment_id, m.side, m.file_id FROM (
  SELECT DISTINCT device_id, canonical, unresolved, CASE WHEN role = 'raw' THEN 'upstream' ELSE 'downstream' END AS side,
         'file-' || sha256(to_json(['src', relative_path])) AS file_id
  FROM (SELECT * FROM fx_canonical WHERE role = 'raw' UNION ALL SELECT * FROM fx_fed)) m
JOIN (SELECT DISTINCT r.device_id, r.canonical, r.unresolved FROM fx_canonical r JOIN fx_fed f
        ON r.device_id = f.device_id AND r.canonical = f.canonical AND r.unresolved = f.unresolved WHERE r.role = 'raw') both_sides
  ON m.device_id = both_sides.device_id AND m.canonical = both_sides.canonical AND m.unresolved = both_sides.unresolved
JOIN fx_derived d ON m.device_id = d.device_id AND m.canonical = d.canonical AND m.unresolved = d.unresolved""",
    "fx_fed", "fx_derived",
)
def linkage_members(v: Views) -> DataFrame:
    """Factorised ``derived_from``: one row per file and side."""
    return linkage.derivation_members(linkage.derive_experiments(v.devices, v.artifacts))


@query(
    """
SELECT d.experiment_id, g.device_id, CAST(g.n_raw AS BIGINT) AS n_raw, CAST(g.n_processed AS BIGINT) AS n_processed, CAST(g.n_figure AS BIGINT) AS n_figure,
       g.unresolved AS needs_review, CASE WHEN g.joined > 1 THEN 'accepted' ELSE 'unknown' END AS review_state
FROM (SELECT device_id, unresolved, island, min(canonical) AS canonical, sum(n_raw) AS n_raw, count(*) AS joined,
             min_by(n_processed, canonical) AS n_processed, min_by(n_figure, canonical) AS n_figure
      FROM (SELECT *, CASE WHEN unresolved THEN row_number() OVER (PARTITION BY device_id ORDER BY unresolved, canonical)
                      ELSE sum(CASE WHEN feeds THEN 0 ELSE 1 END) OVER (PARTITION BY device_id, unresolved ORDER BY canonical) END AS island
            FROM (SELECT *, coalesce(lag(n_processed + n_figure) OVER (PARTITION BY device_id, unresolved ORDER BY canonical), 0) > 0 AS feeds
                  FROM (SELECT device_id, canonical, unresolved, sum(CASE WHEN role = 'raw' THEN 1 ELSE 0 END) AS n_raw,
                               sum(CASE WHEN role = 'processed' THEN 1 ELSE 0 END) AS n_processed, sum(CASE WHEN role = 'figure' THEN 1 ELSE 0 END) AS n_figure
                        FROM fx_canonical GROUP BY device_id, canonical, unresolved)))
      GROUP BY device_id, unresolved, island) g
JOIN fx_derived d ON g.device_id = d.device_id AND g.canonical = d.canonical AND g.unresolved = d.unresolved""",
    "fx_derived",
)
def reviewed_merge(v: Views) -> DataFrame:
    """Chained decisions: every matched experiment with derived files takes the next one's raw files, to the end of the chain."""
    plain = linkage.derive_experiments(v.devices, v.artifacts)
    by_name = Window.partitionBy("device_id").orderBy("canonical")
    named = plain.experiments.where(~F.col("needs_review")).select("device_id", "canonical", (F.col("n_processed") + F.col("n_figure") > 0).alias("feeds"), F.lead("canonical").over(by_name).alias("raw_stem"))
    reviewed = named.where(F.col("feeds") & F.col("raw_stem").isNotNull()).select(
        F.col("canonical").alias("processed_stem"), "raw_stem", F.lit("review").alias("source_reference"), F.array().cast("array<string>").alias("evidence")
    )
    found = linkage.derive_experiments(v.devices, v.artifacts, reviewed, plain).experiments
    return found.select("experiment_id", "device_id", "n_raw", "n_processed", "n_figure", "needs_review", "review_state")


@query(
    """
SELECT 'rel-' || sha256(to_json(['experiment', experiment_id, 'measured_on', 'device', device_id, device_id || ' chip'])) AS relationship_id,
       experiment_id, '{"device_id":"' || device_id || '","directory_context":"' || device_id || ' chip"}' AS value_json
FROM fx_derived""",
    "fx_derived",
)
def linkage_measured_on(v: Views) -> DataFrame:
    """``measured_on`` edges and claims of the derived experiments."""
    found = linkage.derive_experiments(v.devices, v.artifacts).experiments
    edges = linkage.measured_on_edges(found).select(F.col("source_id").alias("experiment_id"), "relationship_id")
    claims = linkage.measured_on_claims(found).select(F.col("subject_id").alias("experiment_id"), "value_json")
    return edges.join(claims, on="experiment_id")
