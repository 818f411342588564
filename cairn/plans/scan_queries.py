"""Registered queries: filename features, grouping, proposals, previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import filename, gates, paths
from cairn.functions.registry import FeatureRegistry
from cairn.functions.text import collapse_whitespace
from cairn.operators import documents, merging, previews, proposals
from cairn.plans.projections import Views, view
from cairn.plans.registry import query

view(
    "fx_stems",
    """
SELECT device_id, relative_path, split_part(relative_path, '/', 2) AS folder, regexp_replace(split_part(relative_path, '/', -1), '\\.[^.]+$', '') AS stem,
       trim(regexp_replace(lower(regexp_replace(split_part(relative_path, '/', -1), '\\.[^.]+$', '')), '[^a-z0-9.]+', '_', 'g'), '_') AS norm
FROM fx_artifacts""",
    "fx_artifacts",
)
view(
    "fx_groups",
    """
SELECT *, regexp_replace(norm, '(_(pl|linear|log|self|drr|dr_r|avg[0-9]*))+$', '') AS group_key,
       CASE WHEN folder = 'Initial Data' THEN 'raw' WHEN folder = 'Initial data after processing' THEN 'intermediate'
            WHEN folder = 'Processed Data' AND relative_path LIKE '%.png' THEN 'figure' WHEN folder = 'Processed Data' THEN 'processed' END AS role,
       TRY_CAST(regexp_extract(norm, '(?:^|[^a-z0-9])([0-9]+(?:\\.[0-9]+)?)k(?:pl|ref)?(?:[^a-z0-9]|$)', 1) AS DOUBLE) AS temperature_K,
       TRY_CAST(regexp_extract(norm, '(?:^|[^a-z0-9])([0-9]+(?:\\.[0-9]+)?)t(?:p[0-9]|[^a-z0-9])', 1) AS DOUBLE) AS magnetic_field_T,
       TRY_CAST(regexp_extract(norm, '(?:^|[^a-z0-9])([0-9]+(?:\\.[0-9]+)?)nm(?:[^a-z]|$)', 1) AS DOUBLE) AS excitation_wavelength_nm,
       CASE WHEN regexp_matches(norm, '(?:^|[^a-z0-9]|k)pl(?:[^a-z0-9]|$)') THEN 'photoluminescence' END AS measurement_type,
       nullif(upper(regexp_extract(norm, '(?:^|[^a-z0-9])((?:d|yz)[0-9]{2,4})(?:[^a-z0-9]|$)', 1)), '') AS sample_id
FROM fx_stems""",
    "fx_stems",
)
_SUPPORTED = "regexp_matches(relative_path, '\\.(csv|dat|xlsx|xls|png)$')"


def _norm(v: Views) -> DataFrame:
    return v.artifacts.select("relative_path", paths.stem(F.col("relative_path")).alias("stem")).withColumn(
        "norm", filename.normalize_stem(F.col("stem"))
    )


def _feature(v: Views, name: str, value: Column) -> DataFrame:
    return _norm(v).select("relative_path", value.alias(name))


@query("SELECT relative_path, temperature_K FROM fx_groups", "fx_groups")
def filename_temperature(v: Views) -> DataFrame:
    return _feature(v, "temperature_K", filename.temperature(F.col("norm")))


@query("SELECT relative_path, magnetic_field_T FROM fx_groups", "fx_groups")
def filename_field(v: Views) -> DataFrame:
    return _feature(v, "magnetic_field_T", filename.magnetic_field(F.col("norm")))


@query("SELECT relative_path, excitation_wavelength_nm FROM fx_groups", "fx_groups")
def filename_wavelength(v: Views) -> DataFrame:
    return _feature(v, "excitation_wavelength_nm", filename.excitation_wavelength(F.col("norm")))


@query("SELECT relative_path, measurement_type FROM fx_groups", "fx_groups")
def filename_type(v: Views) -> DataFrame:
    return _feature(v, "measurement_type", filename.measurement_type(F.col("norm")))


@query("SELECT relative_path, sample_id FROM fx_groups", "fx_groups")
def filename_sample(v: Views) -> DataFrame:
    return _feature(v, "sample_id", filename.sample_id(F.col("norm")))


@query(
    """
SELECT l_orderkey, l_linenumber, 300 * (1 + l_suppkey % 4) AS grating, l_partkey % 100 AS stage, CAST((l_suppkey % 10) + 0.5 AS DOUBLE) AS integration_s,
       l_linenumber AS averages, (l_partkey % 360) + 0.5 AS rotation, 'p' || CAST(l_linenumber AS VARCHAR) AS point
FROM (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem)""",
)
def filename_settings(v: Views) -> DataFrame:
    """Grating, stage, integration, averages, rotation and point label written and read back for every order line."""
    part, supp, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    stem = F.concat_ws(
        "_", F.lit("D356"), F.concat(F.lit("p"), line.cast("string")), F.concat((F.lit(300) * (1 + supp % 4)).cast("string"), F.lit("g")),
        F.concat((supp % 10).cast("string"), F.lit("p5sx"), line.cast("string")),
        F.concat(F.lit("Rot"), (part % 360).cast("string"), F.lit("p5deg")), F.concat(F.lit("Stage"), (part % 100).cast("string")),
    )
    rows = v.table("lineitem").select("l_orderkey", "l_linenumber", stem.alias("stem")).withColumn("norm", filename.normalize_stem(F.col("stem")))
    meta = filename.metadata_struct(F.col("stem"), F.col("norm"))
    return rows.select("l_orderkey", "l_linenumber", meta.alias("m")).select(
        "l_orderkey", "l_linenumber", F.col("m.grating_grooves_per_mm").alias("grating"), F.col("m.stage_position").alias("stage"),
        F.col("m.integration_time_s").alias("integration_s"), F.col("m.averages").alias("averages"),
        F.get("m.rotations_deg", 0).alias("rotation"), F.col("m.measurement_point_label").alias("point"),
    )


@query(
    """
SELECT relative_path, CASE WHEN folder = 'notes' AND NOT regexp_matches(lower(relative_path), '\\.(csv|dat|xlsx|xls|png)$')
   THEN 'unsupported extension ''.' || lower(regexp_extract(relative_path, '\\.([^.]+)$', 1)) || ''': ' || relative_path END AS reason
FROM fx_groups WHERE role IS NULL""",
    "fx_groups",
)
def unclassified_files(v: Views) -> DataFrame:
    return proposals.unclassified_files(v.listing).select("relative_path", "reason")


@query(f"SELECT relative_path, group_key FROM fx_groups WHERE role IS NOT NULL AND {_SUPPORTED}", "fx_groups")
def group_keys(v: Views) -> DataFrame:
    return proposals.classified_files(v.listing).select("relative_path", "group_key")


@query(
    """
SELECT group_key, sum(CASE WHEN role = 'raw' THEN 1 ELSE 0 END) AS n_raw, sum(CASE WHEN role = 'processed' THEN 1 ELSE 0 END) AS n_processed,
       sum(CASE WHEN role = 'figure' THEN 1 ELSE 0 END) AS n_figure, sum(CASE WHEN role = 'intermediate' THEN 1 ELSE 0 END) AS n_intermediate,
       min(CASE WHEN role = 'raw' THEN relative_path END) AS first_raw
FROM fx_groups WHERE role IS NOT NULL GROUP BY group_key""",
    "fx_groups",
)
def proposal_roles(v: Views) -> DataFrame:
    groups = proposals.scan(v.listing).proposals
    return groups.select("group_key", "n_raw", "n_processed", "n_figure", "n_intermediate", "first_raw")


@query(
    """
SELECT device_id, 'temperature_K' AS field, count(DISTINCT temperature_K) AS n_values,
       'conflicting temperature_K values: [' || string_agg(DISTINCT CAST(temperature_K AS VARCHAR), ', ' ORDER BY CAST(temperature_K AS VARCHAR)) || ']' AS warning
FROM fx_groups WHERE role IS NOT NULL GROUP BY device_id HAVING count(DISTINCT temperature_K) > 1
UNION ALL
SELECT device_id, 'magnetic_field_T', count(DISTINCT magnetic_field_T),
       'conflicting magnetic_field_T values: [' || string_agg(DISTINCT CAST(magnetic_field_T AS VARCHAR), ', ' ORDER BY CAST(magnetic_field_T AS VARCHAR)) || ']'
FROM fx_groups WHERE role IS NOT NULL GROUP BY device_id HAVING count(DISTINCT magnetic_field_T) > 1
UNION ALL
SELECT device_id, 'excitation_wavelength_nm', count(DISTINCT excitation_wavelength_nm),
       'conflicting excitation_wavelength_nm values: [' || string_agg(DISTINCT CAST(excitation_wavelength_nm AS VARCHAR), ', ' ORDER BY CAST(excitation_wavelength_nm AS VARCHAR)) || ']'
FROM fx_groups WHERE role IS NOT NULL GROUP BY device_id HAVING count(DISTINCT excitation_wavelength_nm) > 1""",
    "fx_groups",
)
def metadata_conflicts(v: Views) -> DataFrame:
    """Fields in which the files of one device folder disagree, with the warning text."""
    files = merging.with_features(
        v.files.select("relative_path", paths.stem(F.col("relative_path")).alias("stem"))
    ).select(F.regexp_extract("relative_path", "^(\\S+)", 1).alias("device_id"), "meta.*")
    fields = ("temperature_K", "magnetic_field_T", "excitation_wavelength_nm", "measurement_type")
    return merging.conflicts_by_key(files, ["device_id"], fields)


@query(
    """
SELECT group_key, (CASE WHEN max(sample_id) IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN max(measurement_type) IS NOT NULL THEN 25 ELSE 0 END + 30
       + CASE WHEN bool_or(role = 'raw') THEN 15 ELSE 0 END + CASE WHEN bool_or(role = 'processed') THEN 10 ELSE 0 END) / 100.0 AS confidence
FROM fx_groups WHERE role IS NOT NULL GROUP BY group_key""",
    "fx_groups",
)
def proposal_confidence(v: Views) -> DataFrame:
    return proposals.scan(v.listing).proposals.select("group_key", "confidence")


@query(
    """
SELECT group_key, CASE WHEN bool_or(role = 'figure') AND NOT bool_or(role IN ('raw', 'processed')) THEN 1 ELSE 0 END AS n_warnings
FROM fx_groups WHERE role IS NOT NULL GROUP BY group_key""",
    "fx_groups",
)
def proposal_warnings(v: Views) -> DataFrame:
    return proposals.scan(v.listing).proposals.select("group_key", F.size("warnings").alias("n_warnings"))


@query(
    """
SELECT l_orderkey, l_linenumber,
       CASE WHEN regexp_matches(token, '^[0-9.]*TG[+][0-9.]*BG=0(Rev)?$') THEN 'constant_doping'
            WHEN regexp_matches(token, '^[0-9.]*TG-[0-9.]*BG=0(Rev)?$') THEN 'constant_displacement_field' END AS control_mode,
       CASE WHEN regexp_matches(token, '^[^=]*BG[12]?=0Rev$') THEN 'reverse' END AS sweep_direction,
       CASE WHEN regexp_matches(token, '^[0-9.]*(TG[+-][0-9.]*BG|BG1[+-][0-9.]*BG2)=0(Rev)?$') THEN 1 ELSE 0 END AS n_constraints
FROM fx_gates""",
    "fx_gates",
)
def gate_constraints(v: Views) -> DataFrame:
    read = v.gate_stems.select("l_orderkey", "l_linenumber", gates.read_tokens(F.col("stem")).alias("t"))
    found = F.filter(F.transform("t", lambda t: t["constraint"]), lambda c: c.isNotNull())
    return read.select(
        "l_orderkey", "l_linenumber", F.get(found, 0)["control_mode"].alias("control_mode"),
        F.get(found, 0)["sweep_direction"].alias("sweep_direction"), F.size(found).alias("n_constraints"),
    )


@query(
    """
SELECT l_orderkey, l_linenumber,
       CASE WHEN regexp_matches(token, 'BG[12]') AND token <> 'TG+BG=1' THEN 'split' WHEN contains(token, 'BG') AND token <> 'TG+BG=1' THEN 'single' END
         AS back_gate_topology,
       CASE WHEN token LIKE 'FixTG%' THEN CAST(replace(regexp_extract(token, 'FixTG([0-9p]+)V', 1), 'p', '.') AS DOUBLE) END AS fixed_top_gate_V,
       CASE WHEN regexp_matches(token, '=[^0]*[1-9]') THEN 'unsupported electrical expression: ' || token END AS note
FROM fx_gates""",
    "fx_gates",
)
def topology(v: Views) -> DataFrame:
    read = v.gate_stems.withColumn("t", gates.read_tokens(F.col("stem"))).withColumn("e", gates.electrical_struct(F.col("t")))
    return read.select(
        "l_orderkey", "l_linenumber", "e.back_gate_topology", "e.fixed_top_gate_V", F.get("e.notes", 0).alias("note")
    )


@query(
    """
SELECT 'D' || CAST(100 + g.l_partkey % 900 AS VARCHAR) AS device_id, count(DISTINCT g.token) AS n_states
FROM fx_gates g GROUP BY 1""",
    "fx_gates",
)
def electrical_groups(v: Views) -> DataFrame:
    """Grouping keys split by electrical state: number of distinct keys per device."""
    device = F.concat(F.lit("D"), (F.lit(100) + F.col("l_partkey") % 900).cast("string"))
    stems = v.gate_stems.select(device.alias("device_id"), F.concat(device, F.lit("_"), F.col("token")).alias("stem")).distinct()
    return merging.with_features(stems).groupBy("device_id").agg(F.count_distinct("group_key").alias("n_states"))


_RAW_PAIRS = "FROM fx_groups a JOIN fx_groups b ON a.group_key = b.group_key"


@query(
    f"""
SELECT a.relative_path AS source, b.relative_path AS target {_RAW_PAIRS}
WHERE a.role = 'raw' AND b.role = 'processed' AND b.stem IN (a.stem, a.stem || '_PL')""",
    "fx_groups",
)
def raw_to_processed(v: Views) -> DataFrame:
    edges, _ = proposals.raw_links(proposals.classified_files(v.listing))
    return edges.select("source", "target")


@query(
    f"""
SELECT a.relative_path AS source, b.relative_path AS target {_RAW_PAIRS}
WHERE a.role = 'processed' AND b.role = 'figure' AND b.stem IN (a.stem, a.stem || '_linear', a.stem || '_log')""",
    "fx_groups",
)
def processed_to_figure(v: Views) -> DataFrame:
    edges, _ = proposals.figure_links(proposals.classified_files(v.listing))
    return edges.select("source", "target")


@query(
    """
SELECT 'processed' AS source_role, a.relative_path AS source, 'no figure file with a known derivation' AS reason
FROM fx_groups a WHERE a.role = 'processed' AND NOT EXISTS (
  SELECT 1 FROM fx_groups b WHERE b.group_key = a.group_key AND b.role = 'figure' AND b.stem IN (a.stem, a.stem || '_linear', a.stem || '_log'))
UNION ALL
SELECT 'raw', a.relative_path, 'no processed file with a known derivation'
FROM fx_groups a WHERE a.role = 'raw' AND EXISTS (SELECT 1 FROM fx_groups b WHERE b.group_key = a.group_key AND b.role = 'processed')
 AND NOT EXISTS (SELECT 1 FROM fx_groups b WHERE b.group_key = a.group_key AND b.role = 'processed' AND b.stem IN (a.stem, a.stem || '_PL'))""",
    "fx_groups",
)
def unresolved_links(v: Views) -> DataFrame:
    _, unresolved = proposals.lineage(proposals.classified_files(v.listing))
    return unresolved.select("source_role", "source", "reason")


view(
    "fx_twins",
    """
SELECT relative_path, role, group_key, regexp_replace(split_part(relative_path, '/', -1), '\\.[^.]+$', '') AS stem FROM fx_groups WHERE role IS NOT NULL
UNION ALL
SELECT replace(relative_path, 'Processed Data/', 'Processed Data/again/'), role, group_key, regexp_replace(split_part(relative_path, '/', -1), '\\.[^.]+$', '')
FROM fx_groups WHERE role IN ('processed', 'figure') AND CAST(substr(device_id, 2) AS BIGINT) % 3 = 0""",
    "fx_groups",
)
_TWIN_LINK = """
(a.role = 'raw' AND b.role = 'processed' AND regexp_replace(b.stem, '_PL$', '') = a.stem
  OR a.role = 'processed' AND b.role = 'figure' AND b.stem IN (a.stem, a.stem || '_linear', a.stem || '_log'))"""
view(
    "fx_twin_links",
    f"""
SELECT a.role AS source_role, a.relative_path AS source, b.role AS target_role, b.stem AS target_stem, b.relative_path AS candidate,
       row_number() OVER (PARTITION BY a.relative_path, b.role, b.stem ORDER BY b.relative_path) - 1 AS ordinal,
       count(*) OVER (PARTITION BY a.relative_path, b.role, b.stem) AS n
FROM fx_twins a JOIN fx_twins b ON a.group_key = b.group_key AND {_TWIN_LINK}""",
    "fx_twins",
)


def _twins(v: Views) -> DataFrame:
    """The listing, with every third device's derived files a second time in a folder below."""
    path = F.col("relative_path")
    number = F.regexp_extract(path, r"^D(\d+) chip/Processed Data/", 1)
    again = v.listing.where((number != "") & (number.try_cast("long") % 3 == 0)).withColumn(
        "relative_path", F.replace(path, F.lit("Processed Data/"), F.lit("Processed Data/again/"))
    )
    return v.listing.unionByName(again)


@query(
    """
SELECT source_role, source, target_role, 'ambiguous ' || target_role || ' stem' AS reason, target_stem, ordinal, candidate FROM fx_twin_links WHERE n > 1
UNION ALL
SELECT a.role, a.relative_path, CASE WHEN a.role = 'raw' THEN 'processed' ELSE 'figure' END, 'no ' || CASE WHEN a.role = 'raw' THEN 'processed' ELSE 'figure' END || ' file with a known derivation', NULL, NULL, NULL
FROM fx_twins a WHERE a.role IN ('raw', 'processed') AND a.relative_path NOT IN (SELECT source FROM fx_twin_links)
  AND (a.role = 'processed' OR a.group_key IN (SELECT group_key FROM fx_twins WHERE role = 'processed'))""",
    "fx_twins", "fx_twin_links",
)
def unresolved_candidates(v: Views) -> DataFrame:
    """Open links with every candidate by name."""
    files = proposals.scan(_twins(v)).files
    _, unresolved = proposals.lineage(files)
    found = proposals.unresolved_candidates(files, unresolved)
    return found.select("source_role", "source", "target_role", "reason", "target_stem", "ordinal", "candidate")


@query(
    """
SELECT group_key, feature, CASE WHEN count(v) = 1 THEN min(v) END AS value,
       CASE WHEN count(v) > 1 THEN 'conflicting ' || feature || ' values: ' || count(v) || ' from ' || min(v) || ' to ' || max(v) END AS warning
FROM (SELECT DISTINCT group_key, unnest(['series', 'shape']) AS feature,
  unnest([nullif(regexp_extract(stem, '^([A-Z]+[0-9])', 1), ''), nullif(regexp_extract(stem, '_(PL|linear|log)$', 1), '')]) AS v FROM fx_twins)
WHERE v IS NOT NULL GROUP BY group_key, feature""",
    "fx_twins",
)
def scan_with_feature(v: Views) -> DataFrame:
    """A scan with two features of the user's own, merged per group."""
    own = FeatureRegistry()
    own.register("series", lambda stem: F.nullif(F.regexp_extract(stem, "^([A-Z]+[0-9])", 1), F.lit("")))
    own.register("shape", lambda stem: F.nullif(F.regexp_extract(stem, "_(PL|linear|log)$", 1), F.lit("")))
    return proposals.scan(_twins(v), features=own).features


@query(
    """
SELECT group_key, bool_or(role = 'figure') AND NOT bool_or(role IN ('raw', 'processed')) OR
  count(*) FILTER (WHERE role = 'processed' AND NOT EXISTS (SELECT 1 FROM fx_groups b WHERE b.group_key = a.group_key AND b.role = 'figure')) > 0 AS needs_review
FROM fx_groups a WHERE role IS NOT NULL GROUP BY group_key""",
    "fx_groups",
)
def import_proposals(v: Views) -> DataFrame:
    """Review flag of every import proposal."""
    result = proposals.scan(v.listing)
    _, unresolved = proposals.lineage(result.files)
    return proposals.import_proposals(result, unresolved).select("group_key", "needs_review")


@query(
    """
SELECT group_key, count(*) AS n_fields, min(field) AS first_field FROM (
  SELECT group_key, unnest([CASE WHEN max(sample_id) IS NOT NULL THEN 'sample_id' END, 'temperature_K', 'magnetic_field_T', 'excitation_wavelength_nm',
         CASE WHEN max(measurement_type) IS NOT NULL THEN 'measurement_type' END]) AS field
  FROM fx_groups WHERE role IS NOT NULL GROUP BY group_key) WHERE field IS NOT NULL GROUP BY group_key""",
    "fx_groups",
)
def provenance_fields(v: Views) -> DataFrame:
    result = proposals.scan(v.listing)
    _, unresolved = proposals.lineage(result.files)
    rows = proposals.provenance(proposals.import_proposals(result, unresolved), ["group_key"])
    return rows.groupBy("group_key").agg(F.count(F.lit(1)).alias("n_fields"), F.min("field").alias("first_field"))


@query(
    """
SELECT group_key AS proposal_id, count(*) AS n_files, max(sample_id) AS sample_id, max(temperature_K) AS temperature, max(measurement_type) AS measurement_type,
       min(CASE WHEN role = 'raw' THEN relative_path END) AS raw_data_file
FROM fx_groups WHERE role IS NOT NULL GROUP BY group_key""",
    "fx_groups",
)
def experiment_documents(v: Views) -> DataFrame:
    """Nested documents of all proposals, read back as a few fields."""
    result = proposals.scan(v.listing)
    edges, unresolved = proposals.lineage(result.files)
    named = {"group_key": "proposal_id"}
    imported = proposals.import_proposals(result, unresolved).withColumnsRenamed(named)
    rows = documents.build_documents(
        imported, result.files.withColumnsRenamed(named), edges.withColumnsRenamed(named), proposals.provenance(imported, ["proposal_id"])
    )
    return rows.select(
        "proposal_id", F.size("data.files").alias("n_files"), "data.sample_id", "data.temperature", "data.measurement_type", "data.raw_data_file"
    )


@query(
    """
SELECT p.artifact, p.row, 40 + 560 * ((p.x - s.x0) / CASE WHEN s.x1 = s.x0 THEN 1.0 ELSE s.x1 - s.x0 END) AS plot_x,
       320 - 280 * ((p.y - s.y0) / CASE WHEN s.y1 = s.y0 THEN 1.0 ELSE s.y1 - s.y0 END) AS plot_y
FROM fx_points p JOIN (SELECT artifact, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM fx_points GROUP BY artifact) s
  ON p.artifact = s.artifact""",
    "fx_points",
)
def preview_plot_points(v: Views) -> DataFrame:
    return previews.plot_points(v.points, "artifact").select("artifact", "row", "plot_x", "plot_y")


@query(
    """
SELECT artifact, 0 AS x_col, 1 AS y_col, count(*) AS n_points, sum(x) AS sum_x FROM fx_points GROUP BY artifact""",
    "fx_points",
)
def preview_table_axes(v: Views) -> DataFrame:
    """Axis choice and points from cell rows of every event table."""
    numbers = v.points.select(
        "artifact", (F.col("row") + 1).alias("row"),
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("col"), F.col("x").cast("string").alias("cell")),
                F.struct(F.lit(1).alias("col"), F.col("y").cast("string").alias("cell")),
                F.struct(F.lit(2).alias("col"), F.lit("note").alias("cell")),
            )
        ),
    )
    points = previews.table_points(numbers, "artifact").groupBy("artifact").agg(
        F.count(F.lit(1)).alias("n_points"), F.sum("x").alias("sum_x")
    )
    return previews.axis_columns(numbers, "artifact").join(points, on="artifact")


@query(
    """
SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM (
  SELECT doc_id, trim(regexp_replace(text, '[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')) AS t
  FROM documents)""",
)
def preview_search_text(v: Views) -> DataFrame:
    """Whole document texts with whitespace collapsed."""
    text = v.table("documents").select("doc_id", collapse_whitespace(F.col("text")).alias("t"))
    return text.select("doc_id", F.length("t").alias("n_chars"), F.md5("t").alias("digest"))


@query(
    """
SELECT doc_id FROM (
  SELECT doc_id, lower(trim(regexp_replace(text, '[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g'))) AS t
  FROM documents) WHERE contains(t, 'the re')""",
)
def preview_text_filter(v: Views) -> DataFrame:
    found = v.table("documents").select("doc_id", F.col("text").alias("search_text"), F.lit("ready").alias("status"), F.lit("table").alias("kind"))
    return previews.search_previews(found, status="READY", text="The   re").select("doc_id")


@query(
    """
SELECT a.artifact_id, CASE WHEN a.size_bytes % 13 = 0 THEN 'unavailable' WHEN a.size_bytes % 5 = 0 THEN 'stale_catalog'
   WHEN a.extension IN ('csv','dat','tsv','png','jpg','jpeg','tif','tiff','pptx') THEN 'ready' ELSE 'unsupported' END AS status,
   CASE WHEN a.size_bytes % 13 <> 0 AND a.size_bytes % 5 <> 0 THEN CASE WHEN a.extension IN ('csv','dat','tsv') THEN 'table' WHEN a.extension = 'pptx' THEN 'slide'
     WHEN a.extension IN ('png','jpg','jpeg','tif','tiff') THEN 'image' ELSE 'placeholder' END ELSE 'placeholder' END AS kind
FROM fx_artifacts a""",
    "fx_artifacts",
)
def preview_status(v: Views) -> DataFrame:
    """Preview ladder against a listing that lost some files and changed others."""
    size = F.col("size_bytes")
    now = v.artifacts.where(size % 13 != 0).select(
        "storage_source_id", "relative_path", (size + F.when(size % 5 == 0, 1).otherwise(0)).alias("size_bytes"), "mtime_ns"
    )
    return previews.preview_status(v.artifacts, now).select("artifact_id", "status", "kind")


@query(
    f"""
WITH built AS (
  SELECT doc_id, CASE WHEN length(text) > 0 AND doc_id % 11 <> 0 THEN text END AS t FROM documents),
assets AS (
  SELECT doc_id, CASE WHEN t IS NULL THEN 'placeholder.svg' ELSE 'search_text.txt' END AS name,
    CASE WHEN t IS NULL THEN 'placeholder' ELSE 'search' END AS kind,
    CASE WHEN t IS NULL THEN 'image/svg+xml' ELSE 'text/plain' END AS media_type,
    strlen(coalesce(t, '{previews.PLACEHOLDER}')) AS size_bytes, sha256(coalesce(t, '{previews.PLACEHOLDER}')) AS sha256 FROM built)
SELECT *, count(*) OVER (PARTITION BY sha256) AS n_previews, 1 AS n_stored FROM assets""",
)
def preview_assets(v: Views) -> DataFrame:
    """Assets of one preview per document, every eleventh of them malformed; how many previews share a content, stored once."""
    docs = v.table("documents")
    status = F.when(F.col("doc_id") % 11 == 0, "malformed").otherwise("ready")
    built = previews.preview_assets(
        docs.select(F.col("doc_id").alias("preview_id"), status.alias("status")), docs.select(F.col("doc_id").alias("preview_id"), F.col("text").alias("search_text"))
    )
    shared = built.assets.groupBy("sha256").agg(F.count(F.lit(1)).alias("n_previews"))
    stored = built.contents.groupBy(F.sha2("content", 256).alias("sha256")).agg(F.count(F.lit(1)).cast("int").alias("n_stored"))
    return built.assets.withColumnRenamed("preview_id", "doc_id").join(shared, "sha256").join(stored, "sha256")


@query(
    """
SELECT artifact_id, size_bytes % 13 <> 0 AND size_bytes % 5 <> 0 AS fresh,
  CASE WHEN size_bytes % 13 = 0 OR size_bytes % 5 = 0 THEN 'stale_catalog'
    WHEN extension IN ('csv','dat','tsv','png','jpg','jpeg','tif','tiff','pptx') THEN 'ready' ELSE 'unsupported' END AS status,
  CASE WHEN extension IN ('csv','dat','tsv') THEN 'table' WHEN extension = 'pptx' THEN 'slide'
    WHEN extension IN ('png','jpg','jpeg','tif','tiff') THEN 'image' ELSE 'placeholder' END AS kind
FROM fx_artifacts WHERE size_bytes % 7 <> 0""",
    "fx_artifacts",
)
def preview_freshness(v: Views) -> DataFrame:
    """Stored previews of all artifacts after some were catalogued anew and some files changed or went."""
    size = F.col("size_bytes")
    stored = previews.preview_status(v.artifacts, v.artifacts.select("storage_source_id", "relative_path", "size_bytes", "mtime_ns"))
    anew = v.artifacts.withColumn("size_bytes", size + F.when(size % 7 == 0, 1).otherwise(0))
    now = anew.where(size % 13 != 0).select(
        "storage_source_id", "relative_path", (size + F.when(size % 5 == 0, 1).otherwise(0)).alias("size_bytes"), "mtime_ns"
    )
    return previews.discover(stored, anew, now).select("artifact_id", "fresh", "status", "kind")
