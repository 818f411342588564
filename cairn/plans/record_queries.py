"""Registered queries: whole records, typed claim values, lookups, enriched pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators import records, retrieval
from cairn.plans.projections import Views, experiment_key, view
from cairn.plans.registry import query

view(
    "fx_order_files",
    """
SELECT 'EXP-' || lpad(CAST(l_orderkey AS VARCHAR), 10, '0') AS experiment_id, l_linenumber AS ordinal,
       CASE l_returnflag WHEN 'R' THEN 'raw' WHEN 'A' THEN 'processed' ELSE 'figure' END AS role, 'src' AS storage_source_id,
       'runs/' || CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR) || '_' || CAST(l_partkey AS VARCHAR) || '.csv' AS relative_path
FROM lineitem""",
)
view(
    "fx_typed",
    """
SELECT event_id, CASE event_id % 8 WHEN 0 THEN props WHEN 1 THEN CAST(user_id AS VARCHAR) WHEN 2 THEN '"' || event_type || '"' WHEN 3 THEN 'true'
         WHEN 4 THEN 'null' WHEN 5 THEN '[' || CAST(user_id AS VARCHAR) || ', {"k": 1}]' WHEN 6 THEN '{broken' ELSE '{"b": 2, "a": ' || CAST(user_id AS VARCHAR) || '}' END AS value_json,
       CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 8 = 7 THEN '{"a":' || CAST(user_id + event_id % 2 - 1 AS VARCHAR) || ',"b":2}'
         WHEN event_id % 8 = 1 THEN CAST(user_id AS VARCHAR) || '.0' WHEN event_id % 8 = 4 THEN 'null' ELSE '"seen"' END AS reviewed_value_json
FROM events""",
)
_KIND = (
    "CASE WHEN {0} IS NULL THEN 'unset' WHEN NOT json_valid({0}) THEN 'invalid' ELSE CASE json_type({0}) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' "
    "WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END END"
)


def _order_files(v: Views) -> DataFrame:
    key, line = F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")
    kind = F.col("l_returnflag")
    return v.table("lineitem").select(
        experiment_key(F.col("l_orderkey")).alias("experiment_id"), F.col("l_linenumber").cast("long").alias("ordinal"),
        F.when(kind == "R", "raw").when(kind == "A", "processed").otherwise("figure").alias("role"), F.lit("src").alias("storage_source_id"),
        F.concat(F.lit("runs/"), key, F.lit("/"), line, F.lit("_"), F.col("l_partkey").cast("string"), F.lit(".csv")).alias("relative_path"),
    )


def _typed(v: Views) -> DataFrame:
    n, user = F.col("event_id"), F.col("user_id").cast("string")
    turn = n % 8
    value = (
        F.when(turn == 0, F.col("props")).when(turn == 1, user).when(turn == 2, F.concat(F.lit('"'), F.col("event_type"), F.lit('"')))
        .when(turn == 3, "true").when(turn == 4, "null").when(turn == 5, F.concat(F.lit("["), user, F.lit(', {"k": 1}]')))
        .when(turn == 6, "{broken").otherwise(F.concat(F.lit('{"b": 2, "a": '), user, F.lit("}")))
    )
    near = (F.col("user_id") + n % 2 - 1).cast("string")
    reviewed = (
        F.when(n % 3 == 0, F.lit(None)).when(turn == 7, F.concat(F.lit('{"a":'), near, F.lit(',"b":2}')))
        .when(turn == 1, F.concat(user, F.lit(".0"))).when(turn == 4, "null").otherwise('"seen"')
    )
    return v.table("events").select("event_id", value.alias("value_json"), reviewed.alias("reviewed_value_json"))


def _device_claims(v: Views) -> DataFrame:
    """The claims once more, about devices."""
    return v.claims.withColumns(
        {"subject_type": F.lit("device"), "subject_id": F.concat(F.lit("D"), (F.lit(101) + F.col("ordinal") % 150).cast("string"))}
    )


_CLAIM_TEXT = "{0}.field || '=' || {0}.value_json || ' ' || {0}.source_type || ' ' || {0}.source_reference || ' ' || {0}.review_status || ' ' || coalesce({0}.reviewed_value_json, '-')"


def _claim_text(claim: str) -> Column:
    part = lambda name: F.col(f"{claim}.{name}")
    fields = [part(n) for n in ("source_type", "source_reference", "review_status")]
    return F.when(F.col(claim).isNotNull(), F.concat_ws(" ", F.concat(part("field"), F.lit("="), part("value_json")), *fields, F.coalesce(part("reviewed_value_json"), F.lit("-"))))


@query(
    f"""
SELECT experiment_id AS entity_id, 'entity' AS part, NULL AS ordinal, NULL AS role, NULL AS relative_path, NULL AS claim FROM fx_experiments
UNION ALL SELECT f.experiment_id, 'file', f.ordinal, f.role, f.relative_path, NULL FROM fx_order_files f WHERE f.experiment_id IN (SELECT experiment_id FROM fx_experiments)
UNION ALL SELECT c.subject_id, 'claim', c.ordinal, NULL, NULL, {_CLAIM_TEXT.format('c')} FROM fx_claims c WHERE c.subject_id IN (SELECT experiment_id FROM fx_experiments)""",
    "fx_experiments", "fx_order_files", "fx_claims",
)
def experiment_record(v: Views) -> DataFrame:
    """Every part of every experiment record."""
    parts = records.record_parts(v.experiments, "experiment_id", "experiment", v.claims, _order_files(v))
    return parts.select("entity_id", "part", "ordinal", "file.role", "file.relative_path", _claim_text("claim").alias("claim"))


@query(
    f"""
SELECT device_id AS entity_id, 'entity' AS part, NULL AS ordinal, NULL AS claim FROM fx_devices
UNION ALL SELECT * FROM (SELECT 'D' || CAST(101 + c.ordinal % 150 AS VARCHAR) AS device_id, 'claim', c.ordinal, {_CLAIM_TEXT.format('c')} FROM fx_claims c)
  WHERE device_id IN (SELECT device_id FROM fx_devices)""",
    "fx_devices", "fx_claims",
)
def device_record(v: Views) -> DataFrame:
    parts = records.record_parts(v.devices, "device_id", "device", _device_claims(v))
    return parts.select("entity_id", "part", "ordinal", _claim_text("claim").alias("claim"))


@query(
    f"""
SELECT d.device_id, d.display_label, count(c.ordinal) AS n_claims, coalesce(string_agg({_CLAIM_TEXT.format('c')}, '; ' ORDER BY c.ordinal), '') AS claims
FROM (SELECT * FROM fx_devices ORDER BY device_id LIMIT 200 OFFSET 20) d
LEFT JOIN (SELECT *, 'D' || CAST(101 + ordinal % 150 AS VARCHAR) AS device_id FROM fx_claims) c ON c.device_id = d.device_id GROUP BY d.device_id, d.display_label""",
    "fx_devices", "fx_claims",
)
def device_page_record(v: Views) -> DataFrame:
    """One page of devices with their claims nested."""
    found = records.nested_devices(retrieval.search_devices(v.devices, limit=200, offset=20).items, _device_claims(v))
    texts = F.transform("claims", lambda c: F.concat_ws(" ", F.concat(c["field"], F.lit("="), c["value_json"]), c["source_type"], c["source_reference"], c["review_status"], F.coalesce(c["reviewed_value_json"], F.lit("-"))))
    return found.select("device_id", "display_label", F.size("claims").cast("long").alias("n_claims"), F.array_join(texts, "; ").alias("claims"))


@query(
    f"""
SELECT event_id, {_KIND.format('value_json')} AS value_kind, {_KIND.format('reviewed_value_json')} AS reviewed_value_kind,
       CASE WHEN event_id % 8 = 1 THEN CAST(value_json AS DOUBLE) END AS value_number, CASE WHEN event_id % 8 = 2 THEN trim(value_json, '"') END AS value_text,
       CASE WHEN event_id % 8 = 3 THEN true END AS value_flag, CASE WHEN event_id % 8 = 0 THEN CAST(json_extract(value_json, '$.k') AS DOUBLE) END AS member,
       CASE WHEN reviewed_value_json IS NULL THEN FALSE WHEN event_id % 8 IN (1, 4) THEN TRUE
            WHEN event_id % 8 = 7 THEN CAST(json_extract(value_json, '$.a') AS BIGINT) = CAST(json_extract(reviewed_value_json, '$.a') AS BIGINT) ELSE FALSE END AS same
FROM fx_typed""",
    "fx_typed",
)
def claim_values(v: Views) -> DataFrame:
    """Values parsed back with their types, and nested values compared."""
    typed = records.typed_values(_typed(v))
    return typed.select(
        "event_id", "value_kind", "reviewed_value_kind", "value_number", "value_text", "value_flag",
        records.json_member(F.col("value_json"), "$.k", "double").alias("member"),
        records.same_value(F.col("value_json"), F.col("reviewed_value_json")).alias("same"),
    )


@query(
    """
SELECT a.maker_namespace, a.local_device_id, d.device_id
FROM (SELECT DISTINCT 'Brand#' || CAST(11 + l_suppkey % 5 AS VARCHAR) AS maker_namespace, 'D' || CAST(100 + l_partkey % 9000 AS VARCHAR) AS local_device_id FROM lineitem) a
LEFT JOIN fx_devices d ON d.maker_namespace = a.maker_namespace AND d.local_device_id = a.local_device_id""",
    "fx_devices",
)
def device_pair_lookup(v: Views) -> DataFrame:
    """Devices by qualified identity; unknown identities stay with a null device."""
    asked = v.table("lineitem").select(
        F.concat(F.lit("Brand#"), (F.lit(11) + F.col("l_suppkey") % 5).cast("string")).alias("maker_namespace"),
        F.concat(F.lit("D"), (F.lit(100) + F.col("l_partkey") % 9000).cast("string")).alias("local_device_id"),
    )
    return records.lookup_pairs(v.devices, asked)


@query(
    """
SELECT p.artifact_id, p.relative_path, split_part(p.relative_path, '/', -1) AS filename, p.size_bytes, p.mtime_ns,
       coalesce(string_agg(e.source || ' > ' || e.target, '; ' ORDER BY e.source, e.target), '') AS derived_from
FROM (SELECT *, 'file-' || sha256(to_json(['src', relative_path])) AS file_id FROM fx_artifacts ORDER BY artifact_id LIMIT 200 OFFSET 100) p
LEFT JOIN (SELECT r.source_id, r.target_id, a.relative_path AS source, b.relative_path AS target FROM fx_edges r JOIN fx_files a ON a.file_id = r.source_id
           JOIN fx_files b ON b.file_id = r.target_id WHERE r.predicate = 'derived_from') e ON e.source_id = p.file_id OR e.target_id = p.file_id
GROUP BY ALL""",
    "fx_artifacts", "fx_files", "fx_edges",
)
def artifact_page_enriched(v: Views) -> DataFrame:
    """One page of artifacts with the files they derive from or feed."""
    items = retrieval.search_artifacts(v.artifacts, limit=200, offset=100).items
    found = records.enrich_artifacts(items, v.relationships, v.files.select("file_id", "relative_path"))
    texts = F.transform("derived_from", lambda e: F.concat(e["source"], F.lit(" > "), e["target"]))
    return found.select("artifact_id", "relative_path", "filename", "size_bytes", "mtime_ns", F.array_join(texts, "; ").alias("derived_from"))


@query(
    """
SELECT p.experiment_id, p.sample_id, p.confidence, f.n_files, f.files, m.device_id, m.evidence, m.source_reference, c.review_evidence
FROM (SELECT * FROM fx_experiments ORDER BY coalesce(sample_id, ''), coalesce(measurement_type, ''), experiment_id LIMIT 200) p
LEFT JOIN (SELECT experiment_id, count(*) AS n_files, string_agg(role || ':' || relative_path, '; ' ORDER BY ordinal, role, relative_path) AS files FROM fx_order_files GROUP BY ALL) f ON f.experiment_id = p.experiment_id
LEFT JOIN (SELECT e.source_id, arg_min(e.target_id, e.relationship_id) AS device_id,
                  coalesce(any_value(k.evidence), 'explicit device-directory context') AS evidence, coalesce(any_value(k.source_reference), arg_min(e.provenance_source, e.relationship_id)) AS source_reference
           FROM fx_relationships e LEFT JOIN (SELECT subject_id, arg_min(source_reference, ordinal) AS source_reference, CASE WHEN arg_min(has_evidence, ordinal) THEN 'first; second' END AS evidence
                                       FROM fx_claims WHERE field = 'measured_on_device' GROUP BY subject_id) k ON k.subject_id = e.source_id
           WHERE e.predicate = 'measured_on' GROUP BY e.source_id) m ON m.source_id = p.experiment_id
LEFT JOIN (SELECT subject_id, string_agg(value_json || ' ' || review_status, '; ' ORDER BY ordinal) AS review_evidence
           FROM fx_claims WHERE field = 'measured_on_raw_match' GROUP BY subject_id) c ON c.subject_id = p.experiment_id""",
    "fx_experiments", "fx_order_files", "fx_relationships", "fx_claims",
)
def experiment_page_enriched(v: Views) -> DataFrame:
    """One page of experiments with files, device and reviewed matches."""
    items = retrieval.search_experiments(v.experiments, limit=200).items
    found = records.enrich_experiments(items, _order_files(v), v.relationships, v.claims)
    files = F.transform("files", lambda f: F.concat(f["role"], F.lit(":"), f["relative_path"]))
    evidence = F.transform("review_evidence", lambda c: F.concat_ws(" ", c["value_json"], c["review_status"]))
    has = F.size("files") > 0
    return found.select(
        "experiment_id", "sample_id", "confidence", F.when(has, F.size("files").cast("long")).alias("n_files"), F.when(has, F.array_join(files, "; ")).alias("files"),
        "measured_on.device_id", "measured_on.evidence", "measured_on.source_reference", F.array_join(evidence, "; ").alias("review_evidence"),
    )
