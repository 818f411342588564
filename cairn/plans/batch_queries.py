"""Registered queries: batch planning, lifecycle, reconciliation, status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import batches
from cairn.plans.projections import Views, view
from cairn.plans.registry import query

SIZE = 50

view(
    "fx_plan_rows",
    """
SELECT experiment_id AS proposal_id, CAST((row_number() OVER (ORDER BY experiment_id) - 1) // 50 AS BIGINT) + 1 AS batch_number FROM fx_experiments""",
    "fx_experiments",
)


def _members(v: Views) -> DataFrame:
    named = v.experiments.select(F.col("experiment_id").alias("proposal_id"))
    return batches.plan_members(named.withColumn("position", F.col("proposal_id")), SIZE)


@query("SELECT proposal_id, batch_number FROM fx_plan_rows", "fx_plan_rows")
def plan_batches(v: Views) -> DataFrame:
    return _members(v).select("proposal_id", "batch_number")


@query(
    """
SELECT batch_number, n AS item_count, 'Run-7-batch-' || CASE WHEN batch_number < 1000 THEN lpad(CAST(batch_number AS VARCHAR), 3, '0') ELSE CAST(batch_number AS VARCHAR) END
  || '-' || substr(sha256('{"batch_number":' || CAST(batch_number AS VARCHAR) || ',"batch_size":50,"dataset_label":"Run 7","proposals":["' || members || '"]}'), 1, 12) AS batch_id
FROM (SELECT batch_number, count(*) AS n, string_agg(proposal_id, '","' ORDER BY proposal_id) AS members FROM fx_plan_rows GROUP BY batch_number)""",
    "fx_plan_rows",
)
def batch_ids(v: Views) -> DataFrame:
    return batches.plan_batches(_members(v), SIZE, "Run 7").select("batch_number", "item_count", "batch_id")


_LIFECYCLE = """CASE WHEN is_verified THEN 'final_verified' WHEN NOT beyond_preflight THEN 'preflight_ready'
  WHEN status IN ('upload_created', 'processing') THEN 'processing_pending' ELSE 'blocked_invalid' END"""


@query(
    f"""
SELECT lifecycle, count(*) AS n_batches, sum(n) AS expected_entries, sum(CASE WHEN is_verified THEN 3 ELSE 0 END) AS verified_entries,
       sum(CASE WHEN published THEN 1 ELSE 0 END) AS published_batches
FROM (SELECT s.*, {_LIFECYCLE} AS lifecycle, m.n FROM fx_states s JOIN (SELECT batch_number, count(*) AS n FROM fx_members GROUP BY 1) m ON m.batch_number = s.batch_number)
GROUP BY lifecycle""",
    "fx_states", "fx_members",
)
def batch_lifecycle(v: Views) -> DataFrame:
    counts = batches.lifecycle_counts(batches.batch_states(v.manifests))
    return counts.select("lifecycle", "n_batches", "expected_entries", "verified_entries", "published_batches")


@query(
    f"""
SELECT count(*) AS discovered_batches, sum(CASE WHEN {_LIFECYCLE} = 'preflight_ready' THEN 1 ELSE 0 END) AS preflight_ready_batches,
       sum(CASE WHEN is_verified THEN 1 ELSE 0 END) AS final_verified_batches FROM fx_states""",
    "fx_states",
)
def batch_readiness(v: Views) -> DataFrame:
    counts = batches.readiness_counts(batches.batch_states(v.manifests))
    return counts.select("discovered_batches", "preflight_ready_batches", "final_verified_batches")


@query(
    """
SELECT 'proposal' AS kind, proposal_id AS value, count(DISTINCT batch_number) AS n_batches FROM fx_members GROUP BY proposal_id HAVING count(DISTINCT batch_number) > 1
UNION ALL
SELECT 'upload', upload_id, count(DISTINCT batch_number) FROM fx_stages WHERE upload_id IS NOT NULL GROUP BY upload_id HAVING count(DISTINCT batch_number) > 1""",
    "fx_members", "fx_stages",
)
def batch_duplicates(v: Views) -> DataFrame:
    return batches.duplicates(v.manifests)


@query(
    """
SELECT s.batch_number, s.batch_id, CASE WHEN NOT s.has_preflight THEN 'preflight manifest missing' WHEN s.upload_id IS NOT NULL THEN 'known upload requires reconciliation'
   WHEN s.published THEN 'batch publish is True' WHEN s.batch_number > 1 AND NOT coalesce(p.is_verified, FALSE) THEN 'predecessor batch is not final and verified'
   ELSE 'eligible' END AS reason
FROM (SELECT * FROM fx_states WHERE NOT is_verified ORDER BY batch_number LIMIT 1) s LEFT JOIN fx_states p ON p.batch_number = s.batch_number - 1""",
    "fx_states",
)
def next_batch(v: Views) -> DataFrame:
    return batches.eligibility(batches.batch_states(v.manifests)).select("batch_number", "batch_id", "reason")


view(
    "fx_ready",
    """
SELECT upload_name, count(DISTINCT upload_id) AS n_ids, CASE count(DISTINCT upload_id) WHEN 0 THEN 'no_match' WHEN 1 THEN 'single_match' ELSE 'ambiguous' END AS outcome
FROM fx_uploads GROUP BY upload_name""",
    "fx_uploads",
)


@query("SELECT upload_name, n_ids, outcome FROM fx_ready", "fx_ready")
def remote_readiness(v: Views) -> DataFrame:
    return batches.remote_readiness(v.uploads, v.uploads).select("upload_name", "n_ids", "outcome")


@query(
    """
SELECT s.batch_number, CASE WHEN l.local IS NOT NULL THEN 'blocked' WHEN r.outcome = 'no_match' THEN 'create' WHEN r.outcome = 'single_match' THEN 'reconcile' ELSE 'blocked' END AS action,
       coalesce(l.local, CASE r.outcome WHEN 'no_match' THEN 'eligible and no remote match' WHEN 'single_match' THEN 'exactly one remote upload matches' ELSE 'ambiguous remote match' END) AS reason
FROM fx_states s JOIN (
  SELECT s.batch_number, CASE WHEN NOT s.has_preflight THEN 'preflight manifest missing' WHEN s.upload_id IS NOT NULL THEN 'known upload requires reconciliation'
     WHEN s.published THEN 'batch publish is True' WHEN s.batch_number > 1 AND NOT coalesce(p.is_verified, FALSE) THEN 'predecessor batch is not final and verified' END AS local
  FROM fx_states s LEFT JOIN fx_states p ON p.batch_number = s.batch_number - 1) l ON l.batch_number = s.batch_number
JOIN fx_ready r ON r.upload_name = 'upload-' || CAST(s.batch_number AS VARCHAR) WHERE NOT s.is_verified""",
    "fx_states", "fx_ready",
)
def production_actions(v: Views) -> DataFrame:
    ready = batches.remote_readiness(v.uploads, v.uploads)
    name = F.concat(F.lit("upload-"), F.col("batch_number").cast("string"))
    return batches.production_actions(batches.batch_states(v.manifests), ready, name).select("batch_number", "action", "reason")


@query(
    """
SELECT b.batch_number, CASE WHEN b.upload_id IS NULL THEN 'not_created' WHEN u.not_found THEN 'not_found' WHEN b.upload_id <> u.observed THEN 'id_mismatch'
   WHEN u.process_running OR lower(coalesce(u.process_status, '')) = 'processing' THEN 'processing' WHEN lower(coalesce(u.process_status, '')) = 'failed' THEN 'processing_failed'
   WHEN lower(coalesce(u.process_status, '')) = 'success' AND NOT (u.published AND NOT b.published) AND u.entries = b.n THEN 'success' ELSE 'reconciliation_error' END AS state
FROM (SELECT s.*, m.n FROM fx_states s JOIN (SELECT batch_number, count(*) AS n FROM fx_members GROUP BY 1) m ON m.batch_number = s.batch_number) b
JOIN (SELECT *, CASE WHEN c_nationkey % 7 = 3 THEN 'U-x' ELSE 'U-' || CAST((batch_number - 1) % 50 AS VARCHAR) END AS observed,
             CASE WHEN c_nationkey % 8 = 5 THEN 149 ELSE 150 END AS entries FROM fx_uploads WHERE c_custkey % 15 = 0) u ON u.batch_number = b.batch_number""",
    "fx_states", "fx_members", "fx_uploads",
)
def reconcile_states(v: Views) -> DataFrame:
    """State of the current manifest of every batch against its observed upload."""
    states = batches.batch_states(v.manifests).select(
        "batch_number", F.col("current_batch_id").alias("batch_id"), "upload_id", "status", F.col("published").alias("publish"),
        F.col("expected_entries").alias("expected_entry_count"),
    )
    n = F.col("c_nationkey")
    none = F.array().cast("array<string>")
    observed = v.uploads.where(F.col("c_custkey") % 15 == 0).select(
        F.concat(F.lit("B-"), F.col("batch_number").cast("string")).alias("batch_id"),
        F.when(n % 7 == 3, "U-x").otherwise(F.concat(F.lit("U-"), ((F.col("batch_number") - 1) % 50).cast("string"))).alias("observed_upload_id"),
        "process_status", "process_running", "published", "not_found",
        F.when(n % 8 == 5, 149).otherwise(150).alias("entry_count"), none.alias("errors"), none.alias("warnings"),
    )
    return batches.reconcile(states, observed).select("batch_number", "state")


_LABEL = "'batch ' || CASE WHEN batch_number < 1000 THEN lpad(CAST(batch_number AS VARCHAR), 3, '0') ELSE CAST(batch_number AS VARCHAR) END"


@query(
    f"""
SELECT 'blocker' AS level, {_LABEL} || ' has publish=true' AS line FROM fx_states WHERE published
UNION SELECT 'blocker', {_LABEL} || ' is not final and verified (' || status || ')' FROM fx_states WHERE NOT is_verified AND beyond_preflight
UNION SELECT 'blocker', {_LABEL} || ' has an upload ID but no final artifact' FROM fx_states WHERE upload_id IS NOT NULL AND NOT has_final
UNION SELECT 'warning', {_LABEL} || ' is preflight-ready; this does not imply an upload' FROM fx_states WHERE NOT is_verified AND NOT beyond_preflight
UNION SELECT 'blocker', 'duplicate proposal membership: ' || proposal_id FROM fx_members GROUP BY proposal_id HAVING count(DISTINCT batch_number) > 1
UNION SELECT 'blocker', 'duplicate confirmed upload IDs: ' || upload_id FROM fx_stages WHERE upload_id IS NOT NULL GROUP BY upload_id HAVING count(DISTINCT batch_number) > 1
UNION SELECT 'blocker', CAST(count(*) AS VARCHAR) || ' inventory records have pending metadata' FROM fx_prior WHERE metadata_status = 'pending' HAVING count(*) > 0
UNION SELECT 'warning', 'no eligible batch: ' || CASE WHEN NOT s.has_preflight THEN 'preflight manifest missing' WHEN s.upload_id IS NOT NULL THEN 'known upload requires reconciliation'
   WHEN s.published THEN 'batch publish is True' ELSE 'predecessor batch is not final and verified' END
 FROM (SELECT * FROM fx_states WHERE NOT is_verified ORDER BY batch_number LIMIT 1) s LEFT JOIN fx_states p ON p.batch_number = s.batch_number - 1
 WHERE NOT (s.has_preflight AND s.upload_id IS NULL AND NOT s.published AND (s.batch_number = 1 OR coalesce(p.is_verified, FALSE)))""",
    "fx_states", "fx_members", "fx_stages", "fx_prior",
)
def status_report(v: Views) -> DataFrame:
    return batches.status_lines(v.manifests, v.prior)


@query(
    """
SELECT CAST(l_orderkey AS BIGINT) AS batch_number, CASE WHEN bool_and(l_returnflag = 'N') THEN 'SUCCESS' WHEN bool_or(l_returnflag = 'A') THEN 'PROCESSING' ELSE 'PENDING' END AS status
FROM lineitem GROUP BY l_orderkey""",
)
def upload_statuses(v: Views) -> DataFrame:
    """Entry statuses folded into one status per upload, with order lines as entries."""
    flag = F.col("l_returnflag")
    entries = v.table("lineitem").select(
        F.col("l_orderkey").alias("batch_number"), F.col("l_linenumber").alias("item"),
        F.when(flag == "N", "SUCCESS").when(flag == "A", "PROCESSING").otherwise("PENDING").alias("status"),
    )
    return batches.upload_status(entries)


@query(
    """
SELECT batch_number, 'archive' AS kind, 'out/' || proposal_id || '.json' AS source_path, 'archives/' || proposal_id || '.json' AS destination_path
FROM fx_members WHERE CAST(substr(proposal_id, 3) AS BIGINT) % 3 <> 0""",
    "fx_members",
)
def transport_files(v: Views) -> DataFrame:
    """Manifest files with an explicit destination."""
    number = F.substring("proposal_id", 3, 20).cast("long")
    entry = F.struct(
        F.concat(F.lit("out/"), F.col("proposal_id"), F.lit(".json")).alias("source_path"),
        F.when(number % 3 == 0, F.col("proposal_id")).alias("relative_path"),
        F.when(number % 3 != 0, F.concat(F.lit("archives/"), F.col("proposal_id"), F.lit(".json"))).alias("destination_path"),
        F.lit("archive").alias("role"),
    )
    manifests = v.batch_members.groupBy("batch_number").agg(F.collect_list(entry).alias("archive_files"))
    none = F.array().cast("array<struct<source_path:string,relative_path:string,destination_path:string,role:string>>")
    return batches.transport_files(manifests.withColumn("companion_files", none))


@query(
    """
SELECT m.batch_number, m.proposal_id, 'E-' || CAST(m.batch_number AS VARCHAR) || '-' || CAST(m.item AS VARCHAR) AS entry_id
FROM (SELECT batch_number, proposal_id, row_number() OVER (PARTITION BY batch_number ORDER BY proposal_id) - 1 AS item,
             count(*) OVER (PARTITION BY batch_number) AS n FROM fx_members) m WHERE m.n = 150""",
    "fx_members",
)
def entry_pairs(v: Views) -> DataFrame:
    """Proposals and entries matched by position; batches of another size have no pairs."""
    listed = v.batch_members.groupBy("batch_number").agg(F.array_sort(F.collect_list("proposal_id")).alias("p"))
    members = listed.select("batch_number", F.posexplode("p").alias("item", "proposal_id"))
    entries = listed.select("batch_number", F.explode(F.sequence(F.lit(0), F.lit(149))).alias("item")).withColumn(
        "entry_id", F.concat_ws("-", F.lit("E"), F.col("batch_number").cast("string"), F.col("item").cast("string"))
    )
    return batches.entry_pairs(members, entries).select("batch_number", "proposal_id", "entry_id")


@query(
    """
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'rejected' WHEN c_nationkey % 9 = 0 THEN 'creation_unknown' WHEN upload_id IS NULL THEN 'creation_unknown'
   WHEN process_status = 'FAILURE' THEN 'processing_failed' WHEN process_status IS DISTINCT FROM 'SUCCESS' THEN 'processing' ELSE 'upload_created' END AS state
FROM fx_uploads""",
    "fx_uploads",
)
def upload_outcomes(v: Views) -> DataFrame:
    c = F.col("c_custkey")
    attempts = v.uploads.select(
        c, F.when(c % 4 == 0, "planned").otherwise("preflight_passed").alias("status"), F.col("upload_id").alias("result_upload_id"),
        F.col("not_found").alias("raised"), F.lit(False).alias("dry_run"), F.lit(1).alias("transport_archives"),
        F.col("process_status").alias("result_status"), F.lit("entry").alias("result_entry_id"),
    ).withColumn("upload_id", F.lit(None).cast("string"))
    return batches.upload_outcomes(attempts).select("c_custkey", "state")
