"""Registered queries: inventory comparison, relocation, indexing plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import indexing, inventory, relocation, sessions
from cairn.plans.projections import Views, view
from cairn.plans.registry import query

NOW = "2025-01-01T00:00:00Z"

view(
    "fx_diff",
    """
SELECT coalesce(p.relative_path, l.relative_path) AS relative_path, p.metadata_status AS old_status, p.inventory_status AS old_presence,
       CASE WHEN l.relative_path IS NULL AND p.inventory_status = 'present' THEN 'marked_missing' WHEN l.relative_path IS NULL THEN 'still_absent'
            WHEN p.relative_path IS NULL THEN 'new' WHEN p.inventory_status = 'missing' THEN 'restored'
            WHEN p.size_bytes <> l.size_bytes OR p.mtime_ns <> l.mtime_ns THEN 'changed' ELSE 'unchanged' END AS outcome,
       coalesce(p.size_bytes <> l.size_bytes OR p.mtime_ns <> l.mtime_ns, FALSE) AS differs
FROM fx_prior p FULL OUTER JOIN fx_listing l ON p.relative_path = l.relative_path""",
    "fx_prior", "fx_listing",
)


def _reconciled(v: Views) -> DataFrame:
    return inventory.reconcile(v.prior, v.new_listing, "s2", 2, NOW)


@query(
    """
SELECT relative_path, outcome, CASE WHEN outcome IN ('marked_missing', 'still_absent') THEN 'missing' ELSE 'present' END AS inventory_status,
       CASE WHEN outcome = 'new' THEN 'pending' WHEN outcome = 'changed' OR (outcome = 'restored' AND differs) THEN 'stale' ELSE old_status END AS metadata_status
FROM fx_diff""",
    "fx_diff",
)
def inventory_diff(v: Views) -> DataFrame:
    return _reconciled(v).select("relative_path", "outcome", "inventory_status", "metadata_status")


@query(
    """
SELECT sum(CASE WHEN outcome NOT IN ('marked_missing', 'still_absent') THEN 1 ELSE 0 END) AS files_seen, sum(CASE WHEN outcome = 'new' THEN 1 ELSE 0 END) AS files_new,
       sum(CASE WHEN outcome = 'unchanged' THEN 1 ELSE 0 END) AS files_unchanged, sum(CASE WHEN outcome = 'changed' THEN 1 ELSE 0 END) AS files_changed,
       sum(CASE WHEN outcome = 'restored' THEN 1 ELSE 0 END) AS files_restored, sum(CASE WHEN outcome = 'marked_missing' THEN 1 ELSE 0 END) AS files_marked_missing
FROM fx_diff""",
    "fx_diff",
)
def inventory_counters(v: Views) -> DataFrame:
    return inventory.scan_counters(_reconciled(v))


view(
    "fx_walk",
    """
SELECT *, row_number() OVER (ORDER BY split_part(relative_path, '/', 1), split_part(relative_path, '/', 2)) AS place
FROM fx_diff WHERE outcome NOT IN ('marked_missing', 'still_absent')""",
    "fx_diff",
)


def _session_sql(call: str, status: str, files: str, missing: str, remaining: str) -> str:
    kinds = ", ".join(f"count(*) FILTER (WHERE outcome = '{k}') AS files_{k}" for k in ("new", "unchanged", "changed", "restored"))
    return (
        f"SELECT {call} AS call, 's2' AS session_id, 2 AS generation, '{status}' AS status, arg_max(relative_path, place) AS checkpoint_path, count(*) AS files_seen, "
        f"{kinds}, {missing} AS files_marked_missing, {remaining} AS remaining FROM fx_walk WHERE {files}"
    )


@query(
    _session_sql("1", "active", "place <= 500", "0", "(SELECT count(*) - 500 FROM fx_walk)")
    + "\nUNION ALL\n"
    + _session_sql("2", "completed", "true", "(SELECT count(*) FROM fx_diff WHERE outcome = 'marked_missing')", "0"),
    "fx_diff", "fx_walk",
)
def session_counters(v: Views) -> DataFrame:
    """A pass over the whole listing in two calls: the first handles 500 files, the second all others."""
    past = v.spark.createDataFrame([("s1", 1, "completed", None, *[0] * len(sessions.COUNTERS), 0, NOW, NOW)], sessions.SESSIONS)
    one = sessions.scan_batch(v.prior, past, v.new_listing, "s2", NOW, max_files=500)
    two = sessions.scan_batch(one.records, sessions.replaced(past, one.session), v.new_listing, "s3", NOW)
    columns = ("session_id", "generation", "status", "checkpoint_path", *sessions.COUNTERS)
    parts = [s.session.select(F.lit(n).alias("call"), *columns, F.lit(s.remaining).alias("remaining")) for n, s in ((1, one), (2, two))]
    return parts[0].unionByName(parts[1])


@query("SELECT relative_path FROM fx_diff WHERE outcome = 'marked_missing'", "fx_diff")
def mark_missing(v: Views) -> DataFrame:
    return inventory.newly_missing(v.prior, v.new_listing).select("relative_path")


@query(
    """
SELECT p.relative_path, CASE WHEN l.relative_path IS NOT NULL THEN l.size_bytes ELSE p.size_bytes END AS size_bytes, p.created_utc,
       CASE WHEN l.relative_path IS NOT NULL THEN '2025-01-01T00:00:00Z' ELSE p.updated_utc END AS updated_utc
FROM (SELECT coalesce(p.relative_path, l.relative_path) AS relative_path, p.size_bytes,
             CASE WHEN p.relative_path IS NULL THEN '2025-01-01T00:00:00Z' ELSE '2024-01-01T00:00:00Z' END AS created_utc, '2024-01-01T00:00:00Z' AS updated_utc
      FROM fx_prior p FULL OUTER JOIN fx_listing l ON p.relative_path = l.relative_path) p
LEFT JOIN fx_listing l ON p.relative_path = l.relative_path""",
    "fx_prior", "fx_listing",
)
def inventory_upsert(v: Views) -> DataFrame:
    """Insert-or-replace of a whole listing, created time kept."""
    merged = inventory.upsert(v.prior, v.new_listing, NOW)
    return merged.select("relative_path", "size_bytes", "created_utc", "updated_utc")


@query(
    """
SELECT relative_path, CASE WHEN metadata_status = 'failed' THEN 'pending' ELSE metadata_status END AS metadata_status,
       CASE WHEN metadata_status = 'failed' THEN '2025-01-01T00:00:00Z' ELSE '2024-01-01T00:00:00Z' END AS updated_utc FROM fx_prior""",
    "fx_prior",
)
def status_update(v: Views) -> DataFrame:
    retry = v.prior.where(F.col("metadata_status") == "failed").select("relative_path", F.lit("pending").alias("metadata_status"))
    return inventory.update_status(v.prior, retry, NOW).select("relative_path", "metadata_status", "updated_utc")


@query(
    """
SELECT 'inventory_status' AS kind, inventory_status AS status, count(*) AS n_records FROM fx_prior GROUP BY 2
UNION ALL SELECT 'metadata_status', metadata_status, count(*) FROM fx_prior GROUP BY 2""",
    "fx_prior",
)
def status_counts(v: Views) -> DataFrame:
    return inventory.status_counts(v.prior)


@query(
    """
SELECT 'parser_version' AS field, count(nullif(parser_version, '')) AS n_present, count(*) - count(nullif(parser_version, '')) AS n_missing FROM fx_prior
UNION ALL SELECT 'file_kind', count(nullif(file_kind, '')), count(*) - count(nullif(file_kind, '')) FROM fx_prior""",
    "fx_prior",
)
def presence_counts(v: Views) -> DataFrame:
    return inventory.presence_counts(v.prior, ("parser_version", "file_kind"))


_OUTCOME_SQL = """
SELECT p.relative_path, CASE WHEN l.relative_path IS NULL THEN 'missing' WHEN l.size_bytes <> p.size_bytes THEN 'size_mismatch'
  WHEN l.mtime_ns <> p.mtime_ns THEN 'mtime_mismatch' ELSE 'matched' END AS outcome
FROM fx_prior p LEFT JOIN fx_listing l ON p.relative_path = l.relative_path WHERE p.inventory_status = 'present'"""


@query(f"SELECT outcome, count(*) AS n_records FROM ({_OUTCOME_SQL}) GROUP BY outcome", "fx_prior", "fx_listing")
def relocation_outcomes(v: Views) -> DataFrame:
    checked = relocation.outcomes(v.prior, v.new_listing, compare_mtime=True)
    return checked.groupBy("outcome").agg(F.count(F.lit(1)).alias("n_records"))


@query(
    f"SELECT relative_path, outcome FROM ({_OUTCOME_SQL}) WHERE outcome <> 'matched' ORDER BY relative_path LIMIT 100",
    "fx_prior", "fx_listing",
)
def relocation_problems(v: Views) -> DataFrame:
    checked = relocation.outcomes(v.prior, v.new_listing, compare_mtime=True)
    return relocation.problems(checked, 100).select("relative_path", "outcome")


@query(
    f"""
SELECT count(*) AS validated, sum(CASE WHEN outcome = 'matched' THEN 1 ELSE 0 END) AS n_matched, sum(CASE WHEN outcome = 'missing' THEN 1 ELSE 0 END) AS n_missing,
       sum(CASE WHEN outcome <> 'matched' THEN 1 ELSE 0 END) AS problems, TRUE AS complete FROM ({_OUTCOME_SQL})""",
    "fx_prior", "fx_listing",
)
def relocation_summary(v: Views) -> DataFrame:
    checked = relocation.outcomes(v.prior, v.new_listing, compare_mtime=True)
    return relocation.summary(v.prior, checked).select("validated", "n_matched", "n_missing", "problems", "complete")


view(
    "fx_plan",
    """
SELECT *, CASE WHEN inventory_status = 'missing' THEN 'skipped_missing' WHEN metadata_status IN ('pending', 'stale') THEN 'selected'
   WHEN metadata_status = 'failed' THEN 'skipped_failed' WHEN parser_version IS NOT DISTINCT FROM 'v1' THEN 'skipped_indexed' ELSE 'parser_stale' END AS choice
FROM fx_prior""",
    "fx_prior",
)


@query(
    """
SELECT split_part(relative_path, '/', 1) AS scanner_unit, count(*) AS record_count, min(relative_path) AS first_path, max(relative_path) AS last_path
FROM fx_plan WHERE choice IN ('selected', 'parser_stale') GROUP BY 1""",
    "fx_plan",
)
def index_plan_units(v: Views) -> DataFrame:
    return indexing.units(indexing.plan(v.prior, parser_version="v1"))


@query(
    """
SELECT sum(CASE WHEN choice IN ('selected', 'parser_stale') THEN 1 ELSE 0 END) AS selected_count, sum(CASE WHEN choice = 'parser_stale' THEN 1 ELSE 0 END) AS parser_stale_count,
       count(DISTINCT CASE WHEN choice IN ('selected', 'parser_stale') THEN split_part(relative_path, '/', 1) END) AS unit_count,
       sum(CASE WHEN choice = 'skipped_indexed' THEN 1 ELSE 0 END) AS skipped_indexed, sum(CASE WHEN choice = 'skipped_missing' THEN 1 ELSE 0 END) AS skipped_missing,
       sum(CASE WHEN choice = 'skipped_failed' THEN 1 ELSE 0 END) AS skipped_failed
FROM fx_plan""",
    "fx_plan",
)
def index_plan_counts(v: Views) -> DataFrame:
    counts = indexing.readiness(v.prior, "v1")
    return counts.select("selected_count", "parser_stale_count", "unit_count", "skipped_indexed", "skipped_missing", "skipped_failed")
