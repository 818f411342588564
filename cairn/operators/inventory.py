"""Inventory: listing against the previous state, sessions, status updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.lineage import latest_first

# Statuses and outcomes.
PRESENT, MISSING = "present", "missing"
PENDING, INDEXED, STALE, FAILED = "pending", "indexed", "stale", "failed"
INVENTORY_STATUSES = (PRESENT, MISSING)
METADATA_STATUSES = (PENDING, INDEXED, STALE, FAILED)
ACTIVE, COMPLETED = "active", "completed"
OUTCOMES = ("new", "unchanged", "changed", "restored")

CARRIED = ("content_hash", "parser_version", "file_kind", "sample_hint")
RECORD_COLUMNS = (
    "relative_path", "size_bytes", "mtime_ns", "inventory_status", "metadata_status", *CARRIED,
    "last_seen_session_id", "last_seen_generation", "created_utc", "updated_utc",
)


def compare(prior: DataFrame, listing: DataFrame) -> DataFrame:
    """Full outer join of the previous records and a listing with the outcome of each path.

    Only size and mtime decide; contents are never read.  A path the listing
    lacks gets the outcome ``absent``.
    """
    now = listing.select(
        "relative_path", F.col("size_bytes").alias("now_size"), F.col("mtime_ns").alias("now_mtime"), F.lit(True).alias("listed")
    )
    before = prior.withColumn("known", F.lit(True))
    both = before.join(now, on="relative_path", how="full_outer")
    differs = (F.col("size_bytes") != F.col("now_size")) | (F.col("mtime_ns") != F.col("now_mtime"))
    outcome = (
        F.when(F.col("listed").isNull(), "absent")
        .when(F.col("known").isNull(), "new")
        .when(F.col("inventory_status") == MISSING, "restored")
        .when(differs, "changed")
        .otherwise("unchanged")
    )
    return both.withColumn("differs", F.coalesce(differs, F.lit(False))).withColumn("outcome", outcome)


def reconcile(
    prior: DataFrame, listing: DataFrame, session_id: str, generation: int, now_utc: str, complete: bool = True
) -> DataFrame:
    """New inventory records plus ``outcome``.

    ``complete`` says that the listing covers everything without errors; only
    then do unseen present records become missing.
    """
    joined = compare(prior, listing)
    seen = F.col("listed").isNotNull()
    outcome = F.col("outcome")
    status = F.when(seen, PRESENT)
    if complete:
        status = status.when(F.col("inventory_status") == PRESENT, MISSING)
    unseen_now_missing = ~seen & F.lit(complete) & (F.col("inventory_status") == PRESENT)
    metadata = (
        F.when(outcome == "new", PENDING)
        .when(outcome == "changed", STALE)
        .when((outcome == "restored") & F.col("differs"), STALE)
        .otherwise(F.col("metadata_status"))
    )
    touched = seen | unseen_now_missing
    return joined.select(
        "relative_path",
        F.coalesce("now_size", "size_bytes").alias("size_bytes"),
        F.coalesce("now_mtime", "mtime_ns").alias("mtime_ns"),
        status.otherwise(F.col("inventory_status")).alias("inventory_status"),
        metadata.alias("metadata_status"),
        *CARRIED,
        F.when(seen, F.lit(session_id)).otherwise(F.col("last_seen_session_id")).alias("last_seen_session_id"),
        F.when(seen, F.lit(generation).cast("long")).otherwise(F.col("last_seen_generation")).alias("last_seen_generation"),
        F.coalesce("created_utc", F.lit(now_utc)).alias("created_utc"),
        F.when(touched, F.lit(now_utc)).otherwise(F.col("updated_utc")).alias("updated_utc"),
        F.when(unseen_now_missing, "marked_missing").when(~seen, "still_absent").otherwise(outcome).alias("outcome"),
    )


def scan_counters(reconciled: DataFrame, *more: Column) -> DataFrame:
    """One row of session counters, with further aggregates if wanted."""

    def n(*values: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("outcome").isin(*values), 1).otherwise(0)), F.lit(0))

    return reconciled.agg(
        n(*OUTCOMES).alias("files_seen"),
        n("new").alias("files_new"),
        n("unchanged").alias("files_unchanged"),
        n("changed").alias("files_changed"),
        n("restored").alias("files_restored"),
        n("marked_missing").alias("files_marked_missing"),
        *more,
    )


def newly_missing(prior: DataFrame, listing: DataFrame) -> DataFrame:
    """Present records a complete listing lacks."""
    return prior.where(F.col("inventory_status") == PRESENT).join(
        listing.select("relative_path"), on="relative_path", how="left_anti"
    )


def unseen_in_generation(listing: DataFrame, records: DataFrame, generation: int) -> DataFrame:
    """Listing rows an earlier batch of the same generation has not handled yet."""
    done = records.where(F.col("last_seen_generation") == generation).select("relative_path")
    return listing.join(done, on="relative_path", how="left_anti")


def upsert(base: DataFrame, changes: DataFrame, now_utc: str) -> DataFrame:
    """Insert or replace records by path.

    Created time is kept; last-seen columns are kept unless the changes carry them.
    Parquet has no row updates, so this is a full outer join and a rewrite.
    """
    keep_seen = [c for c in ("last_seen_session_id", "last_seen_generation") if c not in changes.columns]
    incoming = changes.select(
        "relative_path", F.lit(True).alias("__hit"), *[F.col(c).alias(f"n_{c}") for c in changes.columns if c != "relative_path"]
    )
    joined = base.join(incoming, on="relative_path", how="full_outer")
    hit = F.col("__hit").isNotNull()

    def pick(name: str) -> Column:
        if name in keep_seen or f"n_{name}" not in joined.columns:
            return F.col(name)
        return F.when(hit, F.col(f"n_{name}")).otherwise(F.col(name)).alias(name)

    managed = ("relative_path", "created_utc", "updated_utc")
    return joined.select(
        "relative_path",
        *[pick(c) for c in base.columns if c not in managed],
        F.coalesce("created_utc", F.lit(now_utc)).alias("created_utc"),
        F.when(hit, F.lit(now_utc)).otherwise(F.col("updated_utc")).alias("updated_utc"),
    )


def update_status(
    base: DataFrame, changes: DataFrame, now_utc: str, columns: tuple[str, ...] = ("metadata_status",)
) -> DataFrame:
    """Set status columns for the paths in ``changes``; other fields stay."""
    incoming = changes.select("relative_path", F.lit(True).alias("__hit"), *[F.col(c).alias(f"n_{c}") for c in columns])
    joined = base.join(incoming, on="relative_path", how="left")
    hit = F.col("__hit").isNotNull()
    sets = {c: F.when(hit, F.col(f"n_{c}")).otherwise(F.col(c)) for c in columns}
    sets["updated_utc"] = F.when(hit, F.lit(now_utc)).otherwise(F.col("updated_utc"))
    return joined.withColumns(sets).select(*base.columns)


def unknown_paths(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Paths an update names but the inventory lacks."""
    return changes.select("relative_path").join(base.select("relative_path"), on="relative_path", how="left_anti")


def needs_indexing(records: DataFrame, include_failed: bool = False) -> DataFrame:
    statuses = [PENDING, STALE] + ([FAILED] if include_failed else [])
    return records.where((F.col("inventory_status") == PRESENT) & F.col("metadata_status").isin(*statuses))


def status_counts(records: DataFrame) -> DataFrame:
    """Counts of both status columns in one pass as (kind, status, n)."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("kind"), F.col(c).alias("status")) for c in ("inventory_status", "metadata_status")]
    )
    return records.select(F.inline(pairs)).groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n_records"))


def presence_counts(records: DataFrame, fields: tuple[str, ...] = ("parser_version", "file_kind", "sample_hint")) -> DataFrame:
    """How many records carry each optional field; an empty string counts as missing."""
    pairs = F.array(
        *[F.struct(F.lit(f).alias("field"), (F.coalesce(f, F.lit("")) != "").alias("has")) for f in fields]
    )
    return records.select(F.inline(pairs)).groupBy("field").agg(
        F.sum(F.when(F.col("has"), 1).otherwise(0)).alias("n_present"),
        F.sum(F.when(F.col("has"), 0).otherwise(1)).alias("n_missing"),
    )


def next_generation(sessions: DataFrame) -> DataFrame:
    return sessions.agg((F.coalesce(F.max("generation"), F.lit(0)) + 1).alias("generation"))


def active_session(sessions: DataFrame) -> DataFrame:
    """The oldest active session, at most one row."""
    return sessions.where(F.col("status") == ACTIVE).orderBy("created_utc").limit(1)


def latest_session(sessions: DataFrame) -> DataFrame:
    return sessions.orderBy(F.desc("generation"), F.desc("updated_utc")).limit(1)


def close_session(
    session: DataFrame, counters: DataFrame, status: str, now_utc: str, errors: list[str] | None = None
) -> DataFrame:
    """Session row with the counters of one more batch added."""
    names = ("files_seen", "files_new", "files_unchanged", "files_changed", "files_restored", "files_marked_missing")
    kept = ("session_id", "generation", "checkpoint_path", "created_utc")
    both = session.select(*kept, *names).unionByName(counters.select(*names), allowMissingColumns=True)
    added = both.agg(*[F.max(c).alias(c) for c in kept], *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
    return added.select(
        "session_id", "generation", F.lit(status).alias("status"), "checkpoint_path", *names,
        F.lit(len(errors or [])).cast("long").alias("errors_count"),
        F.array(*[F.lit(e) for e in sorted(errors or [])]).cast("array<string>").alias("errors"),
        "created_utc", F.lit(now_utc).alias("updated_utc"),
    )


def latest_records(records: DataFrame) -> DataFrame:
    """Newest version of each path when several generations were appended."""
    return latest_first(records, ["relative_path"], [F.desc("last_seen_generation"), F.desc("updated_utc")])
