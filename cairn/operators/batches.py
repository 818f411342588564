"""Batches: planning, lifecycle, reconciliation, next action, status report.

A manifest table has one row per stored manifest: ``batch_number``, ``stage``
(``base`` or a lifecycle stage), identity, counts, status and entry pairs.  Batch
members are bounded by the batch size, so arrays of them are safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import ids
from cairn.functions.text import pad_number
from cairn.operators.ordering import position_within

# Lifecycle stages from most to least advanced, statuses, states.
STAGES = ("final", "reconciled_mainfile", "reconciled", "upload_created", "preflight_passed")
PENDING_STATES = ("pending", "running", "processing")
SUCCESS_STATES = ("success", "succeeded", "complete", "completed")
FAILURE_STATES = ("failed", "failure")
NO_UPLOAD = "manifest has no upload_id; creation is not reconciled"
NOT_FOUND = "remote upload not found; recovery decision required"
PUBLISHED = "remote upload is published although publish=False"


def plan_members(proposals: DataFrame, batch_size: int, order: str = "position", key: str = "proposal_id") -> DataFrame:
    """Batch number and place of each proposal in the caller's order.

    The global rank comes from range partitions, not from one window over all rows.
    """
    if batch_size <= 0:
        raise ValueError("batch_size must be greater than zero")
    ranked = position_within(proposals, [], [order, key], name="__rank")
    number = (F.floor(F.col("__rank") / batch_size) + 1).cast("long")
    return ranked.withColumn("batch_number", number).withColumn("item", F.col("__rank") % batch_size).drop("__rank")


def plan_batches(members: DataFrame, batch_size: int, label: str | None = None, key: str = "proposal_id") -> DataFrame:
    """One row per batch: number, id, ordered members (at most ``batch_size``)."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("item", key))), lambda s: s[key])
    grouped = members.groupBy("batch_number").agg(ordered.alias("proposal_ids"))
    return grouped.select(
        "batch_number",
        ids.batch_id(F.col("batch_number"), F.lit(batch_size), F.lit(label), F.col("proposal_ids")).alias("batch_id"),
        F.lit(label).cast("string").alias("dataset_label"),
        F.size("proposal_ids").alias("item_count"),
        "proposal_ids",
    )


def _stage_rank() -> Column:
    """0 for the most advanced stage; null for the base manifest."""
    return F.coalesce(*[F.when(F.col("stage") == s, i) for i, s in enumerate(STAGES)])


def _verified() -> Column:
    return F.coalesce(
        (F.col("status") == "success")
        & (F.col("verification_status") == "verified")
        & F.col("upload_id").isNotNull()
        & (F.size("entry_ids") > 0),
        F.lit(False),
    )


def batch_states(manifests: DataFrame) -> DataFrame:
    """One row per batch: base identity, most advanced state, verified flag."""
    fields = F.struct("stage", "batch_id", "status", "upload_id", "publish", "verification_status", "entry_ids")
    rank = _stage_rank()
    is_base, preflight, final = (F.col("stage") == s for s in ("base", "preflight_passed", "final"))
    agg = manifests.groupBy("batch_number").agg(
        F.max(F.when(is_base, F.col("batch_id"))).alias("batch_id"),
        F.max(F.when(is_base, F.size("proposal_ids"))).alias("item_count"),
        F.max(F.when(is_base, F.col("expected_entry_count"))).alias("expected_entries"),
        F.min_by(F.when(is_base, fields), F.when(is_base, 1)).alias("base"),
        F.min_by(fields, rank).alias("advanced"),
        F.coalesce(F.bool_or(preflight), F.lit(False)).alias("has_preflight"),
        F.coalesce(F.bool_or(final), F.lit(False)).alias("has_final"),
        F.coalesce(F.bool_or(final & _verified()), F.lit(False)).alias("is_verified"),
        F.max(F.when(final, F.size("entry_ids"))).alias("final_entries"),
        F.coalesce(F.bool_or(~is_base & (F.col("stage") != "preflight_passed")), F.lit(False)).alias("beyond_preflight"),
    )
    now = F.coalesce("advanced", "base")
    return agg.select(
        "batch_number", "batch_id", "item_count", "expected_entries", "has_preflight", "has_final", "is_verified",
        "beyond_preflight", "final_entries",
        now["stage"].alias("stage"),
        now["batch_id"].alias("current_batch_id"),
        now["status"].alias("status"),
        now["upload_id"].alias("upload_id"),
        F.coalesce(now["publish"], F.lit(False)).alias("published"),
        now["verification_status"].alias("verification_status"),
    )


def lifecycle(states: DataFrame) -> DataFrame:
    """Add ``lifecycle``: final_verified, preflight_ready, processing_pending, blocked_invalid."""
    state = (
        F.when(F.col("batch_id").isNull(), "blocked_invalid")
        .when(F.col("is_verified"), "final_verified")
        .when(~F.col("beyond_preflight"), "preflight_ready")
        .when(F.col("status").isin("upload_created", "processing"), "processing_pending")
        .otherwise("blocked_invalid")
    )
    return states.withColumn("lifecycle", state)


def lifecycle_counts(states: DataFrame) -> DataFrame:
    known = F.col("batch_id").isNotNull()
    return lifecycle(states).groupBy("lifecycle").agg(
        F.count(F.lit(1)).alias("n_batches"),
        F.coalesce(F.sum(F.when(known, F.col("expected_entries"))), F.lit(0)).alias("expected_entries"),
        F.coalesce(F.sum(F.when(F.col("is_verified"), F.col("final_entries"))), F.lit(0)).alias("verified_entries"),
        F.coalesce(F.sum(F.when(known & F.col("published"), 1).otherwise(0)), F.lit(0)).alias("published_batches"),
        F.coalesce(F.sum(F.when(known & ~F.col("published"), 1).otherwise(0)), F.lit(0)).alias("unpublished_batches"),
    )


def duplicates(manifests: DataFrame) -> DataFrame:
    """Proposal and upload ids that occur in more than one batch, as (kind, value, n_batches)."""
    base_known = manifests.where(F.col("stage") == "base").select("batch_number").distinct()
    known = manifests.join(base_known, on="batch_number", how="left_semi")
    members = known.select(F.lit("proposal").alias("kind"), "batch_number", F.explode("proposal_ids").alias("value"))
    uploads = known.where((F.col("stage") != "base") & (F.coalesce("upload_id", F.lit("")) != "")).select(
        F.lit("upload").alias("kind"), "batch_number", F.col("upload_id").alias("value")
    )
    return (
        members.unionByName(uploads)
        .groupBy("kind", "value")
        .agg(F.count_distinct("batch_number").alias("n_batches"))
        .where(F.col("n_batches") > 1)
    )


def eligibility(states: DataFrame) -> DataFrame:
    """The lowest batch that is not verified, with the reason it may or may not run.

    One row; no batches at all, or all of them verified, give a null number.
    The predecessor check is a join on number - 1.
    """
    open_batch = ~F.col("is_verified")
    fields = F.struct("batch_number", "batch_id", "current_batch_id", "has_preflight", "upload_id", "published", "status")
    one = states.agg(
        F.min_by(F.when(open_batch, fields), F.when(open_batch, F.col("batch_number"))).alias("b"), F.count(F.lit(1)).alias("n_batches")
    ).select("b.*", "n_batches")
    previous = states.select(
        (F.col("batch_number") + 1).alias("next_number"), F.col("is_verified").alias("previous_verified")
    )
    joined = one.join(previous, on=F.col("batch_number") == F.col("next_number"), how="left")
    reason = (
        F.when(F.col("n_batches") == 0, "no prepared batches")
        .when(F.col("batch_number").isNull(), "no eligible batches")
        .when(~F.col("has_preflight"), "preflight manifest missing")
        .when(F.col("upload_id").isNotNull(), "known upload requires reconciliation")
        .when(F.col("published"), "batch publish is True")
        .when(
            (F.col("batch_number") > 1) & ~F.coalesce("previous_verified", F.lit(False)),
            "predecessor batch is not final and verified",
        )
        .otherwise("eligible")
    )
    return joined.select(
        "batch_number",
        F.when(F.col("has_preflight"), F.col("current_batch_id")).otherwise(F.col("batch_id")).alias("batch_id"),
        reason.alias("reason"),
        (reason == "eligible").alias("eligible"),
        F.when(reason.startswith("predecessor"), F.col("batch_number") - 1).alias("blocking_batch"),
    )


def remote_readiness(names: DataFrame, uploads: DataFrame) -> DataFrame:
    """Outcome of each upload name: no_match, single_match or ambiguous.

    Uploads are reduced to one row per name before the join.
    """
    valid = uploads.where(F.coalesce("upload_id", F.lit("")) != "")
    found = valid.groupBy("upload_name").agg(
        F.count_distinct("upload_id").alias("n_ids"), F.min("upload_id").alias("first_id")
    )
    joined = names.select("upload_name").distinct().join(found, on="upload_name", how="left")
    n = F.coalesce("n_ids", F.lit(0))
    outcome = F.when(n == 0, "no_match").when(n == 1, "single_match").otherwise("ambiguous")
    return joined.select(
        "upload_name", n.alias("n_ids"), outcome.alias("outcome"), F.when(n == 1, F.col("first_id")).alias("matching_upload_id")
    )


def production_actions(states: DataFrame, readiness: DataFrame, upload_name: Column) -> DataFrame:
    """create, reconcile or blocked for every batch, by local state and remote outcome.

    ``upload_name`` names a batch remotely.  A batch is blocked locally by a missing
    preflight, a known upload, publication, or an unverified predecessor.
    """
    previous = states.select((F.col("batch_number") + 1).alias("batch_number"), F.col("is_verified").alias("previous_verified"))
    named = states.where(~F.col("is_verified")).withColumn("upload_name", upload_name)
    joined = named.join(previous, on="batch_number", how="left").join(
        readiness.select("upload_name", "outcome"), on="upload_name", how="left"
    )
    local = (
        F.when(~F.col("has_preflight"), "preflight manifest missing")
        .when(F.col("upload_id").isNotNull(), "known upload requires reconciliation")
        .when(F.col("published"), "batch publish is True")
        .when(
            (F.col("batch_number") > 1) & ~F.coalesce("previous_verified", F.lit(False)),
            "predecessor batch is not final and verified",
        )
        .when(~F.col("status").isin("planned", "preflight_passed"), "batch has unresolved local state")
    )
    outcome = F.coalesce("outcome", F.lit("no_match"))
    action = (
        F.when(local.isNotNull(), "blocked")
        .when(outcome == "no_match", "create")
        .when(outcome == "single_match", "reconcile")
        .otherwise("blocked")
    )
    reason = F.coalesce(
        local,
        F.when(outcome == "no_match", "eligible and no remote match")
        .when(outcome == "single_match", "exactly one remote upload matches")
        .otherwise("ambiguous remote match"),
    )
    return joined.select("batch_number", "batch_id", action.alias("action"), reason.alias("reason"), "published")


def next_action(states: DataFrame, readiness: DataFrame, upload_name: Column) -> DataFrame:
    """The action of the lowest unverified batch."""
    return production_actions(states, readiness, upload_name).orderBy("batch_number").limit(1)


def reconcile(manifests: DataFrame, observed: DataFrame) -> DataFrame:
    """State of each manifest against its observed upload.

    ``observed`` is keyed by ``batch_id`` with ``observed_upload_id,
    process_status, process_running, published, entry_count, errors, warnings,
    not_found``.
    """
    joined = manifests.join(observed, on="batch_id", how="left")
    status = F.lower(F.coalesce("process_status", F.lit("")))
    none = F.array().cast("array<string>")
    base_errors = F.coalesce("errors", none)
    published = F.when(F.coalesce("published", F.lit(False)) & ~F.col("publish"), F.lit(PUBLISHED))
    running = F.coalesce("process_running", F.lit(False)) | status.isin(*PENDING_STATES)
    failed = status.isin(*FAILURE_STATES)
    succeeded = status.isin(*SUCCESS_STATES)
    mismatch = F.col("upload_id") != F.coalesce("observed_upload_id", F.lit(""))
    seen = F.coalesce("entry_count", F.lit(0))
    entries = F.when(
        seen != F.col("expected_entry_count"),
        F.concat(
            F.lit("entry count mismatch: expected "), F.col("expected_entry_count").cast("string"),
            F.lit(", observed "), seen.cast("string"),
        ),
    )
    shown = F.coalesce(F.concat(F.lit("'"), F.col("process_status"), F.lit("'")), F.lit("None"))
    id_text = F.concat(
        F.lit("upload_id mismatch: expected "), F.col("upload_id"), F.lit(", observed "), F.coalesce("observed_upload_id", F.lit("None"))
    )
    no_upload, gone = F.col("upload_id").isNull(), F.coalesce("not_found", F.lit(False))
    own = (
        F.when(no_upload, F.array(F.lit(NO_UPLOAD)))
        .when(gone, F.array(F.lit(NOT_FOUND)))
        .when(mismatch, F.array(id_text))
        .when(running | failed, F.array(published))
        .when(succeeded, F.array(published, entries))
        .otherwise(F.array(published, F.concat(F.lit("unsupported or missing process status: "), shown)))
    )
    errors = F.array_sort(F.array_distinct(F.concat(base_errors, F.array_compact(own))))
    clean = F.size(errors) == 0
    state = (
        F.when(no_upload, "not_created")
        .when(gone, "not_found")
        .when(mismatch, "id_mismatch")
        .when(running, "processing")
        .when(failed, "processing_failed")
        .when(succeeded & clean, "success")
        .otherwise("reconciliation_error")
    )
    settled = F.when(running, clean).otherwise(state.isin("processing_failed", "success"))
    new_status = (
        F.when(state == "processing", "processing")
        .when(state == "processing_failed", "processing_failed")
        .when(state == "success", "success")
        .otherwise(F.col("status"))
    )
    blocked = no_upload | gone | mismatch
    return joined.select(
        "batch_number", "batch_id", state.alias("state"),
        (settled & ~blocked).alias("reconciled"),
        errors.alias("errors"),
        F.array_sort(F.array_distinct(F.coalesce("warnings", none))).alias("warnings"),
        new_status.alias("status"),
    )


def entry_pairs(members: DataFrame, entries: DataFrame) -> DataFrame:
    """Proposals and remote entries matched by position; batches with unequal counts are left out.

    ``members(batch_number, item, proposal_id)`` and ``entries(batch_number, item, entry_id)``
    both count ``item`` from zero.  Items are often listed by arrays, whose rows Spark's size
    estimate leaves out, so the pairs meet in a shuffle and never in a broadcast.
    """
    sizes = members.groupBy("batch_number").agg(F.count(F.lit(1)).alias("n")).join(
        entries.groupBy("batch_number").agg(F.count(F.lit(1)).alias("n")), on=["batch_number", "n"]
    )
    return members.join(entries.hint("merge"), on=["batch_number", "item"]).join(sizes.select("batch_number"), on="batch_number", how="left_semi")


def upload_status(entry_statuses: DataFrame, key: str = "batch_number") -> DataFrame:
    """One status per upload: SUCCESS if all are, else PROCESSING, PENDING, else the first."""
    agg = entry_statuses.groupBy(key).agg(
        F.bool_and(F.col("status") == "SUCCESS").alias("all_done"),
        F.bool_or(F.col("status") == "PROCESSING").alias("busy"),
        F.bool_or(F.col("status") == "PENDING").alias("waiting"),
        F.min_by("status", "item").alias("first"),
    )
    value = F.when(F.col("all_done"), "SUCCESS").when(F.col("busy"), "PROCESSING").when(F.col("waiting"), "PENDING").otherwise(F.col("first"))
    return agg.select(key, value.alias("status"))


def transport_files(manifests: DataFrame) -> DataFrame:
    """Manifest files with an explicit upload destination, archives apart from companions."""

    def side(column: str, kind: str) -> DataFrame:
        rows = manifests.select("batch_number", F.lit(kind).alias("kind"), F.explode(column).alias("f"))
        return rows.where(F.col("f.destination_path").isNotNull()).select(
            "batch_number", "kind", F.col("f.source_path").alias("source_path"), F.col("f.destination_path").alias("destination_path")
        )

    return side("archive_files", "archive").unionByName(side("companion_files", "companion"))


def upload_outcomes(outcomes: DataFrame) -> DataFrame:
    """Classify upload attempts: rejected, planned, creation_unknown, processing_failed, processing, upload_created.

    Columns: ``status, upload_id`` of the manifest, ``transport_archives`` count,
    ``raised, dry_run`` flags and ``result_upload_id, result_entry_id, result_status``.
    """
    got_id = F.coalesce("result_upload_id", F.lit("")) != ""
    state = (
        F.when(F.col("status") != "preflight_passed", "rejected")
        .when(F.col("upload_id").isNotNull(), "rejected")
        .when(F.col("transport_archives") == 0, "rejected")
        .when(F.col("raised"), "creation_unknown")
        .when(F.col("dry_run"), "planned")
        .when(~got_id, "creation_unknown")
        .when(F.coalesce("result_status", F.lit("")) == "FAILURE", "processing_failed")
        .when(F.col("result_entry_id").isNull() | (F.coalesce("result_status", F.lit("")) != "SUCCESS"), "processing")
        .otherwise("upload_created")
    )
    reason = (
        F.when(F.col("status") != "preflight_passed", "batch upload requires manifest status preflight_passed")
        .when(F.col("upload_id").isNotNull(), "batch already has an upload_id; reconcile instead of creating")
        .when(F.col("transport_archives") == 0, "no explicit transport archive mainfile is present")
        .when(F.col("raised"), "uploader failed without a confirmed outcome")
        .when(~F.col("dry_run") & ~got_id, "uploader returned no confirmed upload_id")
        .when(state == "processing_failed", "upload processing failed")
        .when(state == "processing", "upload created; processing requires reconciliation")
    )
    created = state.isin("processing_failed", "processing", "upload_created")
    return outcomes.withColumn("state", state).withColumn("created", created).withColumn("reason", reason)


def status_lines(manifests: DataFrame, records: DataFrame | None = None, sessions: DataFrame | None = None) -> DataFrame:
    """Status report as distinct (level, line) rows; long id lists are one row per id."""
    states = lifecycle(batch_states(manifests))
    label = F.concat(F.lit("batch "), pad_number(F.col("batch_number"), 3))
    known = states.where(F.col("batch_id").isNotNull())

    def lines(df: DataFrame, level: str, *parts: Column) -> DataFrame:
        return df.select(F.lit(level).alias("level"), F.concat(*parts).alias("line"))

    out = [
        lines(states.where(F.col("batch_id").isNull()), "blocker", F.lit("malformed artifact: "), label, F.lit(": base manifest missing or invalid")),
        lines(known.where(F.col("published")), "blocker", label, F.lit(" has publish=true")),
        lines(
            known.where(F.col("lifecycle").isin("processing_pending", "blocked_invalid")),
            "blocker", label, F.lit(" is not final and verified ("), F.col("status"), F.lit(")"),
        ),
        lines(
            known.where(F.col("upload_id").isNotNull() & ~F.col("has_final")),
            "blocker", label, F.lit(" has an upload ID but no final artifact"),
        ),
        lines(known.where(F.col("lifecycle") == "preflight_ready"), "warning", label, F.lit(" is preflight-ready; this does not imply an upload")),
    ]
    dup = duplicates(manifests)
    out.append(lines(dup.where(F.col("kind") == "proposal"), "blocker", F.lit("duplicate proposal membership: "), F.col("value")))
    out.append(lines(dup.where(F.col("kind") == "upload"), "blocker", F.lit("duplicate confirmed upload IDs: "), F.col("value")))
    base = manifests.where(F.col("stage") == "base").groupBy("batch_number").agg(F.max("batch_id").alias("base_id"))
    conflict = manifests.where(F.col("stage") != "base").join(base, on="batch_number").where(F.col("batch_id") != F.col("base_id"))
    out.append(lines(conflict, "blocker", label, F.lit(" lifecycle identity conflicts with base manifest")))
    out.append(lines(eligibility(states).where(~F.col("eligible")), "warning", F.lit("no eligible batch: "), F.col("reason")))
    if records is not None:
        pending = records.where(F.col("metadata_status") == "pending").agg(F.count(F.lit(1)).alias("n")).where("n > 0")
        out.append(lines(pending, "blocker", F.col("n").cast("string"), F.lit(" inventory records have pending metadata")))
    if sessions is not None:
        latest = sessions.orderBy(F.desc("generation"), F.desc("updated_utc")).limit(1)
        out.append(
            lines(latest.where(F.col("status") != "completed"), "blocker", F.lit("latest scan session is "), F.col("status"), F.lit(", not completed"))
        )
        out.append(
            lines(
                latest.where(F.col("errors_count") > 0), "blocker",
                F.lit("latest scan session has "), F.col("errors_count").cast("string"), F.lit(" persisted errors"),
            )
        )
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result.distinct()


def readiness_counts(states: DataFrame) -> DataFrame:
    """Batch readiness totals in one row."""
    rows = lifecycle(states)

    def n(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("lifecycle") == kind, 1).otherwise(0)), F.lit(0))

    return rows.agg(
        F.count(F.lit(1)).alias("discovered_batches"),
        n("preflight_ready").alias("preflight_ready_batches"),
        n("final_verified").alias("final_verified_batches"),
        n("processing_pending").alias("processing_pending_batches"),
        F.coalesce(F.sum("expected_entries"), F.lit(0)).alias("total_expected_entries"),
        F.coalesce(F.sum(F.when(F.col("is_verified"), F.col("final_entries"))), F.lit(0)).alias("total_verified_entries"),
    )


def assemble_manifest(batch: DataFrame, outputs: DataFrame, upload_name: str, publish: bool, now_utc: str) -> DataFrame:
    """Planned manifest rows from batches and their written documents.

    ``outputs(proposal_id, output_path, output_relative_path)``; a batch with a
    member that has no output is left out (see ``quality.assembly_problems``).
    """
    members = batch.select("batch_number", "batch_id", "dataset_label", "item_count", F.posexplode("proposal_ids").alias("item", "proposal_id"))
    files = members.join(outputs, on="proposal_id").groupBy("batch_number").agg(
        F.array_sort(
            F.collect_list(F.struct("item", "proposal_id", "output_path", "output_relative_path"))
        ).alias("__files")
    )
    joined = batch.join(files, on="batch_number").where(F.size("__files") == F.col("item_count"))
    mapped = F.transform(
        "__files",
        lambda f: F.struct(
            f["output_path"].alias("source_path"),
            F.lit(None).cast("string").alias("relative_path"),
            f["output_relative_path"].alias("destination_path"),
            F.lit("archive").alias("role"),
        ),
    )
    no_files = F.array().cast("array<struct<source_path:string,relative_path:string,destination_path:string,role:string>>")
    return joined.select(
        F.lit(1).alias("manifest_version"), "batch_id", "batch_number", "dataset_label",
        F.lit("planned").alias("status"), "proposal_ids", mapped.alias("archive_files"), no_files.alias("companion_files"),
        F.col("item_count").cast("long").alias("expected_entry_count"),
        F.size("__files").cast("long").alias("expected_file_count"),
        F.lit(publish).alias("publish"), F.lit(upload_name).alias("upload_name"),
        F.lit(None).cast("string").alias("upload_id"),
        F.array().cast("array<struct<proposal_id:string,entry_id:string>>").alias("entry_ids"),
        F.lit(None).cast("string").alias("processing_status"), F.lit(None).cast("string").alias("verification_status"),
        F.lit(now_utc).alias("created_utc"), F.lit(now_utc).alias("updated_utc"),
    )


def mark_preflight_passed(manifests: DataFrame, problems: DataFrame) -> DataFrame:
    """Manifests without a problem row, moved to ``preflight_passed``."""
    clean = manifests.join(problems.select("batch_id").distinct(), on="batch_id", how="left_anti")
    return clean.where(F.col("status") == "planned").withColumn("status", F.lit("preflight_passed"))
