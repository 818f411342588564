"""Registered queries: documents written, read back, assembled into batches and checked."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import batches, documents, proposals, quality
from cairn.plans import scan_queries  # noqa: F401  (defines fx_groups)
from cairn.plans.projections import Views, view
from cairn.plans.registry import query
from cairn.session import cut_lineage, shared_folder
from cairn.sources import archives

SIZE = 4
NOW = "2025-01-01T00:00:00Z"

view(
    "fx_proposals",
    """
SELECT group_key AS proposal_id, 'archives/' || group_key || '.archive.json' AS output_relative_path, max(sample_id) AS sample_id, max(temperature_K) AS temperature,
       count(*) AS n_files, bool_or(role = 'figure') AND NOT bool_or(role IN ('raw', 'processed')) AS warned,
       bool_or(role = 'figure') AND NOT bool_or(role IN ('raw', 'processed')) OR bool_or(role = 'processed') AND NOT bool_or(role = 'figure') AS needs_review,
       CAST(regexp_extract(group_key, '^d([0-9]+)_', 1) AS BIGINT) % 7 = 0 AS taken
FROM fx_groups WHERE role IS NOT NULL GROUP BY group_key""",
    "fx_groups",
)
view(
    "fx_archived",
    """
SELECT *, (row_number() OVER (ORDER BY proposal_id) - 1) // 4 + 1 AS batch_number FROM fx_proposals WHERE NOT taken""",
    "fx_proposals",
)


def _generated(v: Views, folder: str) -> tuple[archives.Generated, DataFrame]:
    """Documents of all proposals; the target of every device divisible by seven is taken."""
    result = proposals.scan(v.listing)
    edges, unresolved = proposals.lineage(result.files)
    named = {"group_key": "proposal_id"}
    imported = cut_lineage(proposals.import_proposals(result, unresolved).withColumnsRenamed(named))
    built = documents.build_documents(
        imported, result.files.withColumnsRenamed(named), edges.withColumnsRenamed(named), proposals.provenance(imported, ["proposal_id"])
    )
    jobs = documents.plan_jobs(imported)
    number = F.regexp_extract("proposal_id", "^d([0-9]+)_", 1).cast("long")
    taken = jobs.where(number % 7 == 0).select(F.col("output_relative_path").alias("relative_path"))
    return archives.generate(built, jobs, imported, folder, taken), jobs


def _stored(v: Views, result) -> DataFrame:
    """The result of ``result(folder)``, kept when the folder it was read from is removed again."""
    folder = f"{shared_folder(v.spark)}/archives-{uuid.uuid4().hex}"
    out = cut_lineage(result(folder))
    path = v.spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(v.spark._jsc.hadoopConfiguration()).delete(path, True)
    return out


def _manifests(done: archives.Generated) -> DataFrame:
    ordered = batches.plan_members(done.outputs.select("proposal_id").withColumn("position", F.col("proposal_id")), SIZE)
    planned = batches.plan_batches(ordered, SIZE, "Run 9")
    return batches.assemble_manifest(planned, done.outputs, "upload", False, NOW)


def _problems(done: archives.Generated, manifests: DataFrame) -> DataFrame:
    present = done.outputs.select(F.col("output_path").alias("relative_path"), F.lit(True).alias("is_regular"))
    return quality.preflight_problems(manifests, present, done.documents)


@query(
    """
SELECT proposal_id, CASE WHEN NOT taken THEN output_relative_path END AS output_relative_path, CASE WHEN NOT taken THEN sample_id END AS sample_id,
       CASE WHEN NOT taken THEN temperature END AS temperature, CASE WHEN NOT taken THEN n_files END AS n_files, CASE WHEN NOT taken THEN needs_review END AS needs_review,
       CASE WHEN taken THEN 'collision: output target already exists' END AS problem FROM fx_proposals""",
    "fx_proposals",
)
def document_readback(v: Views) -> DataFrame:
    """All documents written, read back and held against their proposals; refused ones with the reason."""

    def read(folder: str) -> DataFrame:
        done, jobs = _generated(v, folder)
        good = done.documents.join(done.outputs.select("proposal_id"), on="proposal_id", how="left_semi").select(
            "proposal_id", "output_relative_path", "data.sample_id", "data.temperature", F.size("data.files").cast("long").alias("n_files"),
            "data.ingestion_review.needs_review",
        )
        return jobs.select("proposal_id").join(good, on="proposal_id", how="left").join(done.failures, on="proposal_id", how="left")

    return _stored(v, read)


@query(
    """
SELECT batch_number, 'planned' AS status, count(*) AS expected_entry_count, count(*) AS expected_file_count,
       string_agg(proposal_id, ',' ORDER BY proposal_id) AS proposal_ids, string_agg(output_relative_path, ',' ORDER BY proposal_id) AS destinations
FROM fx_archived GROUP BY batch_number""",
    "fx_archived",
)
def assembled_manifests(v: Views) -> DataFrame:
    """Batch manifests of the written documents."""

    def read(folder: str) -> DataFrame:
        rows = _manifests(_generated(v, folder)[0])
        return rows.select(
            "batch_number", "status", "expected_entry_count", "expected_file_count", F.array_join("proposal_ids", ",").alias("proposal_ids"),
            F.array_join("archive_files.destination_path", ",").alias("destinations"),
        )

    return _stored(v, read)


@query(
    """
SELECT batch_number, 'archive needs review: ' || output_relative_path AS problem FROM fx_archived WHERE needs_review
UNION ALL SELECT batch_number, 'archive has review warnings: ' || output_relative_path FROM fx_archived WHERE warned""",
    "fx_archived",
)
def preflight_problems(v: Views) -> DataFrame:
    """Why assembled batches may not be uploaded."""

    def read(folder: str) -> DataFrame:
        done, _ = _generated(v, folder)
        manifests = cut_lineage(_manifests(done))
        found = _problems(done, manifests).join(manifests.select("batch_id", "batch_number"), on="batch_id")
        return found.select("batch_number", F.replace("problem", F.lit(folder + "/"), F.lit("")).alias("problem"))

    return _stored(v, read)


@query(
    """
SELECT batch_number, 'preflight_passed' AS status FROM fx_archived GROUP BY batch_number HAVING NOT bool_or(needs_review OR warned)""",
    "fx_archived",
)
def preflight_passed(v: Views) -> DataFrame:
    """Batches without a problem move on."""

    def read(folder: str) -> DataFrame:
        done, _ = _generated(v, folder)
        manifests = cut_lineage(_manifests(done))
        return batches.mark_preflight_passed(manifests, _problems(done, manifests)).select("batch_number", "status")

    return _stored(v, read)
