"""Archive jobs and experiment documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import paths

# Document field names that differ from the proposal field names.
RENAMES = {
    "measurement_type": "measurement_type",
    "measurement_point_label": "measurement_point_label",
    "temperature_K": "temperature",
    "magnetic_field_T": "magnetic_field",
    "excitation_wavelength_nm": "excitation_wavelength",
    "center_wavelength_nm": "center_wavelength",
    "excitation_power_uW": "excitation_power",
    "grating_grooves_per_mm": "grating",
    "stage_position": "stage_position",
    "integration_time_s": "integration_time",
    "averages": "averages",
    "fixed_top_gate_V": "fixed_top_gate",
    "active_gate_configuration": "active_gate_configuration",
    "sweep_direction": "sweep_direction",
    "bias_start_V": "bias_start",
    "bias_stop_V": "bias_stop",
    "back_gate_topology": "back_gate_topology",
}
DOCUMENT_ROLES = ("raw", "intermediate", "processed", "figure")

# Files or edges a document may carry inline; larger experiments keep them as rows.
INLINE_LIMIT = 10_000


def sweep_direction(constraints: Column) -> Column:
    """The one direction named by exactly one constraint, else null."""
    named = F.filter(F.transform(constraints, lambda c: c["sweep_direction"]), lambda d: d.isNotNull())
    return F.when(F.size(named) == 1, F.get(named, 0))


def output_path(proposal_id: Column, output_dir: str = "archives") -> Column:
    return paths.canonical_path(F.concat(F.lit(output_dir + "/"), proposal_id, F.lit(".archive.json")))


def plan_jobs(proposals: DataFrame, output_dir: str = "archives") -> DataFrame:
    """One job per proposal: id, sample and target path."""
    return proposals.select(
        "proposal_id", "sample_id", output_path(F.col("proposal_id"), output_dir).alias("output_relative_path")
    )


def job_collisions(jobs: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Targets claimed twice, and targets already present in a listing of the output root."""
    twice = jobs.groupBy("output_relative_path").agg(F.count(F.lit(1)).alias("n_jobs")).where("n_jobs > 1")
    out = twice.select("output_relative_path", F.lit("collision: duplicate output target").alias("problem"))
    if existing is None:
        return out
    taken = jobs.select("output_relative_path").join(
        existing.select(F.col("relative_path").alias("output_relative_path")), on="output_relative_path", how="left_semi"
    )
    return out.unionByName(
        taken.distinct().withColumn("problem", F.lit("collision: output target already exists"))
    )


def _inline(rows: DataFrame, key: str, record: Column, name: str, limit: int) -> DataFrame:
    """Ordered records per key for keys within the limit; larger keys are left to the row table."""
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    small = sizes.where(F.col("__n") <= limit).select(key)
    return rows.join(small, on=key, how="left_semi").groupBy(key).agg(F.array_sort(F.collect_list(record)).alias(name))


def build_documents(
    proposals: DataFrame, files: DataFrame, lineage: DataFrame, provenance: DataFrame, inline_limit: int = INLINE_LIMIT
) -> DataFrame:
    """One nested document per proposal.

    All inputs are keyed by ``proposal_id``.  Experiments with more than
    ``inline_limit`` files or edges carry null there and ``external`` true; the
    rows themselves are ``files`` and ``lineage``, written next to the documents,
    so every file is kept without building an unbounded cell.
    """
    role_rank = F.coalesce(*[F.when(F.col("role") == r, i) for i, r in enumerate(DOCUMENT_ROLES)])
    inline_files = _inline(
        files.select("proposal_id", role_rank.alias("rank"), "role", "relative_path"),
        "proposal_id", F.struct("rank", "relative_path", "role"), "__files", inline_limit,
    )
    inline_edges = _inline(lineage, "proposal_id", F.struct("source", "target", "relation"), "__lineage", inline_limit)
    records = provenance.groupBy("proposal_id").agg(
        F.array_sort(
            F.collect_list(F.struct("ordinal", "field", F.col("value_json").alias("value"), "source_type", "source", "method"))
        ).alias("__provenance")
    )
    joined = proposals
    for part in (inline_files, inline_edges, records):
        joined = joined.join(part, on="proposal_id", how="left")
    constraints = F.transform(
        "gate_constraints",
        lambda c: F.struct(
            c["raw_expression"].alias("raw_expression"),
            c["control_mode"].alias("control_mode"),
            F.lit(0.0).alias("constant"),
            F.transform(
                F.array_sort(c["coefficients"]),
                lambda t: F.struct(t["gate"].alias("node"), t["value"].alias("coefficient")),
            ).alias("terms"),
        ),
    )
    n_files = F.col("n_raw") + F.col("n_processed") + F.col("n_figure") + F.col("n_intermediate")
    shown = {**{old: F.col(old) for old in RENAMES if old != "sweep_direction"}, "sweep_direction": sweep_direction(F.col("gate_constraints"))}
    document = F.struct(
        "sample_id",
        *[shown[old].alias(new) for old, new in RENAMES.items()],
        F.col("rotations_deg").alias("rotations"),
        F.transform(
            F.array_sort("fixed_gate_values"), lambda g: F.struct(g["gate"].alias("gate"), g["value"].alias("voltage"))
        ).alias("fixed_gate_values"),
        constraints.alias("gate_constraints"),
        "electrical_connections",
        F.transform(
            "__files", lambda f: F.struct(f["relative_path"].alias("path"), f["role"].alias("role"))
        ).alias("files"),
        F.col("first_raw").alias("raw_data_file"),
        F.col("first_processed").alias("processed_data_file"),
        F.transform("__provenance", lambda p: p.dropFields("ordinal")).alias("metadata_provenance"),
        F.col("__lineage").alias("lineage"),
        F.struct("warnings", "confidence", "needs_review").alias("ingestion_review"),
    )
    external = (n_files > 0) & F.col("__files").isNull()
    return joined.select("proposal_id", document.alias("data"), external.alias("external"))


def readback_problems(written: DataFrame, proposals: DataFrame) -> DataFrame:
    """Written documents whose sample id or review flag differs from the proposal, or that are missing."""
    got = written.select(
        "proposal_id", F.lit(True).alias("found"), F.col("data.sample_id").alias("got_sample"),
        F.col("data.ingestion_review.needs_review").alias("got_review"),
    )
    joined = proposals.select("proposal_id", "sample_id", "needs_review").join(got, on="proposal_id", how="left")
    problem = (
        F.when(F.col("found").isNull(), "document missing")
        .when(F.col("sample_id").isNotNull() & ~F.col("sample_id").eqNullSafe(F.col("got_sample")), "sample id differs")
        .when(F.col("needs_review").isNotNull() & ~F.col("needs_review").eqNullSafe(F.col("got_review")), "review flag differs")
    )
    return joined.withColumn("problem", problem).where(F.col("problem").isNotNull()).select("proposal_id", "problem")
