"""Device data directories -> derived experiments, edges, claims.

All matching is by equality: folder alias by (device, first component), processed
to raw by (device, reduced stem), the metadata fallback by (device, profile hash).
Files stay in long form keyed by (device, canonical stem); only the stems of a
device are ordered, never its files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import ids, paths
from cairn.functions.binding import computed
from cairn.functions.filename import METADATA_FIELDS
from cairn.functions.text import blank_to_null
from cairn.operators.lineage import DOWNSTREAM, UPSTREAM, expand_members, pair_edges, with_file_id, with_relationship_id
from cairn.operators.merging import group_variants, merge_variants, with_readings
from cairn.operators.ordering import position_within
from cairn.session import cut_lineage

# Parser tag, fields, suffix vocabulary and role order.
PARSER_VERSION = "device_directory_context/v2"
PARSER_PREFIX = "device_directory_context/"
MEASURED_ON_FIELD = "measured_on_device"
REVIEWED_FIELD = "measured_on_raw_match"
DERIVATIVE_CHAIN = (
    "^(.+?)((?:_avg1_DR_R_External|_DR_R_first_avg1|_avg1_DR_R_Self|_PL_linear|_PL_log|_PL)*)$"
)
FIGURE_VARIANTS = {"linear": "_PL_linear", "log": "_PL_log"}
ROLE_PRIORITY = ("raw", "processed", "figure", "intermediate")
UNRESOLVED_WARNING = "processed files without a deterministically matching raw measurement"

PROFILE_FIELDS = (
    "sample_id", "measurement_type", "measurement_point_label", "temperature_K", "magnetic_field_T",
    "excitation_wavelength_nm", "center_wavelength_nm", "integration_time_s", "averages",
    "stage_position", "rotations_deg",
)
PROFILE_ELECTRICAL = ("bias_start_V", "bias_stop_V", "fixed_top_gate_V", "active_gate_configuration")

FILE_COLUMNS = ("experiment_id", "role", "storage_source_id", "relative_path", "stem", "unresolved")

# Rounds of joins after which a table's size is taken anew.
SIZED_EVERY = 8

# Files an unresolved group may have and still be listed by path in its warning.
NAME_LIMIT = 1_000


@dataclass(frozen=True)
class Linked:
    """``experiments`` one row each; ``files`` one row per (experiment, storage reference).

    ``placed`` are the files with device and ordinal, as long as no decision has moved any.
    """

    experiments: DataFrame
    files: DataFrame
    absorbed: DataFrame
    placed: DataFrame | None = None


def strip_derivatives(stem: Column) -> Column:
    return F.regexp_extract(stem, "(?s)" + DERIVATIVE_CHAIN, 1)


def counter_suffix(stem: Column) -> Column:
    return blank_to_null(F.regexp_extract(stem, r"_\d+$", 0))


def profile(df: DataFrame, stem: str) -> DataFrame:
    """Add ``profile``: hash of the compared fields, null when none carries a value."""
    m, e = F.col("meta"), F.col("electrical")
    wires = F.array_sort(
        F.transform(
            e["electrical_connections"], lambda c: F.struct(c["nodes"], c["type"], c["source_role"])
        )
    )
    no_text = F.array().cast("array<string>")
    body = F.struct(
        *[m[f].alias(f) for f in PROFILE_FIELDS],
        *[e[f].alias(f) for f in PROFILE_ELECTRICAL],
        F.coalesce(e["fixed_gates"], no_text).alias("fixed_gate_values"),
        F.coalesce(F.to_json(wires), F.lit("[]")).alias("electrical_connections"),
        counter_suffix(F.col(stem)).alias("counter"),
    )
    scalars = [m[f] for f in PROFILE_FIELDS] + [e[f] for f in PROFILE_ELECTRICAL]
    carries = counter_suffix(F.col(stem)).isNotNull()
    for value in scalars:
        carries = carries | value.isNotNull()
    carries = carries | (F.size(F.coalesce(e["fixed_gates"], no_text)) > 0)
    carries = carries | (F.coalesce(F.size(e["electrical_connections"]), F.lit(0)) > 0)
    digest = F.sha2(F.to_json(body, {"ignoreNullFields": "false"}), 256)
    return computed(with_readings(df, stem), F.struct(F.when(carries, digest).alias("profile"))).drop("meta", "electrical")


def data_files(devices: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Artifacts in a data directory below one of their own device's folder aliases."""
    alias = devices.select(
        "device_id", "local_device_id", F.explode("aliases").alias("alias")
    ).where((F.col("alias") != "") & ~F.contains("alias", F.lit("/"))).distinct()
    path = F.col("relative_path")
    bound = artifacts.where(path.isNotNull() & F.col("device_id").isNotNull()).select(
        "artifact_id", "device_id", "storage_source_id", path, F.coalesce("extension", F.lit("")).alias("__stored")
    )
    read = computed(
        bound,
        F.struct(
            paths.first_component(path).alias("alias"),
            paths.second_component(path).alias("folder"),
            paths.component_count(path).alias("__parts"),
            paths.linkage_extension(F.col("__stored"), path).alias("ext"),
            F.lower("__stored").alias("stored_ext"),
            paths.stem(path).alias("stem"),
        ),
    )
    located = read.where(
        (F.col("__parts") >= 3)
        & F.col("folder").isin(*paths.RAW_FOLDERS, paths.PROCESSED_FOLDER)
        & F.col("ext").isin(*paths.LINKAGE_EXTENSIONS)
    ).drop("__parts", "__stored")
    return located.join(alias, on=["device_id", "alias"]).withColumn(
        "role", paths.linkage_role(F.col("folder"), F.col("ext"))
    )


def canonical_stems(files: DataFrame) -> DataFrame:
    """Add ``canonical`` and ``unresolved``.

    Raw files keep their stem; others take the raw stem left after stripping
    derivative suffixes, else the first raw stem with the same profile, else they
    stay unresolved under their own stem.  Raw stems are reduced to distinct rows
    before the joins and the fallback to one row per profile.
    """
    raw_csv = files.where(F.col("folder").isin(*paths.RAW_FOLDERS) & (F.col("stored_ext") == "csv"))
    stems = raw_csv.select("device_id", F.col("stem").alias("reduced")).distinct().withColumn("exact", F.lit(True))
    fallback = raw_csv.where(F.col("folder") == paths.FALLBACK_RAW_FOLDER).select("device_id", "stem").distinct()
    fallback = (
        profile(fallback, "stem")
        .where(F.col("profile").isNotNull())
        .groupBy("device_id", "profile")
        .agg(F.min("stem").alias("profile_stem"))
    )
    raw = files.where(F.col("folder").isin(*paths.RAW_FOLDERS)).select(
        "*", F.col("stem").alias("canonical"), F.lit(False).alias("unresolved")
    )
    derived = files.where(~F.col("folder").isin(*paths.RAW_FOLDERS)).withColumn(
        "reduced", strip_derivatives(F.col("stem"))
    )
    checked = derived.join(stems, on=["device_id", "reduced"], how="left")
    exact = checked.where(F.col("exact")).select(*files.columns, F.col("reduced").alias("canonical"), F.lit(False).alias("unresolved"))
    open_files = checked.where(F.col("exact").isNull())
    matched = profile(open_files.select("device_id", "reduced").distinct(), "reduced").join(
        fallback, on=["device_id", "profile"]
    ).select("device_id", "reduced", "profile_stem")
    rest = open_files.join(matched, on=["device_id", "reduced"], how="left").select(
        *files.columns,
        F.coalesce("profile_stem", "stem").alias("canonical"),
        F.col("profile_stem").isNull().alias("unresolved"),
    )
    return raw.unionByName(exact).unionByName(rest)


def best_roles(files: DataFrame) -> DataFrame:
    """One row per storage reference and group; of several roles the later in the list wins."""
    rank = F.coalesce(*[F.when(F.col("role") == r, i) for i, r in enumerate(ROLE_PRIORITY)])
    return files.groupBy(
        "device_id", "local_device_id", "unresolved", "canonical", "storage_source_id", "relative_path", "stem"
    ).agg(F.max_by("role", rank).alias("role"))


def number_experiments(groups: DataFrame) -> DataFrame:
    """Per-device ordinals: resolved stems in order, then unresolved ones."""
    numbered = position_within(groups, ["device_id"], ["unresolved", "canonical"])
    return numbered.withColumn(
        "experiment_id",
        ids.derived_experiment_id(F.col("device_id"), F.col("local_device_id"), F.col("ordinal")),
    )


def _decided(located: DataFrame, reviewed: DataFrame) -> DataFrame:
    """(absorbed_id, experiment_id, raw_stem) of each decision that finds both its experiments.

    ``reviewed(processed_stem, raw_stem)`` is a table of human adjudications.
    The first experiment in (device, ordinal) order on either side takes part.
    """
    where = F.struct("device_id", "ordinal", "experiment_id")
    derived = located.where(F.col("role").isin("processed", "figure")).withColumn("processed_stem", strip_derivatives(F.col("stem")))
    kept = derived.join(reviewed, on="processed_stem").groupBy("processed_stem", "raw_stem").agg(F.min(where).alias("kept"))
    raw = located.where(F.col("role") == "raw").withColumn("raw_stem", F.col("stem"))
    gone = raw.join(reviewed, on="raw_stem").groupBy("processed_stem", "raw_stem").agg(F.min(where).alias("gone"))
    return kept.join(gone, on=["processed_stem", "raw_stem"]).where(
        F.col("kept.experiment_id") != F.col("gone.experiment_id")
    ).select(
        F.col("gone.experiment_id").alias("absorbed_id"), F.col("kept.experiment_id").alias("experiment_id"), "processed_stem", "raw_stem"
    )


def _cut_round(df: DataFrame, number: int) -> DataFrame:
    """``cut_lineage`` of a numbered round of joins; every ``SIZED_EVERY``-th restores the rows' own size.

    A join's estimated size is the product of its sides' and a cut keeps it, so its
    digits double from round to round; a table kept in storage states what it holds.
    """
    if number % SIZED_EVERY:
        return cut_lineage(df)
    kept = df.persist()
    kept.count()
    cut = cut_lineage(kept.select("*"))
    kept.unpersist()
    return cut


def _jumped(steps: DataFrame, rounds: int) -> tuple[DataFrame, bool]:
    """(each absorbed experiment with the end of its chain, whether all chains have ended).

    Every round doubles the way; the first that moves nothing is the last, so the
    longest chain decides on the rounds and not the number of decisions.
    """
    for number in range(1, rounds + 1):
        onward = steps.select(F.col("absorbed_id").alias("experiment_id"), F.col("experiment_id").alias("__next"))
        jumped = _cut_round(
            steps.join(onward, on="experiment_id", how="left").select(
                "absorbed_id", F.coalesce("__next", "experiment_id").alias("experiment_id"), F.col("__next").isNotNull().alias("__moved")
            ),
            number,
        )
        steps = jumped.drop("__moved")
        if jumped.where("__moved").isEmpty():
            return steps, True
    return steps, False


def final_experiments(steps: DataFrame) -> DataFrame:
    """(absorbed_id, experiment_id): where the chain of ``steps`` from each absorbed experiment ends.

    ``steps`` names one target for each absorbed experiment.  Decisions may chain
    (C into B, B into A) in any order; in a ring the experiment with the smallest
    id stays, and its own decision falls.
    """
    rounds = max(1, steps.count().bit_length())
    ends, ended = _jumped(steps, rounds)
    if ended:
        return ends
    # After so many steps a chain has left the absorbed experiments, unless it runs in a ring.
    ring = ends.join(steps.select(F.col("absorbed_id").alias("experiment_id")), on="experiment_id", how="left_semi").select("experiment_id").distinct()
    if not ring.limit(1).count():
        return ends
    around = steps.join(ring.withColumnRenamed("experiment_id", "absorbed_id"), on="absorbed_id", how="left_semi").select(
        F.col("absorbed_id").alias("node"), F.col("experiment_id").alias("next"), F.least("absorbed_id", "experiment_id").alias("least")
    )
    for number in range(1, rounds + 1):
        onward = around.select(F.col("node").alias("next"), F.col("next").alias("__next"), F.col("least").alias("__least"))
        around = _cut_round(around.join(onward, on="next").select("node", F.col("__next").alias("next"), F.least("least", "__least").alias("least")), number)
    stay = around.where(F.col("node") == F.col("least")).select(F.col("node").alias("absorbed_id"))
    ends, _ = _jumped(steps.join(stay, on="absorbed_id", how="left_anti"), rounds)
    return ends


def _merge_reviewed(located: DataFrame, reviewed: DataFrame) -> DataFrame:
    """(absorbed_id, experiment_id, raw_stem): every absorbed experiment with the one that finally holds its raw files.

    Of several decisions that absorb one experiment the first by stems counts.
    """
    decided = cut_lineage(_decided(located, cut_lineage(reviewed.select("processed_stem", "raw_stem"))))
    first = decided.groupBy("absorbed_id").agg(F.min(F.struct("processed_stem", "raw_stem", "experiment_id")).alias("d"))
    steps = cut_lineage(first.select("absorbed_id", F.col("d.experiment_id").alias("experiment_id")))
    stems = first.select("absorbed_id", F.col("d.raw_stem").alias("raw_stem"))
    return cut_lineage(final_experiments(steps).join(stems, on="absorbed_id"))


def role_counts(files: DataFrame) -> DataFrame:
    """experiment_id and the number of its files in each role."""
    of = lambda role: F.sum(F.when(F.col("role") == role, 1).otherwise(0)).alias(f"n_{role}")
    return files.groupBy("experiment_id").agg(*[of(r) for r in ROLE_PRIORITY])


def _name_unresolved(groups: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """Add the warning of unresolved groups, naming their paths.

    Groups beyond ``NAME_LIMIT`` files state the count; their paths are the file
    rows flagged ``unresolved``, so nothing is lost and no cell grows unbounded.
    """
    n_files = F.col("n_raw") + F.col("n_processed") + F.col("n_figure") + F.col("n_intermediate")
    counted = groups.withColumn("__n", n_files)
    small = counted.where(F.col("unresolved") & (F.col("__n") <= NAME_LIMIT)).select(*keys)
    named = (
        files.where(F.col("unresolved"))
        .join(small, on=keys, how="left_semi")
        .groupBy(*keys)
        .agg(F.array_join(F.array_sort(F.collect_set("relative_path")), "; ").alias("__paths"))
    )
    told = F.coalesce("__paths", F.concat(F.col("__n").cast("string"), F.lit(" files")))
    note = F.when(F.col("unresolved"), F.concat(F.lit(f"{UNRESOLVED_WARNING}: "), told))
    return counted.join(named, on=keys, how="left").withColumn("unresolved_note", note).drop("__n", "__paths")


def derive_experiments(devices: DataFrame, artifacts: DataFrame, reviewed: DataFrame | None = None, plain: Linked | None = None) -> Linked:
    """Derived experiments with metadata, and their files with roles.

    ``plain`` is the result for the same tables without decisions, where a caller
    made it to find the decisions; they are then applied to it.
    """
    if plain is None:
        plain = _derived(devices, artifacts)
    return plain if reviewed is None else _reviewed(plain, reviewed)


def _derived(devices: DataFrame, artifacts: DataFrame) -> Linked:
    # Each result feeds several later plans; stored once instead of being derived again.
    located = cut_lineage(data_files(devices, artifacts))
    files = cut_lineage(best_roles(canonical_stems(located)))
    keys = ["device_id", "unresolved", "canonical"]
    figure = F.col("role") == "figure"
    variants = {
        f"figure_{name}": F.when(figure & F.col("stem").endswith(suffix), F.col("relative_path"))
        for name, suffix in FIGURE_VARIANTS.items()
    }
    minima = {"first_path": F.col("relative_path"), "local_device_id": F.col("local_device_id")}
    groups = merge_variants(group_variants(with_readings(files), keys, minima, variants), warn_figures=False)
    numbered = number_experiments(_name_unresolved(groups, files, keys))
    ids_only = numbered.select("device_id", "unresolved", "canonical", "ordinal", "experiment_id")
    placed = files.join(ids_only, on=keys).select("device_id", "ordinal", *FILE_COLUMNS)
    experiments = numbered.select(
        "experiment_id",
        "device_id",
        paths.first_component(F.col("first_path")).alias("directory_context"),
        "ordinal",
        "canonical",
        F.coalesce("local_device_id", "device_id").alias("sample_id"),
        *[c for c in numbered.columns if c in METADATA_FIELDS and c != "sample_id"],
        "fixed_top_gate_V", "active_gate_configuration", "bias_start_V", "bias_stop_V", "back_gate_topology",
        "fixed_gate_values", "gate_constraints", "electrical_connections",
        "figure_linear", "figure_log",
        "n_raw", "n_processed", "n_figure", "n_intermediate",
        F.array_compact(F.array_append("warnings", F.col("unresolved_note"))).alias("warnings"),
        F.lit(0.0).alias("confidence"),
        F.col("unresolved").alias("needs_review"),
        F.lit("unknown").alias("review_state"),
        F.lit(PARSER_VERSION).alias("parser_version"),
    )
    schema = "absorbed_id string, experiment_id string, raw_stem string"
    return Linked(experiments, placed.select(*FILE_COLUMNS), devices.sparkSession.createDataFrame([], schema), placed)


def _reviewed(plain: Linked, reviewed: DataFrame) -> Linked:
    """``plain`` with the files and experiments that ``reviewed`` decisions move and absorb."""
    experiments = plain.experiments
    placed = cut_lineage(plain.placed)
    file_rows = placed.select(*FILE_COLUMNS)
    merge = _merge_reviewed(placed, reviewed)
    gone = merge.select("absorbed_id", "experiment_id")
    moved = (
        file_rows.where(F.col("role") == "raw")
        .withColumnRenamed("experiment_id", "absorbed_id")
        .join(gone, on="absorbed_id")
        .select(*file_rows.columns)
    )
    lost = gone.select(F.col("absorbed_id").alias("experiment_id"))
    held = cut_lineage(file_rows.join(lost, on="experiment_id", how="left_anti").unionByName(moved).distinct())
    # Experiments that took files in are counted again; the others keep their figures.
    counts = [f"n_{r}" for r in ROLE_PRIORITY]
    kept = gone.select("experiment_id").distinct()
    again = role_counts(held.join(kept, on="experiment_id", how="left_semi")).select(
        "experiment_id", *[F.col(c).alias(f"__{c}") for c in counts], F.lit(True).alias("__kept")
    )
    accepted = F.coalesce("__kept", F.lit(False))
    remaining = experiments.join(lost, on="experiment_id", how="left_anti").join(again, on="experiment_id", how="left")
    remaining = (
        remaining.withColumns({c: F.coalesce(f"__{c}", c) for c in counts})
        .withColumn("needs_review", F.col("needs_review") & ~accepted)
        .withColumn("review_state", F.when(accepted, "accepted").otherwise(F.col("review_state")))
        .select(*experiments.columns)
    )
    return Linked(remaining, held, merge)


def measured_on_edges(experiments: DataFrame) -> DataFrame:
    return with_relationship_id(
        experiments.select(
            F.lit("experiment").alias("source_type"),
            F.col("experiment_id").alias("source_id"),
            F.lit("measured_on").alias("predicate"),
            F.lit("device").alias("target_type"),
            F.col("device_id").alias("target_id"),
            F.col("directory_context").alias("provenance_source"),
            F.lit("unknown").alias("review_state"),
        )
    )


def _claim(df: DataFrame, field: str, value: Column, source_type: str, reference: Column, method: str, evidence: Column, status: str) -> DataFrame:
    return df.select(
        F.lit("experiment").alias("subject_type"),
        F.col("experiment_id").alias("subject_id"),
        F.lit(field).alias("field"),
        value.alias("value_json"),
        F.lit(source_type).alias("source_type"),
        reference.alias("source_reference"),
        F.lit(method).alias("extraction_method"),
        F.lit(None).cast("double").alias("confidence"),
        F.lit("device_linkage").alias("category"),
        evidence.alias("evidence"),
        F.lit(status).alias("review_status"),
        F.lit(None).cast("string").alias("reviewed_value_json"),
    )


def measured_on_claims(experiments: DataFrame) -> DataFrame:
    value = F.to_json(F.struct("device_id", "directory_context"))
    return _claim(
        experiments, MEASURED_ON_FIELD, value, "storage_directory", F.col("directory_context"),
        "device_directory_context", F.array().cast("array<string>"), "unknown",
    )


def reviewed_claims(linked: Linked, reviewed: DataFrame) -> DataFrame:
    """One accepted claim per adjudicated raw stem, on the experiment that now holds it.

    ``reviewed`` carries ``source_reference`` and ``evidence`` next to the stems.
    """
    raw = linked.files.where(F.col("role") == "raw").withColumn("raw_stem", F.col("stem"))
    first = raw.join(reviewed, on="raw_stem").groupBy("processed_stem", "raw_stem").agg(
        F.min(F.struct("relative_path", "storage_source_id", "experiment_id", "source_reference", "evidence")).alias("f")
    )
    owned = first.select("*", "f.experiment_id", "f.source_reference", "f.evidence").join(
        linked.experiments.select("experiment_id", "device_id"), on="experiment_id"
    )
    value = F.to_json(F.struct("device_id", "experiment_id", F.col("f.relative_path").alias("raw_relative_path")))
    return _claim(
        owned, REVIEWED_FIELD, value, "human_review", F.col("source_reference"), "human_reviewed_match", F.col("evidence"), "accepted",
    )


def _figure_parents(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(figure with its processed parent, figures without one).

    The parent has the figure's stem, else the stem before ``_linear`` / ``_log``
    of a ``_PL_`` figure; of several processed files with that stem the last path counts.
    """
    processed = files.where(F.col("role") == "processed").groupBy("experiment_id", "stem").agg(
        F.max_by("file_id", F.struct("relative_path", "storage_source_id")).alias("parent_id")
    )
    figures = files.where(F.col("role") == "figure").select("experiment_id", F.col("file_id").alias("figure_id"), "stem")
    plain = F.regexp_replace("stem", "(?<=_PL)_(?:linear|log)$", "")
    wanted = figures.select(
        "experiment_id", "figure_id",
        F.posexplode(F.array_distinct(F.array(F.col("stem"), plain))).alias("rank", "stem"),
    )
    hits = wanted.join(processed, on=["experiment_id", "stem"]).groupBy("experiment_id", "figure_id").agg(
        F.min_by("parent_id", "rank").alias("parent_id")
    )
    orphans = figures.select("experiment_id", "figure_id").join(hits, on=["experiment_id", "figure_id"], how="left_anti")
    return hits, orphans


def derivation_members(linked: Linked) -> DataFrame:
    """(experiment_id, side, file_id): the files of each experiment that feed, and those that are fed.

    By definition every raw file of an experiment feeds every processed file and
    every figure without a parent.  One row a file says so at every size; the pairs
    themselves are made by ``lineage.expand_members`` for the files somebody names.
    """
    files = with_file_id(linked.files)
    _, orphans = _figure_parents(files)
    raw = files.where(F.col("role") == "raw").select("experiment_id", F.lit(UPSTREAM).alias("side"), "file_id")
    fed = files.where(F.col("role") == "processed").select("experiment_id", F.lit(DOWNSTREAM).alias("side"), "file_id").unionByName(
        orphans.select("experiment_id", F.lit(DOWNSTREAM).alias("side"), F.col("figure_id").alias("file_id"))
    )
    rows = raw.unionByName(fed).distinct()
    sides = rows.groupBy("experiment_id").agg(F.min("side").alias("low"), F.max("side").alias("high")).where("low <> high")
    return rows.join(sides.select("experiment_id"), on="experiment_id", how="left_semi")


def parent_edges(files: DataFrame) -> DataFrame:
    """``derived_from`` edges from processed files to the figures drawn from them, in experiments with raw files.

    ``files`` are rows (experiment_id, role, storage_source_id, relative_path, stem).
    """
    files = with_file_id(files)
    hits, _ = _figure_parents(files)
    owners = files.where(F.col("role") == "raw").select("experiment_id").distinct()
    drawn = hits.join(owners, on="experiment_id", how="left_semi")
    return pair_edges(drawn.select(F.col("parent_id").alias("source_id"), F.col("figure_id").alias("target_id")))


def derived_from_edges(linked: Linked, files: DataFrame | None = None) -> DataFrame:
    """All ``derived_from`` file edges, or those with an end in ``files`` (file_id)."""
    parents = parent_edges(linked.files)
    if files is not None:
        ends = [F.col(f"{side}_id") == F.col("file_id") for side in ("source", "target")]
        named = files.select("file_id").distinct()
        parents = parents.join(named, ends[0], "left_semi").unionByName(parents.join(named, ends[1], "left_semi"))
    return parents.unionByName(expand_members(derivation_members(linked), files)).dropDuplicates(["relationship_id"])


def linkage_counts(experiments: DataFrame, relationships: DataFrame) -> DataFrame:
    """Per-prefix experiment counts and per-predicate edge counts as (metric, n)."""
    prefix = F.concat(F.regexp_extract("experiment_id", "^(.*)-[^-]*$", 1), F.lit("_experiments"))
    by_prefix = experiments.groupBy(prefix.alias("metric")).agg(F.count(F.lit(1)).alias("n"))
    by_predicate = relationships.groupBy(F.concat(F.col("predicate"), F.lit("_relationships")).alias("metric")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return by_prefix.unionByName(by_predicate)
