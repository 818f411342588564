"""File listing -> experiment proposals, their files, lineage and provenance.

Results stay in long form (one row per file, edge or provenance entry) keyed by
``(scope..., group_key)``.  Nothing collects the files of a group, so one group
may hold any share of the listing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import paths
from cairn.functions.binding import computed
from cairn.functions.filename import METADATA_FIELDS
from cairn.functions.gates import ELECTRICAL_SCALARS
from cairn.functions.registry import FeatureRegistry
from cairn.operators.merging import (
    ROLES,
    confidence,
    group_variants,
    merge_variants,
    with_features,
)
from cairn.operators.ordering import position_within

# Derived-name rules and unresolved reasons.
AVERAGE_SUFFIX = r"_avg\d+_DR_R_Self$"
NO_PROCESSED = "no processed file with a known derivation"
NO_FIGURE = "no figure file with a known derivation"
AMBIGUOUS_PROCESSED = "ambiguous processed stem"
AMBIGUOUS_FIGURE = "ambiguous figure stem"
MULTIPLE_SAMPLES = "multiple sample identifiers detected; scan-level sample_id left unset"

@dataclass(frozen=True)
class Scan:
    """Result tables of one scan."""

    files: DataFrame
    proposals: DataFrame
    unclassified: DataFrame
    features: DataFrame | None = None


def classify(listing: DataFrame) -> DataFrame:
    """Add ``role`` and ``reason``; exactly one of them is null.

    The folder rules run once per file behind a barrier, so the filters on role
    and reason that follow compare stored values.
    """
    path, ext = F.col("relative_path"), F.col("__ext")
    read = computed(
        listing, F.struct(paths.suffix(path).alias("__ext"), paths.scan_role(path).alias("__role"))
    )
    supported = ext.isin(*paths.SCAN_EXTENSIONS)
    reason = F.when(~supported, paths.unsupported_reason(path, ext)).when(
        F.col("__role").isNull(), paths.outside_reason(path)
    )
    return read.select(
        *listing.columns, F.when(supported, F.col("__role")).alias("role"), reason.alias("reason")
    )


def classified_files(listing: DataFrame) -> DataFrame:
    """Classified files with stem, features and grouping key."""
    kept = classify(listing).where(F.col("role").isNotNull()).drop("reason")
    return with_features(kept.withColumn("stem", paths.stem(F.col("relative_path"))))


def unclassified_files(listing: DataFrame) -> DataFrame:
    return classify(listing).where(F.col("role").isNull()).drop("role")


def experiment_groups(files: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """One merged record per group: metadata, role counts, warnings, confidence."""
    merged = merge_variants(group_variants(files, [*scope, "group_key"]))
    return merged.withColumn("confidence", confidence(F.col("n_raw"), F.col("n_processed")))


def scan(listing: DataFrame, scope: Sequence[str] = (), features: FeatureRegistry | None = None) -> Scan:
    """Classify, group and merge a listing (``relative_path`` plus scope columns).

    Registered features become columns of ``files`` and, merged per group, rows of
    ``features``.
    """
    files = classified_files(listing)
    own = () if features is None else features.names()
    taken = sorted({*scope, "group_key", "role", "relative_path", "stem"} & set(own))
    if taken:
        raise ValueError(f"feature names clash with scan columns: {', '.join(taken)}")
    named = files.select(*scope, "group_key", "role", "relative_path", "stem")
    if features is not None:
        named = features.apply(named)
    return Scan(
        files=named,
        proposals=experiment_groups(files, scope),
        unclassified=unclassified_files(listing),
        features=group_features(named, own, scope) if own else None,
    )


def group_features(files: DataFrame, names: Sequence[str], scope: Sequence[str] = ()) -> DataFrame:
    """(scope, group_key, feature, value, warning): one row per group and feature read in it.

    Values are reduced to the distinct ones before they are merged.  As for the
    built-in fields a value is kept when it is the only one; otherwise it is null and
    the warning tells how many there are and the first and last of them.
    """
    keys = [*scope, "group_key", "feature"]
    read = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("string").alias("value")) for n in names])
    seen = files.select(*scope, "group_key", F.inline(read)).where("value IS NOT NULL").distinct()
    merged = seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    told = F.concat(F.lit("conflicting "), F.col("feature"), F.lit(" values: "), F.col("n").cast("string"), F.lit(" from "), F.col("low"), F.lit(" to "), F.col("high"))
    return merged.select(*keys, F.when(F.col("n") == 1, F.col("low")).alias("value"), F.when(F.col("n") > 1, told).alias("warning"))


def scan_sample(proposals: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Scan-level sample id: kept when unique, otherwise null with a warning."""
    seen = F.when(F.col("sample_id") != "", F.col("sample_id"))
    low, high = F.min(seen), F.max(seen)
    return (
        proposals.groupBy(*scope)
        .agg(low.alias("__low"), high.alias("__high"))
        .select(
            *scope,
            F.when(F.col("__low") == F.col("__high"), F.col("__low")).alias("sample_id"),
            F.when(F.col("__low") != F.col("__high"), F.lit(MULTIPLE_SAMPLES)).alias("warning"),
        )
    )


def _by_stem(files: DataFrame, role: str, keys: Sequence[str]) -> DataFrame:
    return (
        files.where(F.col("role") == role)
        .groupBy(*keys, "stem")
        .agg(F.count(F.lit(1)).alias("n_candidates"), F.min("relative_path").alias("first_candidate"))
    )


def _parents(stem: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Upstream stems a derived stem may come from (itself included)."""
    stripped = [
        F.when(stem.rlike(pattern), F.regexp_replace(stem, pattern, "")) for _, pattern in rules
    ]
    return F.array_compact(F.array(stem, *stripped))


def _link(
    files: DataFrame,
    keys: Sequence[str],
    upstream: str,
    downstream: str,
    rules: Sequence[tuple[str, str]],
) -> DataFrame:
    """Each upstream file with every downstream stem a rule connects it to.

    The rule is turned around: a downstream stem yields its possible upstream
    stems, so the match is an equality join instead of a pairwise test.
    """
    down = _by_stem(files, downstream, keys)
    candidates = down.select(
        *keys,
        F.col("stem").alias("target_stem"),
        "n_candidates",
        "first_candidate",
        F.explode(_parents(F.col("stem"), rules)).alias("stem"),
    )
    up = files.where(F.col("role") == upstream).select(*keys, "stem", F.col("relative_path").alias("source"))
    return up.join(candidates, on=[*keys, "stem"], how="left")


RAW_RULES = (("pl", "(?<=.)_PL$"), ("avg", AVERAGE_SUFFIX))
FIGURE_RULES = (("linear", "(?<=.)_linear$"), ("log", "(?<=.)_log$"))


def _split_links(
    linked: DataFrame, keys: Sequence[str], relation: str, roles: tuple[str, str], ambiguous: str, missing: str
) -> tuple[DataFrame, DataFrame]:
    edges = linked.where(F.col("n_candidates") == 1).select(
        *keys, "source", F.col("first_candidate").alias("target"), F.lit(relation).alias("relation")
    )
    unresolved = linked.where(F.col("n_candidates").isNull() | (F.col("n_candidates") > 1)).select(
        *keys,
        F.lit(roles[0]).alias("source_role"),
        "source",
        F.lit(roles[1]).alias("target_role"),
        F.when(F.col("n_candidates").isNull(), missing).otherwise(ambiguous).alias("reason"),
        "target_stem",
        "n_candidates",
    )
    return edges, unresolved


def raw_links(files: DataFrame, scope: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """raw -> processed edges and unresolved raw files.

    A raw file without a match counts as unresolved only where its group has
    processed files at all.
    """
    keys = [*scope, "group_key"]
    linked = _link(files, keys, "raw", "processed", RAW_RULES)
    edges, unresolved = _split_links(
        linked, keys, "derived_from", ("raw", "processed"), AMBIGUOUS_PROCESSED, NO_PROCESSED
    )
    with_processed = files.where(F.col("role") == "processed").select(*keys).distinct()
    return edges, unresolved.join(with_processed, on=keys, how="left_semi")


def figure_links(files: DataFrame, scope: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """processed -> figure edges and processed files without a figure."""
    keys = [*scope, "group_key"]
    linked = _link(files, keys, "processed", "figure", FIGURE_RULES)
    return _split_links(
        linked, keys, "visualization_of", ("processed", "figure"), AMBIGUOUS_FIGURE, NO_FIGURE
    )


def lineage(files: DataFrame, scope: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """All lineage edges and all unresolved relationships of a scan."""
    raw_edges, raw_open = raw_links(files, scope)
    figure_edges, figure_open = figure_links(files, scope)
    return raw_edges.unionByName(figure_edges), raw_open.unionByName(figure_open)


def unresolved_candidates(files: DataFrame, unresolved: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Unresolved relationships with every candidate by name, one row each in path order.

    A file that no rule connects to anything keeps one row with a null candidate;
    an ambiguous stem has as many rows as files share it.
    """
    keys = [*scope, "group_key"]
    match = [*keys, "target_role", "target_stem"]
    known = files.select(*keys, F.col("role").alias("target_role"), F.col("stem").alias("target_stem"), F.col("relative_path").alias("candidate"))
    named = unresolved.drop("n_candidates")
    several = named.where(F.col("target_stem").isNotNull()).join(known, on=match)
    placed = position_within(several, [*match, "source_role", "source"], ["candidate"])
    none = named.where(F.col("target_stem").isNull())
    columns = [*keys, "source_role", "source", "target_role", "reason", "target_stem", "ordinal", "candidate"]
    return placed.select(*columns).unionByName(
        none.withColumns({"ordinal": F.lit(None).cast("long"), "candidate": F.lit(None).cast("string")}).select(*columns)
    )


def import_proposals(result: Scan, unresolved: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Proposals with ``n_unresolved`` and ``needs_review``."""
    keys = [*scope, "group_key"]
    counts = unresolved.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_unresolved"))
    joined = result.proposals.join(counts, on=keys, how="left").withColumn(
        "n_unresolved", F.coalesce("n_unresolved", F.lit(0))
    )
    return joined.withColumn(
        "needs_review", (F.size("warnings") > 0) | (F.col("n_unresolved") > 0)
    ).withColumn("provenance_source", F.coalesce("first_raw", "first_processed", "first_figure"))


def provenance(proposals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per populated metadata field, numbered in recording order."""
    scalars = (*[f for f in METADATA_FIELDS if f != "rotations_deg"], *ELECTRICAL_SCALARS)

    def scalar_json(name: str) -> Column:
        column = F.col(name)
        wrapped = F.to_json(F.array(column))
        return F.when(column.isNotNull(), F.regexp_extract(wrapped, r"(?s)^\[(.*)\]$", 1))

    def list_json(name: str, value: Column) -> Column:
        return F.when(F.size(name) > 0, F.to_json(value))

    constraint_json = F.transform(
        "gate_constraints",
        lambda c: F.struct(
            F.map_from_entries(
                F.transform(c["coefficients"], lambda x: F.struct(x["gate"], x["value"]))
            ).alias("coefficients"),
            c["control_mode"].alias("control_mode"),
            c["raw_expression"].alias("raw_expression"),
            c["sweep_direction"].alias("sweep_direction"),
        ),
    )
    wire_json = F.transform(
        "electrical_connections",
        lambda c: F.struct(
            c["nodes"].alias("nodes"), c["raw_expression"].alias("raw_expression"),
            c["source_role"].alias("source_role"), c["type"].alias("type"),
        ),
    )
    fixed_json = F.map_from_entries(
        F.transform("fixed_gate_values", lambda x: F.struct(x["gate"], x["value"]))
    )
    keep_null = {"ignoreNullFields": "false"}
    entries = [(name, scalar_json(name)) for name in scalars] + [
        ("rotations_deg", list_json("rotations_deg", F.col("rotations_deg"))),
        ("fixed_gate_values", F.when(F.size("fixed_gate_values") > 0, F.to_json(fixed_json))),
        ("gate_constraints", F.when(F.size("gate_constraints") > 0, F.to_json(constraint_json, keep_null))),
        (
            "electrical_connections",
            F.when(F.size("electrical_connections") > 0, F.to_json(wire_json, keep_null)),
        ),
    ]
    filled = F.filter(
        F.array(*[F.struct(F.lit(n).alias("field"), v.alias("value_json")) for n, v in entries]),
        lambda e: e["value_json"].isNotNull(),
    )
    return proposals.select(*keys, "provenance_source", F.posexplode(filled).alias("ordinal", "e")).select(
        *keys,
        "ordinal",
        "e.field",
        "e.value_json",
        F.lit("filename").alias("source_type"),
        F.col("provenance_source").alias("source"),
        F.lit("deterministic").alias("method"),
    )


def source_membership(files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Files of each proposal with the order they take in its archive job.

    ``(role_rank, relative_path)`` is that order; ranks follow raw, intermediate,
    processed, figure.
    """
    order = ("raw", "intermediate", "processed", "figure")
    rank = F.coalesce(*[F.when(F.col("role") == r, i) for i, r in enumerate(order)])
    return files.select(*keys, "role", "relative_path", rank.alias("role_rank")).distinct()


__all__ = [
    "ROLES", "METADATA_FIELDS", "Scan", "classify", "classified_files", "experiment_groups",
    "figure_links", "group_features", "import_proposals", "lineage", "provenance", "raw_links", "scan", "scan_sample",
    "source_membership", "unclassified_files", "unresolved_candidates",
]
