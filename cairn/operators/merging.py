"""Merge per-stem features of a group into one record.

Groups are reduced in two steps.  First to one row per distinct feature
combination (map-side combined, so a group with millions of files shrinks before
the shuffle), then to an array of those combinations.  The array is as long as a
group has *different* file name readings, never as long as it has files.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import gates
from cairn.functions.binding import computed, let
from cairn.functions.filename import METADATA_FIELDS, metadata_struct, normalize_stem
from cairn.functions.text import bracket_list, float_text, quoted

ROLES = ("raw", "processed", "figure", "intermediate")
FIGURES_ONLY = "figures found without associated raw or processed data"

_TEXT = {"sample_id", "measurement_type", "measurement_point_label", "active_gate_configuration", "back_gate_topology"}
_WHOLE = {"averages", "grating_grooves_per_mm", "stage_position"}


def with_features(df: DataFrame, stem: str = "stem") -> DataFrame:
    """Add ``meta``, ``electrical`` and ``group_key`` for the stem column.

    ``meta`` is a plain projection and is pruned where it is not needed; the key
    is computed behind a barrier so that joins on it never repeat the parsing.
    """
    keyed = computed(
        df.withColumn("__norm", normalize_stem(F.col(stem))),
        gates.electrical_and_key(F.col(stem), F.col("__norm")),
    )
    return keyed.withColumn("meta", metadata_struct(F.col(stem), F.col("__norm"))).drop("__norm")


def with_readings(df: DataFrame, stem: str = "stem") -> DataFrame:
    """Add ``meta`` and ``electrical`` only."""
    normed = df.withColumn("__norm", normalize_stem(F.col(stem)))
    read = computed(normed, F.struct(gates.electrical_reading(F.col(stem)).alias("electrical")))
    return read.withColumn("meta", metadata_struct(F.col(stem), F.col("__norm"))).drop("__norm")


def _spelling(field: str) -> Callable[[Column], Column]:
    if field in _TEXT:
        return quoted
    if field in _WHOLE:
        return lambda v: v.cast("string")
    if field == "rotations_deg":
        return lambda v: F.when(
            F.size(v) == 1, F.concat(F.lit("("), float_text(F.get(v, 0)), F.lit(",)"))
        ).otherwise(F.concat(F.lit("("), F.array_join(F.transform(v, float_text), ", "), F.lit(")")))
    return float_text


def conflict_note(field: str, values: Column) -> Column:
    """Warning for a field with several distinct values (``values`` sorted), else null."""
    return F.when(
        F.size(values) > 1,
        F.concat(
            F.lit(f"conflicting {field} values: "),
            bracket_list(F.transform(values, _spelling(field))),
        ),
    )


def unique_value(values: Column) -> Column:
    return F.when(F.size(values) == 1, F.get(values, 0))


def first_kept(items: Column, key: Callable[[Column], Column]) -> Column:
    """Drop later items whose key was seen before, keeping the order."""
    return let(
        items,
        lambda xs: let(
            F.transform(xs, key),
            lambda seen: F.filter(xs, lambda x, i: F.array_position(seen, key(x)) == i + 1),
        ),
    )


def group_variants(
    df: DataFrame,
    keys: Sequence[str],
    minima: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per key: ordered distinct feature readings plus role counts and firsts.

    Needs columns ``stem, role, relative_path, meta, electrical``.
    ``minima`` and ``maxima`` name further row expressions of which the smallest
    or largest is kept.
    """
    per_role = [
        agg
        for role in ROLES
        for agg in (
            F.sum(F.when(F.col("role") == role, 1).otherwise(0)).alias(f"n_{role}"),
            F.min(F.when(F.col("role") == role, F.col("relative_path"))).alias(f"first_{role}"),
        )
    ]
    minima, maxima = minima or {}, maxima or {}
    reduced = df.groupBy(*keys, "meta", "electrical").agg(
        F.min("stem").alias("stem"),
        *per_role,
        *[F.min(value).alias(name) for name, value in minima.items()],
        *[F.max(value).alias(name) for name, value in maxima.items()],
    )
    return reduced.groupBy(*keys).agg(
        F.array_sort(
            F.collect_list(F.struct(F.col("stem"), F.col("meta"), F.col("electrical")))
        ).alias("variants"),
        *[F.sum(f"n_{role}").alias(f"n_{role}") for role in ROLES],
        *[F.min(f"first_{role}").alias(f"first_{role}") for role in ROLES],
        *[F.min(name).alias(name) for name in minima],
        *[F.max(name).alias(name) for name in maxima],
    )


def merge_variants(grouped: DataFrame, warn_figures: bool = True) -> DataFrame:
    """Replace ``variants`` by merged metadata columns and ``warnings``.

    A scalar survives only when the group has exactly one distinct value;
    otherwise it is null and a warning lists the sorted values.  Constraints and
    connections are deduplicated, first occurrence in stem order kept.
    """
    variants = F.col("variants")

    def distinct_values(read: Callable[[Column], Column]) -> Column:
        found = F.filter(F.transform(variants, read), lambda v: v.isNotNull())
        return F.array_sort(F.array_distinct(found))

    def reader(part: str, field: str) -> Callable[[Column], Column]:
        return lambda v: v[part][field]

    readers = {f: reader("meta", f) for f in METADATA_FIELDS}
    readers |= {f: reader("electrical", f) for f in gates.ELECTRICAL_SCALARS}
    staged = grouped.withColumns({f"__v_{f}": distinct_values(r) for f, r in readers.items()})

    def flat(field: str, kind: str) -> Column:
        lists = F.transform(
            variants, lambda v: F.coalesce(v["electrical"][field], F.array().cast(kind))
        )
        return F.flatten(lists)

    constraints = first_kept(flat("gate_constraints", gates.CONSTRAINT_TYPE), gates.constraint_key)
    wires = first_kept(flat("electrical_connections", gates.CONNECTION_TYPE), gates.connection_key)
    fixed = F.transform(
        F.array_sort(F.array_distinct(flat("fixed_gates", "array<string>"))),
        lambda g: F.struct(g.alias("gate"), F.lit(0.0).alias("value")),
    )
    conflicts = [
        conflict_note(f, F.col(f"__v_{f}")) for f in (*METADATA_FIELDS, *gates.ELECTRICAL_SCALARS)
    ]
    split_at = len(METADATA_FIELDS)
    # Only the scan warns of lone figures; linkage derives experiments from figures, too.
    figures_only = F.when(
        F.lit(warn_figures) & (F.col("n_figure") > 0) & (F.col("n_raw") == 0) & (F.col("n_processed") == 0),
        F.lit(FIGURES_ONLY),
    )
    notes = F.concat(
        F.array(*conflicts[:split_at]),
        flat("notes", "array<string>"),
        F.array(*conflicts[split_at:]),
    )
    warnings = F.concat(
        F.array_distinct(F.array_compact(notes)), F.array_compact(F.array(figures_only))
    )
    return staged.withColumns(
        {
            **{f: unique_value(F.col(f"__v_{f}")) for f in readers},
            "fixed_gate_values": fixed,
            "gate_constraints": constraints,
            "electrical_connections": wires,
            "warnings": warnings,
        }
    ).drop("variants", *[f"__v_{f}" for f in readers])


def conflicts_by_key(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Long form of the conflict rule for any key: one row per (key, field) with several values.

    Distinct values are reduced before the grouping, so the collected list is
    the list the warning prints.
    """
    pairs = F.array(
        *[
            F.struct(
                F.lit(i).alias("rank"), F.lit(f).alias("field"), F.col(f).cast("string").alias("value"),
                _spelling(f)(F.col(f)).alias("shown"),
                (F.col(f).cast("double") if f not in _TEXT else F.lit(None).cast("double")).alias("number"),
            )
            for i, f in enumerate(fields)
        ]
    )
    long = (
        df.select(*keys, F.explode(pairs).alias("p"))
        .where(F.col("p.value").isNotNull())
        .select(*keys, "p.*")
        .distinct()
    )
    grouped = long.groupBy(*keys, "rank", "field").agg(
        F.count(F.lit(1)).alias("n_values"),
        F.array_sort(F.collect_list(F.struct("number", "value", "shown"))).alias("vs"),
    )
    return grouped.where(F.col("n_values") > 1).select(
        *keys,
        "field",
        "n_values",
        F.concat(
            F.lit("conflicting "), F.col("field"), F.lit(" values: "),
            bracket_list(F.transform("vs", lambda v: v["shown"])),
        ).alias("warning"),
    )


def confidence(raw: Column, processed: Column) -> Column:
    """Score from integer hundredths, so no float error can build up."""

    def points(present: Column, n: int) -> Column:
        return F.when(present, n).otherwise(0)

    total = (
        points(F.coalesce(F.col("sample_id"), F.lit("")) != "", 20)
        + points(F.coalesce(F.col("measurement_type"), F.lit("")) != "", 25)
        + points(F.col("temperature_K").isNotNull(), 10)
        + points(F.col("magnetic_field_T").isNotNull(), 10)
        + points(F.col("excitation_wavelength_nm").isNotNull(), 10)
        + points(raw > 0, 15)
        + points(processed > 0, 10)
    )
    return F.least(total, F.lit(100)) / F.lit(100.0)
