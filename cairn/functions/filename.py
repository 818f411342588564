"""Measurement metadata written into file names.

All features are native regular expressions over the stem: the scan of a large
listing needs no Python worker and keeps the regexes inside one projection.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions.binding import let
from cairn.functions.text import blank_to_null

# Token patterns.  They work on the normalized stem, except the
# measurement point, which keeps the original spelling.
SAMPLE = r"(?<![a-z0-9])(?:d|yz)(?:\d{2,4})(?![a-z0-9])"
TEMPERATURE = r"(?<![a-z0-9])(\d+(?:\.\d+)?)k(?=(?:pl|ref)?(?![a-z0-9]))"
FIELD = r"(?<![a-z0-9])(\d+(?:\.\d+)?)t(?=p\d|[^a-z0-9])"
EXCITATION = r"(?<![a-z0-9])(\d+(?:\.\d+)?)nm(?![a-z])"
LUMINESCENCE = r"(?:(?<![a-z0-9])|(?<=k))pl(?![a-z0-9])"
ABSORPTION = (
    r"(?:(?:(?<![a-z0-9])|(?<=k))ref|(?<![a-z0-9])(?:dr_r|drr|absorb(?:ance|ption)?))"
    r"(?![a-z0-9])"
)
CENTER = r"(?<![a-z0-9])(\d+(?:[p.]\d+)?)nmc(?![a-z0-9])"
POWER = r"(\d+(?:[p.]\d+)?)uw(?![a-z])"
INTEGRATION = r"(?<![a-z0-9])(\d+(?:[p.]\d+)?)sx(\d+)(?![a-z0-9])"
GRATING = r"(?<![a-z0-9])(\d+)g(?![a-z0-9])"
ROTATION = r"(?<![a-z0-9])rot_?(\d+(?:[p.]\d+)?)deg(?![a-z])"
STAGE = r"(?<![a-z0-9])stage(\d+)(?![a-z0-9])"
POINT = r"(?i)(?:(?<![a-z0-9])|(?<=\dt))p(?:\d+[a-z0-9]*|[a-z]\d+|x)(?![a-z0-9])"

# Sample identifiers known under a second name.
SAMPLE_ALIASES = {"YZ356": "D356"}

# Whole-word role tokens ignored when stems are grouped.
ROLE_TOKENS = (
    "data", "dataset", "datasets", "fig", "figure", "figures", "final", "graph", "image",
    "img", "output", "plot", "plots", "proc", "process", "processed", "raw", "result", "results",
)
# Suffixes of derived files, open chain at the end of the stem.
DERIVED_SUFFIXES = r"(?:_(?:pl|linear|log|self|drr|dr_r|avg\d*))+$"

# Metadata columns in merge order; the electrical scalars follow in gates.py.
METADATA_FIELDS = (
    "sample_id", "temperature_K", "magnetic_field_T", "excitation_wavelength_nm",
    "measurement_type", "center_wavelength_nm", "integration_time_s", "averages",
    "excitation_power_uW", "grating_grooves_per_mm", "rotations_deg", "stage_position",
    "measurement_point_label",
)


def normalize_stem(stem: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(stem), "[^a-z0-9.]+", "_"), F.lit("_"))


def normalize_component(name: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))


def decimal(text: Column) -> Column:
    """Number in which ``p`` may stand for the decimal point; blank is no number and gives null."""
    return F.replace(text, F.lit("p"), F.lit(".")).try_cast("double")


def _holds(norm: Column, parts: Iterable[str]) -> Column:
    """Whether a stem has one of some plain texts, far cheaper than the regular expressions it spares."""
    return reduce(Column.__or__, [F.contains(norm, F.lit(part)) for part in parts])


def _marked(norm: Column, marker: str) -> Column:
    """Whether a digit stands before the marker, as in every token that the marker ends."""
    return F.contains(norm, F.lit(marker)) & _holds(norm, [digit + marker for digit in "0123456789"])


def _number(norm: Column, marker: str, pattern: str) -> Column:
    """Number of a token; stems without the token's marker skip the regular expression."""
    return F.when(_marked(norm, marker), decimal(F.regexp_extract(norm, pattern, 1)))


def _integer(marked: Column, norm: Column, pattern: str) -> Column:
    return F.when(marked, F.regexp_extract(norm, pattern, 1).try_cast("long"))


def sample_id(norm: Column) -> Column:
    def named(found: Column) -> Column:
        out = F.upper(blank_to_null(found))
        for alias, target in SAMPLE_ALIASES.items():
            out = F.when(F.upper(found) == alias, F.lit(target)).otherwise(out)
        return out

    return let(F.regexp_extract(norm, SAMPLE, 0), named)


def temperature(norm: Column) -> Column:
    return _number(norm, "k", TEMPERATURE)


def magnetic_field(norm: Column) -> Column:
    return _number(norm, "t", FIELD)


def excitation_wavelength(norm: Column) -> Column:
    return _number(norm, "nm", EXCITATION)


def measurement_type(norm: Column) -> Column:
    return F.when(_holds(norm, ["pl"]) & norm.rlike(LUMINESCENCE), "photoluminescence").when(
        _holds(norm, ["ref", "dr", "absorb"]) & norm.rlike(ABSORPTION), "absorption"
    )


def rotations(norm: Column) -> Column:
    """All rotation angles in order of appearance; null when there are none."""
    found = F.regexp_extract_all(norm, F.lit(ROTATION), F.lit(1))
    angles = let(found, lambda texts: F.when(F.size(texts) > 0, F.transform(texts, decimal)))
    return F.when(F.contains(norm, F.lit("deg")), angles)


def point_label(stem: Column) -> Column:
    return blank_to_null(F.regexp_extract(stem, POINT, 0))


def metadata_struct(stem: Column, norm: Column) -> Column:
    """The thirteen filename fields of one stem; ``norm`` is ``normalize_stem(stem)``.

    Bound as one unit: thirteen regular expressions unrolled into generated code
    would exceed the method size the JVM still compiles.  Inside the binding nothing
    shares what it repeats, so each expression is searched for in one place.
    """
    exposure = F.when(F.contains(norm, F.lit("sx")), F.regexp_extract(norm, INTEGRATION, 0))
    return let(
        F.struct(norm.alias("norm"), exposure.alias("exposure")),
        lambda bound: _fields(stem, bound["norm"], bound["exposure"]),
    )


def _fields(stem: Column, norm: Column, exposure: Column) -> Column:
    values = {
        "sample_id": sample_id(norm),
        "temperature_K": temperature(norm),
        "magnetic_field_T": magnetic_field(norm),
        "excitation_wavelength_nm": excitation_wavelength(norm),
        "measurement_type": measurement_type(norm),
        "center_wavelength_nm": _number(norm, "nmc", CENTER),
        "integration_time_s": decimal(F.substring_index(exposure, "sx", 1)),
        "averages": F.substring_index(exposure, "sx", -1).try_cast("long"),
        "excitation_power_uW": _number(norm, "uw", POWER),
        "grating_grooves_per_mm": _integer(_marked(norm, "g"), norm, GRATING),
        "rotations_deg": rotations(norm),
        "stage_position": _integer(_holds(norm, ["stage"]), norm, STAGE),
        "measurement_point_label": point_label(stem),
    }
    return F.struct(*[values[name].alias(name) for name in METADATA_FIELDS])


def group_core(norm: Column) -> Column:
    """Normalized stem without role tokens and derived suffixes (electrical part excluded)."""
    fenced = F.concat(F.lit("_"), norm, F.lit("_"))
    words = F.regexp_replace(fenced, f"(?<=_)(?:{'|'.join(ROLE_TOKENS)})_", "")
    return F.regexp_replace(F.btrim(words, F.lit("_")), DERIVED_SUFFIXES, "")
