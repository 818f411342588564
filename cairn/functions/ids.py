"""Deterministic identities.

File, relationship and device ids hash ASCII-escaped JSON; batch and preview ids
hash unescaped JSON.  Both are pure functions of their inputs, so a row has the
same id on any number of partitions and after any task retry.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions.text import label_slug, pad_number

# Control escapes that the JSON writer spells in upper-case hex.
UPPER_HEX_ESCAPES = (
    "\\u000B", "\\u000E", "\\u000F",
    "\\u001A", "\\u001B", "\\u001C", "\\u001D", "\\u001E", "\\u001F",
)

# Preview identity constants.
PREVIEW_GENERATOR = "artifact-preview-1"
PREVIEW_SCHEMA_VERSION = 1
PREVIEW_POLICY = "bounded-1"


def _escape_char(ch: Column) -> Column:
    code = F.ascii(ch)

    def unit(value: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(value), 4, "0")))

    astral = code - F.lit(65536)
    high = F.lit(55296) + F.shiftright(astral, 10)
    low = F.lit(56320) + astral.bitwiseAND(F.lit(1023))
    return (
        F.when(code < 127, ch)
        .when(code <= 65535, unit(code))
        .otherwise(F.concat(unit(high), unit(low)))
    )


def ascii_json(json_text: Column) -> Column:
    """Escape every character above ``~`` as ``\\uXXXX`` (surrogate pairs included)."""
    fixed = json_text
    for escape in UPPER_HEX_ESCAPES:
        fixed = F.replace(fixed, F.lit(escape), F.lit(escape[:2] + escape[2:].lower()))
    escaped = F.array_join(F.transform(F.split(fixed, ""), _escape_char), "")
    needs_work = json_text.rlike(r"[^ -~]|\\u00[01][0-9A-F]")
    return F.when(needs_work, escaped).otherwise(json_text)


def _array_digest(prefix: str, *parts: Column) -> Column:
    body = F.to_json(F.array(*[p.cast("string") for p in parts]))
    return F.concat(F.lit(prefix), F.sha2(ascii_json(body), 256))


def file_id(storage_source_id: Column, canonical_path: Column) -> Column:
    """Null when either half of the storage reference is null."""
    return F.when(
        storage_source_id.isNotNull() & canonical_path.isNotNull(),
        _array_digest("file-", storage_source_id, canonical_path),
    )


def relationship_id(
    source_type: Column,
    source_id: Column,
    predicate: Column,
    target_type: Column,
    target_id: Column,
    provenance_source: Column,
) -> Column:
    return _array_digest(
        "rel-", source_type, source_id, predicate, target_type, target_id, provenance_source
    )


def device_id(namespace: Column, local: Column) -> Column:
    """The one namespace whose ``D<digits>`` ids are already global keeps them as they are."""
    keeps = (namespace == "YZ") & local.rlike("^D[0-9]+$")
    return F.when(keeps, local).otherwise(_array_digest("dev-", namespace, local))


def joined_id(prefix: str, *parts: Column) -> Column:
    """Artifact and slide ids: digest of ``::``-joined parts."""
    return F.concat(F.lit(prefix + "-"), F.sha2(F.concat_ws("::", *parts), 256))


def artifact_id(relative_path: Column) -> Column:
    return joined_id("art", relative_path)


def slide_id(relative_path: Column, slide_index: Column) -> Column:
    return joined_id("slide", relative_path, pad_number(slide_index, 4))


def derived_experiment_id(device: Column, local: Column, ordinal: Column) -> Column:
    return F.concat(F.coalesce(local, device), F.lit("-"), pad_number(ordinal, 4))


def batch_id(number: Column, size: Column, label: Column, members: Column) -> Column:
    """``members`` is the ordered array of proposal ids of one batch (bounded by its size)."""
    identity = F.struct(
        number.cast("long").alias("batch_number"),
        size.cast("long").alias("batch_size"),
        label.cast("string").alias("dataset_label"),
        members.alias("proposals"),
    )
    body = F.to_json(identity, {"ignoreNullFields": "false"})
    digest = F.substring(F.sha2(body, 256), 1, 12)
    return F.concat(label_slug(label), F.lit("-batch-"), pad_number(number, 3), F.lit("-"), digest)


def preview_id(
    artifact: Column, storage_source_id: Column, relative_path: Column, size: Column, mtime_ns: Column
) -> Column:
    payload = F.struct(
        artifact.alias("artifact_id"),
        mtime_ns.cast("long").alias("catalog_mtime_ns"),
        size.cast("long").alias("catalog_size_bytes"),
        F.lit(PREVIEW_GENERATOR).alias("generator"),
        F.lit(PREVIEW_POLICY).alias("policy_version"),
        relative_path.alias("relative_path"),
        F.lit(PREVIEW_SCHEMA_VERSION).alias("schema_version"),
        storage_source_id.alias("storage_source_id"),
    )
    body = F.to_json(payload, {"ignoreNullFields": "false"})
    return F.sha2(F.concat(body, F.lit("\n")), 256)
