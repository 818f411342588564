"""Whole records: entities with their files and claims, lookups, enriched pages, typed claim values.

Two forms.  ``record_parts`` keeps every part of every record a row, for whole
catalogs: a record with a third of all claims stays spread.  ``nested_*`` packs
the parts of asked records into arrays; the asked ids are a page (at most
``MAX_LIMIT`` rows) or one id, so they go to the tasks and the part tables are
filtered by them before anything is grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import paths
from cairn.operators import lineage, retrieval
from cairn.operators.retrieval import MAX_LIMIT

# Kinds of JSON values, and two for what is no value.
NULL, BOOLEAN, NUMBER, STRING, ARRAY, OBJECT = "null", "boolean", "number", "string", "array", "object"
UNSET, INVALID = "unset", "invalid"

CLAIM_PARTS = (
    "ordinal", "field", "value_json", "source_type", "source_reference", "extraction_method", "confidence",
    "category", "evidence", "review_status", "reviewed_value_json",
)
FILE_PARTS = ("ordinal", "role", "storage_source_id", "relative_path")


# ---- typed values -------------------------------------------------------------------


def json_kind(text: Column) -> Column:
    """Kind of a JSON text: a missing text is ``unset``, a broken one ``invalid``.

    A JSON null is a value of its own (``null``), so a review that sets null
    differs from one that sets nothing.
    """
    value = F.try_parse_json(text)
    shape = F.schema_of_variant(value)
    return (
        F.when(text.isNull(), UNSET)
        .when(value.isNull(), INVALID)
        .when(shape == "VOID", NULL)
        .when(shape == "BOOLEAN", BOOLEAN)
        .when(shape == "STRING", STRING)
        .when(shape.startswith("ARRAY"), ARRAY)
        .when(shape.startswith("OBJECT"), OBJECT)
        .otherwise(NUMBER)
    )


def json_member(text: Column, path: str, kind: str) -> Column:
    """Typed member of a JSON text, null where it is absent or of another type."""
    return F.try_variant_get(F.try_parse_json(text), path, kind)


def canonical_json(text: Column) -> Column:
    """Spelling with sorted keys and no blanks, null for broken texts; equal for equal nested values."""
    return F.to_json(F.try_parse_json(text))


def same_value(left: Column, right: Column) -> Column:
    """Whether two JSON texts hold the same value: numbers by value, everything else by canonical spelling."""
    numbers = (json_kind(left) == NUMBER) & (json_kind(right) == NUMBER)
    return F.when(numbers, json_member(left, "$", "double") == json_member(right, "$", "double")).otherwise(
        F.coalesce(canonical_json(left) == canonical_json(right), F.lit(False))
    )


def typed_values(claims: DataFrame) -> DataFrame:
    """Claims with both value texts parsed back: kind, scalar by type, canonical text; ``effective_json`` is the reviewed value if one is set."""
    out = claims.withColumn("effective_json", F.coalesce("reviewed_value_json", "value_json"))
    for name in ("value", "reviewed_value", "effective"):
        text = F.col(f"{name}_json")
        kind = json_kind(text)
        out = out.withColumns(
            {
                f"{name}_kind": kind,
                f"{name}_number": F.when(kind == NUMBER, json_member(text, "$", "double")),
                f"{name}_text": F.when(kind == STRING, json_member(text, "$", "string")),
                f"{name}_flag": F.when(kind == BOOLEAN, json_member(text, "$", "boolean")),
                f"{name}_canonical": canonical_json(text),
            }
        )
    return out


# ---- parts --------------------------------------------------------------------------


def _packed(names: tuple[str, ...]) -> Column:
    return F.struct(*names)


def record_parts(entities: DataFrame, key: str, entity_type: str, claims: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(entity_id, part, ordinal, file, claim): one ``entity`` row per entity, one row per file and claim.

    Files and claims of unknown entities are left out; entities without any keep
    their own row.
    """
    null_file = F.lit(None).cast("struct<ordinal:bigint,role:string,storage_source_id:string,relative_path:string>")
    packed_claims = claims.where(F.col("subject_type") == entity_type).select(F.col("subject_id").alias("entity_id"), "ordinal", _packed(CLAIM_PARTS).alias("claim"))
    null_claim = F.lit(None).cast(packed_claims.schema["claim"].dataType)
    known = entities.select(F.col(key).alias("entity_id"))
    own = known.select("entity_id", F.lit("entity").alias("part"), F.lit(None).cast("long").alias("ordinal"), null_file.alias("file"), null_claim.alias("claim"))
    of_claims = packed_claims.join(known, on="entity_id", how="left_semi").select("entity_id", F.lit("claim").alias("part"), "ordinal", null_file.alias("file"), "claim")
    out = own.unionByName(of_claims)
    if files is None:
        return out
    packed = files.select(F.col(key).alias("entity_id"), "ordinal", _packed(FILE_PARTS).alias("file"))
    of_files = packed.join(known, on="entity_id", how="left_semi").select("entity_id", F.lit("file").alias("part"), "ordinal", "file", null_claim.alias("claim"))
    return out.unionByName(of_files)


# ---- lookups ------------------------------------------------------------------------


def lookup(table: DataFrame, key: str, value: str) -> DataFrame:
    """Rows of one id; an equality that reaches the scan, where files are clustered by the id."""
    if not isinstance(value, str) or not value:
        raise ValueError(f"{key} must be a non-empty string")
    return table.where(F.col(key) == value)


def lookup_device(devices: DataFrame, maker_namespace: str, local_device_id: str) -> DataFrame:
    """The device of a qualified identity."""
    return lookup(lookup(devices, "maker_namespace", maker_namespace), "local_device_id", local_device_id)


def lookup_pairs(devices: DataFrame, asked: DataFrame) -> DataFrame:
    """Distinct asked identities (maker_namespace, local_device_id) with their device, null where there is none."""
    own = devices.where(F.col("maker_namespace").isNotNull() & F.col("local_device_id").isNotNull())
    pair = ["maker_namespace", "local_device_id"]
    return asked.select(*pair).distinct().join(own.select(*pair, "device_id"), on=pair, how="left")


# ---- nested records -----------------------------------------------------------------


def _ids(page_rows: DataFrame, key: str) -> DataFrame:
    return F.broadcast(page_rows.select(F.col(key).alias("entity_id")).limit(MAX_LIMIT))


def _nested(parts: DataFrame, page_rows: DataFrame, key: str, name: str, columns: tuple[str, ...]) -> DataFrame:
    """``page_rows`` with an array ``name`` of the parts (entity_id, columns) of each row, sorted by ``columns``."""
    chosen = parts.join(_ids(page_rows, key), on="entity_id", how="left_semi")
    packed = chosen.groupBy(F.col("entity_id").alias(key)).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    joined = page_rows.join(packed, on=key, how="left")
    empty = F.array().cast(packed.schema[name].dataType)
    return joined.withColumn(name, F.coalesce(F.col(name), empty))


def with_claims(page_rows: DataFrame, key: str, entity_type: str, claims: DataFrame) -> DataFrame:
    """A page with the claims of each row in recording order."""
    own = claims.where(F.col("subject_type") == entity_type).withColumn("entity_id", F.col("subject_id"))
    return _nested(own, page_rows, key, "claims", CLAIM_PARTS)


def with_files(page_rows: DataFrame, experiment_files: DataFrame) -> DataFrame:
    """A page of experiments with the files of each in stored order."""
    own = experiment_files.withColumn("entity_id", F.col("experiment_id"))
    return _nested(own, page_rows, "experiment_id", "files", FILE_PARTS)


def nested_experiments(page_rows: DataFrame, experiment_files: DataFrame, claims: DataFrame) -> DataFrame:
    return with_claims(with_files(page_rows, experiment_files), "experiment_id", "experiment", claims)


def nested_devices(page_rows: DataFrame, claims: DataFrame) -> DataFrame:
    return with_claims(page_rows, "device_id", "device", claims)


def nested_artifacts(page_rows: DataFrame, claims: DataFrame) -> DataFrame:
    return with_claims(retrieval.project_artifacts(page_rows), "artifact_id", "artifact", claims)


# ---- enriched pages -----------------------------------------------------------------


def enrich_artifacts(page_rows: DataFrame, relationships: DataFrame, references: DataFrame) -> DataFrame:
    """A page of artifacts with file name and ``derived_from`` pairs, sorted; empty where none resolves."""
    pairs = lineage.artifact_derivations(page_rows, relationships, references, few=True)
    edges = pairs.select(F.col("artifact_id").alias("entity_id"), "source", "target", F.lit("derived_from").alias("relation"))
    named = page_rows.withColumn("filename", paths.file_name(F.col("relative_path")))
    return _nested(edges, named, "artifact_id", "derived_from", ("source", "target", "relation"))


def enrich_experiments(
    page_rows: DataFrame, experiment_files: DataFrame, relationships: DataFrame, claims: DataFrame
) -> DataFrame:
    """A page of experiments with files, lineage, ``measured_on`` and ``review_evidence``.

    Every part table is reduced to the page before it is grouped.  Evidence is
    null where no reviewed match exists.
    """
    ids = _ids(page_rows, "experiment_id")
    own_edges = lineage.edges_touching(
        relationships.where(F.col("predicate") == "measured_on"), ids.select(F.lit("experiment").alias("entity_type"), "entity_id")
    ).select(*relationships.columns).distinct()
    own_claims = claims.join(ids.withColumnRenamed("entity_id", "subject_id"), on="subject_id", how="left_semi")
    own_files = experiment_files.join(ids.withColumnRenamed("entity_id", "experiment_id"), on="experiment_id", how="left_semi")
    out = with_files(retrieval.enrich_experiments(page_rows, own_edges, own_claims), own_files)
    evidence = lineage.review_evidence(own_claims).withColumnRenamed("experiment_id", "entity_id")
    columns = ("ordinal", "field", "value_json", "source_type", "source_reference", "extraction_method", "category", "evidence", "review_status")
    out = _nested(evidence, out, "experiment_id", "review_evidence", columns)
    out = out.withColumn("review_evidence", F.when(F.size("review_evidence") > 0, F.col("review_evidence")))
    edges = lineage.experiment_lineage(own_files, relationships).withColumnRenamed("experiment_id", "entity_id")
    return _nested(edges, out, "experiment_id", "lineage", ("source", "target", "relation"))
