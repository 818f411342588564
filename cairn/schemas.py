"""Table schemas of the catalog, inventory, manifests and readers."""

from __future__ import annotations

from cairn.functions.gates import CONNECTION_TYPE, CONSTRAINT_TYPE

LISTING = "relative_path string, size_bytes long, mtime_ns long"

METADATA = (
    "sample_id string, temperature_K double, magnetic_field_T double, excitation_wavelength_nm double, "
    "measurement_type string, center_wavelength_nm double, integration_time_s double, averages long, "
    "excitation_power_uW double, grating_grooves_per_mm long, rotations_deg array<double>, stage_position long, "
    "measurement_point_label string, fixed_top_gate_V double, active_gate_configuration string, bias_start_V double, "
    "bias_stop_V double, back_gate_topology string, fixed_gate_values array<struct<gate:string,value:double>>, "
    f"gate_constraints {CONSTRAINT_TYPE}, electrical_connections {CONNECTION_TYPE}"
)

CATALOG = {
    "experiments": (
        f"experiment_id string, {METADATA}, metadata_keys array<string>, warnings array<string>, confidence double, "
        "needs_review boolean, review_state string, parser_version string, roles array<string>, "
        "directory_context string, figure_linear string, figure_log string"
    ),
    "experiment_files": (
        "experiment_id string, ordinal long, role string, storage_source_id string, relative_path string, file_id string"
    ),
    "devices": (
        "device_id string, device_type string, aliases array<string>, review_state string, metadata_json string, "
        "maker_namespace string, local_device_id string, display_label string"
    ),
    "artifacts": (
        "artifact_id string, role string, category string, extension string, media_type string, device_id string, "
        "experiment_id string, storage_source_id string, relative_path string, size_bytes long, mtime_ns long, "
        "review_state string, metadata_json string, file_id string"
    ),
    "metadata_claims": (
        "subject_type string, subject_id string, ordinal long, field string, value_json string, source_type string, "
        "source_reference string, extraction_method string, confidence double, category string, evidence array<string>, "
        "review_status string, reviewed_value_json string"
    ),
    "relationships": (
        "relationship_id string, source_type string, source_id string, predicate string, target_type string, "
        "target_id string, provenance_source string, review_state string, ordinal long"
    ),
    # Factorised derived_from edges: each upstream file of an experiment feeds each downstream one.
    "derivations": "experiment_id string, side string, file_id string",
    # File links that stay open: one row per candidate, one without a candidate where none is known.
    "unresolved_links": (
        "experiment_id string, source_role string, source string, target_role string, reason string, target_stem string, "
        "ordinal long, candidate string"
    ),
}

# Column that readers filter on most; files are clustered by it when written.
CLUSTER_BY = {
    "experiments": "experiment_id",
    "experiment_files": "experiment_id",
    "devices": "device_id",
    "artifacts": "artifact_id",
    "metadata_claims": "subject_id",
    "relationships": "source_id",
    "derivations": "file_id",
    "unresolved_links": "experiment_id",
}

INVENTORY = (
    "relative_path string, size_bytes long, mtime_ns long, inventory_status string, metadata_status string, "
    "content_hash string, parser_version string, file_kind string, sample_hint string, last_seen_session_id string, "
    "last_seen_generation long, created_utc string, updated_utc string"
)

_FILES = "array<struct<source_path:string,relative_path:string,destination_path:string,role:string>>"
MANIFEST = (
    "manifest_version int, batch_id string, batch_number long, dataset_label string, status string, "
    f"proposal_ids array<string>, archive_files {_FILES}, companion_files {_FILES}, expected_entry_count long, "
    "expected_file_count long, publish boolean, upload_name string, upload_id string, "
    "entry_ids array<struct<proposal_id:string,entry_id:string>>, processing_status string, verification_status string, "
    "created_utc string, updated_utc string"
)

SLIDES = (
    "deck_relative_path string, slide_index int, title string, text_boxes array<array<string>>, text_runs array<string>, "
    "labels array<string>, notes string, image_refs array<string>"
)
PACKAGES = (
    "relative_path string, length long, members long, uncompressed long, max_ratio double, max_xml long, slides long, problem string"
)
IMAGES = "relative_path string, width long, height long"
CELLS = "relative_path string, row int, col int, cell string"
