"""Path expressions: canonical form, components, roles, media types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions.binding import let
from cairn.functions.text import blank_to_null

# File extensions the experiment scan accepts.
SCAN_EXTENSIONS = (".csv", ".dat", ".xlsx", ".xls", ".png")

# Data folders and extensions of the device linkage.
RAW_FOLDERS = ("Initial Data", "Initial data", "Initial data after processing")
PROCESSED_FOLDER = "Processed Data"
FALLBACK_RAW_FOLDER = "Initial Data"
LINKAGE_EXTENSIONS = ("csv", "dat", "xlsx", "xls", "png")

# Media types by extension.
MEDIA_TYPES = {
    "ppt": "application/vnd.ms-powerpoint",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "pdf": "application/pdf",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "tif": "image/tiff",
    "tiff": "image/tiff",
    "opju": "application/octet-stream",
}

# Extension sets of the artifact kinds.
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "gif", "bmp", "tif", "tiff", "webp", "svg", "fig")
DOCUMENT_EXTENSIONS = ("pdf", "ppt", "pptx", "doc", "docx", "txt", "md", "ipynb")
DATA_EXTENSIONS = (
    "csv", "tsv", "dat", "xlsx", "xls", "mat", "spe", "phu", "asc", "sif",
    "json", "jsonl", "m", "npy", "npz", "h5", "hdf5",
)
DEVICE_DOCUMENT_EXTENSIONS = ("pdf", "ppt", "pptx")

UNKNOWN = "UNKNOWN"


def forward_slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def path_error(path: Column) -> Column:
    """Reason a relative path is unusable, else null."""
    p = forward_slashes(path)
    return (
        F.when(path.isNull() | (path == ""), "empty")
        .when(p.startswith("/") | p.rlike("^[A-Za-z]:"), "absolute")
        .when(p.rlike(r"(?:^|/)\.\.(?:/|$)"), "traversal")
        .when(p.rlike(r"^[./]*$") & ~p.rlike(r"(?:^|/)\.{3,}(?:/|$)"), "empty")
    )


def canonical_path(path: Column) -> Column:
    """Forward-slash form without empty and ``.`` parts; null when not storage-relative."""
    parts = F.filter(F.split(forward_slashes(path), "/"), lambda c: (c != "") & (c != "."))
    clean = F.array_join(parts, "/")
    tidy = ~path.rlike(r"\\|//|/$|(?:^|/)\.(?:/|$)")
    return F.when(path_error(path).isNull(), F.when(tidy, path).otherwise(clean))


def first_component(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def second_component(path: Column) -> Column:
    """Second path component; the first one again when there is no second."""
    return F.substring_index(F.substring_index(path, "/", 2), "/", -1)


def component_count(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))) + 1


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dirs(path: Column) -> Column:
    """Everything before the last slash (empty for a root file)."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def suffix(path: Column) -> Column:
    """Last dot suffix of the file name in lower case, dot included; empty when there is none."""
    return F.lower(F.regexp_extract(path, r"(?s)[^/](\.[^./]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?s)(?<=.)\.[^.]+$", "")


def extension(path: Column) -> Column:
    """Dot-free lower-case extension, ``UNKNOWN`` when there is none."""
    ext = F.substring(suffix(path), 2, 1000)
    return F.coalesce(blank_to_null(ext), F.lit(UNKNOWN))


def extension_token(ext: Column) -> Column:
    """Stored extension without dots on either side, ASCII lower case."""
    return F.lower(F.btrim(ext, F.lit(".")))


def media_type(ext: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, ext), F.lit(UNKNOWN))


def scan_role(path: Column) -> Column:
    """Role by parent folders: intermediate wins, then raw, then processed (PNG there is a figure).

    Each component is folded to lower case with runs of other characters as one
    blank; the whole directory part is folded at once, slashes kept as borders.
    """
    folded = F.regexp_replace(F.lower(parent_dirs(path)), "[^a-z0-9/]+", " ")

    def ladder(dirs: Column) -> Column:
        def has(folder: str) -> Column:
            return dirs.rlike(f"(?:^|/) ?{folder} ?(?:/|$)")

        processed = F.contains(dirs, F.lit("processed data")) & has("processed data")
        initial = F.contains(dirs, F.lit("initial data"))
        return (
            F.when(initial & has("initial data after process(?:ing)?"), "intermediate")
            .when(initial & has("initial data"), "raw")
            .when(processed, F.when(suffix(path) == ".png", "figure").otherwise("processed"))
        )

    return let(folded, ladder)


def unsupported_reason(path: Column, ext: Column) -> Column:
    shown = F.coalesce(blank_to_null(ext), F.lit("(none)"))
    return F.concat(F.lit("unsupported extension '"), shown, F.lit("': "), path)


def outside_reason(path: Column) -> Column:
    return F.concat(F.lit("outside recognised data directories: "), path)


def linkage_extension(ext: Column, path: Column) -> Column:
    stored = blank_to_null(ext)
    return F.lower(F.coalesce(stored, F.substring(suffix(path), 2, 1000)))


def linkage_role(folder: Column, ext: Column) -> Column:
    return (
        F.when(folder.isin(*RAW_FOLDERS) | (ext == "csv"), "raw")
        .when(ext == "png", "figure")
        .otherwise("processed")
    )


def artifact_kind(ext: Column, media: Column) -> dict[str, Column]:
    """One predicate per kind; ``other`` is the exact complement of the rest."""
    token = extension_token(ext)
    image = token.isin(*IMAGE_EXTENSIONS) | F.lower(media).startswith("image/")
    document = token.isin(*DOCUMENT_EXTENSIONS)
    data = token.isin(*DATA_EXTENSIONS)
    return {
        "image": image,
        "document": document,
        "data": data,
        "other": ~image & ~document & ~data,
    }


def unsafe_path_reason(path: Column, noun: str = "relative path") -> Column:
    """Preflight wording for paths that leave the upload root."""
    p = forward_slashes(path)
    return (
        F.when(path.isNull() | (path == ""), f"{noun} is empty")
        .when(
            p.startswith("/") | p.rlike("^[A-Za-z]:"),
            F.concat(F.lit(f"unsafe absolute {noun}: "), path),
        )
        .when(
            p.rlike(r"(?:^|/)\.\.(?:/|$)"),
            F.concat(F.lit(f"unsafe traversal {noun}: "), path),
        )
    )


def destination_error(path: Column) -> Column:
    """Reason an upload destination is refused, else null."""
    return (
        F.when(path == "", "empty")
        .when(path.rlike(r"^\p{L}:"), "drive path")
        .when(path.rlike(r"^(?:\\\\|//)"), "UNC path")
        .when(path.rlike(r"^[/\\]"), "leading slash")
        .when(forward_slashes(path).rlike(r"(?:^|/)\.\.(?:/|$)"), "parent reference")
    )
