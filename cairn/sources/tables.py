"""Delimited text files as cell rows for previews."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.previews import POLICY, PreviewPolicy, delimiter
from cairn.schemas import CELLS

# Bytes of a table a preview reads, characters the delimiter is chosen from.
TABLE_BYTES = 2 * 1024 * 1024
SAMPLE_CHARS = 8192


def _rows(text: str, mark: str | None) -> list[list[str]]:
    if mark is None:
        return [line.split() for line in text.splitlines()]
    return list(csv.reader(io.StringIO(text), delimiter=mark))


def read_cells(files: DataFrame, policy: PreviewPolicy = POLICY, table_bytes: int | None = None) -> DataFrame:
    """(relative_path, row, col, cell) of text tables, header as row 0.

    The policy's row and column counts define what a preview shows; a
    wider policy reads whole tables.  Files are read to their end unless
    ``table_bytes`` asks for their start only; invalid bytes become U+FFFD.
    """
    body = F.col("content") if table_bytes is None else F.substring(F.col("content"), 1, table_bytes)
    text = F.regexp_replace(F.make_valid_utf8(body.cast("string")), "^\\x{FEFF}", "")
    decoded = files.where("content is not null").select("relative_path", text.alias("text"))
    marked = decoded.withColumn("mark", delimiter(F.substring("text", 1, SAMPLE_CHARS)))
    height, width = policy.table_rows + 1, policy.table_columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content, mark in zip(batch["relative_path"], batch["text"], batch["mark"], strict=True):
                try:
                    table = _rows(content, mark if isinstance(mark, str) else None)[:height]
                except csv.Error:
                    continue
                cells = [(path, r, c, cell) for r, row in enumerate(table) for c, cell in enumerate(row[:width])]
                yield pd.DataFrame(cells, columns=["relative_path", "row", "col", "cell"])

    return marked.mapInPandas(run, CELLS)


def table_findings(cells: DataFrame, files: DataFrame, policy: PreviewPolicy = POLICY) -> DataFrame:
    """Tables that cannot be previewed: no rows at all, or a cell beyond the cap."""
    wide = cells.where(F.length("cell") > policy.cell_chars).select("relative_path").distinct()
    empty = files.select("relative_path").join(cells.select("relative_path").distinct(), on="relative_path", how="left_anti")
    return wide.unionByName(empty).distinct().withColumn("finding", F.lit("malformed"))
