"""What the operators of this package share: tables, lineage cuts, word hashes, sampling, fitting.

Texts cross into Python as Arrow batches.  The byte-level helpers work on the
UTF-8 buffer of such a batch, never on Python strings, and on pieces of about a
megabyte, so the memory of a task does not follow the size of its input.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.session import cut_lineage

__all__ = [
    "BLANK", "NOT_ALNUM", "blocks", "crc_fold", "cut_lineage", "fit_once", "labelled_sample", "mix", "pack", "run_hashes", "shuffle_width", "table", "text_buffer",
    "unpack", "word_hashes",
]

# Fixed value: the white space of all word rules, space and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"
PIECE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text modulo ``mod``; a null id falls into fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod, F.lit(0))


# ---- byte buffers -------------------------------------------------------------------


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column of an Arrow batch; null is empty."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def blocks(offsets: np.ndarray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes; a longer row stands alone."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(rows, max(last, first + 1))
        yield first, last
        first = last


# ---- word hashes --------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) < n:
        steps = np.full(max(n, PIECE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        got = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return got


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that all bits depend on all bits."""
    h = h.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    h ^= h >> np.uint64(31)
    return h


def _folding() -> np.ndarray:
    fold = np.arange(256, dtype=np.uint64) + 1
    fold[65:91] = fold[97:123]
    return fold


LOWERED = _folding()
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[48:58] = NOT_ALNUM[65:91] = NOT_ALNUM[97:123] = NOT_ALNUM[128:] = False


def run_hashes(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``inside`` bytes, and the bounds of each row's runs; runs do not cross rows.

    A run's hash is the difference of two prefix sums of value * base^position,
    shifted back to position zero, so one pass hashes all runs of all rows.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values[data] * _power(_BASE, n)[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _power(_INVERSE, n)[starts])
    return hashes, np.searchsorted(starts, offsets).astype(np.int64)


def word_hashes(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word with A-Z lowered, and the bounds of each row's words."""
    return run_hashes(data, offsets, ~separators[data], LOWERED)


# ---- bounded fitting ----------------------------------------------------------------


def labelled_sample(labels: DataFrame, label: str, limit: int) -> DataFrame:
    """At most about ``limit`` rows (doc_id, label), evenly from each label, chosen by a hash of the id.

    Null ids, null labels and repeated ids are left out of the sample.
    """
    known = labels.select("doc_id", F.col(label).alias("label")).dropna()
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    ticket = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1_000_000))
    chosen = F.lit(False)
    for value, count in counts.items():
        share = min(1_000_000, round(1_000_000 * limit / len(counts) / count))
        chosen = chosen | ((F.col("label") == F.lit(value)) & (ticket < share))
    return known.where(chosen).dropDuplicates(["doc_id"])


def pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpack(model: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(model), allow_pickle=False) as got:
        return {k: got[k] for k in got.files}


def fit_once(sample: DataFrame, fit: Callable, empty: Callable[[], bytes]) -> bytes:
    """Fit a model on a bounded sample in one task; only the packed model reaches the driver.

    ``fit`` gets the rows as a pandas frame in id order, so reruns agree.
    """

    def run(frames):
        import pandas as pd

        parts = [f for f in frames if len(f)]
        if parts:
            rows = pd.concat(parts, ignore_index=True)
            rows = rows.sort_values("doc_id", kind="stable", ignore_index=True)
            yield pd.DataFrame({"model": [fit(rows)]})

    got = sample.repartition(1).mapInPandas(run, "model binary").collect()
    return bytes(got[0]["model"]) if got else empty()
