"""Document fingerprints as invertible Bloom lookup sketches.

A text is a multiset of paragraphs: its lines, cut behind sentence ends and, where
neither comes, at every ``MOST_WORDS``-th white space.  The n-th repeat of a paragraph
counts as an element of its own.  Each element is a 64-bit digest placed in three
cells; a cell holds a count, the xor of its digests and the xor of their checks.
Sketches of two versions subtract cell by cell; elements of both cancel, and
peeling cells with a single element recovers the digests of the difference.
Parity bits of the digests suggest a first size.  Peeling fails when the difference
is too large for the cells; both sketches are then rebuilt four times as large.

The fingerprint column is the smallest sketch (``CELLS`` cells) in hex with the
element count in front, so equal texts have equal fingerprints.  The likeness of
two texts is shared / (shared + differing elements), found from the peeled
difference.

The next document in id order comes from one shuffle: bounds at quantiles of the
ids cut the id range into strips, a strip's first document is also sent to the
strip before it, and a pass over each sorted strip pairs neighbours.  Nothing but
the bounds (a fixed number) reaches the driver.

Cases: null text is empty, an empty text has no element, two empty texts have
likeness 1; null ids come first; equal ids follow each other in text order; with
one document the next is itself; an empty table gives no row; further columns
are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import BLANK, PIECE_BYTES, mix, run_hashes, shuffle_width, table

CELLS = 18
HASHES = 3
GROWTH = 4
MOST_WORDS = 12
PARITY = 256
BYTES = np.arange(256, dtype=np.uint64) + 1
SENTENCE_END = np.isin(np.arange(256), np.frombuffer(b".!?", np.uint8))
_REPEAT = np.uint64(0xD6E8FEB86659FD93)
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def elements(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the paragraphs of all texts and the bounds of each text's digests, sorted within a text."""
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    white = BLANK[data]
    cut = white & (data == 10)
    cut[1:] |= white[1:] & SENTENCE_END[data[:-1]]
    # White space since the last cut or the start of the text.
    total = np.cumsum(white)
    mark = np.where(cut, total, 0)
    first = offsets[:-1][np.diff(offsets) > 0]
    mark[first] = np.maximum(mark[first], total[first] - white[first])
    since = total - np.maximum.accumulate(mark)
    cut |= white & (since > 0) & (since % MOST_WORDS == 0)
    keys, bounds = run_hashes(data, offsets, ~cut, BYTES)
    row = np.repeat(np.arange(len(texts)), np.diff(bounds))
    order = np.lexsort((keys, row))
    keys, row = keys[order], row[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
    at = np.arange(len(keys))
    repeat = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return np.where(repeat == 0, keys, mix(keys + repeat.astype(np.uint64) * _REPEAT)), bounds


class Placed:
    """Digests of many pairs of texts with the hashes that place them in cells."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        one, two = mix(keys + np.uint64(0x9E3779B97F4A7C15)), mix(keys ^ np.uint64(0xC2B2AE3D27D4EB4F))
        self.check = mix(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        half = np.uint64(32)
        self.spots = ((one & np.uint64(0xFFFFFFFF)).astype(np.int64), (one >> half).astype(np.int64), (two >> half).astype(np.int64))

    def cells(self, base: np.ndarray, third: np.ndarray) -> np.ndarray:
        """One cell in each third of the table that starts at ``base``."""
        return np.concatenate([base + j * third + spot % third for j, spot in enumerate(self.spots)])


def _add(table: tuple[np.ndarray, np.ndarray, np.ndarray], placed: Placed, cells: np.ndarray, sign: np.ndarray) -> None:
    count, digest, check = table
    np.add.at(count, cells, np.tile(sign, HASHES))
    np.bitwise_xor.at(digest, cells, np.tile(placed.keys, HASHES))
    np.bitwise_xor.at(check, cells, np.tile(placed.check, HASHES))


def _empty(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)


def differences(keys: np.ndarray, pair: np.ndarray, sign: np.ndarray, pairs: int, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Recovered digests, their pairs and signs, for many pairs of sketches at once.

    ``sign`` is 1 for digests of a pair's first text and -1 for its second, so
    adding all is subtracting sketches.  ``cells`` is each pair's first size;
    pairs whose peeling leaves cells over are rebuilt ``GROWTH`` times as large.
    """
    found = []
    todo = np.arange(pairs)
    thirds = np.maximum(1, -(-cells // HASHES))
    while len(todo):
        slot = np.full(pairs, -1)
        slot[todo] = np.arange(len(todo))
        own = slot[pair] >= 0
        third = thirds[todo]
        base = np.concatenate([[0], np.cumsum(third * HASHES)])
        owner = np.repeat(np.arange(len(todo)), third * HASHES)
        table = _empty(base[-1])
        placed = Placed(keys[own])
        at = slot[pair[own]]
        _add(table, placed, placed.cells(base[at], third[at]), sign[own])
        got = []
        while True:
            single = np.flatnonzero(np.abs(table[0]) == 1)
            single = single[mix(table[1][single] ^ np.uint64(0xA5A5A5A5A5A5A5A5)) == table[2][single]]
            if not len(single):
                break
            order = np.lexsort((table[1][single], owner[single]))
            single = single[order]
            fresh = np.ones(len(single), bool)
            fresh[1:] = (table[1][single][1:] != table[1][single][:-1]) | (owner[single][1:] != owner[single][:-1])
            single = single[fresh]
            peeled, of, signs = Placed(table[1][single]), owner[single], table[0][single]
            got.append((peeled.keys, of, signs))
            _add(table, peeled, peeled.cells(base[of], third[of]), -signs)
        left = np.unique(owner[(table[0] != 0) | (table[1] != 0) | (table[2] != 0)])
        done = np.ones(len(todo), bool)
        done[left] = False
        for k, of, signs in got:
            ok = done[of]
            found.append((k[ok], todo[of[ok]], signs[ok]))
        thirds[todo[left]] *= GROWTH
        todo = todo[left]
    join = lambda i, kind: np.concatenate([f[i] for f in found]) if found else np.zeros(0, kind)
    return join(0, np.uint64), join(1, np.int64), join(2, np.int64)


def _guess(keys: np.ndarray, pair: np.ndarray, pairs: int) -> np.ndarray:
    """Cells to begin with: how many of ``PARITY`` parity bits differ tells about how many digests do."""
    bits = np.bincount(pair * PARITY + (mix(keys + np.uint64(77)) % np.uint64(PARITY)).astype(np.int64), minlength=pairs * PARITY) & 1
    odd = bits.reshape(pairs, PARITY).sum(1)
    number = np.bincount(pair, minlength=pairs)
    guess = -PARITY / 2 * np.log(np.maximum(1 - 2 * odd / PARITY, 1 / PARITY))
    return np.maximum(CELLS, 1.6 * np.minimum(number, guess) + 6).astype(np.int64)


def likenesses(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """shared / (shared + differing) for the i-th text of both sides, 1 for two empty texts."""
    pairs = len(a[1]) - 1
    keys = np.concatenate([a[0], b[0]])
    sizes = np.diff(a[1]), np.diff(b[1])
    pair = np.concatenate([np.repeat(np.arange(pairs), s) for s in sizes])
    sign = np.repeat([1, -1], [len(a[0]), len(b[0])])
    _, of, signs = differences(keys, pair, sign, pairs, _guess(keys, pair, pairs))
    differing = np.bincount(of, minlength=pairs)
    shared = sizes[0] - np.bincount(of, signs > 0, pairs).astype(np.int64)
    return np.where(sizes[0] + sizes[1] == 0, 1.0, shared / np.maximum(1, shared + differing))


def fingerprints_of(sets: tuple[np.ndarray, np.ndarray]) -> list[str]:
    """The smallest sketch of each text."""
    keys, bounds = sets
    rows = len(bounds) - 1
    of = np.repeat(np.arange(rows), np.diff(bounds))
    table, placed = _empty(rows * CELLS), Placed(keys)
    third = np.full(len(keys), CELLS // HASHES)
    _add(table, placed, placed.cells(of * CELLS, third), np.ones(len(keys), np.int64))
    count, digest, check = (t.reshape(rows, CELLS) for t in table)
    parts = np.concatenate([count.astype("<i4").view(np.uint8), digest.view(np.uint8), check.view(np.uint8)], 1)
    return [f"{n}:{base64.b64encode(p.tobytes()).decode()}" for n, p in zip(np.diff(bounds), parts)]


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _part(sets: tuple[np.ndarray, np.ndarray], rows: slice) -> tuple[np.ndarray, np.ndarray]:
    keys, bounds = sets
    own = bounds[rows.start : rows.stop + 1]
    return keys[own[0] : own[-1]], own - own[0]


def compare(ids: list, texts: list[str]) -> pd.DataFrame:
    """Result rows of all texts but the last, each with the text behind it as its next."""
    n = len(texts) - 1
    changed = [edited(texts[i], texts[i + 1]).encode() for i in range(n)]
    own, other = elements([t.encode() for t in texts]), elements(changed)
    first = _part(own, slice(0, n))
    prints = fingerprints_of(first)
    return pd.DataFrame(
        {
            "doc_id": pd.array(ids[:n], "Int64"),
            "n_chars": [len(t) for t in texts[:n]],
            "edited_sha256": [hashlib.sha256(t).hexdigest() for t in changed],
            "fingerprint": prints,
            "edited_fingerprint": fingerprints_of(other),
            "near_edited": likenesses(first, other),
            "near_next": likenesses(first, _part(own, slice(1, n + 1))),
        }
    )


def _pair(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by (strip, guest, order); a strip's guest is the next of its last document.

    Runs of neighbours of about a megabyte are compared at once; the last row of
    a run starts the next one.
    """
    ids: list = []
    texts: list[str] = []
    size, strip, closed = 0, None, None
    for frame in frames:
        for now, guest, doc_id, text in zip(frame["strip"], frame["guest"], frame["doc_id"], frame["text"]):
            if now == closed:
                continue  # equal rows at a bound are all guests, and the first one counts
            closed = now if guest else None
            if now != strip or size > PIECE_BYTES:
                if len(texts) > 1:
                    yield compare(ids, texts)
                keep = slice(-1, None) if now == strip else slice(0, 0)
                ids, texts = ids[keep], texts[keep]
                size, strip = sum(map(len, texts)), now
            ids.append(None if pd.isna(doc_id) else int(doc_id))
            texts.append(text)
            size += len(text)
    if len(texts) > 1:
        yield compare(ids, texts)


def with_next(docs: DataFrame, strips: int) -> DataFrame:
    """Documents by strip and order; each strip ends with a guest, the first document of the next one.

    Strip bounds are ids, so a strip starts with the first document of its bound.
    The first document of all closes the last strip.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # A null id sorts before all others, and the smallest long stands for it.
    rows = rows.withColumn("place", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("tie", F.xxhash64("text"))
    shares = [i / strips for i in range(strips)]
    got = rows.agg(F.percentile_approx("place", shares, 10 * strips).alias("bounds"), F.min("place").alias("least")).first()
    bounds = sorted({got["least"], *(got["bounds"] or [])} - {None})
    if not bounds:
        return rows.select(F.lit(0).alias("strip"), F.lit(False).alias("guest"), "place", "tie", "doc_id", "text").limit(0)
    firsts = rows.where(F.col("place").isin(bounds)).groupBy("place").agg(F.min("tie").alias("tie"), F.count(F.lit(1)).alias("n")).collect()
    first_tie = {r["place"]: r["tie"] for r in firsts}
    edges = spark.createDataFrame([(b, first_tie[b], (i - 1) % len(bounds)) for i, b in enumerate(bounds)], "place long, tie long, guest_strip int")
    limits = F.array(*[F.lit(b) for b in bounds])
    strip = (F.size(F.filter(limits, lambda b: b <= F.col("place"))) - 1).cast("int")
    # One row per bound: at most ``strips`` rows, so the broadcast has a proven bound.
    placed = rows.withColumn("strip", strip).join(F.broadcast(edges), ["place", "tie"], "left")
    copies = F.when(F.col("guest_strip").isNull(), F.array(F.struct(F.col("strip").alias("strip"), F.lit(False).alias("guest"))))
    copies = copies.otherwise(F.array(F.struct(F.col("strip").alias("strip"), F.lit(False).alias("guest")), F.struct(F.col("guest_strip").alias("strip"), F.lit(True).alias("guest"))))
    return placed.select(F.inline(copies), "place", "tie", "doc_id", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and its edited text, and the likeness to both neighbours."""
    spark = docs.sparkSession
    width = shuffle_width(spark)
    placed = with_next(docs, 8 * width)
    in_order = placed.repartition(width, "strip").sortWithinPartitions("strip", "guest", "place", "tie")
    return in_order.select("strip", "guest", "doc_id", "text").mapInPandas(_pair, SCHEMA)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
