"""Near duplicates by MinHash with tensored banding.

A document's set is its distinct 4-word shingles as 64-bit hashes; equal sets are
one class with a digest.  Two collections of ``SIDE`` bands, left and right, of
``ROWS`` minhashes each are computed per set; a table key is a pair of a left and a
right band, so 2 * SIDE * ROWS minhashes (96) give SIDE * SIDE tables (256) of
2 * ROWS rows, which would take 1,536 minhashes one by one.  A pair of similarity s meets
in a table unless all its left or all its right bands differ: it is missed with a
probability below 2 * (1 - s ** ROWS) ** SIDE, 2.1e-5 at 0.8 and less above.

A table can only join two sets where both its bands do, so work goes from bands
to tables:

1. Bands.  In each band bucket every member is held against one of them (the
   bucket's first by hash), so copies link at the price of 2 * SIDE rows a class.
2. Tables.  A band is live where members of different components share it.  Only
   live left and right bands are combined into table keys, and only buckets that
   still hold several components are kept.
3. Rest.  Within a kept bucket all pairs between different components are held
   against each other in numpy, in cells of a bounded number of rows.  A pair leaves
   the task only if it is within the bound below, and only from the first table
   in which it meets (told by the lower 31 bits of the bands).

A pair is a candidate only within a bound that no similar pair breaks: sizes, and
parity bits (each differing element flips one bit at most).  Candidates are
confirmed on the full sets: those of step 1, at most 2 * SIDE a class, and those of
step 3, all of them between two components.

Cases: texts of fewer than 4 words have one shingle, the whole sequence; null and
empty texts have none, stand alone and are kept; equal texts are one class; a
repeated id counts as one document; null ids are no component's smallest id
unless all are null, and such rows are kept; an empty table gives no row; further
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import blocks, cut_lineage, mix, shuffle_width, table, text_buffer, word_hashes
from cairn.llm.components import components

WORDS = 4
SIDE = 16
ROWS = 3
PARITY_WORDS = 16
CELL = 2048
SLOTS = 1 << 24
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
_SEEDS = np.arange(1, 2 * SIDE * ROWS + 1, dtype=np.uint64)
_XOR = (mix(_SEEDS) >> np.uint64(32)).astype(np.uint32)
_ODD = (mix(_SEEDS * _FACTORS[1]) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


# ---- sets ---------------------------------------------------------------------------


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a buffer."""
    words, bounds = word_hashes(data, offsets)
    n = max(0, len(words) - WORDS + 1)
    runs = mix(sum((words[j : j + n] * _FACTORS[j] for j in range(WORDS)), np.zeros(n, np.uint64)))
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= WORDS:
            out.append(np.unique(runs[a : b - WORDS + 1]))
        else:
            few = (words[a:b] * _FACTORS[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([few] if b > a else [], np.uint64)))
    return out


def digests(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit digest of each set, independent of order."""
    return mix(np.add.reduceat(mix(flat ^ _FACTORS[2]), starts) + sizes.astype(np.uint64)).view(np.int64)


def parities(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Parity bits of each set as rows of words: a bit is odd when an odd number of elements falls on it."""
    bits = 64 * PARITY_WORDS
    at = (mix(flat + _FACTORS[0]) % np.uint64(bits)).astype(np.int64) + np.repeat(np.arange(len(sizes)) * bits, sizes)
    odd = (np.bincount(at, minlength=bits * len(sizes)) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64).reshape(len(sizes), PARITY_WORDS)


def band_hashes(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The 2 * SIDE bands of each set, left ones first; each is a hash of ROWS minhashes and of its place."""
    short = (flat >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), 2 * SIDE), np.uint64)
    for band in range(2 * SIDE):
        total = np.full(len(starts), band, np.uint64)
        for r in range(ROWS):
            at = band * ROWS + r
            total += np.minimum.reduceat((short ^ _XOR[at]) * _ODD[at], starts).astype(np.uint64) * _FACTORS[r]
        out[:, band] = mix(total)
    return out.view(np.int64)


def _lists(rows: np.ndarray, held: np.ndarray) -> pa.Array:
    """A list column: the next row of ``rows`` where ``held``, else null."""
    width = rows.shape[1]
    offsets = np.append(0, np.cumsum(held * width)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()), mask=pa.array(~held))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n, digest, parity and bands of every row; nulls for an empty set."""
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        for a, b in blocks(offsets):
            sets = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            sizes = np.array([len(s) for s in sets], np.int64)
            held = sizes > 0
            full = sizes[held]
            flat = np.concatenate(sets)
            starts = np.cumsum(full) - full
            found = (digests(flat, starts, full), parities(flat, full), band_hashes(flat, starts)) if held.any() else (np.zeros(0, np.int64), np.zeros((0, PARITY_WORDS), np.int64), np.zeros((0, 2 * SIDE), np.int64))
            digest = np.zeros(b - a, np.int64)
            digest[held] = found[0]
            columns = [batch.column("doc_id").slice(a, b - a).cast(pa.int64()), pa.array(sizes), pa.array(digest, mask=~held), _lists(found[1], held), _lists(found[2], held)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "digest", "parity", "bands"])


# ---- the bound ----------------------------------------------------------------------


def _may_link(n: np.ndarray, m: np.ndarray, flips: np.ndarray) -> np.ndarray:
    """Sets of n and m elements with 100 * intersection >= 80 * union differ in at most (n + m) / 9 elements."""
    return (9 * flips <= n + m) & (5 * np.minimum(n, m) >= 4 * np.maximum(n, m))


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs within the bound."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (batch.column(c).flatten().to_numpy().view(np.uint64).reshape(-1, PARITY_WORDS) for c in ("parity_a", "parity_b"))
        flips = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
        ok = _may_link(batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), flips)
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok)) for c in ("a", "b")], names=["a", "b"])


def near_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The distinct pairs (a < b) within the bound."""
    of = lambda x: classes.select(F.col("digest").alias(x), F.col("n").alias(f"n_{x}"), F.col("parity").alias(f"parity_{x}"))
    met = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(of("a"), "a").join(of("b"), "b")
    return met.mapInArrow(_near, "a long, b long")


# ---- confirmation -------------------------------------------------------------------


def _slot(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(SLOTS))


def class_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """digest and elements of the wanted classes, each once.

    A bit map of fixed size over the hashed ids of one document of each wanted class keeps
    the tasks from building most other sets; the join behind it is exact.
    """
    chosen = cut_lineage(classes.join(wanted, "digest", "left_semi").select("digest", F.col("least_id").alias("doc_id")))
    marked = chosen.select(_slot(F.col("doc_id")).alias("slot")).groupBy(F.floor(F.col("slot") / 63).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot % 63 AS INT))")).alias("bits")).toArrow()
    bits = np.zeros(SLOTS // 63 + 1, np.int64)
    bits[marked.column("word").to_numpy()] = marked.column("bits").to_numpy()

    def build(batches):
        for batch in batches:
            slot = batch.column("slot").to_numpy()
            rows = np.flatnonzero((bits[slot // 63] >> (slot % 63)) & 1)
            data, offsets = text_buffer(batch.column("text").take(pa.array(rows)))
            for a, b in blocks(offsets):
                sets = [s for s in shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) if len(s)]
                if sets:
                    sizes = np.array([len(s) for s in sets], np.int64)
                    flat = np.concatenate(sets)
                    own = digests(flat, np.cumsum(sizes) - sizes, sizes)
                    elements = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(flat.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(own), elements], names=["digest", "elements"])

    built = docs.select("text", _slot(F.col("doc_id")).alias("slot")).mapInArrow(build, "digest long, elements array<long>")
    return built.join(chosen.select("digest"), "digest", "left_semi").dropDuplicates(["digest"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sets are similar enough."""
    for batch in batches:
        x, y, ok = batch.column("set_a"), batch.column("set_b"), []
        for i in range(batch.num_rows):
            p, q = x[i].values.to_numpy(), y[i].values.to_numpy()
            common = len(np.intersect1d(p, q, assume_unique=True))
            ok.append(100 * common >= 80 * (len(p) + len(q) - common))
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok, pa.bool_())) for c in ("a", "b")], names=["a", "b"])


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    of = lambda x: sets.select(F.col("digest").alias(x), F.col("elements").alias(f"set_{x}"))
    return cut_lineage(pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").mapInArrow(_confirm, "a long, b long"))


def sets_of(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    return cut_lineage(class_sets(docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct()))


# ---- buckets ------------------------------------------------------------------------


def band_rows(classes: DataFrame) -> DataFrame:
    """band, place (left ones below SIDE, right ones from there) and digest."""
    return classes.select("digest", F.posexplode("bands").alias("place", "band")).select("band", "place", "digest")


def spokes(bands: DataFrame) -> DataFrame:
    """Pairs of each member of a band bucket with the bucket's first member by hash."""
    order = F.struct(F.xxhash64("digest").alias("h"), "digest")
    first = bands.groupBy("band").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1").select("band", F.col("first.digest").alias("a"))
    return bands.join(first, "band").where("digest <> a").select("a", F.col("digest").alias("b")).distinct()


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    met = rows.join(labels.withColumnRenamed("node", "digest"), "digest", "left")
    return met.withColumn("label", F.coalesce("label", "digest"))


def _mixed(rows: DataFrame, key: str) -> DataFrame:
    """Buckets with several components, and their sizes."""
    found = rows.groupBy(key).agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size"))
    return found.where("low <> high").select(key, "size")


def tables(bands: DataFrame, labels: DataFrame) -> DataFrame:
    """bucket, table (its number), digest, label, size: the buckets of tables over live bands that hold several components."""
    named = cut_lineage(_labelled(bands, labels))
    live = named.join(_mixed(named, "band").select("band"), "band", "left_semi")
    band, is_left = F.struct("place", "band"), F.col("place") < SIDE
    sides = live.groupBy("digest", "label").agg(F.collect_list(F.when(is_left, band)).alias("lefts"), F.collect_list(F.when(~is_left, band)).alias("rights"))
    keyed = sides.select("digest", "label", "rights", F.explode("lefts").alias("left")).select("digest", "label", "left", F.explode("rights").alias("right"))
    number = F.col("left.place") * SIDE + F.col("right.place") - SIDE
    rows = cut_lineage(keyed.select(F.xxhash64("left.band", "right.band").alias("bucket"), number.alias("table"), "digest", "label"))
    return rows.join(_mixed(rows, "bucket"), "bucket")


def first_table(marks: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Number of the first table in which a set meets each of the others, which share a left and a right band with it."""
    same = others == marks
    return same[:, :SIDE].argmax(axis=1) * SIDE + same[:, SIDE:].argmax(axis=1)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) within the bound and between components, in cells that come as runs of sorted rows.

    A pair leaves in the first of the tables where it meets, so once.
    """
    held: list[pa.RecordBatch] = []

    def pairs(cell: pa.Table) -> Iterator[pa.RecordBatch]:
        n, label, digest, part = (cell.column(c).to_numpy() for c in ("n", "label", "digest", "part"))
        parity = cell.column("parity").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, PARITY_WORDS)
        marks = cell.column("marks").combine_chunks().flatten().to_numpy().reshape(-1, 2 * SIDE)
        row, column, number = (int(cell.column(c)[0].as_py()) for c in ("row", "column", "table"))
        order = np.argsort(n, kind="stable")
        n, label, digest, part, parity, marks = n[order], label[order], digest[order], part[order], parity[order], marks[order]
        last = np.searchsorted(n, n * 5 // 4, "right")
        for i in range(len(n) - 1):
            there = slice(i + 1, last[i])
            other = label[there] != label[i]
            if row != column:
                other &= part[there] != part[i]
            at = np.flatnonzero(other) + i + 1
            if not len(at):
                continue
            flips = np.bitwise_count(parity[at] ^ parity[i]).sum(axis=1, dtype=np.int64)
            at = at[_may_link(n[at], n[i], flips)]
            at = at[first_table(marks[i], marks[at]) == number]
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), digest[i])), pa.array(digest[at])], names=["a", "b"])

    names = ("bucket", "row", "column")
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in names], axis=1)
        starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        if held and any(held[-1].column(c)[0].as_py() != batch.column(c)[0].as_py() for c in names):
            yield from pairs(pa.Table.from_batches(held))
            held = []
        for a, b in zip(starts, starts[1:]):
            if a:
                yield from pairs(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield from pairs(pa.Table.from_batches(held))


def rest(found: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs within the bound between components of each table, compared in cells of about CELL rows a side."""
    parts = F.ceil(F.col("size") / CELL)
    dealt = found.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("digest", F.lit(9)), F.col("parts")))
    celled = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    marks = F.transform("bands", lambda b: b.bitwiseAND(0x7FFFFFFF).cast("int"))
    carried = classes.select("digest", "n", "parity", marks.alias("marks"))
    rows = celled.join(carried, "digest").select("bucket", "table", F.least("part", "other").alias("row"), F.greatest("part", "other").alias("column"), "digest", "label", "part", "n", "parity", "marks")
    ordered = rows.repartition(shuffle_width(found.sparkSession), "bucket", "row", "column").sortWithinPartitions("bucket", "row", "column")
    return ordered.mapInArrow(_across, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    schema = "doc_id long, n long, digest long, parity array<long>, bands array<long>"
    described = cut_lineage(docs.select("doc_id", "text").mapInArrow(_describe, schema))
    one = {c: F.any_value(c).alias(c) for c in ("n", "parity", "bands")}
    classes = cut_lineage(described.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("least_id"), *one.values()))
    bands = band_rows(classes)
    near = cut_lineage(near_pairs(spokes(bands), classes))
    good = confirmed(near, sets_of(near, docs, classes))
    far = cut_lineage(near_pairs(rest(tables(bands, components(good)), classes), classes))
    labels = components(good.union(confirmed(far, sets_of(far, docs, classes))))
    named = _labelled(classes.select("digest", "least_id"), labels)
    of_class = named.join(named.groupBy("label").agg(F.min("least_id").alias("component_id")), "label").select("digest", "component_id")
    met = described.select("doc_id", "n", "digest").join(of_class, "digest", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return met.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
