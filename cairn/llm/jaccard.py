"""N-gram Jaccard join with PartEnum signatures.

A document's set is its distinct 5-word shingles as 64-bit hashes; equal sets are
one class with a digest.  Set sizes fall into bands [4^t, 4^(t+1)); a pair meets
under the tag of the smaller set's band, so every set signs for its own band and,
where a set of the band below can be similar to it, for that one too.

A band cuts the feature domain into partitions, and the subsets enumerated are the
single partitions: a token is the hash of all elements of a set in one partition.
Sets of n and m elements with a similarity of 3/4 differ in at most
``k = (n + m) // 7`` elements, so in at most ``k`` partitions, and all other
partitions hold equal tokens.  Tokens have one order for all sets, rare ones first,
and a set signs the first ``k + 1`` of its filled partitions: the first token that
two similar sets share is among them in both, for else ``k + 1`` tokens before it
would differ.  Two similar sets without any equal token both fill at most ``k``
partitions; such sets also sign their first ``n // 4 + 1`` elements, one of which
they share.  No similar pair is missed, no key stands for emptiness, and passages
that many documents hold are signed last.  The order comes from counts over a
sample of ``ORDERED`` documents; it decides what the join costs, never its result.

Signatures meet after one shuffle in sorted order.  A pass over each partition
keeps buckets of two and more classes, once per distinct set of members.  Links
are found in three steps, each between members of different components only:

1. Each bucket's first member by hash is its hub.  Of the hubs within the bound
   below, each class is held against the one it shares most buckets with, so a
   group of copies links at one pair a class.
2. Each component's likeliest pair in each cell, so no more pairs than rows.
3. All that is left.

Buckets of up to ``SMALL`` members give their pairs of fitting sizes.  Larger ones
are compared in numpy, in cells of about ``CELL`` rows a side, and only pairs
within an exact bound leave the task (parity bits: each differing element flips at
most one).  All candidates are confirmed on whole sets.

Cases: texts of fewer than 5 words have one shingle, the whole sequence; null and
empty texts have none and stand alone; equal texts are one class; a repeated id
counts as one document; null ids are no component's smallest id unless all are
null; an empty table gives no row; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import blocks, cut_lineage, mix, shuffle_width, table, text_buffer, word_hashes
from cairn.llm.components import components

WORDS = 5
SLOTS = 1 << 24
LEVELS = 1 << 19
ORDERED = 20_000
PARITY_BITS = 1 << 15
SMALL = 16
CELL = 2048
HELD = 200_000
KNOWN = 500_000
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


# ---- sets ---------------------------------------------------------------------------


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a buffer."""
    words, bounds = word_hashes(data, offsets)
    if len(words) >= WORDS:
        n = len(words) - WORDS + 1
        runs = np.zeros(n, np.uint64)
        for j in range(WORDS):
            runs += words[j : j + n] * _FACTORS[j]
        runs = mix(runs)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= WORDS:
            out.append(np.unique(runs[a : b - WORDS + 1]))
        elif b > a:
            few = (words[a:b] * _FACTORS[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([few], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digest_of(elements: np.ndarray) -> int:
    """64-bit digest of a set, independent of order."""
    total = mix(elements ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(mix(np.array([total + np.uint64(len(elements))], np.uint64)).view(np.int64)[0])


def parity_of(elements: np.ndarray) -> np.ndarray:
    """Parity bits as words: a bit is odd when an odd number of elements falls on it.

    Up to ``PARITY_BITS`` there are at least twice as many bits as elements, and a
    power of two, so the bits of a larger set fold onto those of a smaller one.
    """
    bits = 64
    while bits < min(2 * len(elements), PARITY_BITS):
        bits *= 2
    at = (mix(elements + _FACTORS[4]) % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(at, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


# ---- signatures ---------------------------------------------------------------------


def _tokens(elements: np.ndarray, tag: int) -> np.ndarray:
    """Tokens of the partitions of a tag that a set fills: 2 * 4^tag + 8 of them, so that a set of its sizes fills more than k."""
    n = 2 * 4**tag + 8
    part = (mix(elements + np.uint64(tag)) % np.uint64(n)).astype(np.uint16 if n <= 1 << 16 else np.int64)
    order = np.argsort(part, kind="stable")
    part = part[order]
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    sums = np.add.reduceat(mix(elements[order] ^ np.uint64(0x2545F4914F6CDD1D)), starts)
    return mix(sums + part[starts].astype(np.uint64) * _FACTORS[0] + np.uint64(tag * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF))


def _tags(size: int) -> list[tuple[int, int]]:
    """(tag, k) of a set: the largest number of elements in which a partner differs; none below 3 elements, where only equal sets are similar."""
    if size < 3:
        return []
    own = (size.bit_length() - 1) // 2
    below = 4**own - 1
    lower = [(own - 1, (size + below) // 7)] if own and 3 * size <= 4 * below else []
    return [(own, (size + 4 * size // 3) // 7), *lower]


def _first(tokens: np.ndarray, level: np.ndarray, n: int) -> np.ndarray:
    """The first n tokens in the common order."""
    if len(tokens) <= n:
        return tokens
    rank = (level[(tokens % np.uint64(LEVELS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (tokens >> np.uint64(8))
    return tokens[np.lexsort((tokens, rank))[:n]]


def signatures(elements: np.ndarray, level: np.ndarray) -> np.ndarray:
    """All signatures of one set."""
    size = len(elements)
    out = [np.zeros(0, np.uint64)]
    for tag, k in _tags(size):
        tokens = _tokens(elements, tag)
        out.append(_first(tokens, level, k + 1))
        if len(tokens) <= k:
            out.append(_first(mix(elements * _FACTORS[2] + np.uint64(tag)), level, size // 4 + 1))
    return np.concatenate(out)


def token_order(docs: DataFrame) -> np.ndarray:
    """Level of each of ``LEVELS`` slots of tokens: how far, in steps of a quarter power of two, a slot is above twice the mean count.

    Counts come from about ``ORDERED`` documents chosen by a hash.
    """
    rows = docs.count()
    ticket = F.pmod(F.xxhash64(F.col("doc_id"), F.octet_length("text")), F.lit(1_000_000_000))
    sample = docs.where(ticket < int(1_000_000_000 * min(1, ORDERED / max(1, rows)))).select("text")

    def count(batches):
        total = np.zeros(LEVELS, np.int64)
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for a, b in blocks(offsets):
                for elements in shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
                    for tag, _ in _tags(len(elements)):
                        np.add.at(total, (_tokens(elements, tag) % np.uint64(LEVELS)).astype(np.int64), 1)
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(total[slot])], names=["slot", "n"])

    counted = sample.coalesce(shuffle_width(docs.sparkSession)).mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(LEVELS)
    total[counted.column("slot").to_numpy()] = counted.column("n").to_numpy()
    return (4 * np.log2(np.maximum(1, total / max(1.0, 2 * total.mean())))).astype(np.uint8)


def _sign(level: np.ndarray):
    """A pass that gives (signature, digest) of the sets of a partition, each set once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for a, b in blocks(offsets):
                found, owner = [], []
                for elements in shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
                    if not len(elements) or (digest := digest_of(elements)) in seen:
                        continue
                    if len(seen) >= KNOWN:
                        seen.clear()  # a set signed twice only repeats rows
                    seen.add(digest)
                    found.append(signatures(elements, level))
                    owner.append(digest)
                if found:
                    digests = np.repeat(np.array(owner, np.int64), [len(f) for f in found])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(digests)], names=["signature", "digest"])

    return run


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_shingles, digest (null for an empty set) and parity bits of every row."""
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        size, digest, parity = [], [], []
        for a, b in blocks(offsets):
            for elements in shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
                size.append(len(elements))
                digest.append(digest_of(elements) if len(elements) else None)
                parity.append(parity_of(elements))
        columns = [batch.column("doc_id").cast(pa.int64()), pa.array(size, pa.int64()), pa.array(digest, pa.int64()), pa.array(parity, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "digest", "parity"])


# ---- buckets ------------------------------------------------------------------------


def _bucket_rows(signature: np.ndarray, digest: np.ndarray, known: set[int]) -> pa.RecordBatch | None:
    """Rows (bucket, digest) of the buckets with two classes and more, once per set of members."""
    fresh = np.ones(len(digest), bool)
    fresh[1:] = (signature[1:] != signature[:-1]) | (digest[1:] != digest[:-1])
    signature, digest = signature[fresh], digest[fresh]
    starts = np.flatnonzero(np.concatenate([[True], signature[1:] != signature[:-1]]))
    sizes = np.diff(np.append(starts, len(signature)))
    names = mix(np.add.reduceat(mix(digest.view(np.uint64)), starts)).view(np.int64)
    _, first = np.unique(names, return_index=True)
    wanted = np.zeros(len(starts), bool)
    wanted[first] = True
    wanted &= sizes > 1
    at = np.flatnonzero(wanted)
    at = at[[int(n) not in known for n in names[at]]] if len(at) else at
    if not len(at):
        return None
    if len(known) > KNOWN:
        known.clear()  # a bucket named twice only repeats rows
    known.update(names[at].tolist())
    keep = np.repeat(np.isin(np.arange(len(starts)), at), sizes)
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(names[at], sizes[at])), pa.array(digest[keep])], names=["bucket", "digest"])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (signature, digest); a bucket may span any number of batches.

    The open bucket is held back until its end.  Beyond ``HELD`` rows it goes out
    as it comes, under its signature.
    """
    known: set[int] = set()
    held_s, held_d = np.zeros(0, np.int64), np.zeros(0, np.int64)
    streaming: int | None = None
    for batch in batches:
        s = np.concatenate([held_s, batch.column("signature").to_numpy()])
        d = np.concatenate([held_d, batch.column("digest").to_numpy()])
        if not len(s):
            continue
        if streaming is not None:
            n = int(np.searchsorted(s, streaming, "right")) if s[0] == streaming else 0
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(s[:n]), pa.array(d[:n])], names=["bucket", "digest"])
            s, d = s[n:], d[n:]
            if not len(s):
                held_s, held_d = s, d
                continue
            streaming = None
        last = int(np.searchsorted(s, s[-1], "left"))
        if last and (rows := _bucket_rows(s[:last], d[:last], known)) is not None:
            yield rows
        held_s, held_d = s[last:], d[last:]
        if len(held_s) > HELD:
            streaming = int(held_s[0])
            yield pa.RecordBatch.from_arrays([pa.array(held_s), pa.array(held_d)], names=["bucket", "digest"])
            held_s, held_d = held_s[:0], held_d[:0]
    if len(held_s) and streaming is None and (rows := _bucket_rows(held_s, held_d, known)) is not None:
        yield rows


def _met(signed: DataFrame) -> DataFrame:
    """bucket, digest: the classes that share signatures."""
    ordered = signed.repartition(shuffle_width(signed.sparkSession), "signature").sortWithinPartitions("signature", "digest")
    return cut_lineage(ordered.mapInArrow(_gather, "bucket long, digest long").distinct())


def buckets(docs: DataFrame) -> DataFrame:
    return _met(docs.select("text").mapInArrow(_sign(token_order(docs)), "signature long, digest long"))


# ---- verification -------------------------------------------------------------------


def _slot(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(SLOTS))


def _chosen_sets(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id, digest and elements of the documents of ``chosen`` (digest, doc_id), and of few others.

    A bit map of fixed size over the hashed ids of those documents goes to the
    tasks, which build sets only for documents in it.
    """
    marked = chosen.select(_slot(F.col("doc_id")).alias("slot")).groupBy(F.floor(F.col("slot") / 63).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot % 63 AS INT))")).alias("bits")).toArrow()
    bits = np.zeros(SLOTS // 63 + 1, np.int64)
    bits[marked.column("word").to_numpy()] = marked.column("bits").to_numpy()

    def build(batches):
        for batch in batches:
            slot = batch.column("slot").to_numpy()
            rows = np.flatnonzero((bits[slot // 63] >> (slot % 63)) & 1)
            if not len(rows):
                continue
            own = batch.take(pa.array(rows))
            data, offsets = text_buffer(own.column("text"))
            for a, b in blocks(offsets):
                sets = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                columns = [
                    own.column("doc_id").slice(a, b - a).cast(pa.int64()),
                    pa.array([digest_of(e) if len(e) else None for e in sets], pa.int64()),
                    pa.array([e.view(np.int64) for e in sets], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "elements"])

    return docs.select("doc_id", "text", _slot(F.col("doc_id")).alias("slot")).mapInArrow(build, "doc_id long, digest long, elements array<long>")


def _chosen(classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """digest and doc_id: one document of each wanted class."""
    return cut_lineage(classes.join(wanted, "digest", "left_semi").select("digest", F.col("least_id").alias("doc_id")))


def class_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """digest and elements of the wanted classes, each once."""
    chosen = _chosen(classes, wanted)
    built = _chosen_sets(docs, chosen)
    exact = built.join(chosen, (built["doc_id"].eqNullSafe(chosen["doc_id"])) & (built["digest"] == chosen["digest"]), "left_semi")
    return exact.dropDuplicates(["digest"]).select("digest", "elements")


def _flips(x: Column, y: Column) -> Column:
    """Differing parity bits, the longer array folded onto the shorter one."""
    folded = lambda v, w: F.when(F.size(v) > F.size(w), F.zip_with(F.slice(v, F.lit(1), (F.size(v) / 2).cast("int")), F.slice(v, (F.size(v) / 2).cast("int") + 1, (F.size(v) / 2).cast("int")), lambda p, q: p.bitwiseXOR(q))).otherwise(v)
    return F.aggregate(F.zip_with(folded(x, y), folded(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, n: s + n)


def _possible(x: str, y: str) -> Column:
    """A bound that no similar pair breaks: sizes, and parity bits flipped by differing elements.

    Similar sizes have bit counts that differ by a factor of two at most.
    """
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    close = 4 * F.least(n, m) >= 3 * F.greatest(n, m)
    return F.when(close, 7 * _flips(F.col(f"{x}.parity"), F.col(f"{y}.parity")) <= n + m).otherwise(False)


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b), already within the bound, whose sets have 100 * intersection >= 75 * union."""
    pairs = cut_lineage(pairs)
    if not pairs.limit(1).count():
        return pairs
    sets = cut_lineage(class_sets(docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct()))
    of = lambda x: sets.select(F.col("digest").alias(x), F.col("elements").alias(f"{x}_set"))
    met = pairs.join(of("a"), "a").join(of("b"), "b")
    common = F.size(F.array_intersect("a_set", "b_set"))
    union = F.size("a_set") + F.size("b_set") - common
    return cut_lineage(met.where(100 * common >= 75 * union).select("a", "b"))


def _bounded(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) that can be similar by size and parity."""
    of = lambda x: classes.select(F.col("digest").alias(x), F.struct("n", "parity").alias(f"of_{x}"))
    met = pairs.distinct().join(of("a"), "a").join(of("b"), "b")
    return met.where(_possible("of_a", "of_b")).select("a", "b")


def _labelled(found: DataFrame, labels: DataFrame) -> DataFrame:
    met = found.join(labels.withColumnRenamed("node", "digest"), "digest", "left")
    return met.withColumn("label", F.coalesce("label", "digest"))


# ---- links --------------------------------------------------------------------------


def hubs(found: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: each class with the hub within the bound it shares most buckets with; a bucket's hub is its first member by hash."""
    order = F.struct(F.xxhash64("digest").alias("h"), "digest")
    of = found.groupBy("bucket").agg(F.min(order).alias("first")).select("bucket", F.col("first.digest").alias("hub"))
    shared = found.join(of, "bucket").where("digest <> hub").groupBy("digest", "hub").agg(F.count(F.lit(1)).alias("n"))
    side = lambda x, name: classes.select(F.col("digest").alias(x), F.struct("n", "parity").alias(name))
    near = shared.join(side("digest", "of_a"), "digest").join(side("hub", "of_b"), "hub").where(_possible("of_a", "of_b"))
    best = near.groupBy("digest").agg(F.max(F.struct("n", "hub")).alias("best")).select("digest", F.col("best.hub").alias("hub"))
    return best.select(F.least("digest", "hub").alias("a"), F.greatest("digest", "hub").alias("b")).distinct()


def _mixed(found: DataFrame, labels: DataFrame) -> DataFrame:
    """bucket, digest, label, size: the buckets that hold several components."""
    named = _labelled(found, labels)
    several = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high").select("bucket", "size")
    return cut_lineage(named.join(several, "bucket").select("bucket", "digest", "label", "size"))


def _steps(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of all pairs within runs of rows, by distance."""
    last = np.repeat(ends, ends - starts)
    i, step = np.arange(len(last)), 1
    while len(i := i[i + step < last[i]]):
        yield i, i + step
        step += 1


def _pairs_of(columns: dict[str, np.ndarray], parity: pa.Array | None, best: bool) -> pa.RecordBatch:
    """Pairs (a, b) of sorted runs of rows: between components, of fitting sizes, within the parity bound where parities are given.

    With ``best`` one pair of each component and run, that of the fewest flips or nearest sizes.
    """
    key, n, label, digest = (columns[c] for c in ("key", "n", "label", "digest"))
    order = np.lexsort((n, key))
    key, n, label, digest = key[order], n[order], label[order], digest[order]
    part, crossed = columns["part"][order], columns["crossed"][order]
    edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    if parity is not None:
        flat, at = parity.flatten().to_numpy().view(np.uint64), parity.offsets.to_numpy().astype(np.int64)
        at -= at[0]
        width, begin = np.diff(at)[order], at[:-1][order]
    kept: list[np.ndarray] = []

    def flips_of(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for w in np.unique(width[i]):
            for v in (w, 2 * w):
                rows = np.flatnonzero((width[i] == w) & (width[j] == v))
                if len(rows):
                    x = flat[begin[i[rows]][:, None] + np.arange(w)]
                    y = flat[begin[j[rows]][:, None] + np.arange(v)]
                    y = y if v == w else y[:, :w] ^ y[:, w:]
                    out[rows] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
        return out

    def reduce(rows: np.ndarray) -> np.ndarray:
        run, of = np.tile(key[rows[0]], 2), np.concatenate([label[rows[0]], label[rows[1]]])
        rank = np.lexsort((np.tile(rows[2], 2), of, run))
        run, of = run[rank], of[rank]
        first = np.concatenate([[True], (run[1:] != run[:-1]) | (of[1:] != of[:-1])])
        return rows[:, np.unique(rank[first] % rows.shape[1])]

    held = 0
    for i, j in _steps(edges[:-1], edges[1:]):
        fits = (label[i] != label[j]) & (4 * n[i] >= 3 * n[j])
        fits &= ~crossed[i] | (part[i] != part[j])
        i, j = i[fits], j[fits]
        if not len(i):
            continue
        cost = 1000 * (n[j] - n[i]) // n[j]
        if parity is not None:
            flips = flips_of(i, j)
            near = 7 * flips <= n[i] + n[j]
            i, j, cost = i[near], j[near], 1000 * flips[near] // n[j[near]]
        kept.append(np.stack([i, j, cost]))
        held += len(i)
        if best and held > 500_000:
            kept = [reduce(np.concatenate(kept, axis=1))]
            held = 0
    rows = np.concatenate(kept, axis=1) if kept else np.zeros((3, 0), np.int64)
    if best and rows.shape[1]:
        rows = reduce(rows)
    a, b = np.minimum(digest[rows[0]], digest[rows[1]]), np.maximum(digest[rows[0]], digest[rows[1]])
    pairs = np.unique(np.stack([a, b]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])


def _compare(best: bool):
    """A pass over rows sorted by ``cell``; a cell, of a bounded number of rows, may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def done(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            columns = {c: rows.column(c).to_numpy() for c in ("n", "label", "digest", "part", "crossed")}
            columns["key"] = rows.column("cell").to_numpy()
            parity = rows.column("parity").combine_chunks() if "parity" in rows.column_names else None
            return _pairs_of(columns, parity.chunk(0) if isinstance(parity, pa.ChunkedArray) else parity, best)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            cell = held.column("cell").to_numpy()
            last = int(np.searchsorted(cell, cell[-1], "left"))
            if last:
                yield done(held.slice(0, last))
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield done(held)

    return run


def across(found: DataFrame, classes: DataFrame, best: bool) -> DataFrame:
    """Distinct candidate pairs (a, b) between components within mixed buckets."""
    schema = "a long, b long"
    width = shuffle_width(found.sparkSession)
    small = found.where(F.col("size") <= SMALL).join(classes.select("digest", "n"), "digest")
    small = small.select(F.col("bucket").alias("cell"), "digest", "label", "n", F.lit(0).cast("long").alias("part"), F.lit(False).alias("crossed"))
    large = found.where(F.col("size") > SMALL).withColumn("parts", F.ceil(F.col("size") / CELL))
    dealt = large.withColumn("part", F.pmod(F.xxhash64("digest", F.lit(9)), F.col("parts")))
    celled = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    row, column = F.least("part", "other"), F.greatest("part", "other")
    cell = F.when(F.col("parts") == 1, F.col("bucket")).otherwise(F.xxhash64("bucket", row, column))
    celled = celled.select(cell.alias("cell"), "digest", "label", "part", (row != column).alias("crossed")).join(classes.select("digest", "n", "parity"), "digest")
    compared = [d.repartition(width, "cell").sortWithinPartitions("cell").mapInArrow(_compare(best), schema) for d in (small, celled)]
    return cut_lineage(compared[0].union(compared[1]).distinct())


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between classes that give the components of all links."""
    found = buckets(docs)
    good = verified(hubs(found, classes), docs, classes)
    for best in (True, False):
        found = _mixed(found, components(good))
        more = verified(_bounded(across(found, classes, best), classes), docs, classes)
        good = cut_lineage(good.union(more))
        found = found.select("bucket", "digest")
    return good


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    described = cut_lineage(docs.select("doc_id", "text").mapInArrow(_describe, "doc_id long, n_shingles long, digest long, parity array<long>"))
    classes = described.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("least_id"), F.min("n_shingles").alias("n"), F.min("parity").alias("parity"))
    classes = cut_lineage(classes)
    labels = components(links(docs, classes))
    named = _labelled(classes, labels)
    least = named.groupBy("label").agg(F.min("least_id").alias("component_id"))
    of_class = named.join(least, "label").select("digest", "component_id")
    met = described.join(of_class, "digest", "left")
    return met.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
