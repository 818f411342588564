"""Benchmark decontamination by latent semantic retrieval.

Words are runs of letters and digits, hashed to ``FEATURES`` features.  Passages
are windows over the whole text of every document, in a few lengths: an item is
searched with windows it fills (``FROM_WORDS``), so that a short one does not drown
in the text around it.  Documents give windows with the steps ``STEPS``, items with
``ITEM_STEPS``, so that the two grids meet within a few words.  Weights are TF-IDF
with document frequencies counted over all documents.

A randomised SVD of the TF-IDF matrix of the ``WINDOW`` word passages of all documents and
items gives ``RANK`` latent directions.  The words of every text are stored once as
features, with the lengths of their passages; each of the ``POWER`` + 1 rounds goes over all of them, multiplies A^T (A Q)
for its part, a matrix of fixed size per task (three tasks a core), which tasks add up in ``SLICES`` slices;
the driver orthonormalises the one sum.  The last round needs (A Q)^T (A Q) alone.  Directions are scaled to
equal variance, so rare directions count as much as common ones.

Every passage is then projected and compared by cosine with all benchmark windows
of its length in blocks.  Pairs of document and item above ``COSINE`` whose passage has at least
``KNOWN_SHARE`` of its weight in words of the item are candidates and are checked
on words: the longest common subsequence of the item with the stretch of
the document around the passage must cover ``COVER`` of the item's words, and its
answer (the item's last words) must be there to ``ANSWER``.  Both leave room for
paraphrases.

The benchmark is the stated query set and goes to every task; its size is
checked first, and a larger one is worked through in parts of ``PART`` items.

Cases: null and empty texts have no passage; a text or an item shorter than a
window is one window; items of fewer than ``LEAST`` words are not searched;
repeated items each report; repeated rows give repeated rows; an empty documents
or benchmark table gives no row; further columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import NOT_ALNUM, blocks, cut_lineage, table, text_buffer, word_hashes

FEATURES = 1 << 14
WINDOW, STEP, ITEM_STEP = 24, 12, 8
# Window length of each class of items, with its steps in documents and in items, and the least words of its items.
STEPS = {8: 4, 12: 4, 16: 4, WINDOW: STEP}
ITEM_STEPS = {8: 1, 12: 2, 16: 4, WINDOW: ITEM_STEP}
FROM_WORDS = {8: 0, 12: 12, 16: 16, WINDOW: 30}
RANK, EXTRA, POWER = 48, 16, 2
SLICES = 32
# Bytes of texts that a task cuts and searches, and of features that it multiplies, at a time.
PIECE = 1 << 18
SPAN = 1 << 20
GROUP = 8
# Rows of sums made at a time, few enough to stay in a core's cache.
ROWS = 512
# Words on both sides of an item's place that its checks look at, too.
SLACK = WINDOW // 2
# Both filters come before the word checks; set from the recall they leave (README).
COSINE = 0.45
KNOWN_SHARE = 0.35
COVER, ANSWER, ANSWER_WORDS = 0.6, 0.5, 8
LEAST = 8
PART = 2000
SCHEMA = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double, start_word int"


def _words(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row range, word hashes and word bounds of pieces of a batch."""
    data, offsets = text_buffer(batch.column("text"))
    for a, b in blocks(offsets, PIECE):
        words, bounds = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], NOT_ALNUM)
        yield a, b, words, bounds


def features_of(words: np.ndarray) -> np.ndarray:
    return (words & np.uint64(FEATURES - 1)).astype(np.int64)


def window_starts(n: int, step: int = STEP, window: int = WINDOW) -> np.ndarray:
    """Starts of the windows over n words; the last one ends with the text."""
    if n <= window:
        return np.zeros(min(n, 1), np.int64)
    return np.unique(np.append(np.arange(0, n - window + 1, step), n - window))


def length_class(n: int) -> int:
    """Window length for an item of n words."""
    return max(w for w, least in FROM_WORDS.items() if n >= least)


# ---- corpus statistics and the latent space -----------------------------------------


def stored_features(texts: DataFrame) -> DataFrame:
    """The features of all words of each text in order, two bytes a word, stored for the rounds over them."""

    def cut(batches):
        for batch in batches:
            for _, _, words, bounds in _words(batch):
                data = features_of(words).astype("<u2").tobytes()
                offsets = pa.py_buffer((bounds * 2).astype(np.int32))
                column = pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([column], names=["features"])

    return cut_lineage(texts.select("text").mapInArrow(cut, "features binary"))


def _spans(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row range, features and text bounds of pieces of a batch of stored features."""
    data, offsets = text_buffer(batch.column("features"))
    for a, b in blocks(offsets, SPAN):
        yield a, b, data[offsets[a] : offsets[b]].view("<u2").astype(np.int64), (offsets[a : b + 1] - offsets[a]) // 2


def document_frequencies(stored: DataFrame) -> tuple[np.ndarray, int]:
    """Documents per feature over the whole corpus; at most FEATURES rows reach the driver."""

    def count(batches):
        total, rows = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for _, _, features, bounds in _spans(batch):
                pairs = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) * FEATURES + features
                pairs.sort()
                new = np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)]
                total += np.bincount(pairs[new] % FEATURES, minlength=FEATURES)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(total[used], rows))], names=["feature", "documents"])

    got = stored.mapInArrow(count, "feature long, documents long").groupBy("feature").agg(F.sum("documents").alias("n")).collect()
    out, rows = np.zeros(FEATURES), 0
    for r in got:
        if r["feature"] < 0:
            rows = r["n"]
        else:
            out[r["feature"]] = r["n"]
    return out, rows


def _flat(rows: list) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(r) for r in rows], np.int64)
    return (np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])


def project(features: np.ndarray, bounds: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Sum of the matrix rows of each window."""
    if len(bounds) < 2:
        return np.zeros((0, matrix.shape[1]), matrix.dtype)
    return np.add.reduceat(matrix[features], bounds[:-1], axis=0)


def text_blocks(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all blocks of ``STEP`` words, whether each goes on with the next one, and whether a passage begins with it.

    Passages are pairs of neighbouring blocks, so the last one of a text is shorter; a text of one block is one passage.
    """
    per_row = -(-np.diff(bounds) // STEP)
    row = np.repeat(np.arange(len(per_row)), per_row)
    starts = bounds[row] + (np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)) * STEP
    paired = np.append(row[1:] == row[:-1], False)[: len(row)]
    return starts, np.minimum(starts + STEP, bounds[row + 1]), paired, paired | (per_row[row] == 1)


def square_norms(features: np.ndarray, bounds: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Squared length of the TF-IDF row of the passage that begins with each block, infinite where none does.

    A word that a passage repeats counts with the square of its number.
    """
    starts, ends, paired, first = text_blocks(bounds)
    block, short, each = np.repeat(np.arange(len(starts)), ends - starts), features.astype(np.uint16), squares.take(features)
    own = np.bincount(block, each, len(starts))
    # (a + b)^2 = a^2 + b^2 + 2ab: each two equal words of one passage add twice their square.
    same = [np.flatnonzero(short[apart:] == short[:-apart]) for apart in range(1, min(2 * STEP, len(short)))]
    left = np.concatenate([np.zeros(0, np.int64), *same])
    at, twice = block.take(left), 2 * each.take(left)
    blocks_apart = block.take(left + np.repeat(np.arange(1, len(same) + 1), [len(x) for x in same])) - at
    within, across = blocks_apart == 0, blocks_apart == 1
    own += np.bincount(at[within], twice[within], len(starts))
    # Without any words to count it gives integers.
    both = np.bincount(at[across], twice[across], len(starts)).astype(np.float64)
    both[:-1] += own[1:]
    return np.where(first, own + np.where(paired, both, 0.0), np.inf).astype(np.float32)


def with_norms(stored: DataFrame, idf: np.ndarray) -> DataFrame:
    """Stored features with ``square_norms`` of each text, four bytes a passage."""
    squares = idf.astype(np.float32).astype(np.float64) ** 2

    def add(batches):
        for batch in batches:
            for a, b, features, bounds in _spans(batch):
                norms = square_norms(features, bounds, squares).astype("<f4").tobytes()
                offsets = np.append(0, np.cumsum(-(-np.diff(bounds) // STEP))) * 4
                column = pa.BinaryArray.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(norms)])
                yield pa.RecordBatch.from_arrays([batch.column("features").slice(a, b - a), column], names=["features", "norms"])

    return stored.mapInArrow(add, "features binary, norms binary")


def passage_products(features: np.ndarray, bounds: np.ndarray, norms: np.ndarray, weighted: np.ndarray, out: np.ndarray, last: bool) -> int:
    """Adds A^T (A Q), transposed and without the weights of A^T, over all passages of a piece of texts; returns their number.

    For the ``last`` round it adds (A Q)^T (A Q).  Rows have unit length: no passage,
    whatever it repeats, weighs more than another.  ``weighted`` has one
    more row, zero, for places behind a text.
    """
    if not len(features):
        return 0
    starts, ends, paired, first = text_blocks(bounds)
    padded = np.append(features, np.full(STEP, FEATURES))
    sums = np.zeros((len(starts) + 1, weighted.shape[1]), np.float32)
    for lo in range(0, len(starts), ROWS):
        hi = min(lo + ROWS, len(starts))
        sums[lo:hi] = window_sums(padded, starts[lo:hi], ends[lo:hi], STEP, weighted)
    goes_on = paired.astype(np.float32)[:, None]
    scale = (np.sqrt(norms) if last else norms)[:, None]
    # Each word gets the products of the passages it stands in: those of its block.  A block that no passage begins with gives zero.
    back = np.zeros_like(sums)
    for lo in range(0, len(starts), ROWS):
        hi = min(lo + ROWS, len(starts))
        y = sums[lo + 1 : hi + 1] * goes_on[lo:hi]
        y += sums[lo:hi]
        y /= scale[lo:hi]
        if last:
            out += y.T @ y
            continue
        back[lo:hi] += y
        y *= goes_on[lo:hi]
        back[lo + 1 : hi + 1] += y
    if last:
        return int(first.sum())
    # Words in the order of their features, summed in groups of GROUP words of one feature and then by feature.
    order = np.argsort(features.astype(np.uint16), kind="stable")
    block = np.append(np.repeat(np.arange(len(starts)), ends - starts)[order], np.zeros(GROUP, np.int64))
    times = np.bincount(features, minlength=FEATURES)
    groups = -(-times // GROUP)
    of = np.repeat(np.arange(FEATURES), groups)
    ahead = np.cumsum(times) - times
    at = ahead[of] + (np.arange(len(of)) - np.repeat(np.cumsum(groups) - groups, groups)) * GROUP
    until = np.minimum(at + GROUP, (ahead + times)[of])
    for lo in range(0, len(of), ROWS):
        own = of[lo : lo + ROWS]
        new = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        totals = window_sums(block, at[lo : lo + ROWS], until[lo : lo + ROWS], GROUP, back)
        out.T[own[new]] += np.add.reduceat(totals, new, axis=0, dtype=np.float64)
    return int(first.sum())


def _product(stored: DataFrame, idf: np.ndarray, q: np.ndarray, last: bool = False) -> tuple[np.ndarray, int]:
    """A^T (A Q), for the ``last`` round (A Q)^T (A Q), over all passages and their number; tasks add up the parts of the tasks, slice by slice."""
    width = q.shape[1]
    rows, slices = (width, 1) if last else (FEATURES, SLICES)
    size = rows // slices
    weights = idf.astype(np.float32)[:, None]
    weighted = np.vstack([q * weights, np.zeros((1, width))]).astype(np.float32)
    if "norms" not in stored.columns:
        stored = with_norms(stored, idf)

    def multiply(batches):
        out, passages = np.zeros((rows, width)).T, 0
        for batch in batches:
            data, offsets = text_buffer(batch.column("norms"))
            for a, b, features, bounds in _spans(batch):
                norms = data[offsets[a] : offsets[b]].view("<f4").astype(np.float32)
                passages += passage_products(features, bounds, norms, weighted, out, last)
        if passages:
            sums = (out.T if last else out.T * weights).astype(np.float32)
            part, sums = TaskContext.get().partitionId(), sums.reshape(slices, size * width)
            columns = [pa.array(range(slices)), pa.array([part] * slices), pa.array([s.tobytes() for s in sums], pa.binary()), pa.array([passages] * slices)]
            yield pa.RecordBatch.from_arrays(columns, names=["slice", "part", "sums", "passages"])

    def add(batches):
        totals: dict[int, list] = {}
        for batch in batches:
            for at, sums, passages in zip(batch.column("slice").to_pylist(), batch.column("sums"), batch.column("passages").to_pylist()):
                own = totals.setdefault(at, [np.zeros(size * width), 0])
                own[0] += np.frombuffer(sums.as_buffer(), np.float32)
                own[1] += passages
        columns = [pa.array(list(totals), pa.int64()), pa.array([t[0].tobytes() for t in totals.values()], pa.binary()), pa.array([t[1] for t in totals.values()], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["slice", "sums", "passages"])

    parts = stored.mapInArrow(multiply, "slice long, part long, sums binary, passages long")
    # In the order of the tasks, so reruns add up the same.
    dealt = parts.repartition(slices, "slice").sortWithinPartitions("slice", "part")
    got = dealt.mapInArrow(add, "slice long, sums binary, passages long").collect()
    total, passages = np.zeros((slices, size * width)), 0
    for r in got:
        total[r["slice"]], passages = np.frombuffer(r["sums"]), r["passages"]
    return total.reshape(rows, width), passages


def latent_space(stored: DataFrame, idf: np.ndarray, rank: int = RANK, seed: int = 11) -> np.ndarray:
    """FEATURES x rank matrix, IDF and scaling included, by distributed randomised SVD over all passages."""
    # A task's sums have a fixed size: a few tasks a core, whatever the number of files, bound what is shuffled.
    stored = cut_lineage(with_norms(stored, idf)).coalesce(3 * stored.sparkSession.sparkContext.defaultParallelism)
    q = np.random.default_rng(seed).standard_normal((FEATURES, rank + EXTRA)).astype(np.float32)
    for _ in range(POWER):
        total, passages = _product(stored, idf, q)
        if not passages:
            return np.zeros((FEATURES, rank), np.float32)
        q = np.linalg.qr(total)[0].astype(np.float32)
    # One more product gives A^T A in the basis q; its eigenvectors are the right singular vectors.
    total, passages = _product(stored, idf, q, True)
    values, vectors = np.linalg.eigh(total)
    order = np.argsort(-values)[:rank]
    scale = np.sqrt(np.maximum(values[order], 1e-9) / passages)
    return ((q @ vectors[:, order]) / np.maximum(scale, 1e-6) * idf[:, None]).astype(np.float32)


# ---- search and checks --------------------------------------------------------------


def places_of(a: list[int]) -> dict[int, int]:
    """Bits of the places of each word."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    return places


def lcs_length(a: list[int], b: list[int], places: dict[int, int] | None = None) -> int:
    """Longest common subsequence by bit-parallel rows; words of ``b`` outside ``a`` change no row."""
    full, row = (1 << len(a)) - 1, (1 << len(a)) - 1
    for of in filter(None, map((places_of(a) if places is None else places).get, b)):
        m = row & of
        row = (row + m | row - m) & full
    return len(a) - row.bit_count()


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


class Items:
    """Benchmark items with their windows in the latent space."""

    def __init__(self, ids: list[int], words: list[np.ndarray], space: np.ndarray, idf: np.ndarray):
        self.ids, self.words = ids, [w.tolist() for w in words]
        self.places = [places_of(w) for w in self.words]
        self.idf = idf.astype(np.float32)
        # Which features an item has: FEATURES bits an item.
        self.has = np.zeros((len(ids), FEATURES), bool)
        for mine, w in zip(self.has, words):
            mine[features_of(w)] = True
        # Windows of each item's own length class: latent units, item, start.
        self.classes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        lengths = np.array([length_class(len(w)) for w in words], np.int64)
        for window in np.unique(lengths).tolist():
            mine = np.flatnonzero(lengths == window)
            starts = [window_starts(len(words[i]), ITEM_STEPS[window], window) for i in mine]
            features, bounds = _flat([features_of(words[i][s : s + window]) for i, own in zip(mine, starts) for s in own])
            units = _units(project(features, bounds, space)).astype(np.float32)
            self.classes[window] = (units, np.repeat(mine, [len(s) for s in starts]), np.concatenate(starts))
        # Features that any item of a class has.
        self.vocabulary = {window: self.has[np.unique(owner)].any(0) for window, (_, owner, _) in self.classes.items()}

    def shares(self, windows: np.ndarray, of: np.ndarray, owners: np.ndarray) -> np.ndarray:
        """Part of the weight of the window ``of`` each pair in words that the item has, too."""
        weight = self.idf.take(windows)
        known = self.has.ravel().take(owners[:, None] * FEATURES + windows.take(of, axis=0))
        return (weight.take(of, axis=0) * known).sum(1) / weight.sum(1).take(of)

    def hopeless(self, item: int, document: list[int], begins: list[int]) -> set[int]:
        """Begins of an item in a document whose stretches cannot cover it, told of neighbours at once.

        A common subsequence with a stretch is one with all that lies around it, too.
        """
        own, out = self.words[item], set()
        begins, at = sorted(begins), 0
        while at < len(begins):
            end = bisect_right(begins, begins[at] + len(own) // 2)
            if end - at > 1:
                around = document[max(0, begins[at] - SLACK) : begins[end - 1] + len(own) + SLACK]
                if lcs_length(own, around, self.places[item]) / len(own) < COVER:
                    out.update(begins[at:end])
            at = end
        return out

    def check(self, item: int, document: list[int], at: int, window_at: int) -> tuple[float, float, int]:
        """LCS and answer share of an item against the stretch of a document around a passage."""
        own = self.words[item]
        first = max(0, at - window_at - SLACK)
        stretch = document[first : at - window_at + len(own) + SLACK]
        share = lcs_length(own, stretch, self.places[item]) / len(own)
        if share < COVER:
            return share, 0.0, first
        answer = own[-min(ANSWER_WORDS, max(1, len(own) // 3)) :]
        return share, lcs_length(answer, stretch) / len(answer), first


def grid_windows(bounds: np.ndarray, window: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of all windows of one length over the texts of a piece, as ``window_starts`` places them."""
    size = np.diff(bounds)
    on_grid = np.where(size >= window, (size - window) // step + 1, size > 0)
    row = np.repeat(np.arange(len(size)), on_grid)
    place = (np.arange(len(row)) - np.repeat(np.cumsum(on_grid) - on_grid, on_grid)) * step
    # One more window ends with a text that the grid does not fill.
    rest = np.flatnonzero((size > window) & ((size - window) % step != 0))
    rows = np.concatenate([row, rest])
    starts = np.concatenate([bounds[row] + place, bounds[rest + 1] - window])
    return starts, np.minimum(starts + window, bounds[rows + 1]), rows


def window_sums(features: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int, space: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``space`` named by windows of ``features``, place by place; its last row is zero and stands behind an end.

    ``features`` goes on for a window behind the last end.
    """
    at = starts + np.arange(window)[:, None]
    sums, rows = np.zeros((2, len(starts), space.shape[1]), space.dtype)
    for place in np.where(at < ends, features.take(at), len(space) - 1):
        # All places are there; clipping them only saves a copy.
        sums += space.take(place, axis=0, out=rows, mode="clip")
    return sums


def _near(features: np.ndarray, weights: tuple[np.ndarray, np.ndarray], bounds: np.ndarray, items: Items, space: np.ndarray, window: int, cosine: float, best: dict) -> None:
    """Adds to ``best`` the pairs of a window and an item window of one length that pass both filters."""
    starts, ends, row = grid_windows(bounds, window, STEPS[window])
    units, owner, at = items.classes[window]
    # No item knows more of a window than all items together: what they do not know enough is not projected.
    known, total = (sums[ends] - sums[starts] for sums in weights)
    open_ = np.flatnonzero((known >= (KNOWN_SHARE - 1e-4) * total) | (ends - starts < window))
    for lo in range(0, len(open_), ROWS):
        of_block = open_[lo : lo + ROWS]
        s, e, r = starts[of_block], ends[of_block], row[of_block]
        likeness = _units(window_sums(features, s, e, window, space)) @ units.T
        flat = np.flatnonzero(likeness >= cosine)
        if not len(flat):
            continue
        near, of = np.divmod(flat, likeness.shape[1])
        # A short text's window is filled up with its own words.
        inside = s[:, None] + np.arange(window) % (e - s)[:, None]
        # Neighbouring pairs of a window and one item have one share.
        item = owner[of]
        new = np.append(True, (near[1:] != near[:-1]) | (item[1:] != item[:-1]))
        known = (items.shares(features[inside], near[new], item[new]) >= KNOWN_SHARE)[np.cumsum(new) - 1]
        near, of = near[known], of[known]
        for row_, item, *hit in zip(*(x.tolist() for x in (r[near], owner[of], -likeness[near, of], s[near], at[of]))):
            best.setdefault((row_, item), []).append(tuple(hit))


def search_words(words: np.ndarray, bounds: np.ndarray, items: Items, space: np.ndarray, cosine: float) -> list[tuple]:
    """(row, item, cosine, lcs share, answer share, start) of the confirmed pairs of a piece of texts; ``space`` ends with a row of zeros."""
    if not len(words):
        return []
    features = np.append(features_of(words), np.full(WINDOW, FEATURES))
    weight = items.idf[features[:-WINDOW]].astype(np.float64)
    total = np.append(0.0, np.cumsum(weight))
    best: dict[tuple[int, int], list] = {}
    for window, mine in items.vocabulary.items():
        known = np.append(0.0, np.cumsum(weight * mine[features[:-WINDOW]]))
        _near(features, (known, total), bounds, items, space, window, cosine, best)
    out = []
    documents: dict[int, list[int]] = {}
    for (r, item), hits in best.items():
        if r not in documents:
            documents[r] = words[bounds[r] : bounds[r + 1]].tolist()
        start = int(bounds[r])
        top, seen = None, {start + begin for begin in items.hopeless(item, documents[r], list({s - start - window_at for _, s, window_at in hits}))}
        for like, s, window_at in sorted(hits):
            # Windows in step show the same stretch; the first has the best cosine.
            if s - window_at in seen:
                continue
            seen.add(s - window_at)
            lcs, answer, first = items.check(item, documents[r], s - start, window_at)
            if lcs >= COVER and answer >= ANSWER and (top is None or lcs > top[1]):
                top = (-like, lcs, answer, first)
                if lcs == 1.0:
                    break
        if top:
            out.append((r, item, *top))
    return out


def benchmark_words(benchmark: DataFrame) -> DataFrame:
    """item_id and word hashes of the items long enough to search."""

    def hashed(batches):
        for batch in batches:
            for a, b, words, bounds in _words(batch):
                own = [words[x:y].view(np.int64) for x, y in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("item_id").slice(a, b - a).cast(pa.int64()), pa.array(own, pa.list_(pa.int64()))], names=["item_id", "words"])

    rows = benchmark.select("item_id", "text").mapInArrow(hashed, "item_id long, words array<long>")
    return rows.where(F.size("words") >= LEAST)


def contaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per document and item it holds, with the evidence."""
    listed = cut_lineage(benchmark_words(benchmark))
    n = listed.count()
    parts = max(1, -(-n // PART))
    stored = stored_features(docs)
    frequencies, rows = document_frequencies(stored)
    idf = np.log((1 + rows) / (1 + frequencies)) + 1
    space = latent_space(stored.unionByName(stored_features(benchmark)), idf)
    found = None
    for part in range(parts):
        # At most about PART items at a time, whatever the size of the benchmark.
        own = listed.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect()
        own = sorted(((r["item_id"], r["words"]) for r in own), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        more = _search(docs, [r[0] for r in own], [np.array(r[1], np.int64).view(np.uint64) for r in own], space, idf, cosine)
        found = more if found is None else found.unionByName(more)
    return found


def _search(docs: DataFrame, ids: list, words: list[np.ndarray], space: np.ndarray, idf: np.ndarray, cosine: float) -> DataFrame:
    def run(batches):
        items, padded = Items(ids, words, space, idf), np.vstack([space, np.zeros((1, space.shape[1]), space.dtype)])
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for a, _, hashes, bounds in _words(batch):
                hits = search_words(hashes, bounds, items, padded, cosine) if ids else []
                if hits:
                    columns = [[doc_ids[a + h[0]] for h in hits], [items.ids[h[1]] for h in hits], *([h[k] for h in hits] for k in range(2, 6))]
                    types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "item_id", "cosine", "lcs_share", "answer_share", "start_word"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
