"""Quality classifier: a byte-level convolutional network in numpy.

A text is its UTF-8 bytes.  Each byte has a learned vector; learned filters of
``WIDTH`` bytes slide over the text with step 2.  The responses are max-pooled
over blocks of ``BLOCK`` positions, blocks over overlapping chunks of 8 blocks
with step 7, which together cover the whole text.  A chunk is described by the
maximum and the mean of its block maxima (repetition lowers the mean of most
filters), a hidden layer turns that into a chunk logit, and the mean, the largest
and the smallest chunk logit combine into one probability.

The network is trained with Adam on a bounded sample of labelled rows
(``SAMPLE`` rows, evenly from both labels) by ``TRAIN_CHUNKS`` spread chunks
each, in one task; scoring goes over every byte of every text.

Cases: null and empty texts score like a text of padding bytes; very long texts
are convolved piece by piece; repeated rows give repeated rows; without labelled
rows every score is 0.5 and prediction 1; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import crc_fold, fit_once, labelled_sample, pack, table, text_buffer, unpack

SAMPLE = 3000
TRAIN_CHUNKS = 6
EPOCHS = 6
EMBED, WIDTH, STEP, FILTERS, HIDDEN = 8, 6, 2, 32, 16
BLOCK, CHUNK, CHUNK_STEP = 32, 8, 7
PIECE = BLOCK * 512
CHUNK_BYTES = (BLOCK * CHUNK - 1) * STEP + WIDTH
FOLDS, HELD_OUT = 3, 1


def start_model(seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    n = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    return {
        "embed": n(256, EMBED, scale=0.5),
        "filters": n(WIDTH * EMBED, FILTERS, scale=(2 / (WIDTH * EMBED)) ** 0.5),
        "bias": np.zeros(FILTERS, np.float32),
        "dense": n(2 * FILTERS, HIDDEN, scale=(1 / FILTERS) ** 0.5),
        "dense_bias": np.zeros(HIDDEN, np.float32),
        "out": n(HIDDEN, scale=HIDDEN**-0.5),
        "out_bias": np.zeros(1, np.float32),
        # mean, max, min of the chunk logits
        "combine": np.array([0.5, 0.25, 0.25], np.float32),
    }


def _windows(embedded: np.ndarray) -> np.ndarray:
    """(..., bytes, EMBED) to (..., positions, WIDTH * EMBED), contiguous for the matrix product."""
    positions = (embedded.shape[-2] - WIDTH) // STEP + 1
    lead, s = embedded.shape[:-2], embedded.strides
    view = np.lib.stride_tricks.as_strided(embedded, (*lead, positions, WIDTH * EMBED), (*s[:-2], STEP * s[-2], s[-1]))
    return np.ascontiguousarray(view)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _padded(data: np.ndarray) -> np.ndarray:
    """At least one window, and no byte behind the last one."""
    need = max(WIDTH, len(data))
    need += (need - WIDTH) % STEP
    return data if need == len(data) else np.concatenate([data, np.zeros(need - len(data), np.uint8)])


def chunk_starts(n_blocks: int) -> np.ndarray:
    """First block of each chunk; the last chunk reaches the last block."""
    return np.arange(0, max(1, n_blocks - (CHUNK - CHUNK_STEP)), CHUNK_STEP)


def score_bytes(data: np.ndarray, m: dict[str, np.ndarray]) -> float:
    """Probability of label 1 for one whole text."""
    data = _padded(data)
    positions = (len(data) - WIDTH) // STEP + 1
    maxima = []
    for first in range(0, positions, PIECE):
        last = min(positions, first + PIECE)
        piece = m["embed"][data[first * STEP : (last - 1) * STEP + WIDTH]]
        response = _windows(piece) @ m["filters"]
        maxima.append(np.maximum.reduceat(response, np.arange(0, last - first, BLOCK), axis=0))
    top = np.maximum(np.concatenate(maxima) + m["bias"], 0)
    starts = chunk_starts(len(top))
    member = starts[:, None] + np.arange(CHUNK)
    inside = member < len(top)
    of = top[np.minimum(member, len(top) - 1)]
    mean = (of * inside[..., None]).sum(1) / inside.sum(1)[:, None]
    hidden = np.tanh(np.concatenate([of.max(1), mean], 1) @ m["dense"] + m["dense_bias"])
    logits = hidden @ m["out"]
    a, b, c = m["combine"]
    return float(_sigmoid(a * logits.mean() + b * logits.max() + c * logits.min() + m["out_bias"][0]))


# ---- training -----------------------------------------------------------------------


def _training_chunks(text: str) -> np.ndarray:
    """TRAIN_CHUNKS spread chunks of a text as rows of bytes; a shorter text repeats its last."""
    data = np.frombuffer(text.encode(), np.uint8)
    last = max(0, len(data) - CHUNK_BYTES)
    starts = np.linspace(0, last, TRAIN_CHUNKS).astype(int) // STEP * STEP
    out = np.zeros((TRAIN_CHUNKS, CHUNK_BYTES), np.uint8)
    for row, s in zip(out, starts):
        own = data[s : s + CHUNK_BYTES]
        row[: len(own)] = own
    return out




def gradients(m, x, n_positions, y):
    """Loss and gradients for chunk bytes x (docs, chunks, bytes) with labels y."""
    docs, chunks, _ = x.shape
    flat = x.reshape(docs * chunks, -1)
    n_positions = np.repeat(n_positions, chunks)
    windows = _windows(m["embed"][flat])
    response = windows @ m["filters"]
    positions = response.shape[1]
    response[np.arange(positions)[None, :] >= n_positions[:, None]] = -1e9
    blocked = response.reshape(len(flat), CHUNK, BLOCK, FILTERS)
    where = blocked.argmax(2)
    best = np.take_along_axis(blocked, where[:, :, None], 2)[:, :, 0] + m["bias"]
    inside = (np.arange(CHUNK) * BLOCK)[None, :] < n_positions[:, None]
    top = np.maximum(best, 0) * inside[..., None]
    count = inside.sum(1)[:, None]
    peak = top.argmax(1)
    features = np.concatenate([np.take_along_axis(top, peak[:, None], 1)[:, 0], top.sum(1) / count], 1)
    hidden = np.tanh(features @ m["dense"] + m["dense_bias"])
    logits = (hidden @ m["out"]).reshape(docs, chunks)
    high, low = logits.argmax(1), logits.argmin(1)
    rows = np.arange(docs)
    parts = np.stack([logits.mean(1), logits[rows, high], logits[rows, low]], 1)
    p = _sigmoid(parts @ m["combine"] + m["out_bias"][0])
    loss = -np.mean(y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))
    d = ((p - y) / docs).astype(np.float32)
    g = {"combine": parts.T @ d, "out_bias": d.sum(keepdims=True)}
    d_logits = np.repeat((d * m["combine"][0] / chunks)[:, None], chunks, 1)
    d_logits[rows, high] += d * m["combine"][1]
    d_logits[rows, low] += d * m["combine"][2]
    d_logits = d_logits.reshape(-1)
    g["out"] = hidden.T @ d_logits
    d_hidden = d_logits[:, None] * m["out"] * (1 - hidden**2)
    g["dense"], g["dense_bias"] = features.T @ d_hidden, d_hidden.sum(0)
    d_features = d_hidden @ m["dense"].T
    d_top = np.repeat((d_features[:, FILTERS:] / count)[:, None], CHUNK, 1)
    at = np.take_along_axis(d_top, peak[:, None], 1) + d_features[:, None, :FILTERS]
    np.put_along_axis(d_top, peak[:, None], at, 1)
    d_top *= (best > 0) & inside[..., None]
    g["bias"] = d_top.sum((0, 1))
    # Only the winning position of a block carries a gradient.
    sample, block, filt = np.nonzero(d_top)
    amount = d_top[sample, block, filt]
    position = block * BLOCK + where[sample, block, filt]
    g["filters"] = np.zeros_like(m["filters"])
    for f in range(FILTERS):
        own = filt == f
        g["filters"][:, f] = amount[own] @ windows[sample[own], position[own]]
    d_window = (amount[:, None] * m["filters"].T[filt]).reshape(-1, WIDTH, EMBED)
    touched = flat[sample[:, None], position[:, None] * STEP + np.arange(WIDTH)]
    g["embed"] = np.zeros_like(m["embed"])
    for k in range(EMBED):
        g["embed"][:, k] = np.bincount(touched.ravel(), d_window[:, :, k].ravel(), 256)
    return loss, g


def _with_excerpts(texts: list[str], labels: np.ndarray, seed: int) -> tuple[list[str], np.ndarray]:
    """Short runs of words of some documents as further examples, so that shortness alone says nothing."""
    rng = np.random.default_rng(seed)
    more, marks = [], []
    for text, label in zip(texts, labels):
        words = text.split(" ")
        n = int(rng.integers(3, 16)) if label else int(rng.integers(8, 16))
        if rng.random() < (0.4 if label else 0.2) and len(words) > n:
            at = int(rng.integers(0, len(words) - n))
            more.append(" ".join(words[at : at + n]))
            marks.append(label)
    return [*texts, *more], np.concatenate([labels, np.array(marks, labels.dtype)])


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 4e-3, batch: int = 32, seed: int = 5) -> dict[str, np.ndarray]:
    m = start_model(seed)
    texts, labels = _with_excerpts(texts, labels, seed)
    x = np.stack([_training_chunks(t) for t in texts])
    length = np.array([len(t.encode()) for t in texts])
    n_positions = np.array([max(1, -(-(max(WIDTH, min(n, CHUNK_BYTES)) - WIDTH) // STEP) + 1) for n in length])
    y = labels.astype(np.float32)
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in m.items()}
    second = {k: np.zeros_like(v) for k, v in m.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            own = order[at : at + batch]
            _, g = gradients(m, x[own], n_positions[own], y[own])
            step += 1
            now = rate * (1 - epoch / epochs)
            for k in m:
                first[k] += 0.1 * (g[k] - first[k])
                second[k] += 0.001 * (g[k] ** 2 - second[k])
                m[k] = (m[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return m


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> bytes:
    """A packed model from at most about ``limit`` labelled documents (doc_id, quality)."""
    chosen = labelled_sample(labels, "quality", limit)
    # At most ``limit`` rows of two numbers, so the broadcast has a proven bound.
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return fit_once(rows, lambda r: pack(**train(list(r["text"]), r["label"].to_numpy())), lambda: pack(none=np.zeros(1)))


def score(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]):
        m = unpack(model)
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            if "none" in m:
                scores = np.full(batch.num_rows, 0.5)
            else:
                scores = np.fromiter((score_bytes(data[a:b], m) for a, b in zip(offsets[:-1], offsets[1:])), np.float64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(scores)], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def learnable(labels: DataFrame) -> DataFrame:
    """Labelled rows outside the held-out fold."""
    return labels.where(crc_fold(F.col("doc_id"), FOLDS) != HELD_OUT)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, learnable(table(spark, sf_dir, "labels"))))
    held = crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
