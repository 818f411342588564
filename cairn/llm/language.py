"""Language identification by averaged hashed subword embeddings with a linear softmax.

Subwords are all byte runs of 3 and 4 bytes of the text with A-Z lowered, hashed
to ``BUCKETS`` rows of an embedding table.  A text is the average of its rows; a
linear layer and softmax give the languages.  Table and layer are trained
together by stochastic gradient descent in numpy on a bounded sample (``SAMPLE``
documents, evenly from each language), in one task.

Scoring multiplies table and layer once, which leaves one logit row per bucket:
the average of logit rows is the logit of the average.

Calibration: a held-back fifth of the sample sets a temperature (least log loss)
and a rejection level, the smallest probability above which at most ``ERRORS`` of
the held-back predictions are wrong.  A prediction below it is marked in
``rejected``; ``lang_pred`` still names the likeliest language.

Cases: null texts and texts without a letter are ``und`` with score 0 and
rejected; texts shorter than a subword use the bias alone; without training rows
everything is ``und``; repeated rows give repeated rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import blocks, crc_fold, fit_once, labelled_sample, pack, table, text_buffer, unpack

SAMPLE = 3000
BUCKETS = 1 << 15
SIZES = (3, 4)
WIDTH = 16
EPOCHS = 6
ERRORS = 0.01
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"

_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
# Odd multipliers of the subword hash; their order keeps "abc" apart from "cba".
_STEPS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)


def subwords(data: np.ndarray, size: int) -> np.ndarray:
    """Bucket of the subword of ``size`` bytes at each position of a buffer."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    low = _LOWER[data] + np.uint32(1)
    h = np.full(n, size * 0x61C88647 & 0xFFFFFFFF, np.uint32)
    for k in range(size):
        h = (h ^ low[k : k + n]) * _STEPS[k]
        h ^= h >> np.uint32(15)
    return h % np.uint32(BUCKETS)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(text.encode(), np.uint8)
    found, n = np.unique(np.concatenate([subwords(data, s) for s in SIZES]), return_counts=True)
    return found.astype(np.int64), (n / max(1, n.sum())).astype(np.float32)


def train(texts: list[str], labels: list[str], epochs: int = EPOCHS, rate: float = 1.0, seed: int = 3) -> dict[str, np.ndarray]:
    """Logit row per bucket, bias, language names, temperature and rejection level."""
    names = sorted(set(labels))
    target = np.array([names.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    embed = (rng.standard_normal((BUCKETS, WIDTH)) * 0.1).astype(np.float32)
    layer = np.zeros((WIDTH, len(names)), np.float32)
    bias = np.zeros(len(names), np.float32)
    rows = [_counts(t) for t in texts]
    held = rng.permutation(len(rows)) < len(rows) // 5
    learn, steps = np.flatnonzero(~held), 0
    for epoch in range(epochs):
        for i in rng.permutation(learn):
            found, share = rows[i]
            mean = share @ embed[found]
            p = _softmax(mean @ layer + bias)
            p[target[i]] -= 1
            now = rate * (1 - steps / (epochs * len(learn)))
            back = layer @ p
            layer -= now * np.outer(mean, p)
            bias -= 0.1 * now * p
            # The average spreads the step over all subwords; the factor undoes that.
            embed[found] -= (now * 20 * share)[:, None] * back
            steps += 1
    logits = np.stack([share @ (embed[found] @ layer) + bias for found, share in rows])
    own = held if held.any() else np.ones(len(rows), bool)
    temperature = min(np.geomspace(0.2, 5, 40), key=lambda t: -np.log(_softmax(logits[own] / t)[np.arange(own.sum()), target[own]] + 1e-9).mean())
    p = _softmax(logits[own] / temperature)
    order = np.argsort(-p.max(1), kind="stable")
    wrong = (p.argmax(1) != target[own])[order]
    share_wrong = np.cumsum(wrong) / np.arange(1, len(wrong) + 1)
    good = np.flatnonzero(share_wrong <= ERRORS)
    level = p.max(1)[order][good[-1]] if len(good) else 1.0
    return {"table": embed @ layer, "bias": bias, "names": np.array(names), "temperature": np.array(temperature), "level": np.array(level)}


def fit(docs: DataFrame, limit: int = SAMPLE) -> bytes:
    """A packed model from at most about ``limit`` documents with text and lang."""
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL")
    chosen = labelled_sample(known, "lang", limit)
    rows = known.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return fit_once(rows, lambda r: pack(**train(list(r["text"]), list(r["label"]))), lambda: pack(none=np.zeros(1)))


def logits_of(data: np.ndarray, offsets: np.ndarray, m: dict[str, np.ndarray]) -> np.ndarray:
    """Logits of each row of a text buffer; subwords do not cross rows."""
    rows = len(offsets) - 1
    total, count = np.zeros((rows, len(m["names"]))), np.zeros(rows)
    for size in SIZES:
        ends = offsets[1:] - size + 1
        full = np.flatnonzero(ends > offsets[:-1])
        if not len(full):
            continue
        got = m["table"][subwords(data, size)]
        cuts = np.stack([offsets[full], ends[full]], 1).ravel()
        cuts = cuts[:-1] if cuts[-1] >= len(got) else cuts
        total[full] += np.add.reduceat(got, cuts, axis=0, dtype=np.float64)[::2]
        count[full] += ends[full] - offsets[full]
    return total / np.maximum(count, 1)[:, None] + m["bias"]


def predict(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row."""

    def run(batches: Iterator[pa.RecordBatch]):
        m = unpack(model)
        for batch in batches:
            letter = np.asarray(batch.column("has_letter").to_numpy(zero_copy_only=False), bool)
            names, scores, rejected = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows), np.ones(batch.num_rows, bool)
            if "none" not in m:
                data, offsets = text_buffer(batch.column("text"))
                for a, b in blocks(offsets):
                    own = data[offsets[a] : offsets[b]]
                    p = _softmax(logits_of(own, offsets[a : b + 1] - offsets[a], m) / m["temperature"])
                    names[a:b], scores[a:b] = m["names"][p.argmax(1)], p.max(1)
                names[~letter], scores[~letter] = UNKNOWN, 0.0
                rejected = ~letter | (scores < m["level"])
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(names, pa.string()), pa.array(scores), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "rejected"])

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has_letter")
    return docs.select("doc_id", "text", letter).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = crc_fold(F.col("doc_id"), FOLDS)
    got = predict(docs, fit(docs.where(fold != HELD_OUT)))
    return got.select("doc_id", (fold == HELD_OUT).alias("held_out"), "lang_pred", "score", "rejected")
