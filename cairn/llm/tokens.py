"""Token counts of whole texts from the pieces of their distinct pre-tokens.

The tokenizer works on pre-tokens: spaces (or U+2581, its space mark) followed by others.  No piece of
its vocabulary has a space mark behind another character, so merges never cross
a pre-token, and the count of a text is the sum over its pre-tokens.  Each task
goes through its documents in blocks: it splits them into pre-tokens, lists the
distinct ones, counts the pieces of each once, joins the counts to the
per-document frequencies by code and sums.  Token ids are never built: a count
is the length of what the library returns for one short pre-token.

"Distinct" holds within a task (a table of counts with a bound on its entries
carries over from block to block), not over the corpus: see README for what a
corpus-wide join of frequencies would move.

Cases: null is the empty text, 0 bytes and 0 tokens; a text of spaces only is
one pre-token; a pre-token of any length is counted whole; repeated rows give
repeated rows; an empty table gives no row; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cairn.llm.common import blocks, table, text_buffer

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
KEPT = 400_000
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
# The vocabulary writes a space as U+2581; the character itself in a text counts as one.
_MARK = "\u2581"
_PRE_TOKEN = re.compile(f"[ {_MARK}]*[^ {_MARK}]+|[ {_MARK}]+")


def tokenizer_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceCounts:
    """Number of pieces of a pre-token, counted once and kept."""

    def __init__(self, path: str, most: int = KEPT):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        if any(_MARK in p.lstrip(_MARK) for p in pieces):
            raise ValueError("a piece holds a space mark behind another character")
        self.most = most
        self.known: dict[str, int] = {}
        # Every text gets one space mark in front; behind a line feed, which is
        # never part of a piece, a pre-token stands as inside a text.
        self.lead = len(self.model.encode("\n"))

    def of(self, pre_tokens: list[str]) -> np.ndarray:
        new = [t for t in pre_tokens if t not in self.known]
        if len(self.known) + len(new) > self.most:
            self.known = {}
            new = pre_tokens
        if new:
            pieces = self.model.encode(["\n" + t for t in new], num_threads=1)
            self.known.update(zip(new, (len(p) - self.lead for p in pieces)))
        return np.fromiter(map(self.known.__getitem__, pre_tokens), np.int64, len(pre_tokens))


def count_texts(texts: list[str], counts: PieceCounts) -> np.ndarray:
    """Tokens of each text: distinct pre-tokens of the block, their counts, frequencies, sum."""
    code: dict[str, int] = {}
    rows, codes = [], []
    for text in texts:
        found = _PRE_TOKEN.findall(" " + text) if text else []
        rows.append(len(found))
        codes.extend([code.setdefault(t, len(code)) for t in found])
    if not code:
        return np.zeros(len(texts), np.int64)
    per_code = counts.of(list(code))
    row = np.repeat(np.arange(len(texts)), rows)
    pair, frequency = np.unique(row * len(code) + np.asarray(codes, np.int64), return_counts=True)
    return np.bincount(pair // len(code), per_code[pair % len(code)] * frequency, len(texts)).astype(np.int64)


def counter(path: str, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        counts = PieceCounts(path)
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id")
            _, offsets = text_buffer(texts)
            for first, last in blocks(offsets, 2 << 20):
                own = ["" if t is None else t for t in texts.slice(first, last - first).to_pylist()]
                n = count_texts(own, counts)
                size = np.diff(offsets[first : last + 1])
                columns = [ids.slice(first, last - first).cast(pa.int64()), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; ``path`` must exist on the executors."""
    return docs.select("doc_id", "text").mapInArrow(counter(path, limit), SCHEMA)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path())
