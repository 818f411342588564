"""Alignment of two tokenizers by a monoid of fragments.

A fragment describes a byte range of a text: the tokens of both tokenizers before
the first offset at which both end (open prefix), the groups between such offsets
(closed), and the tokens behind the last one (open suffix); a range without such
an offset is all open.  Two neighbouring fragments compose into one: the suffix
of the left and the prefix of the right close where their ends meet.  Composition
is associative, so fragments of a text combine in any tree.

A text is cut at blanks that follow a character that is not white space; both
tokenizers always end there, so a piece of text between two cuts (a segment) has
the same tokens alone and in place, and each distinct segment of a task is encoded
once.  Texts of more than ``CHUNK`` characters become byte-range chunks of
their own rows.  The two tokenizers are cut separately, each at its own next safe
place, so a chunk may hold tokens of one that end where the other's go on; such
groups stay open until the neighbour is known.  The chunks are spread over tasks
and their fragments composed by neighbours, ``FAN`` at a time, until one is left.

Counts over the corpus: every document row keeps its distinct linked id pairs with
their numbers in a table in the shared folder; from that table pairs are counted
(pre-aggregated in each task) and joined back.  Up to ``BROADCAST_PAIRS`` distinct
pairs the counts travel to the tasks as one array; beyond that documents and
counts meet in a shuffled join.  Both ways give equal rows.

Cases: null, empty and unfaithful texts (the joined bytes of one tokenizer differ
from a space and the text) have zeros and '' and take no part in the counts; a
text of any length is one row, its groups are written to the hash as a whole;
repeated rows count as documents of their own; a null id stays null; an empty
table gives no row; further columns are not read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import blocks, cut_lineage, pack, table, text_buffer, unpack
from cairn.llm.tokens import tokenizer_path
from cairn.session import shared_folder

BYTES_MODEL = "byte_bpe_50k.json"
PIECES_MODEL = "piece_bpe_32k.model"
CHUNK = 1 << 16
FAN = 8
KEPT = 200_000
WIDE = 1 << 16
RUN = 64
BROADCAST_PAIRS = 1 << 20
_CUT = re.compile(r"(?<=\S)(?= )")
_CUT_A = re.compile(r"(?<=\S)(?=\s)")
_NONE = np.zeros(0, np.int64)

ROW = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


# ---- fragments ----------------------------------------------------------------------


@dataclass
class Open:
    """Tokens that wait for a common end: ids and byte offsets of their ends, of both tokenizers."""

    a: np.ndarray = field(default_factory=lambda: _NONE)
    a_end: np.ndarray = field(default_factory=lambda: _NONE)
    b: np.ndarray = field(default_factory=lambda: _NONE)
    b_end: np.ndarray = field(default_factory=lambda: _NONE)

    def __add__(self, right: Open) -> Open:
        return Open(*(np.concatenate([x, y]) for x, y in zip(self.parts(), right.parts())))

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.a, self.a_end, self.b, self.b_end

    def split(self, end: int) -> tuple[Open, Open]:
        """The tokens that end at or before ``end``, and the others."""
        i, j = int(np.searchsorted(self.a_end, end, "right")), int(np.searchsorted(self.b_end, end, "right"))
        return Open(self.a[:i], self.a_end[:i], self.b[:j], self.b_end[:j]), Open(self.a[i:], self.a_end[i:], self.b[j:], self.b_end[j:])


@dataclass
class Closed:
    """Summary of whole groups, in order."""

    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    text: str = ""
    pairs: np.ndarray = field(default_factory=lambda: _NONE)
    times: np.ndarray = field(default_factory=lambda: _NONE)

    def __add__(self, right: Closed) -> Closed:
        if not self.n_groups or not right.n_groups:
            return self if self.n_groups else right
        pairs, times = summed(np.concatenate([self.pairs, right.pairs]), np.concatenate([self.times, right.times]))
        sums = (getattr(self, n) + getattr(right, n) for n in ("n_a", "n_b", "n_groups", "n_links"))
        return Closed(*sums, f"{self.text};{right.text}", pairs, times)


@dataclass
class Fragment:
    """``prefix`` is all tokens while ``cut`` is false; then ``closed`` and ``suffix`` are empty."""

    prefix: Open = field(default_factory=Open)
    cut: bool = False
    closed: Closed = field(default_factory=Closed)
    suffix: Open = field(default_factory=Open)
    faithful: bool = True

    def __add__(self, right: Fragment) -> Fragment:
        middle = (self.suffix if self.cut else self.prefix) + right.prefix
        ends = np.intersect1d(middle.a_end, middle.b_end, assume_unique=True)
        faithful = self.faithful and right.faithful
        if not len(ends):
            if self.cut and right.cut:
                raise ValueError("a prefix ends without a common end")
            if self.cut:
                return Fragment(self.prefix, True, self.closed, middle, faithful)
            return Fragment(middle, right.cut, right.closed, right.suffix, faithful)
        prefix, closed = self.prefix, self.closed
        if not self.cut:
            prefix, middle = middle.split(int(ends[0]))
            ends = ends[1:]
        if len(ends):
            whole, middle = middle.split(int(ends[-1]))
            closed = closed + close(whole, ends)
        if right.cut:
            return Fragment(prefix, True, closed + right.closed, right.suffix, faithful)
        return Fragment(prefix, True, closed, middle, faithful)

    def whole(self) -> Closed | None:
        """All groups of a text whose fragments are composed; None if the text is not faithful."""
        if not self.faithful or not self.cut or len(self.suffix.a) or len(self.suffix.b):
            return None
        return close(self.prefix, self.prefix.a_end[-1:]) + self.closed


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of ``n`` over each."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else _NONE
    return keys[starts], np.add.reduceat(n, starts) if len(keys) else _NONE


def linked(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, wide: int = WIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, pair, times) of all links of groups whose tokens end at places ``i`` of a and ``j`` of b.

    Groups of up to ``wide`` links are crossed token by token, wider ones by their
    distinct tokens, so a long group costs its distinct pairs only.
    """
    i0, j0 = np.append(0, i[:-1]), np.append(0, j[:-1])
    n_b = j - j0
    links = (i - i0) * n_b
    plain = np.flatnonzero(links <= wide)
    group = np.repeat(plain, links[plain])
    at = np.arange(len(group)) - np.repeat(np.cumsum(links[plain]) - links[plain], links[plain])
    left, right = a[i0[group] + at // n_b[group]], b[j0[group] + at % n_b[group]]
    found = [(group, (left << 32) | right, np.ones(len(group), np.int64))]
    for g in np.flatnonzero(links > wide).tolist():
        x, n = np.unique(a[i0[g] : i[g]], return_counts=True)
        y, m = np.unique(b[j0[g] : j[g]], return_counts=True)
        pairs = ((x[:, None] << 32) | y[None, :]).ravel()
        found.append((np.full(len(pairs), g), pairs, (n[:, None] * m[None, :]).ravel()))
    return tuple(np.concatenate(c) for c in zip(*found))


def spelled(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[str]:
    """The tokens group by group, first those of a, each with what follows it: a comma, a bar or a semicolon."""
    i0, j0 = np.append(0, i[:-1]), np.append(0, j[:-1])
    a_mark, b_mark = np.zeros(len(a), np.int64), np.full(len(b), 2)
    a_mark[i - 1], b_mark[j - 1] = 1, 3
    out = np.empty(len(a) + len(b), np.int64)
    out[np.arange(len(a)) + np.repeat(j0, i - i0)] = (a << 2) | a_mark
    out[np.arange(len(b)) + np.repeat(i, j - j0)] = (b << 2) | b_mark
    return [f"{c >> 2}{',|,;'[c & 3]}" for c in out.tolist()]


def close(tokens: Open, ends: np.ndarray) -> Closed:
    """Summary of the groups that end at ``ends``, the last one at the tokens' end."""
    i, j = np.searchsorted(tokens.a_end, ends, "right"), np.searchsorted(tokens.b_end, ends, "right")
    links = np.diff(i, prepend=0) * np.diff(j, prepend=0)
    _, pairs, times = linked(tokens.a, tokens.b, i, j)
    return Closed(len(tokens.a), len(tokens.b), len(ends), int(links.sum()), "".join(spelled(tokens.a, tokens.b, i, j))[:-1], *summed(pairs, times))


def fragment_of(a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray, faithful: bool = True) -> Fragment:
    return Fragment(faithful=faithful) + Fragment(Open(a, a_end, b, b_end)) if faithful else Fragment(faithful=False)


def packed(f: Fragment) -> bytes:
    arrays = {f"{side}{i}": x for side, o in (("p", f.prefix), ("s", f.suffix)) for i, x in enumerate(o.parts())}
    c = f.closed
    return pack(**arrays, pairs=c.pairs, times=c.times, n=np.array([c.n_a, c.n_b, c.n_groups, c.n_links, f.cut, f.faithful]), text=np.frombuffer(c.text.encode(), np.uint8))


def unpacked(raw: bytes) -> Fragment:
    got = unpack(raw)
    prefix, suffix = (Open(*(got[f"{side}{i}"] for i in range(4))) for side in "ps")
    n_a, n_b, n_groups, n_links, cut, faithful = got["n"].tolist()
    return Fragment(prefix, bool(cut), Closed(n_a, n_b, n_groups, n_links, got["text"].tobytes().decode(), got["pairs"], got["times"]), suffix, bool(faithful))


# ---- tokenizers ---------------------------------------------------------------------


def _byte_letters() -> dict[str, int]:
    """Fixed rule of byte-level vocabularies: printable bytes stand for themselves, the others follow from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Pair:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, bytes_path: str, pieces_path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has its one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(bytes_path)
        self.a.encode_special_tokens = True
        letters = _byte_letters()
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(t) for t in tokens], np.int64) for tokens in (self.a_bytes, self.b_bytes))
        # A line feed is a piece of its own: what follows it is encoded as inside a text.
        self.lead = len(self.b.encode("\n"))

    def encode_a(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int64) for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_b(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids[self.lead :], np.int64) for ids in self.b.encode(["\n" + t for t in texts], num_threads=1)]

    @staticmethod
    def joined(ids: np.ndarray, tokens: list[bytes]) -> bytes:
        return b"".join([tokens[i] for i in ids.tolist()])

    def faithful(self, text: str, a: np.ndarray, b: np.ndarray) -> bool:
        raw = text.encode()
        return self.joined(a, self.a_bytes) == raw and self.joined(b, self.b_bytes) == raw

    def fragment(self, a_text: str, a_start: int, b_text: str, b_start: int) -> Fragment:
        """The fragment of a chunk; the bytes of each tokenizer begin at its own offset."""
        a, b = self.encode_a([a_text])[0], self.encode_b([b_text])[0]
        sure = self.joined(a, self.a_bytes) == a_text.encode() and self.joined(b, self.b_bytes) == b_text.encode()
        return fragment_of(a, a_start + np.cumsum(self.a_size[a]), b, b_start + np.cumsum(self.b_size[b]), sure)


class Segments:
    """The groups of known segments by code: numbers, text, and a range of distinct pairs."""

    def __init__(self, pair: Pair, most: int = KEPT):
        self.pair, self.most = pair, most
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.texts: list[str] = []
        # n_a, n_b, n_groups, n_links, faithful, distinct pairs
        self.numbers = np.zeros((0, 6), np.int64)
        self.pairs = self.times = _NONE

    def codes(self, segments: list[str]) -> list[int]:
        found = list(map(self.code.get, segments))
        new = list(dict.fromkeys([s for s, c in zip(segments, found) if c is None]))
        if not new:
            return found
        if len(self.code) + len(new) > self.most:
            self.clear()
            new = list(dict.fromkeys(segments))
        # Only the last segment of a text can end with white space; behind it nothing may follow.
        for own in ([s for s in new if not s[-1].isspace()], [s for s in new if s[-1].isspace()]):
            for low in range(0, len(own), 20_000):
                self._learn(own[low : low + 20_000])
        return list(map(self.code.__getitem__, segments))

    def _tokens(self, segments: list[str]) -> tuple[list[str], list[bool], np.ndarray, np.ndarray]:
        """The segments, whether each is faithful, and the tokens of the faithful ones.

        Runs of segments are encoded as one text; a run that is not faithful is taken apart.
        """
        step = 1 if segments[0][-1].isspace() else RUN
        runs = ["".join(segments[at : at + step]) for at in range(0, len(segments), step)]
        a, b = self.pair.encode_a(runs), self.pair.encode_b(runs)
        names, sure, x, y = [], [], [], []
        for n, run in enumerate(runs):
            own = segments[n * step : (n + 1) * step]
            good = self.pair.faithful(run, a[n], b[n])
            if good or len(own) == 1:
                found = [(good, a[n], b[n])]
                sure += [good] * len(own)
            else:
                each = zip(own, self.pair.encode_a(own), self.pair.encode_b(own))
                found = [(self.pair.faithful(*part), part[1], part[2]) for part in each]
                sure += [part[0] for part in found]
            names += own
            x += [p for ok, p, _ in found if ok]
            y += [q for ok, _, q in found if ok]
        return names, sure, np.concatenate([_NONE, *x]), np.concatenate([_NONE, *y])

    def _learn(self, new: list[str]) -> None:
        new, sure, x, y = self._tokens(new)
        kept = np.flatnonzero(sure)
        numbers = np.zeros((len(new), 6), np.int64)
        numbers[:, 4] = sure
        texts = [""] * len(new)
        if len(kept):
            # Segments end at common ends, so all of them are cut into groups as one text.
            x_end, y_end = np.cumsum(self.pair.a_size[x]), np.cumsum(self.pair.b_size[y])
            ends = np.intersect1d(x_end, y_end, assume_unique=True)
            i, j = np.searchsorted(x_end, ends, "right"), np.searchsorted(y_end, ends, "right")
            last = np.cumsum([len(new[s].encode()) for s in kept.tolist()])
            own = np.searchsorted(last, ends)
            group, pairs, times = linked(x, y, i, j)
            order = np.lexsort((pairs, own[group]))
            of, pairs, times = own[group][order], pairs[order], times[order]
            starts = np.flatnonzero(np.append(True, (pairs[1:] != pairs[:-1]) | (of[1:] != of[:-1])))
            of, pairs, times = of[starts], pairs[starts], np.add.reduceat(times, starts)
            n_a, n_b = np.diff(i, prepend=0), np.diff(j, prepend=0)
            first = np.searchsorted(own, np.arange(len(kept)))
            sums = [np.add.reduceat(n, first) for n in (n_a, n_b, np.ones(len(own), np.int64), n_a * n_b)]
            numbers[np.ix_(kept, [0, 1, 2, 3, 5])] = np.stack([*sums, np.bincount(of, minlength=len(kept))], axis=1)
            words, p = spelled(x, y, i, j), 0
            for s, q in zip(kept.tolist(), np.cumsum(sums[0] + sums[1]).tolist()):
                texts[s] = "".join(words[p:q])
                p = q
            self.pairs, self.times = np.append(self.pairs, pairs), np.append(self.times, times)
        at = len(self.code)
        self.code.update(zip(new, range(at, at + len(new))))
        self.texts += texts
        self.numbers = np.concatenate([self.numbers, numbers])


def rows_of(texts: list[str | None], known: Segments) -> list[Closed | None]:
    """The groups of each text, composed from those of its segments."""
    split = [_CUT.split(" " + t) if t else [] for t in texts]
    codes = np.array(known.codes([s for own in split for s in own]), np.int64)
    bounds = np.cumsum([0, *map(len, split)])
    row = np.repeat(np.arange(len(texts)), np.diff(bounds))
    sure = np.diff(bounds) > 0
    sure[row[known.numbers[codes, 4] == 0]] = False
    sums = np.zeros((len(texts), 4), np.int64)
    np.add.at(sums, row, known.numbers[codes, :4])
    size = known.numbers[:, 5]
    key, n = np.unique(row * len(size) + codes, return_counts=True)
    who, code = key // len(size) if len(size) else key, key % len(size) if len(size) else key
    own = size[code]
    at = np.repeat((np.cumsum(size) - size)[code] - (np.cumsum(own) - own), own) + np.arange(own.sum())
    pairs, place = np.unique(known.pairs[at], return_inverse=True)
    key, times = summed(np.repeat(who, own) * len(pairs) + place, known.times[at] * np.repeat(n, own))
    ends = np.searchsorted(key, np.arange(len(texts) + 1) * len(pairs))
    key = pairs[key % len(pairs)] if len(pairs) else key
    out: list[Closed | None] = []
    for t in range(len(texts)):
        if not sure[t]:
            out.append(None)
            continue
        here = slice(ends[t], ends[t + 1])
        words = "".join([known.texts[c] for c in codes[bounds[t] : bounds[t + 1]].tolist()])[:-1]
        out.append(Closed(*sums[t].tolist(), words, key[here], times[here]))
    return out


def _columns(found: list[Closed | None]) -> list[pa.Array]:
    import hashlib

    own = [c or Closed() for c in found]
    numbers = [pa.array([getattr(c, n) for c in own], pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")]
    digest = pa.array([hashlib.sha256(c.text.encode()).hexdigest() if c.n_groups else "" for c in own], pa.string())
    return [*numbers, digest, *(pa.array([getattr(c, n) for c in own], pa.list_(pa.int64())) for n in ("pairs", "times"))]


_NAMES = [part.split()[0] for part in ROW.split(", ")]


def _short(paths: tuple[str, str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of texts that are one chunk."""

    def run(batches):
        known = Segments(Pair(*paths))
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id")
            _, offsets = text_buffer(texts)
            for a, b in blocks(offsets, 4 << 20):
                found = rows_of(texts.slice(a, b - a).to_pylist(), known)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a).cast(pa.int64()), *_columns(found)], names=["doc_id", *_NAMES])

    return run


# ---- long texts ---------------------------------------------------------------------


def chunk_ranges(text: str, chunk: int) -> list[tuple[int, int, int, int]]:
    """Ranges of code points (A from, to, B from, to): each tokenizer is cut at its own next safe place behind a multiple of ``chunk``."""
    a, b = [0], [0]
    for at in range(chunk, len(text), chunk):
        for cuts, safe in ((a, _CUT_A), (b, _CUT)):
            got = safe.search(text, max(at, cuts[-1]))
            cuts.append(got.start() if got else len(text))
    a.append(len(text))
    b.append(len(text))
    return [r for r in zip(a, a[1:], b, b[1:]) if r[0] < r[1] or r[2] < r[3]]


def _chunks(chunk: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        names = ["doc_key", "doc_id", "place", "a_text", "a_start", "b_text", "b_start"]
        for batch in batches:
            for key, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("doc_key", "doc_id", "text"))):
                whole, a_byte, b_byte = " " + text, 0, 0
                for place, (a, a2, b, b2) in enumerate(chunk_ranges(whole, chunk)):
                    row = [key, doc_id, place, whole[a:a2], a_byte, whole[b:b2], b_byte]
                    a_byte, b_byte = a_byte + len(row[3].encode()), b_byte + len(row[5].encode())
                    yield pa.RecordBatch.from_pydict({n: pa.array([v], pa.string() if n.endswith("text") else pa.int64()) for n, v in zip(names, row)})

    return run


def _fragments(paths: tuple[str, str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        pair = Pair(*paths)
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("a_text", "a_start", "b_text", "b_start")))
            out = [packed(pair.fragment(*row)) for row in rows]
            columns = [batch.column("doc_key"), batch.column("doc_id"), batch.column("place"), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_key", "doc_id", "place", "fragment"])

    return run


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for group in batch.column("found").to_pylist():
            total = Fragment()
            for part in group:
                total = total + unpacked(part["fragment"])
            out.append(packed(total))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_key", "doc_id", "place")), pa.array(out, pa.binary())], names=["doc_key", "doc_id", "place", "fragment"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [unpacked(f).whole() for f in batch.column("fragment").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_columns(found)], names=["doc_id", *_NAMES])


def _long(docs: DataFrame, paths: tuple[str, str], chunk: int) -> DataFrame:
    """Rows of longer texts: chunks spread over tasks, fragments composed by neighbours in a tree."""
    keyed = docs.withColumn("doc_key", F.monotonically_increasing_id())
    schema = "doc_key long, doc_id long, place long, a_text string, a_start long, b_text string, b_start long"
    chunks = cut_lineage(keyed.mapInArrow(_chunks(chunk), schema))
    fragments = "doc_key long, doc_id long, place long, fragment binary"
    found = cut_lineage(chunks.repartition("doc_key", "place").mapInArrow(_fragments(paths), fragments))
    most = found.agg(F.max("place")).first()[0] or 0
    while most:
        grouped = found.groupBy("doc_key", F.floor(F.col("place") / FAN).alias("above")).agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("place", "fragment"))).alias("found"))
        found = cut_lineage(grouped.select("doc_key", "doc_id", F.col("above").alias("place"), "found").mapInArrow(_compose, fragments))
        most //= FAN
    return found.mapInArrow(_finish, "doc_id long, " + ROW)


# ---- counts over the corpus ---------------------------------------------------------


def _with_counts(rows: DataFrame, pairs: np.ndarray, counts: np.ndarray) -> DataFrame:
    """Adds n_best and count_sum from sorted pairs with their counts."""
    a = pairs >> 32
    starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else _NONE
    best = counts == np.repeat(np.maximum.reduceat(counts, starts), np.diff(np.append(starts, len(a)))) if len(a) else np.zeros(0, bool)

    def run(batches):
        for batch in batches:
            own = batch.column("pairs")
            at = np.searchsorted(pairs, own.flatten().to_numpy())
            times = batch.column("times").flatten().to_numpy()
            bounds = np.append(0, np.cumsum(own.value_lengths().to_numpy()))
            sums = []
            for n in (times * best[at], times * counts[at]):
                total = np.append(0, np.cumsum(n))
                sums.append(pa.array(total[bounds[1:]] - total[bounds[:-1]], pa.int64()))
            kept = [batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
            yield pa.RecordBatch.from_arrays([*kept, *sums, batch.column("groups_sha256")], names=_OUT)

    return rows.mapInArrow(run, OUT)


OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_OUT = [part.split()[0] for part in OUT.split(", ")]


def _joined(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """As ``_with_counts`` by a shuffled join; the sums go back to their rows by key."""
    keyed = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))
    best = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("best"))
    marked = counts.withColumn("a", F.shiftright("pair", 32)).join(best, "a").select("pair", "n", (F.col("n") == F.col("best")).cast("long").alias("top"))
    links = keyed.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    sums = links.join(marked, "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("top")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    met = keyed.join(sums, "row", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_best", "count_sum")})
    return met.select(*_OUT)


def align(docs: DataFrame, bytes_path: str, pieces_path: str, chunk: int = CHUNK, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """One row per document row; the tokenizer files must exist on the executors."""
    spark, paths = docs.sparkSession, (bytes_path, pieces_path)
    own = docs.select("doc_id", "text")
    is_long = F.coalesce(F.length("text"), F.lit(0)) > chunk
    schema = "doc_id long, " + ROW
    place = f"{shared_folder(spark).rstrip('/')}/alignment-{uuid.uuid4().hex}"
    own.where(~is_long).mapInArrow(_short(paths), schema).unionByName(_long(own.where(is_long), paths, chunk)).write.option("compression", "zstd").parquet(place)
    rows = spark.read.schema(schema).parquet(place)
    counts = cut_lineage(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")))
    if counts.count() > broadcast_pairs:
        return _joined(rows, counts)
    got = counts.sort("pair").toArrow()
    return _with_counts(rows, got.column("pair").to_numpy(), got.column("n").to_numpy())


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), tokenizer_path(BYTES_MODEL), tokenizer_path(PIECES_MODEL))
