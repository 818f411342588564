"""Ranked lexical search of many queries at once, with common subexpressions computed once.

The items are a stated query set, taken in blocks of a bounded number of terms.
For a block the terms that its items share are mined: first the terms that occur
in exactly the same items (one node each), then, round by round, neighbouring
nodes that stand together in two items or more (one node for each such pair,
the most frequent first).  Nodes form a graph whose leaves are terms; an item is
a short list of nodes.

Two passes read the documents.  The first counts documents, terms and the
documents that hold each query term.  The second works on blocks of documents:
it gives each query term its part of the score, adds the parts of every node
once per document (its partial accumulator, leaves first), and adds up the nodes
of each item.  A task keeps the best rows of each item, exactly: a row goes only
when as many better ones are known, so memory follows the items, not the
documents.  The best rows of all tasks are ranked in two steps, salted by document.

Nothing but query terms and their weights is sent to the tasks, at most
``BLOCK_TERMS`` terms at a time; documents and postings never move.

Cases: null and empty texts hold no term and are never found; an item without
terms, or whose terms no document holds, has no row; rows of one item id are one
item with the terms of all of them (a null id is an id); a repeated document row
counts and ranks as a document of its own; equal scores go by doc_id, null last;
no documents or no items give no row; further columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.common import NOT_ALNUM, blocks, cut_lineage, table, text_buffer, word_hashes

TOP = 50
BLOCK_TERMS = 200_000
CELLS = 1 << 21
KEPT_ROWS = 200_000
SALTS = 64


# ---- query graph --------------------------------------------------------------------


@dataclass
class Graph:
    """Shared term sets: ``terms`` sorted hashes, ``levels`` of nodes with their children, ``items`` as lists of nodes.

    Child and node numbers below ``len(terms)`` are terms, later ones nodes in the order of the levels.
    """

    terms: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray]]
    item_starts: np.ndarray
    item_nodes: np.ndarray

    @property
    def width(self) -> int:
        return len(self.terms) + sum(len(starts) for starts, _ in self.levels)

    def additions(self) -> int:
        return sum(len(children) for _, children in self.levels) + len(self.item_nodes)


def _level(groups: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.cumsum([0, *map(len, groups[:-1])]).astype(np.int64)
    return starts, np.array([c for g in groups for c in g], np.int64)


def _paired(sequences: list[list[int]], first: int) -> tuple[list[list[int]], list[list[int]]]:
    """Replace neighbours that occur in two sequences or more by new nodes, the most frequent pairs first."""
    counts = Counter(pair for s in sequences for pair in zip(s, s[1:]))
    shared = {pair: n for pair, n in counts.items() if n > 1}
    used: dict[tuple[int, int], int] = {}
    out = []
    for s in sequences:
        best = sorted((i for i in range(len(s) - 1) if (s[i], s[i + 1]) in shared), key=lambda i: (-shared[s[i], s[i + 1]], s[i], s[i + 1]))
        taken: set[int] = set()
        heads: set[int] = set()
        for i in best:
            if i not in taken and i + 1 not in taken:
                taken |= {i, i + 1}
                heads.add(i)
        new, i = [], 0
        while i < len(s):
            if i in heads:
                new.append(used.setdefault((s[i], s[i + 1]), first + len(used)))
                i += 2
            else:
                new.append(s[i])
                i += 1
        out.append(new)
    # A pair that other choices left in one sequence only is taken apart again.
    kept = Counter(n for s in out for n in s)
    names, groups = {}, []
    for pair, node in used.items():
        if kept[node] > 1:
            names[node] = first + len(groups)
            groups.append(list(pair))
    parts = {node: pair for pair, node in used.items()}
    again = [[m for n in s for m in ([names[n]] if n in names else parts.get(n, (n,)))] for s in out]
    return again, groups


def mine(item_terms: list[np.ndarray]) -> Graph:
    """The graph of a block of items, each given as distinct term hashes."""
    terms = np.unique(np.concatenate([np.asarray(t, np.int64) for t in item_terms]))
    holders: dict[int, list[int]] = {}
    for i, own in enumerate(item_terms):
        for t in np.searchsorted(terms, own).tolist():
            holders.setdefault(t, []).append(i)
    same: dict[tuple[int, ...], list[int]] = {}
    for t in sorted(holders):
        same.setdefault(tuple(holders[t]), []).append(t)
    # Sets held by many items come first, so that equal runs stand at the same end.
    ordered = sorted(same.items(), key=lambda x: (-len(x[0]), x[0]))
    levels, at = [], len(terms)
    sequences: list[list[int]] = [[] for _ in item_terms]
    groups = [own for _, own in ordered if len(own) > 1]
    names = iter(range(at, at + len(groups)))
    for who, own in ordered:
        node = next(names) if len(own) > 1 else own[0]
        for i in who:
            sequences[i].append(node)
    while True:
        if groups:
            levels.append(_level(groups))
            at += len(groups)
        sequences, groups = _paired(sequences, at)
        if not groups:
            break
    starts, nodes = _level(sequences)
    return Graph(terms, levels, starts, nodes)


def accumulate(graph: Graph, parts: np.ndarray) -> np.ndarray:
    """Scores (item, document) from the parts (term, document) of the terms."""
    total = np.empty((graph.width, parts.shape[1]), np.int64)
    total[: len(parts)] = parts
    at = len(parts)
    for starts, children in graph.levels:
        total[at : at + len(starts)] = np.add.reduceat(total[children], starts, axis=0)
        at += len(starts)
    return np.add.reduceat(total[graph.item_nodes], graph.item_starts, axis=0)


# ---- passes -------------------------------------------------------------------------


def _found(column: pa.Array, terms: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per block of rows: its bounds, the terms of each row, and (row, query term, occurrences)."""
    data, offsets = text_buffer(column)
    for a, b in blocks(offsets):
        words, bounds = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], NOT_ALNUM)
        n = np.diff(bounds)
        own = words.view(np.int64)
        at = np.minimum(np.searchsorted(terms, own), len(terms) - 1)
        hit = terms[at] == own
        row = np.repeat(np.arange(b - a), n)[hit]
        key, tf = np.unique(row * len(terms) + at[hit], return_counts=True)
        yield a, b, n, key // len(terms), key % len(terms), tf


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and the distinct hashes of its terms, sorted; items without terms are left out."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            words, bounds = word_hashes(data, offsets, NOT_ALNUM)
            own = [np.unique(words[a:b].view(np.int64)) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("item_id").cast(pa.int64()), pa.array(own, pa.list_(pa.int64()))], names=["item_id", "terms"])

    found = items.select("item_id", "text").mapInArrow(run, "item_id long, terms array<long>")
    return found.select("item_id", F.explode("terms").alias("term")).groupBy("item_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))


def _counted(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """term (its place, -1 documents with a term, -2 all terms) and n."""

    def run(batches):
        df = np.zeros(len(terms), np.int64)
        held = total = 0
        for batch in batches:
            for _, _, n, _, term, _ in _found(batch.column("text"), terms):
                df += np.bincount(term, minlength=len(terms))
                held += int((n > 0).sum())
                total += int(n.sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(df[at], [held, total]))], names=["term", "n"])

    return docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _best(item: np.ndarray, doc: np.ndarray, null: np.ndarray, score: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` best rows of each item."""
    order = np.lexsort((doc, null, -score, item))
    item = item[order]
    starts = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]])) if len(item) else np.zeros(0, np.int64)
    rank = np.arange(len(item)) - np.repeat(starts, np.diff(np.append(starts, len(item))))
    return order[rank < top]


def _scored(docs: DataFrame, graph: Graph, ids: list[int | None], weights: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """The best rows of every task: item_id, doc_id, score."""

    def run(batches):
        high = max(1, CELLS // graph.width)
        item, doc, null, score = (np.zeros(0, t) for t in (np.int64, np.int64, bool, np.int64))
        least = np.ones(len(graph.item_starts), np.int64)
        for batch in batches:
            own = batch.column("doc_id").cast(pa.int64())
            own_null = own.is_null().to_numpy(zero_copy_only=False)
            own_id = own.fill_null(0).to_numpy()
            for a, _, n, row, term, tf in _found(batch.column("text"), graph.terms):
                m = 50 + (50 * n.astype(np.int64) * n_docs) // n_terms
                part = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[row]))
                for low in range(0, len(n), high):
                    here = slice(*np.searchsorted(row, [low, low + high]))
                    parts = np.zeros((len(graph.terms), min(high, len(n) - low)), np.int64)
                    parts[term[here], row[here] - low] = part[here]
                    scores = accumulate(graph, parts)
                    q, at = np.nonzero(scores >= least[:, None])
                    at_doc = a + low + at
                    item, doc = np.append(item, q), np.append(doc, own_id[at_doc])
                    null, score = np.append(null, own_null[at_doc]), np.append(score, scores[q, at])
                    if len(item) > KEPT_ROWS:
                        keep = _best(item, doc, null, score, top)
                        item, doc, null, score = item[keep], doc[keep], null[keep], score[keep]
                        full = np.flatnonzero(np.bincount(item, minlength=len(least)) >= top)
                        lowest = np.full(len(least), np.iinfo(np.int64).max)
                        np.minimum.at(lowest, item, score)
                        least[full] = np.maximum(1, lowest[full])
        keep = _best(item, doc, null, score, top)
        names = pa.array(ids, pa.int64()).take(pa.array(item[keep]))
        columns = [names, pa.array(doc[keep], mask=null[keep]), pa.array(score[keep])]
        yield pa.RecordBatch.from_arrays(columns, names=["item_id", "doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "item_id long, doc_id long, score long")


def ranked(found: DataFrame, top: int) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` best rows of each item, first within salted parts."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order))).where(F.col("rank") <= top)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= top)
    return last.select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of the ``top`` best documents of each item."""
    spark = docs.sparkSession
    queries = cut_lineage(item_terms(items))
    total = queries.agg(F.sum(F.size("terms"))).first()[0] or 0
    n_blocks = -(-total // block_terms)
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for at in range(n_blocks):
        own = queries.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == at).orderBy("item_id").collect()
        if not own:
            continue
        graph = mine([np.array(r["terms"], np.int64) for r in own])
        counts = {r["term"]: r["n"] for r in _counted(docs, graph.terms).collect()}
        n_docs, n_terms = counts.get(-1, 0), counts.get(-2, 0)
        if not n_terms:
            continue
        weights = np.array([weight(n_docs, counts.get(t, 0)) for t in range(len(graph.terms))], np.int64)
        found = found.unionByName(_scored(docs, graph, [r["item_id"] for r in own], weights, n_docs, n_terms, top))
    return ranked(found, top)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
SQL = f"""
WITH found AS (SELECT doc_id, {_TERMS} AS term FROM documents),
posting AS (SELECT doc_id, term, count(*) AS tf FROM found GROUP BY doc_id, term),
doc AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM posting GROUP BY doc_id),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM doc),
query AS (SELECT DISTINCT item_id, {_TERMS} AS term FROM benchmark),
weight AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM posting CROSS JOIN total GROUP BY term, docs),
scored AS (
  SELECT query.item_id, posting.doc_id,
    CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // terms))))) AS BIGINT) AS score
  FROM query JOIN posting USING (term) JOIN weight USING (term) JOIN doc ON doc.doc_id = posting.doc_id CROSS JOIN total
  GROUP BY query.item_id, posting.doc_id),
ordered AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ordered WHERE rank <= {TOP}
"""
