"""Toxicity by a weighted finite-state pattern grammar over clauses.

Five transducers read the words of a clause from left to right and are composed:

* insult: words and word stems with learned weights (a prefix arc accepts every
  inflected form of a stem),
* threat: a verb of harm followed within ``WINDOW`` words by a target,
* target: words that address a person, raising the weight of an insult near them,
* negation: scales what follows within ``WINDOW`` words by ``NEGATED``,
* reported speech: from its verb to the end of the clause scales by ``REPORTED``.

The state of the composition is (words since a negation, words since a target,
words since a verb of harm, reported or not).  A clause's score is the sum of its
weighted matches; words without an accepting path add nothing, so isolated
function words never count.  The strongest clause, the total and the number of
matched clauses of a text go into a small logistic regression.

Insult weights are log odds of documents that hold a word or stem of 4 to 6
letters, counted over a bounded sample of labelled rows (``SAMPLE``); stems that
only repeat a shorter one are dropped.  The regression is fitted on that sample.

Cases: null and empty texts have no clause and get the regression's constant;
very long texts are read whole; repeated rows give repeated rows; without
labelled rows every score is 0; further columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import crc_fold, fit_once, labelled_sample, pack, table, unpack

SAMPLE = 6000
WINDOW, NEGATED, REPORTED, AIMED = 4, 0.5, 0.7, 1.25
STEMS = (4, 5, 6)
LEAST_ODDS, LEAST_SHARE = 3.0, 0.006
FOLDS, HELD_OUT = 5, 0

# Closed word classes of the grammar in English, French, Spanish, German.
TARGETS = frozenset("you your yourself they them he she him tu toi vous il elle usted ustedes vosotros du dich dir euch sie ihr".split())
NEGATIONS = frozenset("not never no nobody isn't aren't don't pas jamais nunca jamás nicht nie kein keine niemals".split())
REPORTS = frozenset("said says wrote writes quoted claims claimed according dit écrit selon dijo dice escribió según sagte sagt schrieb laut".split())
HARMS = frozenset("kill hurt destroy shoot stab beat burn hang tuer frapper brûler matar golpear quemar töten schlagen verbrennen".split())
THREAT_WEIGHT = 4.0

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE = re.compile(r"[.!?;:\n]+")


class Grammar:
    """The composed transducer with its learned insult arcs."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems
        self.heads = {s[: STEMS[0]] for s in stems}

    def insult(self, word: str) -> float:
        got = self.words.get(word, 0.0)
        if not got and word[: STEMS[0]] in self.heads:
            for n in STEMS:
                if len(word) > n and word[:n] in self.stems:
                    return self.stems[word[:n]]
        return got

    def clause(self, words: list[str]) -> float:
        """Run the composition over one clause."""
        far = WINDOW + 1
        negation = target = harm = far
        reported, score, lately = False, 0.0, []
        for at, word in enumerate(words):
            negation, target, harm = negation + 1, target + 1, harm + 1
            scale = (NEGATED if negation <= WINDOW else 1.0) * (REPORTED if reported else 1.0)
            weight = self.insult(word)
            if weight:
                aimed = target <= WINDOW
                score += weight * scale * (AIMED if aimed else 1.0)
                if not aimed:
                    lately.append((at, weight * scale * (AIMED - 1)))
            if word in TARGETS:
                target = 0
                if harm <= WINDOW:
                    score += THREAT_WEIGHT * scale
                score += sum(w for place, w in lately if at - place <= WINDOW)
                lately.clear()
            if word in HARMS:
                harm = 0
            if word in NEGATIONS:
                negation = 0
            reported = reported or word in REPORTS
        return score

    def features(self, text: str) -> tuple[float, float, float]:
        """Strongest clause, total and number of matched clauses."""
        low = text.lower()
        known = set(_WORD.findall(low))
        if not any(self.insult(w) for w in known) and not (known & HARMS and known & TARGETS):
            return 0.0, 0.0, 0.0
        scores = [s for c in _CLAUSE.split(low) if (s := self.clause(_WORD.findall(c))) > 0]
        return (max(scores), float(np.log1p(sum(scores))), float(np.log1p(len(scores)))) if scores else (0.0, 0.0, 0.0)


def learn_insults(texts: list[str], labels: np.ndarray) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems whose presence in a document speaks for the label."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for text, label in zip(texts, labels):
        words = set(_WORD.findall(text.lower()))
        counts[int(label)].update(words | {w[:n] + "*" for n in STEMS for w in words if len(w) > n})
    n_clean, n_toxic = max(1, int((labels == 0).sum())), max(1, int((labels == 1).sum()))
    odds = {}
    for item, n in counts[1].items():
        if n >= max(4, LEAST_SHARE * n_toxic):
            o = float(np.log((n + 0.5) / (n_toxic + 1)) - np.log((counts[0][item] + 0.5) / (n_clean + 1)))
            if o >= LEAST_ODDS:
                odds[item] = o
    stems: dict[str, float] = {}
    for item in sorted((i for i in odds if i[-1] == "*"), key=len):
        stem = item[:-1]
        if not any(stem[:n] in stems for n in STEMS if n < len(stem)):
            stems[stem] = odds[item]
    words = {w: o for w, o in odds.items() if w[-1] != "*" and not any(len(w) > n and w[:n] in stems for n in STEMS)}
    return words, stems


def fit_regression(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Logistic regression with a constant, by damped Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) / len(y) + ridge * np.append(w[:-1], 0)
        bend = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        w -= np.linalg.solve(bend, slope)
    return w


def train(texts: list[str], labels: np.ndarray) -> dict[str, np.ndarray]:
    words, stems = learn_insults(texts, labels)
    grammar = Grammar(words, stems)
    x = np.array([grammar.features(t) for t in texts])
    items = [*words.items(), *((s + "*", o) for s, o in stems.items())]
    return {"items": np.array([i for i, _ in items], "U"), "odds": np.array([o for _, o in items]), "weights": fit_regression(x, labels.astype(float))}


def grammar_of(m: dict[str, np.ndarray]) -> Grammar:
    pairs = list(zip(m["items"].tolist(), m["odds"].tolist()))
    return Grammar({i: o for i, o in pairs if i[-1] != "*"}, {i[:-1]: o for i, o in pairs if i[-1] == "*"})


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> bytes:
    """A packed grammar from at most about ``limit`` labelled documents (doc_id, toxic)."""
    chosen = labelled_sample(labels, "toxic", limit)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return fit_once(rows, lambda r: pack(**train(list(r["text"]), r["label"].to_numpy())), lambda: pack(none=np.zeros(1)))


def score(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, score and number-like features of every row."""

    def run(frames: Iterator[pd.DataFrame]):
        m = unpack(model)
        grammar = None if "none" in m else grammar_of(m)
        for frame in frames:
            if grammar is None:
                p = np.zeros(len(frame))
            else:
                x = np.array([grammar.features(t) if isinstance(t, str) else (0.0, 0.0, 0.0) for t in frame["text"]]).reshape(-1, 3)
                p = 1 / (1 + np.exp(-np.clip(np.concatenate([x, np.ones((len(x), 1))], 1) @ m["weights"], -30, 30)))
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "score": p})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, score double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = crc_fold(F.col("doc_id"), FOLDS)
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels").where(fold != HELD_OUT)))
    return scored.select("doc_id", (fold == HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
