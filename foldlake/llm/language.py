"""Language ID: a linear-chain conditional random field over words.

Every word has emission scores from hashed features (affixes, character n-grams, the word itself
and whether the learned lexicon of a language has it), neighbouring words have learned
transition scores, and forward-backward gives each word's label probabilities, so that
code-switched text is labelled word by word. A document's language is the one with the most
probability mass over its words, and its score is that share.

Training: averaged stochastic gradient steps on the log likelihood. Documents carry one label
each, so sequences are spliced from stretches of documents of different languages; that is
where the transitions are learned. Every language seen is learned. The sample is bounded: ``MAX_DOCS`` documents for
each language, those with the least hash of id and text, and fewer (one at least) if all languages
together would have more than ``MAX_ROWS``. From these, ``SEQUENCES`` sequences of ``LENGTH`` words are
spliced, or ``PER_LANGUAGE`` for each language if that is more.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and so is every
text if nothing was learned or no row can teach; null labels are not learned from; repeated rows
are labelled each and learned from once; of languages with one mass the first by name is given;
words of any length and texts of any number of words are used whole; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldlake.llm.common import batched, documents, fold_of

DIMS = 1 << 15
MAX_DOCS = 250
MAX_ROWS = 16_000
SEQUENCES = 2400
PER_LANGUAGE = 150
LENGTH = 32
WIDEN = 8
#: Words kept with their emission scores in each Python worker.
CACHE = 600_000
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def features_of(word: str) -> list[int]:
    """Hashed affixes, character bigrams and trigrams, and the word."""
    w = f"<{word}>"
    keys = {"w" + w, "i" + w[:2], "i" + w[:3], "i" + w[:4], "f" + w[-2:], "f" + w[-3:], "f" + w[-4:]}
    keys.update("g" + w[i : i + 2] for i in range(len(w) - 1))
    keys.update("t" + w[i : i + 3] for i in range(len(w) - 2))
    return [crc32(k.encode()) % DIMS for k in keys]


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # DIMS x labels
    lexicon: dict[str, int]  # word -> bits of the labels that have it
    lexicon_weights: np.ndarray  # labels
    transitions: np.ndarray  # from x to
    start: np.ndarray

    def emission(self, word: str) -> np.ndarray:
        f = features_of(word)
        e = self.weights[f].sum(0) / np.sqrt(len(f))
        if bits := self.lexicon.get(word):
            e = e + self.lexicon_weights * [(bits >> i) & 1 for i in range(len(self.labels))]
        return e


def forward_backward(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities (batch x time x label) and summed pair probabilities (label x label).

    ``emissions`` is padded to batch x time x label, rows by falling length. Scaled in each step.
    """
    n, steps, _ = emissions.shape
    e = np.exp(emissions - emissions.max(2, keepdims=True))
    a, t = np.empty_like(e), np.exp(transitions - transitions.max())
    live = np.searchsorted(-lengths, -np.arange(steps), side="left")  # rows longer than each step
    scale = np.ones((n, steps))
    x = np.exp(start - start.max()) * e[:, 0]
    for i in range(steps):
        m = live[i]
        if i:
            x = (a[:m, i - 1] @ t) * e[:m, i]
        s = x.sum(1)
        scale[:m, i] = s
        a[:m, i] = x[:m] / s[:m, None]
        x = a[:m, i]
    out, pairs, b = np.zeros_like(e), np.zeros_like(t), np.ones((n, e.shape[2]))
    for i in range(steps - 1, -1, -1):
        m = live[i]
        if i + 1 < steps and live[i + 1]:
            k = live[i + 1]
            v = e[:k, i + 1] * b[:k] / scale[:k, i + 1, None]
            pairs += (a[:k, i].T @ v) * t
            b[:k] = v @ t.T
        out[:m, i] = a[:m, i] * b[:m]
    return out, pairs


def _spliced(docs: list[tuple[str, int]], rng, count: int, length: int) -> list[tuple[list[str], list[int]]]:
    """Sequences of stretches from documents of any label; most have one or two switches."""
    worded = [(w, y) for t, y in docs if len(w := words_of(t)) >= 1]
    by_label: dict[int, list[list[str]]] = {}
    for w, y in worded:
        by_label.setdefault(y, []).append(w)
    labels, out = sorted(by_label), []
    for _ in range(count):
        cuts = np.sort(rng.integers(4, length - 4, rng.integers(0, 3)))
        words, ys = [], []
        for lo, hi in zip([0, *cuts], [*cuts, length], strict=True):
            y = labels[rng.integers(len(labels))]
            w = by_label[y][rng.integers(len(by_label[y]))]
            at = rng.integers(max(1, len(w) - (hi - lo) + 1))
            piece = w[at : at + hi - lo]
            words += piece
            ys += [y] * len(piece)
        out.append((words, ys))
    return out


def fit(texts, langs, epochs: int = 3, sequences: int = SEQUENCES, length: int = LENGTH, batch: int = 48, rate: float = 0.35) -> Model | None:
    labels = sorted(set(langs))
    if not labels:
        return None
    sequences = max(sequences, PER_LANGUAGE * len(labels))
    rng, size = np.random.default_rng(3), len(labels)
    at = {x: i for i, x in enumerate(labels)}
    docs = [(t, at[x]) for t, x in zip(texts, langs, strict=True)]
    if not any(words_of(t) for t, _ in docs):
        return None
    seen = [Counter() for _ in labels]
    for t, y in docs:
        seen[y].update(set(words_of(t)))
    lexicon: dict[str, int] = {}
    for i, c in enumerate(seen):
        for w, k in c.items():
            if k >= 3:
                lexicon[w] = lexicon.get(w, 0) | (1 << i)
    m = Model(labels, np.zeros((DIMS, size)), lexicon, np.zeros(size), np.zeros((size, size)), np.zeros(size))
    data = _spliced(docs, rng, sequences, length)
    known: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for w in {w for s, _ in data for w in s}:
        bits = lexicon.get(w, 0)
        known[w] = (np.array(features_of(w)), np.array([(bits >> i) & 1 for i in range(size)], float))
    grad2, total, steps = np.full((DIMS, size), 1e-6), np.zeros((DIMS, size)), 0
    kept = [np.zeros(size), np.zeros((size, size)), np.zeros(size)]
    for _ in range(epochs):
        for k in range(0, len(data), batch):
            chosen = sorted(data[k : k + batch], key=lambda s: -len(s[0]))
            flat = [w for s, _ in chosen for w in s]
            cols = np.concatenate([known[w][0] for w in flat])
            each = np.array([len(known[w][0]) for w in flat])
            rows = np.repeat(np.arange(len(flat)), each)
            norm = 1 / np.sqrt(each)
            lex = np.array([known[w][1] for w in flat])
            emit = np.add.reduceat(m.weights[cols], np.concatenate([[0], np.cumsum(each)[:-1]]), axis=0) * norm[:, None] + lex * m.lexicon_weights
            lengths = np.array([len(s) for s, _ in chosen])
            padded = np.zeros((len(chosen), lengths.max(), size))
            where = np.arange(lengths.max()) < lengths[:, None]
            padded[where] = emit
            prob, pairs = forward_backward(padded, lengths, m.transitions, m.start)
            gold = np.concatenate([y for _, y in chosen])
            gap = np.eye(size)[gold] - prob[where]
            true_pairs = np.zeros((size, size))
            for _, y in chosen:
                np.add.at(true_pairs, (np.array(y[:-1], int), np.array(y[1:], int)), 1)
            g = np.zeros((DIMS, size))
            np.add.at(g, cols, gap[rows] * norm[rows][:, None])
            hit = np.unique(cols)
            grad2[hit] += g[hit] ** 2
            m.weights[hit] += rate * g[hit] / np.sqrt(grad2[hit])
            m.lexicon_weights += rate * 0.2 * (gap * lex).sum(0) / len(flat) * 10
            m.transitions += rate * 2 * (true_pairs - pairs) / len(flat) * 10
            m.start += rate * 0.2 * (np.eye(size)[[y[0] for _, y in chosen]] - prob[:, 0]).mean(0)
            total += m.weights
            kept = [a + b for a, b in zip(kept, (m.lexicon_weights, m.transitions, m.start), strict=True)]
            steps += 1
    m.weights = (total / steps).astype(np.float32)
    m.lexicon_weights, m.transitions, m.start = (x / steps for x in kept)
    return m


class Labeller:
    """Applies a model to texts, with emission scores kept for words seen before."""

    def __init__(self, model: Model):
        self.model, self.ids = model, {}
        self.table = np.zeros((1024, len(model.labels)), np.float32)

    def _indices(self, words: list[str]) -> np.ndarray:
        ids = self.ids
        for w in set(words).difference(ids):
            k = len(ids)
            if k >= len(self.table):
                self.table = np.vstack([self.table, np.zeros_like(self.table)])
            self.table[k] = self.model.emission(w)
            ids[w] = k
        return np.fromiter(map(ids.__getitem__, words), np.int64, len(words))

    def probabilities(self, texts) -> list[np.ndarray | None]:
        """For each text, words x labels; None without words. Texts go in groups of like length."""
        out: list[np.ndarray | None] = [None] * len(texts)
        for group in self._groups(texts):
            lengths = np.array([len(e) for _, e in group])
            padded = np.zeros((len(group), lengths[0], len(self.model.labels)), np.float32)
            for k, (_, e) in enumerate(group):
                padded[k, : len(e)] = e
            prob, _ = forward_backward(padded, lengths, self.model.transitions.astype(np.float32), self.model.start.astype(np.float32))
            for k, (i, e) in enumerate(group):
                out[i] = prob[k, : len(e)]
        return out

    def _groups(self, texts, cells: int = 120_000, most: int = 512):
        found = []
        for i, t in enumerate(texts):
            if words := words_of(t):
                if len(self.ids) > CACHE:
                    self.ids.clear()
                ix = self._indices(words)  # may move the table
                found.append((i, self.table[ix]))
        found.sort(key=lambda x: -len(x[1]))
        group: list = []
        for x in found:
            if group and (len(group) >= most or (len(group) + 1) * len(group[0][1]) > cells):
                yield group
                group = []
            group.append(x)
        if group:
            yield group

    def documents(self, texts) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for p in self.probabilities(list(texts)):
            if p is None:
                langs.append("und")
                scores.append(0.0)
            else:
                mass = p.sum(0, dtype=float)
                k = int(mass.argmax())
                langs.append(self.model.labels[k])
                scores.append(float(min(1.0, mass[k] / mass.sum())))
        return langs, scores

    def words(self, text: str) -> list[tuple[str, str, float]]:
        """(word, language, probability) along a text: its code switches."""
        p = self.probabilities([text])[0]
        return [] if p is None else [(w, self.model.labels[int(q.argmax())], float(q.max())) for w, q in zip(words_of(text), p, strict=True)]


def sample(docs: DataFrame, max_docs: int = MAX_DOCS, max_rows: int = MAX_ROWS, folds: int = 5, held: int = 0) -> DataFrame:
    """(text, lang): the training rows, never a held-out one.

    The rows with the least hashes are wanted, so of a language with many rows only those below a
    hash under which ``WIDEN`` times as many are expected leave their task. A language most of whose rows
    repeat others may so give fewer than its share.
    """
    known = docs.filter(F.col("lang").isNotNull() & (fold_of(F.col("doc_id"), folds) != held))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))  # one row a language
    each = max(1, min(max_docs, max_rows // max(1, counts.count())))
    hashed = known.select("lang", F.xxhash64("doc_id", "text").alias("h"), "text").join(F.broadcast(counts), "lang")
    near = hashed.filter(F.col("h") / F.lit(2.0**64) + 0.5 <= F.lit(float(WIDEN * each)) / F.col("_n"))
    # Equal rows have equal hashes: dense ranks count them once.
    picked = near.withColumn("k", F.dense_rank().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("k") <= each)
    return picked.groupBy("lang", "h").agg(F.first("text").alias("text")).select("text", "lang")


def train(docs: DataFrame, max_docs: int = MAX_DOCS, max_rows: int = MAX_ROWS, folds: int = 5, held: int = 0) -> Model | None:
    pairs = sorted((r.text or "", r.lang) for r in sample(docs, max_docs, max_rows, folds, held).toLocalIterator())  # max_rows rows, or one a language
    return fit([p[0] for p in pairs], [p[1] for p in pairs])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs``' id with lang_pred and score."""
    if model is None:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def label(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(model)
        for t in texts:
            langs, scores = labeller.documents(t)
            yield pd.DataFrame({"lang_pred": pd.Series(langs, dtype=object), "score": pd.Series(scores, dtype=float)})

    label.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    out = batched(docs).select("doc_id", F.pandas_udf(label, "lang_pred string, score double")("text").alias("p"))
    return out.select("doc_id", "p.lang_pred", "p.score")


def op5_language(spark, sf_dir):
    docs = documents(spark, sf_dir)
    rows = predict(docs.select("doc_id", "text"), train(docs.select("doc_id", "text", "lang")))
    return rows.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


QUERIES = {"op5_language": op5_language}
ORACLES: dict[str, str] = {}
