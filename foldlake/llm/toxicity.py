"""Toxicity: a counterfactually regularised classifier.

A logistic model over the distinct words of a text, by hashed features of each word and its
affixes. It is fitted by proximal gradient steps under an L1 penalty, which leaves the weights
of words that tell nothing at zero, so that long texts do not add them up. For every sentence
of a labelled text that mentions an identity term, counterfactuals are built by swapping the
term for the others of its group, and the squared change of the score is penalised; so a group
mention as such carries no weight.

Fitted on a bounded sample: at most ``MAX_ROWS`` labelled rows for each label, those with the least
hash of id and text. Executors turn them into counts of hashed features and differences of swapped
sentences, each told once with its number; only these numbers reach the driver, never a text. Scoring
is one pass without a shuffle.

Defined cases: null and empty texts get the score of no words; a text of any length is scored whole;
with no labelled row, or none of one label, every score is the share of the label in the sample (0.5
for none); null labels are left out; an id with both labels counts as toxic; repeated rows are scored
each; an empty table gives no rows; other columns are ignored and keep their values, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldlake.llm.common import batched, documents, fold_of, free_name
from foldlake.llm.words import WordScores, features_of, words_of

DIMS = 1 << 16
MAX_ROWS = 1500

#: Groups of terms that stand for one another, each of one language.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man", "girl", "boy"),
    ("femmes", "hommes"),
    ("frauen", "männer"),
    ("mujeres", "hombres"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "blind", "deaf", "autistic"),
    ("old", "young", "elderly"),
)
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def counterfactuals(text: str, groups=IDENTITY_TERMS) -> list[tuple[list[str], list[str]]]:
    """Pairs of words: of a sentence with an identity term, and with the term swapped, for every other of its group."""
    where = {t: (g, i) for g in groups for i, t in enumerate(g)}
    out = []
    for sentence in SENTENCE.split(text or ""):
        words = words_of(sentence)
        for k, w in enumerate(words):
            if w in where:
                group, i = where[w]
                for s in range(1, len(group)):
                    out.append((words, words[:k] + [group[(i + s) % len(group)]] + words[k + 1 :]))
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, texts) -> np.ndarray:
        sums = WordScores(self.weights)
        return self.squash([sums(set(words_of(t))) for t in texts])

    def squash(self, sums) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.asarray(sums, float) + self.bias, -40, 40)))


class _Rows:
    """Sparse rows of feature counts in flat arrays: product with weights, and its transpose."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], dims: int):
        self.n, self.dims = len(rows), dims
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), [len(c) for c, _ in rows])
        self.col = np.concatenate([c for c, _ in rows]) if rows else np.zeros(0, np.int32)
        self.val = np.concatenate([v for _, v in rows]) if rows else np.zeros(0, np.float32)

    def keep(self, columns: np.ndarray) -> None:
        """Drop the entries of other columns."""
        m = columns[self.col]
        self.row, self.col, self.val = self.row[m], self.col[m], self.val[m]

    def dot(self, w):
        return np.bincount(self.row, self.val * w[self.col], self.n)

    def back(self, x):
        return np.bincount(self.col, self.val * x[self.row], self.dims)


def _counts(words, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, how many of the distinct words have them)."""
    cols, n = np.unique(np.fromiter((f for w in set(words) for f in features_of(w, dims)), np.int32), return_counts=True)
    return cols, n.astype(np.float32)


def _difference(a, b, dims: int) -> tuple[np.ndarray, np.ndarray]:
    (ca, na), (cb, nb) = _counts(a, dims), _counts(b, dims)
    cols, where = np.unique(np.concatenate([ca, cb]), return_inverse=True)
    v = np.bincount(where, np.concatenate([na, -nb])).astype(np.float32)
    return cols[v != 0], v[v != 0]


Sparse = tuple[np.ndarray, np.ndarray]


def features(text: str | None, groups=IDENTITY_TERMS, dims: int = DIMS) -> tuple[Sparse, list[tuple[Sparse, int]]]:
    """(feature counts of a text, differences of its swapped sentences and how often each occurs)."""
    kept: dict[bytes, tuple[Sparse, int]] = {}
    for a, b in counterfactuals(text or "", groups):
        d = _difference(a, b, dims)
        key = d[0].tobytes() + d[1].tobytes()
        kept[key] = (d, kept[key][1] + 1 if key in kept else 1)
    return _counts(words_of(text), dims), list(kept.values())


def fit(texts, labels, groups=IDENTITY_TERMS, dims: int = DIMS, **how) -> Model:
    return solve([features(t, groups, dims) for t in texts], labels, dims, **how)


def solve(made: list[tuple[Sparse, list[tuple[Sparse, int]]]], labels, dims: int = DIMS, l1: float = 1e-2, fairness: float = 1.0, steps: int = 150, least: int = 3) -> Model:
    """``least``: texts that must have a feature. ``fairness`` weighs the mean squared score change over all swapped sentences."""
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return Model(np.zeros(dims), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    rows = _Rows([r for r, _ in made], dims)
    rows.keep(np.bincount(rows.col, minlength=dims) >= least)
    pairs = [p for _, ps in made for p in ps]
    swaps, times = _Rows([d for d, _ in pairs], dims), np.array([n for _, n in pairs], float)
    times /= max(times.sum(), 1)
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    # Common features get shorter steps: each is scaled by its root mean square.
    scale = np.sqrt(np.bincount(rows.col, rows.val**2, dims) / rows.n)
    scale[scale == 0] = 1.0
    rows.val /= scale[rows.col].astype(np.float32)
    if swaps.n:
        swaps.val /= scale[swaps.col].astype(np.float32)
    # Lipschitz bound by power iteration.
    v = np.random.default_rng(7).normal(size=dims)
    for _ in range(12):
        v = rows.back(rows.dot(v)) / rows.n * 0.25 + (2 * fairness * swaps.back(swaps.dot(v) * times) if swaps.n else 0)
        top = np.linalg.norm(v)
        v /= max(top, 1e-12)
    rate = 1 / (1.5 * top + 0.5)
    w, u, b, c, t = np.zeros(dims), np.zeros(dims), 0.0, 0.0, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(rows.dot(u) + c, -40, 40)))
        g = (p - y) * share
        grad = rows.back(g) / rows.n
        if swaps.n:
            grad += 2 * fairness * swaps.back(swaps.dot(u) * times)
        nw = u - rate * grad
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * l1, 0)
        nb = c - rate * g.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, c = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return Model(w / scale, float(b))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, per_label: int) -> DataFrame:
    """(text, y): for each label the ``per_label`` training rows with the least hash of id and text. Never a held-out row."""
    ids = labels.filter(F.col(label).isin(0, 1) & (fold_of(F.col("doc_id"), folds) != held)).select(F.col("doc_id").alias("_id"), F.col(label).alias("y"))
    ids = ids.groupBy("_id").agg(F.max("y").alias("y")).join(docs.select(F.col("doc_id").alias("_id")).distinct(), "_id", "left_semi")
    picked = [ids.filter(F.col("y") == v).orderBy(F.xxhash64("_id"), "_id").limit(per_label) for v in (0, 1)]
    picked = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * per_label ids
    rows = docs.select(F.col("doc_id").alias("_id"), "text").join(picked, "_id")
    # An id may have any number of rows: the window's limit keeps few of them before its shuffle.
    first = F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("_id", F.coalesce("text", F.lit("")))))
    return rows.withColumn("_k", first).filter(F.col("_k") <= per_label).select("text", "y")


def _features_frame(sample: DataFrame) -> DataFrame:
    """The sample's features, made on the executors."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [features(t) for t in b["text"]]
            yield pd.DataFrame({
                "y": b["y"].astype("int32"),
                "cols": [c.astype(np.int32).tobytes() for (c, _), _ in out],
                "vals": [v.astype(np.float32).tobytes() for (_, v), _ in out],
                "swaps": [[{"cols": c.astype(np.int32).tobytes(), "vals": v.astype(np.float32).tobytes(), "n": n} for (c, v), n in s] for _, s in out],
            })

    return batched(sample).mapInPandas(make, "y int, cols binary, vals binary, swaps array<struct<cols:binary,vals:binary,n:int>>")


def train(docs: DataFrame, labels: DataFrame, per_label: int = MAX_ROWS) -> Model:
    sparse = lambda r: (np.frombuffer(r.cols, np.int32), np.frombuffer(r.vals, np.float32))
    rows = _features_frame(labelled_sample(docs, labels, "toxic", 5, 0, per_label)).toLocalIterator()  # 2 * per_label rows at most
    made = [((r.y, bytes(r.cols), bytes(r.vals)), sparse(r), [(sparse(s), s.n) for s in r.swaps]) for r in rows]
    made.sort(key=lambda m: m[0])  # the same model whatever order rows come in
    return solve([m[1:] for m in made], [m[0][0] for m in made])


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``score``, with underscores before it if that name is taken."""
    name = free_name(docs, "score")
    keep = np.flatnonzero(model.weights)
    sparse, bias, dims = (keep, model.weights[keep]), model.bias, len(model.weights)

    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = np.zeros(dims)
        w[sparse[0]] = sparse[1]
        m, sums = Model(w, bias), WordScores(w)
        for texts in batches:
            yield pd.Series(m.squash([sums(set(words_of(t))) for t in texts]))

    return batched(docs).withColumn(name, F.pandas_udf(_evaluated(rate), "double").asNondeterministic()(F.col(text_col)))


def _evaluated(f):
    """Spark reads the kind of UDF from real types, not from strings."""
    f.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return f


def op1_toxicity(spark, sf_dir):
    docs, labels = documents(spark, sf_dir), documents(spark, sf_dir, "labels")
    rows = score(docs.select("doc_id", "text"), train(docs, labels))
    return rows.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_stage(spark, docs, sf_dir):
    """Pipeline stage: documents with a score of 0.5 or more go."""
    model = train(docs, documents(spark, sf_dir, "labels"))
    scored = score(docs, model)
    name = next(c for c in scored.columns if c not in docs.columns)
    return scored.filter(F.col(name) < 0.5).select(*docs.columns)


QUERIES = {"op1_toxicity": op1_toxicity}
ORACLES: dict[str, str] = {}
