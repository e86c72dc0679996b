"""Quality classifier: random Fourier features over document statistics, ridge, isotonic calibration.

Each text gives a row of statistics (shares of capitals, digits and symbols, repetition of words
and lines, lengths). Standardised, they go through random Fourier features, which approximate a
Gaussian kernel. Each partition sums its normal equations (Z'Z and Z'y); the sums are added and
solved with a ridge. On other labelled rows, pool-adjacent-violators fits the calibration from
ridge score to probability.

Fitted on a bounded sample: the ``MAX_ROWS`` labelled training rows with the least hash of
their id, dealt to ``PARTS`` partitions; a fifth of them serves for calibration. The texts stay
on the executors; only statistics sums and at most ``MAX_ROWS`` (score, label) pairs reach the
driver. Scoring is one pass without a shuffle.

Defined cases: null and empty texts have the statistics of no words; without labelled rows the
score is 0.5, with one label only its share; null labels are left out; repeated rows are scored
each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldlake.llm.common import batched, documents, fold_of

MAX_ROWS = 12000
PARTS = 8
FEATURES = 192
SYMBOLS = re.compile(r"[^\w\s.,;:'’\"()!?-]+")
STATS = 16


def statistics(text: str | None) -> list[float]:
    """``STATS`` numbers about a whole text."""
    t = text or ""
    n = max(len(t), 1)
    words = t.split()
    k = max(len(words), 1)
    counts = Counter(words)
    lines = t.split("\n")
    symbols = sum(map(len, SYMBOLS.findall(t)))
    upper = sum(map(str.isupper, words))
    twice = sum(map(str.__eq__, words, words[1:]))
    top = max(counts.values(), default=0)
    return [
        np.log1p(len(t)),
        np.log1p(len(words)),
        min(len(t) / k, 40.0),
        upper / k,
        symbols / n,
        t.count("|") / k,
        t.count("!") / k,
        (t.count(".") + t.count(",")) / k,
        twice / k,
        np.sqrt(twice / k),
        top / k,
        len(counts) / k,
        len(set(lines)) / len(lines),
        np.log1p(n / len(lines)),
        sum(map(str.istitle, words)) / k,
        sum(t.count(d) for d in "0123456789") / n,
    ]


def random_features(seed: int = 11, count: int = FEATURES, width: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and phases for a Gaussian kernel of that width."""
    rng = np.random.default_rng(seed)
    return rng.normal(size=(STATS, count)) / width, rng.uniform(0, 2 * np.pi, count)


def fourier(x: np.ndarray, mean: np.ndarray, spread: np.ndarray, waves: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Rows of features: the linear ones, cosines, and 1."""
    s = np.clip((x - mean) / spread, -8, 8)
    z = np.sqrt(2 / waves[0].shape[1]) * np.cos(s @ waves[0] + waves[1])
    return np.hstack([z, s * 0.1, np.ones((len(x), 1))])


def isotonic(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (knots, values), both rising; each block stands at its mean score."""
    order = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []
    for x, y in zip(scores[order], labels[order], strict=True):
        blocks.append([float(y), 1.0, float(x)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            y2, n2, x2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + y2, blocks[-1][1] + n2, blocks[-1][2] + x2]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return fourier(stats, self.mean, self.spread, random_features()) @ self.beta

    def probability(self, raw: np.ndarray) -> np.ndarray:
        """Calibrated; a thousandth of the raw score keeps the order within a level."""
        level = np.interp(raw, self.knots, self.values) if len(self.knots) else np.full(len(raw), 0.5)
        return np.clip(0.999 * level + 0.001 * np.clip(raw, 0, 1), 0, 1)


def _stats_frame(docs: DataFrame, keep: list[str]) -> DataFrame:
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[keep].copy()
            out["x"] = [statistics(t) for t in b["text"]]
            yield out

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return batched(docs).select(*keep, "text").mapInPandas(rows, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "x array<double>"]))


def _summed(rows: DataFrame, mean, spread) -> tuple[np.ndarray, np.ndarray]:
    """Normal equations of the rows: each partition sends one sum."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waves, a, b = random_features(), 0.0, 0.0
        for f in batches:
            if len(f):
                z = fourier(np.array(f["x"].tolist()), mean, spread, waves)
                a, b = a + z.T @ z, b + z.T @ f["y"].to_numpy(float)
        if not np.isscalar(a):
            yield pd.DataFrame({"a": [a.tobytes()], "b": [b.tobytes()]})

    parts = batched(rows).mapInPandas(sums, "a binary, b binary").collect()  # one row a partition, PARTS at most
    size = FEATURES + STATS + 1
    a = sum((np.frombuffer(p.a).reshape(size, size) for p in parts), np.zeros((size, size)))
    return a, sum((np.frombuffer(p.b) for p in parts), np.zeros(size))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, folds: int = 4, held: int = 2) -> Model:
    ids = labels.filter(F.col("quality").isin(0, 1) & (fold_of(F.col("doc_id"), folds) != held)).groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").cast("double").alias("y"))
    ids = ids.join(docs.select(F.col("doc_id").alias("_id")).distinct(), "_id", "left_semi")
    ids = F.broadcast(ids.orderBy(F.xxhash64("_id"), "_id").limit(max_rows))  # at most max_rows ids
    picked = docs.select(F.col("doc_id").alias("_id"), "text").join(ids, "_id").withColumn("part", F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(5)))
    rows = _stats_frame(picked, ["y", "part"]).repartition(PARTS).persist()
    try:
        fit_rows, cal_rows = rows.filter("part > 0"), rows.filter("part = 0")
        each = [F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(STATS)] + [F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(STATS)]
        first = fit_rows.agg(F.count("y").alias("n"), F.avg("y").alias("y"), *each).first()
        empty = np.zeros(0)
        if not first["n"]:
            return Model(np.zeros(STATS), np.ones(STATS), np.zeros(FEATURES + STATS + 1), empty, empty)
        mean = np.array([first[f"m{i}"] for i in range(STATS)])
        spread = np.array([first[f"s{i}"] or 1.0 for i in range(STATS)])
        a, b = _summed(fit_rows, mean, spread)
        beta = np.linalg.solve(a + 1e-3 * first["n"] / 100 * np.eye(len(a)), b)
        model = Model(mean, spread, beta, np.array([0.0]), np.array([first["y"]]))
        pairs = cal_rows.select("x", "y").collect() or fit_rows.select("x", "y").collect()  # max_rows rows of STATS numbers at most
        raw = model.raw(np.array([p.x for p in pairs]))
        order = np.lexsort((np.array([p.y for p in pairs]), raw))  # the same whatever order rows came in
        model.knots, model.values = isotonic(raw[order], np.array([p.y for p in pairs])[order])
        return model
    finally:
        rows.unpersist()


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row."""

    def rate(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            x = np.array([statistics(s) for s in t]) if len(t) else np.zeros((0, STATS))
            yield pd.Series(model.probability(model.raw(x)))

    rate.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return batched(docs).select("doc_id", F.pandas_udf(rate, "double")("text").alias("score"))


def op3_quality(spark, sf_dir):
    docs, labels = documents(spark, sf_dir), documents(spark, sf_dir, "labels")
    rows = score(docs, train(docs, labels))
    return rows.select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op3_quality": op3_quality}
ORACLES: dict[str, str] = {}
