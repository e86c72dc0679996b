"""Word features hashed to buckets, with a bounded cache; used by the toxicity classifier."""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
CACHE = 400_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def features_of(word: str, dims: int) -> list[int]:
    """Buckets of the word itself and of its affixes."""
    w = word.encode()
    keys = [b"w" + w] + [b"p" + word[:n].encode() for n in (3, 4, 5, 6) if len(word) > n] + [b"s" + word[-n:].encode() for n in (3, 4) if len(word) > n]
    return [crc32(k) % dims for k in keys]


class WordScores:
    """Sum of the weights of a word's features, kept for words seen before."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.dims, self.kept = weights.astype(float).tolist(), len(weights), {}

    def __call__(self, words) -> float:
        kept, total = self.kept, 0.0
        for w in words:
            s = kept.get(w)
            if s is None:
                if len(kept) >= CACHE:
                    kept.clear()
                s = kept[w] = sum(self.weights[i] for i in features_of(w, self.dims))
            total += s
        return total
