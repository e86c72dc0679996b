"""Benchmark decontamination by q-gram lemma filtering.

A pattern of m characters that matches a stretch of text within e edits shares at least
m + 1 - q(e + 1) of its q-grams with it, and all on diagonals (text position minus pattern
position) that lie within e of each other. So the q-grams of a text that occur in the benchmark
are counted by pattern and diagonal band; bands are 2w diagonals wide (w > e) and start every w,
so that any match lies in one of them. Regions that reach the count are retained and verified by
an alignment banded to their diagonals.

Texts are normalised first: lower case, and every run of characters other than letters and digits is one space.
Patterns are windows of each benchmark item (the last one flush with the end), or the whole item if
that is shorter: those of ``WINDOW`` characters, ``STRIDE`` apart, of which ``RATE`` may be edits, and
the shorter and denser ones of ``PASSAGES``. So any verbatim passage of ``PASSAGE`` characters
(normalised, from any offset that is no space) holds a whole window and is found. An item of under
``Q`` characters must appear exactly, as whole words. Grams are kept once for an item and counted for
its windows only where an item and band have enough of them.

The benchmark goes to the tasks in blocks of at most ``BLOCK_CHARS`` characters, each a closure of
that proven size; documents are read once for a block and never shuffled.

Defined cases: null or empty texts are clean; an item that is null or has no letter or digit
matches nothing; an empty benchmark leaves every document clean; repeated rows are searched each
(and rows of one id, null included, count together in the report);
texts of any length are searched whole; columns other than those named are passed through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldlake.llm.common import batched, documents

Q = 10
WINDOW = 100
STRIDE = 50
RATE = 0.08
#: (size, stride, rate of edits) of the windows for parts of items: short ones are to be nearly verbatim.
PASSAGES = ((60, 10, RATE), (44, 4, RATE / 2))
PASSAGE = min(size + stride - 1 for size, stride, _ in PASSAGES)
BLOCK_CHARS = 4_000_000
GAP = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    return GAP.sub(" ", (text or "").lower()).strip()


def edit_budget(m: int, rate: float = RATE, q: int = Q) -> int:
    """Edits allowed for a pattern of m characters: ``rate`` of them, as far as the lemma still asks for a gram."""
    return max(0, min(int(rate * m), m // q - 1))


def windows(text: str, size: int = WINDOW, stride: int = STRIDE) -> list[tuple[int, str]]:
    if len(text) <= size:
        return [(0, text)]
    starts = [*range(0, len(text) - size, stride), len(text) - size]
    return [(s, text[s : s + size]) for s in starts]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the Q-grams at each position."""
    if len(codes) < Q:
        return np.zeros(0, np.uint64)
    mul = np.uint64(0x9E3779B97F4A7C15)
    one = codes.astype(np.uint64)
    two = one[:-1] * mul + one[1:]
    four = (two[:-2] * mul) ^ (two[2:] >> np.uint64(7)) ^ two[2:]
    eight = (four[:-4] * mul) ^ (four[4:] >> np.uint64(9)) ^ four[4:]
    h = (eight[: len(codes) - Q + 1] * mul) ^ two[8 : 8 + len(codes) - Q + 1]
    return h ^ (h >> np.uint64(29))


def banded_alignments(patterns: list[np.ndarray], codes: np.ndarray, lows: np.ndarray, wide: int, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edits, stops): for each pattern the least edits to a stretch of ``codes`` and where that stops, exclusive.

    The stretch lies between begin and end and starts anywhere; diagonals (text position minus
    pattern position) go from low to low + wide - 1. All alignments advance a character at a time.
    """
    size = np.array([len(p) for p in patterns])
    chars = np.full((len(patterns), size.max()), -1, np.int64)
    for k, p in enumerate(patterns):
        chars[k, : len(p)] = p
    far = int(size.max()) * 2 + wide + 1
    offset = np.arange(wide)
    lo, hi = begins[:, None], ends[:, None]
    place = lows[:, None] + offset  # text position on each diagonal before the row's character
    row = np.where((place >= lo) & (place <= hi), 0, far)
    text = codes.astype(np.int64)
    edits, stops = np.full(len(patterns), far), np.zeros(len(patterns), np.int64)
    gone = np.full((len(patterns), 1), far)
    for i in range(int(size.max())):
        met = (place >= lo) & (place < hi)
        same = text[np.clip(place, 0, len(text) - 1)] == chars[:, i : i + 1]
        step = np.where(met, row + ~same, far)
        place = place + 1
        valid = (place >= lo) & (place <= hi)
        # The pattern's character has no partner: same text position, one diagonal down.
        down = np.hstack([row[:, 1:], gone]) + 1
        row = np.where(valid, np.minimum(step, down), far)
        # A character of the text has no partner.
        row = np.where(valid, np.minimum.accumulate(row - offset, axis=1) + offset, far)
        for k in np.flatnonzero(size == i + 1):
            best = int(row[k].argmin())
            edits[k], stops[k] = row[k, best], place[k, best]
    return edits, stops


@dataclass
class Pattern:
    item: int
    start: int
    text: str
    codes: np.ndarray
    budget: int
    shift: int  # bands start every 2**shift diagonals and are twice as wide


class Windows(Sequence):
    """The windows of one size of all items, made when asked for."""

    def __init__(self, items: list[tuple[int, str]], bases: list[int], size: int, stride: int, rate: float = RATE, words: bool = False):
        self.items, self.rate, self.shift = items, rate, max(3, edit_budget(size, rate).bit_length())
        # A text does not begin with a space, so a window that would starts a character before (``words``).
        starts = [[s - (words and t[s] == " " and s + size < len(t)) for s, _ in windows(t, size, stride)] for _, t in items]
        if words:  # whole items are patterns already
            starts = [s if len(t) > size else [] for s, (_, t) in zip(starts, items, strict=True)]
        self.count = np.array([len(s) for s in starts], np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.owner = np.repeat(np.arange(len(items)), self.count)
        self.start = np.array([s for part in starts for s in part], np.int64)
        self.begin = self.start + np.array(bases, np.int64)[self.owner]
        self.size = np.array([min(size, len(t)) for _, t in items], np.int64)
        # The least grams that a match shares with a window; the windows of an item are of one length.
        self.need = np.array([m + 1 - Q * (edit_budget(m, rate) + 1) for m in self.size.tolist()], np.int64)
        self.need[self.count == 0] = 1 << 40

    def __len__(self) -> int:
        return len(self.start)

    def __getitem__(self, k: int) -> Pattern:
        if not 0 <= k < len(self):
            raise IndexError(k)
        o, start = int(self.owner[k]), int(self.start[k])
        item, text = self.items[o]
        text = text[start : start + int(self.size[o])]
        return Pattern(item, start, text, _codes(text), edit_budget(len(text), self.rate), self.shift)


class Patterns(Sequence):
    """Windows of several sizes, numbered through."""

    def __init__(self, kinds: list[Windows]):
        self.kinds = kinds
        self.offsets = [sum(map(len, kinds[:i])) for i in range(len(kinds))]

    def __len__(self) -> int:
        return sum(map(len, self.kinds))

    def __getitem__(self, k: int) -> Pattern:
        i = max(i for i, at in enumerate(self.offsets) if at <= k)
        return self.kinds[i][k - self.offsets[i]]


class Matcher:
    """Finds the patterns of a block of benchmark items in batches of texts."""

    BITS = 22

    def __init__(self, items: list[tuple[int, str]]):
        self.short, long, bases, chars = [], [], [], 0
        grams, owners, places = [], [], []
        for item, text in items:
            t = normal(text)
            if not t:
                continue
            if len(t) < Q:
                self.short.append((item, f" {t} "))
                continue
            g = _grams(_codes(t))
            grams.append(g)
            owners.append(np.full(len(g), len(long), np.int32))
            places.append(np.arange(len(g), dtype=np.int32))
            long.append((item, t))
            bases.append(chars)
            chars += len(t)
        kinds = [Windows(long, bases, WINDOW, STRIDE), *(Windows(long, bases, *p, words=True) for p in PASSAGES)]
        self.patterns = Patterns(kinds if long else [])
        if not grams:
            return
        self.base, self.chars, self.far = np.array(bases, np.int64), chars, max(len(t) for _, t in long)
        g = np.concatenate(grams)
        order = np.argsort(g, kind="stable")
        self.owner, self.place = np.concatenate(owners)[order], np.concatenate(places)[order]
        self.grams, self.first = np.unique(g[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(g)))
        self.mask = np.zeros(1 << self.BITS, bool)
        self.mask[(self.grams >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    def _hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, index of a known gram) of the text's grams that the items have."""
        g = _grams(codes)
        pos = np.flatnonzero(self.mask[(g >> np.uint64(64 - self.BITS)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.grams, g[pos]), len(self.grams) - 1)
        same = self.grams[k] == g[pos]
        return pos[same], k[same]

    def regions(self, codes: np.ndarray) -> list[tuple[int, int, int]]:
        """(pattern, lowest diagonal, highest diagonal) of the bands that reach the count."""
        pos, k = self._hits(codes)
        if not len(pos):
            return []
        each = self.count[k]
        spread = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(self.first[k], each)
        owner, place = self.owner[spread].astype(np.int64), self.place[spread].astype(np.int64)
        diagonal = np.repeat(pos, each) - place + self.far  # of the item; never negative
        out = []
        for kind, offset in zip(self.patterns.kinds, self.patterns.offsets, strict=True):
            out += self._bands(kind, offset, owner, place, diagonal)
        return out

    def _bands(self, kind: Windows, offset: int, owner: np.ndarray, place: np.ndarray, diagonal: np.ndarray) -> Iterator[tuple[int, int, int]]:
        wide = np.int64(1) << 32
        cell = owner * wide + (diagonal >> kind.shift) + 1
        seen, at, n = np.unique(cell, return_inverse=True, return_counts=True)
        # The band that starts in a cell has the hits of that cell and of the next.
        follows = np.append(seen[1:] == seen[:-1] + 1, False)
        precedes = np.append(False, follows[:-1])
        need = kind.need[seen // wide]
        after = n + np.where(follows, np.append(n[1:], 0), 0) >= need
        before = n + np.where(precedes, np.append(0, n[:-1]), 0) >= need
        both = np.concatenate([np.flatnonzero(after[at]), np.flatnonzero(before[at])])
        if not len(both):
            return
        # A band is named by the cell it starts in, plus one.
        band = np.concatenate([cell[after[at]], cell[before[at]] - 1])
        names, band = np.unique(band, return_inverse=True)
        # A gram of the item counts once in a band, however often the text repeats it.
        once = np.unique(band * self.chars + self.base[owner[both]] + place[both])
        band, begin = once // self.chars, once % self.chars
        item = names[band] // wide
        low = np.maximum(np.searchsorted(kind.begin, begin - (kind.size[item] - Q)), kind.first[item])
        each = np.searchsorted(kind.begin, begin, side="right") - low
        window = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(low, each)
        key, n = np.unique(np.repeat(band, each) * len(kind) + window, return_counts=True)
        band, window = key // len(kind), key % len(kind)
        good = n >= kind.need[kind.owner[window]]
        for b, o in zip((names[band[good]] % wide).tolist(), window[good].tolist(), strict=True):
            lowest = ((b - 1) << kind.shift) - self.far + int(kind.start[o])
            yield offset + o, lowest, lowest + (2 << kind.shift) - 1

    def search(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """For each normalised text, (item, start, end, edits) of its matches, the best of each pattern."""
        found: list[list] = [[] for _ in texts]
        for i, t in enumerate(texts):
            if self.short and t:
                padded = f" {t} "
                found[i] += [(item, at, at + len(s) - 2, 0) for item, s in self.short if (at := padded.find(s)) >= 0]
        if not self.patterns:
            return found
        # One array for many texts: the line feed between them is in no pattern.
        lo = 0
        while lo < len(texts):
            hi, chars = lo, 0
            while hi < len(texts) and (hi == lo or chars + len(texts[hi]) < 300_000):
                chars += len(texts[hi]) + 1
                hi += 1
            joined = "\n".join(texts[lo:hi])
            codes, ends = _codes(joined), np.cumsum([len(t) + 1 for t in texts[lo:hi]])
            best: dict[tuple[int, int], tuple[int, int, int]] = {}
            todo: list[tuple[int, int, int, int, int]] = []
            for o, low, high in self.regions(codes):
                text = self.patterns[o].text
                m = len(text)
                for d in range(int(np.searchsorted(ends, max(0, low), side="right")), min(len(ends) - 1, int(np.searchsorted(ends, high + m, side="right"))) + 1):
                    if best.get((o, d), (1,))[0] == 0:
                        continue
                    begin, end = (int(ends[d - 1]) if d else 0), int(ends[d]) - 1
                    exact = joined.find(text, max(begin, low), max(begin, min(end, high + m)))
                    if exact >= 0:
                        best[o, d] = (0, exact - begin, exact - begin + m)
                    else:
                        todo.append((o, d, low, begin, end))
            self._align([t for t in todo if best.get(t[:2], (1,))[0]], codes, best)
            for (o, d), (edits, start, stop) in best.items():
                found[lo + d].append((self.patterns[o].item, start, stop, edits))
            lo = hi
        return found

    def _align(self, todo: list[tuple[int, int, int, int, int]], codes: np.ndarray, best: dict) -> None:
        """Verify regions (pattern, text, lowest diagonal, begin, end), those of one band width together."""
        kept = {o: self.patterns[o] for o in {t[0] for t in todo}}
        for shift in {p.shift for p in kept.values()}:
            same = [t for t in todo if kept[t[0]].shift == shift]
            for k in range(0, len(same), 256):
                part = same[k : k + 256]
                ps = [kept[t[0]] for t in part]
                low, begin, end = (np.array([t[i] for t in part], np.int64) for i in (2, 3, 4))
                edits, stops = banded_alignments([p.codes for p in ps], codes, low, 2 << shift, begin, end)
                for (o, d, _, b, _), p, e, stop in zip(part, ps, edits.tolist(), stops.tolist(), strict=True):
                    if e <= p.budget and e < best.get((o, d), (e + 1,))[0]:
                        best[o, d] = (e, max(0, stop - len(p.text) - b), stop - b)


def blocks(benchmark: DataFrame, most: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in blocks of at most ``most`` characters (or of one longer item)."""
    block, chars = [], 0
    for r in benchmark.select("item_id", "text").orderBy("item_id").toLocalIterator():
        size = len(r.text or "")
        if block and chars + size > most:
            yield block
            block, chars = [], 0
        block.append((r.item_id, r.text or ""))
        chars += size
    if block:
        yield block


MATCHES = "array<struct<item_id:bigint,start:int,end:int,edits:int>>"


def matches(docs: DataFrame, items: list[tuple[int, str]], name: str) -> DataFrame:
    """``docs`` with a column of the matches with one block of items: positions in the normalised text."""

    def find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(items)
        for t in texts:
            found = matcher.search([normal(x) for x in t])
            yield pd.Series([[{"item_id": i, "start": a, "end": b, "edits": e} for i, a, b, e in sorted(f)] for f in found], dtype=object)

    find.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    # Not deterministic in name only: so the optimizer does not evaluate it once for the filter and again for its rows.
    return batched(docs).withColumn(name, F.pandas_udf(find, MATCHES).asNondeterministic()("text"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, windows, edits, start, end) for every document and item that it has a window of."""
    out = None
    for items in blocks(benchmark):
        rows = matches(docs.select("doc_id", "text"), items, "m").filter(F.size("m") > 0).select("doc_id", F.explode("m").alias("m"))
        rows = rows.groupBy("doc_id", F.col("m.item_id").alias("item_id")).agg(
            F.count(F.lit(1)).alias("windows"), F.min("m.edits").alias("edits"), F.min("m.start").alias("start"), F.max("m.end").alias("end")
        )
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, windows bigint, edits int, start int, end int")
    return out


def op6_decontamination(spark, sf_dir):
    return contaminated(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def filter_stage(spark, docs, sf_dir):
    """Pipeline stage: documents with a window of a benchmark item go."""
    out = docs
    for items in blocks(documents(spark, sf_dir, "benchmark")):
        name = "_m" + "_" * max(map(len, docs.columns), default=0)
        out = matches(out, items, name).filter(F.size(name) == 0).select(*docs.columns)
    return out


QUERIES = {"op6_decontamination": op6_decontamination}
ORACLES: dict[str, str] = {}
