"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

A template of n shingles (of five words; of all its words if it has fewer) is sought in windows of 2s shingles that
begin at every s-th, where s is the power of two from n on: whatever s + 1 shingles in a row hold, one window holds
whole. A window with the required share of the template has a Jaccard similarity of at least need / (2s + n - need);
with one row per band, enough bands are taken that such a window shares one with a probability of 1 - MISS at least.
Hashes only retrieve: each retrieved pair is judged by the share of the template's shingles that the window has word by
word, shingles being named by their words' places in the templates.

Words are compared in lower case (A-Z) without what isn't a letter or digit of ASCII at either end; words of which
nothing is left don't count. Null and empty text match nothing. Rows are judged alone, so repeated rows repeat their
matches; null ids are carried. Ties between windows go to the first. Extra columns don't matter.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, slices
from .license_texts import TEMPLATES

SHINGLE = 5
CONTAINMENT = Fraction(4, 5)
MISS = 1e-6
_EDGES = re.compile(rb"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$")


def plain(word: bytes) -> bytes:
    """A word as it is compared; empty if it doesn't count."""
    return _EDGES.sub(b"", word.lower())


def need(n: int, share: Fraction = CONTAINMENT) -> int:
    """Shingles of n that a window must have."""
    return math.ceil(n * share)


def _rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    total = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for i in range(width):
        total += hashes[i : len(hashes) - width + 1 + i] * np.uint64(pow(0x9E3779B97F4A7C15, i, 1 << 64))
    total = (total ^ (total >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return total ^ (total >> np.uint64(29))


def _hashed(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def _turned(h: np.ndarray, i: int) -> np.ndarray:
    """The i-th hash function of the MinHash, of 32 bits."""
    factor = pow(0xD1342543DE82EF95, 2 * i + 1, 1 << 64)
    return ((h * np.uint64(factor)) >> np.uint64(32)).astype(np.uint32)


class Spellings:
    """Exact numbers of the templates' words and shingles, from 1; 0 is any other.

    A shingle grows word by word: the number of its beginning and that of the next word make a pair, and pairs are
    numbered in order. No hash is involved, so equal numbers are equal words.
    """

    def __init__(self, width: int, templates: list[list[bytes]]):
        self.words = {w: i + 1 for i, w in enumerate(sorted({w for t in templates for w in t}))}
        self.base = np.int64(len(self.words) + 1)
        self.pairs: list[np.ndarray] = []
        coded = [self.coded(t) for t in templates]
        for k in range(1, width):
            self.pairs.append(np.unique(np.concatenate([self._paired(c, k) for c in coded])))

    def coded(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter((self.words.get(w, 0) for w in words), np.int64, len(words))

    def _paired(self, coded: np.ndarray, k: int) -> np.ndarray:
        """Pairs of the beginnings of k words with the words after them; 0 where either is another's."""
        start, after = self.shingles(coded, k)[: max(0, len(coded) - k)], coded[k:]
        return np.where((start > 0) & (after > 0), start * self.base + after, 0)

    def shingles(self, coded: np.ndarray, width: int) -> np.ndarray:
        """The number of the shingle at each place."""
        if width == 1:
            return coded
        pairs, found = self.pairs[width - 2], self._paired(coded, width - 1)
        at = np.minimum(np.searchsorted(pairs, found), len(pairs) - 1)
        return np.where((found > 0) & (pairs[at] == found), at + 1, 0)


class Group:
    """Templates with shingles of one width and windows of one size; `bands` hash functions retrieve them."""

    def __init__(self, width: int, stride: int, templates: dict[str, list[bytes]], share: Fraction):
        self.width, self.stride, self.share = width, stride, share
        self.names = sorted(templates)
        self.sets = [np.unique(_rolling(_hashed(templates[n]), width)) for n in self.names]
        self.spellings = Spellings(width, [templates[n] for n in self.names])
        self.exact = [np.unique(self.spellings.shingles(self.spellings.coded(templates[n]), width)) for n in self.names]
        least = min(need(len(s), share) / (2 * stride + len(s) - need(len(s), share)) for s in self.sets)
        self.bands = max(1, math.ceil(math.log(MISS) / math.log1p(-least)))
        self.minima = [[int(_turned(s, i).min()) for s in self.sets] for i in range(self.bands)]


def groups(templates: dict[str, str], share: Fraction = CONTAINMENT) -> list[Group]:
    found: dict[tuple[int, int], dict[str, list[bytes]]] = {}
    for name, text in templates.items():
        words = [w for w in map(plain, text.encode().split()) if w]
        if not words:
            raise ValueError(f"{name} has no words")
        width = min(SHINGLE, len(words))
        distinct = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}
        stride = 1 << (len(distinct) - 1).bit_length()
        found.setdefault((width, stride), {})[name] = words
    return [Group(w, s, t, share) for (w, s), t in sorted(found.items())]


def _matches(group: Group, hashes: np.ndarray, coded: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, str, int, int, int, int, int]]:
    """(document, template, matched, total, first word, last word, windows) of the best window of each."""
    counts = np.maximum(np.diff(offsets) - group.width + 1, 0)
    if not counts.sum():
        return
    begin = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(begin[-1]) - np.repeat(begin[:-1], counts)
    shingles = _rolling(hashes, group.width)[np.repeat(offsets[:-1], counts) + at]
    blocks = -(-counts // group.stride)
    first = np.concatenate([[0], np.cumsum(blocks)])
    of_block = np.repeat(np.arange(len(counts)), blocks)
    starts = np.repeat(begin[:-1], blocks) + (np.arange(first[-1]) - np.repeat(first[:-1], blocks)) * group.stride
    last = np.zeros(first[-1], bool)
    last[first[1:][blocks > 0] - 1] = True
    hit: list[set[int]] = [set() for _ in group.names]
    for i in range(group.bands):
        minima = np.minimum.reduceat(_turned(shingles, i), starts)
        window = minima.copy()
        window[:-1] = np.where(last[:-1], minima[:-1], np.minimum(minima[:-1], minima[1:]))
        for t, least in enumerate(group.minima[i]):
            hit[t].update(np.flatnonzero(window == least).tolist())
    for t, name in enumerate(group.names):
        whole = group.exact[t]
        best: dict[int, list[int]] = {}
        for w in sorted(hit[t]):
            d = int(of_block[w])
            start = int(starts[w] - begin[d])
            end = min(start + 2 * group.stride, int(counts[d]))
            own = group.spellings.shingles(coded[offsets[d] + start : offsets[d] + end + group.width - 1], group.width)
            inside = np.isin(own, whole)
            matched = len(np.unique(own[inside]))
            if matched < need(len(whole), group.share):
                continue
            places = np.flatnonzero(inside) + start
            found = [matched, len(whole), int(places[0]), int(places[-1]) + group.width - 1, 1]
            if d not in best:
                best[d] = found
            else:
                n = best[d][4] + 1
                best[d] = [*(found if matched > best[d][0] else best[d])[:4], n]
        for d, (matched, total, a, b, n) in best.items():
            yield d, name, matched, total, a, b, n


def scan(df: DataFrame, templates: dict[str, str] | None = None, key: str = "doc_id", text: str = "text", containment: Fraction = CONTAINMENT) -> DataFrame:
    """A row per document and template found: (doc_id, license, matched, total, first_word, last_word, windows).

    matched of total shingles are in the best window, at those words (counted from 0 among words that count); windows:
    how many windows pass.
    """
    chosen = dict(templates or TEMPLATES)
    names = ["doc_id", "license", "matched", "total", "first_word", "last_word", "windows"]
    kinds = [pa.int64(), pa.string(), *[pa.int64()] * 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_groups = groups(chosen, containment)
        for batch in batches:
            for some in slices(batch):
                words = Words(some.column(1))
                kept = [plain(w) for w in words.vocab]
                counts = np.fromiter(map(bool, kept), bool, len(kept))
                own = counts[words.codes] if len(kept) else np.zeros(0, bool)
                offsets = np.concatenate([[0], np.cumsum(own)])[words.offsets].astype(np.int64)
                hashes = _hashed(kept)[words.codes[own]] if len(kept) else np.zeros(0, np.uint64)
                codes = [g.spellings.coded(kept)[words.codes[own]] if len(kept) else np.zeros(0, np.int64) for g in all_groups]
                ids = some.column(0).to_pylist()
                rows = [(ids[d], *rest) for g, coded in zip(all_groups, codes) for d, *rest in _matches(g, hashes, coded, offsets)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    schema = "doc_id long, license string, matched long, total long, first_word long, last_word long, windows long"
    return df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)
