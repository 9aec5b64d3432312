"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Benchmark items are normalised (lower-case words, one space between) and cut into overlapping segments of at most
``SEGMENT`` characters. A segment of m characters may be changed by k = error * m edits. Of its m // q disjoint q-grams each
edit spoils one at most, so a region of a text within the budget still has m // q - k of them, all on diagonals at most
2k apart (text position minus segment position). q is 8, or less for items under 16 characters, so that the lemma asks for
one q-gram at least; items of less than 8 characters are their own only q-gram. Hits are counted in bands of diagonals that
overlap by half; bands that reach the count are verified by an alignment that keeps to the band, and a text holds an item
if one of its segments aligns within k edits.

Items are cut twice, into segments of SEGMENT characters that overlap by half and into those of QUOTE: long ones may have
more edits in one place, and each quote of QUOTE * 3 / 2 - 1 = 119 normalised characters (some 20 words) holds a whole short
one. The edits of a leak are the least of its longest segments found, its span covers all segments found.

All texts are searched whole, in small Arrow batches, against an index of the benchmark that each Python worker holds. The
benchmark is cut into parts by a hash of the item, as many as keep a part near ``PART_CHARS`` characters; each part is a
pass of its own over the documents, so neither the driver nor a task ever holds more than one part. Very long texts are
hashed and counted in pieces of CHUNK characters; a worker holds the code points of one text, the hits of one piece, and the
bands found, one in 2k + 1 characters at most for each segment that the text repeats throughout. A null text has no leaks. Items of null text, or without
words, are not searched; a null item_id is an id like others, and repeated items are one. Repeated rows are searched alike. Ties of
place are not told apart: a leak has the span of all its places. Empty tables give an empty result. Other columns,
whatever their names, are ignored by ``query`` and kept by ``drop_leaks``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import code_points, is_word, light_batches, materialise

Q, ERROR, SEGMENT, QUOTE = 8, 0.08, 160, 80
PART_CHARS = 4_000_000
BITS = 20
#: Characters whose hits are counted at once, and how many of them the next piece has too: more than a band's hits of a segment span.
CHUNK, OVERLAP = 1 << 14, 512


def budget(length: int) -> int:
    """How many edits a segment may have."""
    return int(ERROR * length)


def gram_length(length: int) -> int:
    """The longest q up to Q of which the lemma still asks for one q-gram."""
    return next(q for q in range(min(Q, length), 0, -1) if length // q > budget(length))


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-case words of a text with one space between, and the places of the text that they come from."""
    low = text.lower()
    c = code_points(low)
    word = is_word(c)
    keep = word.copy()
    keep[1:] |= word[:-1]
    at = np.flatnonzero(keep)
    c = np.where(word[at], c[at], np.uint32(32))
    if len(low) != len(text):  # some capitals have longer lower forms
        at = np.repeat(np.arange(len(text)), [len(ch.lower()) for ch in text])[at] if len(low) == sum(len(ch.lower()) for ch in text) else np.minimum(at, len(text) - 1)
    return (c[:-1], at[:-1]) if len(c) and c[-1] == 32 else (c, at)


def gram_hashes(c: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit polynomial hash of each q-gram: pairs, pairs of pairs and so on, put together by the binary digits of q."""
    if len(c) < q:
        return np.zeros(0, dtype=np.uint64)
    n, base = len(c) - q + 1, 0x9E3779B97F4A7C15
    h, width, out, done = c.astype(np.uint64), 1, np.zeros(n, dtype=np.uint64), 0
    while width <= q:
        if q & width:
            out = out * np.uint64(pow(base, width, 1 << 64)) + h[done : done + n]
            done += width
        if 2 * width <= q:
            h = h[:-width] * np.uint64(pow(base, width, 1 << 64)) + h[width:]
        width *= 2
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out


def cuts(length: int) -> list[tuple[int, int]]:
    """Start and end of the segments of an item."""
    return sorted({(at, min(at + size, length)) for size in (SEGMENT, QUOTE) for at in {0, *range(size // 2, length - size, size // 2), max(0, length - size)}})


class Grams:
    """The disjoint q-grams of segments for one q, ordered by hash, with a bit table of their top bits before them."""

    def __init__(self, q: int, hashes: list[np.ndarray], of: list[int]) -> None:
        self.q = q
        sizes = [len(h) for h in hashes]
        every, owner = np.concatenate(hashes), np.repeat(np.array(of, dtype=np.int64), sizes)
        place = (np.arange(len(every)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) * q
        order = np.argsort(every, kind="stable")
        self.hashes, self.of, self.at = every[order], owner[order], place[order]
        self.table = np.zeros(1 << BITS, dtype=bool)
        self.table[self.hashes >> np.uint64(64 - BITS)] = True

    def hits(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in c and the numbers of the q-grams found there."""
        h = gram_hashes(c, self.q)
        pos = np.flatnonzero(self.table[h >> np.uint64(64 - BITS)])
        low = np.searchsorted(self.hashes, h[pos])
        n = np.searchsorted(self.hashes, h[pos], side="right") - low
        return np.repeat(pos, n), np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())


class Index:
    """The segments of items (id, code points, budget, least number of q-grams), and their q-grams by q."""

    def __init__(self, items: list[tuple[object, str]]) -> None:
        self.segments, hashes, of = [], {}, {}
        self.best: dict[object, tuple[int, int]] = {}  # what the longest segment of an item gives without edits
        for item, text in items:
            n = normal(text)[0]
            known = {}
            for start, end in cuts(len(n)) if len(n) else []:
                q, k = gram_length(end - start), budget(end - start)
                known[q] = known[q] if q in known else gram_hashes(n, q)
                hashes.setdefault(q, []).append(known[q][start : end - q + 1 : q])
                of.setdefault(q, []).append(len(self.segments))
                self.segments.append((item, n[start:end], k, (end - start) // q - k))
                self.best[item] = min(self.best.get(item, (0, 0)), (start - end, 0))
        self.grams = [Grams(q, hashes[q], of[q]) for q in sorted(hashes)]
        self.least = np.array([s[3] for s in self.segments], dtype=np.int64)
        self.width = np.array([2 * s[2] + 1 for s in self.segments], dtype=np.int64)

    def bands(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Segments and first diagonals of the bands with enough of the segment's q-grams, by diagonal. Long texts are counted in pieces, each with the end of the one before."""
        found = [np.zeros((0, 2), dtype=np.int64)]
        for start in range(0, max(len(c) - OVERLAP, 1), CHUNK - OVERLAP):
            found += [np.column_stack(x) for x in self._bands(c[start : start + CHUNK], start)]
        every = np.unique(np.concatenate(found), axis=0)
        order = np.argsort(every[:, 1], kind="stable")
        return every[order, 0], every[order, 1]

    def _bands(self, c: np.ndarray, start: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same of a piece that starts at a place of its text."""
        for grams in self.grams:
            pos, hit = grams.hits(c)
            seg, which, count = np.unique(grams.of[hit], return_inverse=True, return_counts=True)
            keep = (count >= self.least[seg])[which]
            if not keep.any():
                continue
            hit, rank, width = hit[keep], which[keep], self.width[grams.of[hit[keep]]]
            # Band b holds the diagonals from b * width to (b + 2) * width; each diagonal lies in two, and a q-gram counts once in a band.
            band = (pos[keep] + start - grams.at[hit]) // width - (start - SEGMENT) // width + 1
            n_bands, at = int(band.max()) + 1, grams.at[hit] // grams.q
            cells = np.unique(np.concatenate([(rank * n_bands + b) * SEGMENT + at for b in (band, band - 1)])) // SEGMENT
            cells, count = np.unique(cells, return_counts=True)
            enough = cells[count >= self.least[seg[cells // n_bands]]]
            s = seg[enough // n_bands]
            yield s, (enough % n_bands - 1 + (start - SEGMENT) // self.width[s]) * self.width[s]

    def leaks(self, text: str) -> list[tuple[object, int, int, int]]:
        """(item, start, end, edits) with code points of the text as given."""
        c, at = normal(text)
        segments, diagonals = self.bands(c)
        # From both ends inwards: then what lies between the first and the last place of an item found without edits changes nothing.
        order = np.empty(len(segments), dtype=np.int64)
        order[::2], order[1::2] = np.arange((len(order) + 1) // 2), len(order) - 1 - np.arange(len(order) // 2)
        best: dict[object, tuple[int, int, tuple[int, int]]] = {}
        for seg, diagonal in zip(segments[order].tolist(), diagonals[order].tolist(), strict=True):
            item, pattern, k, _ = self.segments[seg]
            low, high = diagonal - k, diagonal + 2 * int(self.width[seg]) + k
            held = best.get(item)
            if held and held[2] == self.best[item] and held[0] <= max(low, 0) and min(high + len(pattern), len(c)) <= held[1]:
                continue
            if found := align(pattern, c, low, high, k):
                edits, start, end = found
                least = (-len(pattern), edits)
                first, last, other = held or (start, end, least)
                best[item] = (min(first, start), max(last, end), min(least, other))
        return [(item, int(at[start]), int(at[end - 1]) + 1, edits) for item, (start, end, (_, edits)) in sorted(best.items(), key=lambda x: (x[0] is None, 0 if x[0] is None else x[0]))]


def align(pattern: np.ndarray, text: np.ndarray, low: int, high: int, k: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of the pattern on the diagonals low to high of the text, if it has k edits at most."""
    m, band = len(pattern), high - low + 1
    exact = text[max(low, 0) : max(high + m, 0)].tobytes().find(pattern.tobytes())
    if exact >= 0 and not exact % 4:
        return 0, max(low, 0) + exact // 4, max(low, 0) + exact // 4 + m
    # Cell b of row i is the end of i pattern characters at text position low + b + i.
    region = np.full(band + m, -1, dtype=np.int64)
    first, last = max(low, 0), min(low + band + m, len(text))
    region[first - low : max(last, first) - low] = text[first:last]
    steps, far = np.arange(band), 1 << 40
    cost, start = np.where((steps + low >= 0) & (steps + low <= len(text)), 0, far), steps + low
    for i, p in enumerate(pattern.tolist(), 1):
        new, origin = cost + (region[i - 1 : i - 1 + band] != p), start.copy()
        up = new[:-1] > cost[1:] + 1
        new[:-1][up], origin[:-1][up] = cost[1:][up] + 1, start[1:][up]
        by = np.minimum.accumulate((new - steps) * (band + 1) + steps) % (band + 1)  # the best cell to come from on the left
        cost, start = new[by] + steps - by, origin[by]
        if low + i < 0 or low + i + band > len(text) + 1:
            cost[(steps + low + i < 0) | (steps + low + i > len(text))] = far
        if cost.min() > k:
            return None
    b = int(cost.argmin())
    end = low + b + m
    return (int(cost[b]), int(start[b]), end) if start[b] < end else None


def _n_parts(benchmark: DataFrame) -> int:
    return ceil((benchmark.agg(F.sum(F.length("text") + 50)).first()[0] or 0) / PART_CHARS)


_HELD: dict[str, Index] = {}


def _held(number: str, items: list[tuple[object, str]]) -> Index:
    """The index of a part, kept by a worker until it meets another part."""
    if number not in _HELD:
        _HELD.clear()
        _HELD[number] = Index(items)
    return _HELD[number]


def leaks(text: Column, benchmark: DataFrame, part: int, n_parts: int) -> Column:
    """The leaks of a text in a part of the benchmark: structs of item_id, start, end, edits."""
    rows = benchmark.filter("text IS NOT NULL").filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_parts)) == part).select("item_id", "text").distinct()
    shared, number = benchmark.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in rows.toLocalIterator()]), uuid.uuid4().hex

    @F.pandas_udf(f"array<struct<item_id:{benchmark.schema['item_id'].dataType.simpleString()},start:int,end:int,edits:int>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = _held(number, shared.value)
        for texts in batches:
            yield pd.Series([index.leaks(t) if t else [] for t in texts])

    return find(text)


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text holds no benchmark item."""
    light_batches(docs.sparkSession)
    n = _n_parts(benchmark)
    for i in range(n):
        docs = docs.filter(F.size(leaks(F.col("text"), benchmark, i, n)) == 0)
        docs = materialise(docs, "leaks-left") if i < n - 1 else docs
    return docs


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, end (code points of the text) and edits, for each leak."""
    light_batches(docs.sparkSession)
    n = _n_parts(benchmark)

    def search(part: int) -> DataFrame:
        found = docs.select("doc_id", leaks(F.col("text"), benchmark, part, n).alias("leaks"))
        # Outer, then without nulls: explode() alone makes Spark infer a filter that searches each text twice.
        found = found.select("doc_id", F.explode_outer("leaks").alias("x")).filter("x IS NOT NULL")
        return found.select("doc_id", F.col("x.item_id").alias("item_id"), F.col("x.start").alias("start"), F.col("x.end").alias("end"), F.col("x.edits").alias("edits"))

    if n <= 1:
        return search(0) if n else docs.limit(0).select("doc_id", F.lit(None).cast(benchmark.schema["item_id"].dataType).alias("item_id"), *[F.lit(None).cast("int").alias(c) for c in ("start", "end", "edits")])
    out = materialise(search(0), "leaks")
    for i in range(1, n):
        out = out.unionByName(materialise(search(i), "leaks"))
    return out
