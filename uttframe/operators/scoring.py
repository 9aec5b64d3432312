"""Transcript scoring: pairing, word alignment, micro-averaged error rates."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_words


def stem(path: Column) -> Column:
    """A path without its last suffix."""
    return F.regexp_replace(path, r"\.[^./]*$", "")


def pair(hyps: DataFrame, refs: DataFrame, norms: DataFrame | None = None) -> DataFrame:
    """Tables with a column path: hypothesis, reference and normalisation of equal stems, and where the result goes. has_ref is false where the reference is missing."""
    h = hyps.select(stem(F.col("path")).alias("stem"), F.col("path").alias("hyp"))
    out = h.join(refs.select(stem(F.col("path")).alias("stem"), F.col("path").alias("ref")), "stem", "left")
    if norms is not None:
        out = out.join(norms.select(F.regexp_replace("path", r"\.norm\.json$", "").alias("stem"), F.col("path").alias("norm")), "stem", "left")
    return out.withColumn("log", F.concat("stem", F.lit(".log.json"))).withColumn("has_ref", F.col("ref").isNotNull())


def distance(ref: Column, hyp: Column) -> Column:
    """Word edit distance, as a fold over one row of the table after another."""
    first = F.transform(F.sequence(F.lit(0), F.size(hyp)), lambda j: j)

    def row(prev: Column, r: Column) -> Column:
        def cell(acc: Column, j: Column) -> Column:
            best = F.least(F.get(prev, j) + F.when(F.get(hyp, j) == r, 0).otherwise(1), F.get(prev, j + 1) + 1, F.element_at(acc, -1) + 1)
            return F.concat(acc, F.array(best))

        at = F.when(F.size(hyp) > 0, F.sequence(F.lit(0), F.size(hyp) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(at, F.array(F.get(prev, F.lit(0)) + 1), cell)

    return F.element_at(F.aggregate(ref, first, row), -1)


def edit_counts(ref: list[str], hyp: list[str], same: dict[str, str] | None = None) -> tuple[int, int, int, int]:
    """(correct, substitutions, deletions, insertions) of a best alignment; among equal ones match, substitution, deletion, insertion in that order. same: words to the form that they count as."""
    if same:
        ref, hyp = [same.get(w, w) for w in ref], [same.get(w, w) for w in hyp]
    ids: dict[str, int] = {}
    r = np.array([ids.setdefault(w, len(ids)) for w in ref], dtype=np.int32)
    h = np.array([ids.setdefault(w, len(ids)) for w in hyp], dtype=np.int32)
    # Costs are kept for one row in so many; the moves of the rows between are made again on the way back.
    every = max(1, int(len(r) ** 0.5))
    kept, cost = [], np.arange(len(h) + 1)
    for i in range(len(r) + 1):
        if i % every == 0:
            kept.append(cost)
        if i < len(r):
            cost = _next_row(cost, h != r[i], i + 1)[0]
    i, j, n = len(r), len(h), [0, 0, 0, 0]
    for block in range(len(kept) - 1, -1, -1):
        first, cost, moves = block * every, kept[block], []
        for k in range(first, i):
            cost, move = _next_row(cost, h != r[k], k + 1)
            moves.append(move)
        while i > first:
            move = moves[i - first - 1][j]
            if move == 1:
                n[0 if r[i - 1] == h[j - 1] else 1] += 1
                i, j = i - 1, j - 1
            elif move == 2:
                n[2] += 1
                i -= 1
            else:
                n[3] += 1
                j -= 1
    return n[0], n[1], n[2], n[3] + j


def _next_row(cost: np.ndarray, differs: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Row i of the table of costs from the one before, and its moves: 1 diagonal, 2 up, 3 left."""
    steps = np.arange(len(cost))
    diagonal, up = cost[:-1] + differs, cost[1:] + 1
    new = np.minimum.accumulate(np.concatenate(([i], np.minimum(diagonal, up))) - steps) + steps
    moves = np.full(len(cost), 2, dtype=np.int8)
    moves[1:] = np.where(new[1:] == diagonal, 1, np.where(new[1:] == up, 2, 3))
    return new, moves


def align(df: DataFrame, key: str, ref: str, hyp: str, same: dict[str, str] | None = None) -> DataFrame:
    """(key, correct, substitutions, deletions, insertions, num_errors, num_ref) of each row's word arrays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = [edit_counts(list(a), list(b), same) for a, b in zip(pdf[ref], pdf[hyp], strict=True)]
            yield pd.DataFrame([(k, c, s, d, i, s + d + i, c + s + d) for k, (c, s, d, i) in zip(pdf[key], n, strict=True)])

    schema = f"{key} {df.schema[key].dataType.simpleString()}, correct long, substitutions long, deletions long, insertions long, num_errors long, num_ref long"
    return df.select(key, ref, hyp).mapInPandas(run, schema)


#: An error's cost, and a match's gain: the fewest errors first, then the most matches, then the fewest substitutions.
ERROR, MATCH = 1 << 42, 1 << 21


def graph_counts(ref: list[str], hyp: list[str], others: Iterable[tuple[int, int, Sequence[str]]]) -> tuple[int, int, int, int]:
    """(correct, substitutions, deletions, insertions) of hyp against the best reading of ref.

    others has (start, end, words): ref[start:end] may be read as these words, any number of them. The readings are the paths
    of a graph whose nodes are the places between words. The table of costs has a row for each node, and for each place
    inside an edge of several words; rows that no later edge needs are dropped.
    """
    ids: dict[str, int] = {}
    h = np.array([ids.setdefault(w, len(ids)) for w in hyp], dtype=np.int64)
    ramp = np.arange(len(h) + 1, dtype=np.int64) * ERROR
    edges: dict[int, list[tuple[int, Sequence[str]]]] = {}
    for start, end, words in others:
        if 0 <= start < end <= len(ref):
            edges.setdefault(start, []).append((end, words))
    due: dict[int, np.ndarray] = {0: ramp.copy()}

    def after(row: np.ndarray, word: str) -> np.ndarray:
        out = row + ERROR
        np.minimum(out[1:], row[:-1] + np.where(h == ids.get(word, -1), -MATCH, ERROR + 1), out=out[1:])
        return np.minimum.accumulate(out - ramp) + ramp

    for at, own in enumerate(ref):
        row = due.pop(at)
        for end, words in [(at + 1, (own,)), *edges.get(at, [])]:
            new = row
            for word in words:
                new = after(new, word)
            due[end] = np.minimum(due[end], new) if end in due else new
    total = int(due[len(ref)][-1])
    substitutions, rest = total % MATCH, total // MATCH
    correct = -rest % MATCH
    errors = (rest + correct) // MATCH
    insertions = len(h) - correct - substitutions
    return correct, substitutions, errors - substitutions - insertions, insertions


class Rules:
    """Phrases with other phrases that they may be read as, found by their first word."""

    def __init__(self, rules: Iterable[tuple[Sequence[str], Sequence[str]]]) -> None:
        self.by_first: dict[str, list[tuple[list[str], list[str]]]] = {}
        for phrase, other in rules:
            if phrase:
                self.by_first.setdefault(phrase[0], []).append((list(phrase), list(other)))

    def others(self, ref: list[str]) -> Iterator[tuple[int, int, list[str]]]:
        for i, word in enumerate(ref):
            for phrase, other in self.by_first.get(word, ()):
                if ref[i : i + len(phrase)] == phrase:
                    yield i, i + len(phrase), other


def align_readings(df: DataFrame, key: str, ref: str, hyp: str, rules: Iterable[tuple[Sequence[str], Sequence[str]]] = (), readings: str | None = None) -> DataFrame:
    """As ``align``, against the best reading of each reference; num_ref counts the words of that reading.

    rules: phrases and what they may be read as, wherever they stand (a synonym file's, so a short list). readings: a column
    with a row's own, an array of (start, end, words). Null arrays count as empty ones.
    """
    known = Rules(rules)
    plain = lambda xs: [] if xs is None else list(xs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, r, h, own in zip(pdf["k"], pdf["r"], pdf["h"], pdf["own"], strict=True):
                words = plain(r)
                others = [*known.others(words), *[(x["start"], x["end"], plain(x["words"])) for x in plain(own)]]
                c, s, d, i = graph_counts(words, plain(h), others)
                out.append((k, c, s, d, i, s + d + i, c + s + d))
            yield pd.DataFrame(out, columns=names)

    schema = f"{key} {df.schema[key].dataType.simpleString()}, correct long, substitutions long, deletions long, insertions long, num_errors long, num_ref long"
    names = [c.split()[0] for c in schema.split(", ")]
    own = F.transform(readings, lambda x: F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"), x["words"].alias("words"))) if readings else F.array().cast("array<struct<start:int,end:int,words:array<string>>>")
    return df.select(F.col(key).alias("k"), F.col(ref).alias("r"), F.col(hyp).alias("h"), own.alias("own")).mapInPandas(run, schema)


def word_error_rate(counts: DataFrame, *by: str) -> DataFrame:
    """Micro averages of rows with insertions, deletions, substitutions, num_errors, num_ref; without groups, no reference words are an error."""
    summed = counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("insertions", "deletions", "substitutions", "num_errors", "num_ref")])
    out = summed.select(*by, "insertions", "deletions", (F.col("num_errors") - F.col("insertions") - F.col("deletions")).alias("substitutions"), (F.col("num_ref") - F.col("substitutions") - F.col("deletions")).alias("correct"), "num_ref")
    ref = F.when(F.col("num_ref") != 0, F.col("num_ref"))
    if not by:
        ref = F.coalesce(ref, F.raise_error(F.lit("no reference words")).cast("long"))
    errors = F.col("insertions") + F.col("deletions") + F.col("substitutions")
    return out.withColumns({"ins_rate": F.col("insertions") / ref, "del_rate": F.col("deletions") / ref, "sub_rate": F.col("substitutions") / ref, "wer": errors / ref})


def summary(rates: DataFrame) -> DataFrame:
    """Four lines of text for each row of word_error_rate()."""
    n = F.col("num_ref")
    parts = [("WER", F.col("insertions") + F.col("deletions") + F.col("substitutions")), ("INS", F.col("insertions")), ("DEL", F.col("deletions")), ("SUB", F.col("substitutions"))]
    return rates.select(F.explode(F.array(*[F.format_string("%s:\t%d/%d = %.2f%%", F.lit(t), c, n, 100.0 * c / n) for t, c in parts])).alias("value"))


def words(text: Column) -> Column:
    return split_words(text)
