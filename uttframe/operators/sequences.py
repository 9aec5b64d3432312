"""Dynamic programs over one utterance at a time: grouped jobs, an utterance a group."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind
from .ranking import top_k


def forced_path(logp: np.ndarray, labels: np.ndarray, blank: int = 0) -> np.ndarray:
    """The label of each frame on the best path through the labels with blanks between; the first of equal predecessors wins."""
    states = np.full(2 * len(labels) + 1, blank)
    states[1::2] = labels
    n, s = len(logp), len(states)
    score = np.full(s, -np.inf)
    score[:2] = logp[0, states[:2]]
    back = np.zeros((n, s), dtype=np.int64)
    skip = np.zeros(s, dtype=bool)
    skip[2:] = (states[2:] != blank) & (states[2:] != states[:-2])
    for t in range(1, n):
        options = np.full((3, s), -np.inf)
        options[0] = score
        options[1, 1:] = score[:-1]
        options[2, skip] = score[np.flatnonzero(skip) - 2]
        choice = options.argmax(axis=0)
        back[t] = np.arange(s) - choice
        score = options[choice, np.arange(s)] + logp[t, states]
    at = s - 1 if s == 1 or score[s - 1] >= score[s - 2] else s - 2
    path = np.empty(n, dtype=np.int64)
    for t in range(n - 1, -1, -1):
        path[t] = at
        at = back[t, at]
    return states[path]


def forced_alignment(frames: DataFrame, labels: DataFrame, key: str = "key", blank: int = 0) -> DataFrame:
    """(key, frame_idx, token) from (key, frame_idx, logp) and (key, labels); tokens are null where the labels, with a blank between equal ones, are more than the frames."""
    whole = frames.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("frame_idx", "logp"))).alias("f")).join(labels, key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, f, y in zip(pdf[key], pdf["f"], pdf["labels"], strict=True):
                y = np.asarray(y, dtype=np.int64)
                fits = len(y) + np.count_nonzero(y[1:] == y[:-1]) <= len(f)
                path = forced_path(np.stack([x["logp"] for x in f]).astype(np.float64), y, blank) if fits else [None] * len(f)
                yield pd.DataFrame({key: k, "frame_idx": [x["frame_idx"] for x in f], "token": path})

    kind = frames.schema[key].dataType.simpleString()
    return whole.select(key, "f", "labels").mapInPandas(run, f"{key} {kind}, frame_idx int, token int")


class Phrases:
    """A trie of phrases with failure links; walking it scores the matched tokens."""

    def __init__(self, phrases: list[list[int]], bonus: float) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.score, self.fail, self.ends = [0.0], [0], [False]
        for phrase in phrases:
            at = 0
            for token in phrase:
                if token not in self.next[at]:
                    self.next[at][token] = len(self.next)
                    self.next.append({})
                    self.score.append(self.score[at] + bonus)
                    self.fail.append(0)
                    self.ends.append(False)
                at = self.next[at][token]
            self.ends[at] = self.ends[at] or at > 0
        todo = deque(self.next[0].values())
        self.output = [s if e else 0.0 for s, e in zip(self.score, self.ends, strict=True)]
        while todo:
            at = todo.popleft()
            for token, child in self.next[at].items():
                f = self.fail[at]
                while f and token not in self.next[f]:
                    f = self.fail[f]
                self.fail[child] = self.next[f].get(token, 0)
                self.output[child] += self.output[self.fail[child]]
                todo.append(child)

    def step(self, at: int, token: int) -> tuple[int, float]:
        """The next node, and what the step adds: the token's bonus, or back to a suffix's score; phrases that end keep theirs."""
        was = at
        while at and token not in self.next[at]:
            at = self.fail[at]
        to = self.next[at].get(token, 0)
        kept = self.output[to]
        start = 0 if self.ends[was] else self.score[was]  # an ended phrase's score is not taken back
        return to, (0 if self.ends[to] else self.score[to]) - start + kept

    def end(self, at: int) -> float:
        """What is taken back at the end: the score of an unfinished phrase."""
        return 0.0 if self.ends[at] else -self.score[at]


def phrase_bonus(tokens: Column, phrases: list[list[int]], bonus: float) -> Column:
    """The bonus of a token array: ``bonus`` a token for each phrase in it."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trie = Phrases(phrases, bonus)
        for xs in batches:
            out = []
            for x in xs:
                at, total = 0, 0.0
                for t in x:
                    at, add = trie.step(at, int(t))
                    total += add
                out.append(total + trie.end(at))
            yield pd.Series(out)

    return run(tokens)


def ending(phrases: DataFrame, phrase: str, order: str) -> DataFrame:
    """The phrases that end where a trie filled in order marks ends only at new nodes: those that no earlier one starts with."""
    rows = phrases.select(F.col(phrase).alias("_p"), F.col(order).alias("_o")).filter(F.size("_p") > 0)
    heads = rows.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("_p")), lambda n: F.slice("_p", F.lit(1), n))).alias("_p"), "_o")
    first = heads.groupBy("_p").agg(F.min("_o").alias("_first"))
    return rows.groupBy("_p").agg(F.min("_o").alias("_o")).join(first, "_p").filter("_o = _first").select(F.col("_p").alias(phrase))


def phrase_matches(df: DataFrame, key: str, tokens: str, phrases: DataFrame, phrase: str = "phrase") -> DataFrame:
    """(key, place, n_tokens, phrase) of all places where a phrase of a table of any size stands in a token array.

    Windows of the lengths that phrases have meet the phrases by two hashes; a table of a size that Spark broadcasts costs no
    shuffle, and a larger one shuffles hashes, not windows. The lengths, few numbers, are part of the plan. Repeated phrases are one,
    empty ones match nothing.
    """
    known = phrases.select(F.col(phrase).alias("phrase")).filter(F.size("phrase") > 0).distinct()
    lengths = sorted(r[0] for r in known.select(F.size("phrase")).distinct().collect())
    of_tokens = lambda w: F.transform(w, lambda t: F.struct(F.xxhash64(t).alias("a"), F.hash(t).alias("b")))
    hashes = lambda own: (F.xxhash64(*[x["a"] for x in own]).alias("_a"), F.hash(*[x["b"] for x in own]).alias("_b"))
    of_phrase = {n: F.struct(*hashes([F.get(of_tokens(F.col("phrase")), F.lit(k)) for k in range(n)])) for n in lengths}

    def windows(h: Column, n: int) -> Column:
        at = F.when(F.size(h) >= n, F.sequence(F.lit(0), F.size(h) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(i.alias("place"), F.lit(n).alias("n_tokens"), *hashes([F.get(h, i + k) for k in range(n)])))

    # A token is hashed once, and a window from its tokens' hashes; these are bound, so that they are made once a row.
    every = bind(of_tokens(F.col(tokens)), lambda h: F.flatten(F.array(*[windows(h, n) for n in lengths]))) if lengths else F.array().cast("array<struct<place:int,n_tokens:int,_a:bigint,_b:int>>")
    each = df.select(F.col(key).alias(key), F.explode(every).alias("_w")).select(key, "_w.place", "_w.n_tokens", "_w._a", "_w._b")
    hashed = F.coalesce(*[F.when(F.size("phrase") == n, x) for n, x in of_phrase.items()]) if lengths else F.lit(None).cast("struct<_a:bigint,_b:int>")
    return each.join(known.select("phrase", hashed.alias("_h")).select("phrase", "_h._a", "_h._b"), ["_a", "_b"]).select(key, "place", "n_tokens", "phrase")


def phrase_bonus_join(df: DataFrame, key: str, tokens: str, phrases: DataFrame, bonus: float, phrase: str = "phrase", order: str | None = None) -> DataFrame:
    """(key, bonus): ``phrase_bonus`` with a table of phrases of any size. With order, phrases end as ``ending`` says. Rows that share a key are one."""
    known = ending(phrases, phrase, order) if order else phrases
    found = phrase_matches(df, key, tokens, known, phrase).groupBy(F.col(key).alias("_k")).agg(F.sum("n_tokens").alias("_n"))
    out = df.select(key).distinct().join(found, F.col(key).eqNullSafe(F.col("_k")), "left")
    return out.select(key, (F.coalesce("_n", F.lit(0)) * F.lit(float(bonus))).alias("bonus"))


def phrase_list(phrases: DataFrame, phrase: str = "phrase", most: int = 200_000) -> list[list[int]]:
    """The phrases of a table for a beam search, whose workers each hold them as a trie; more than ``most`` are an error."""
    found = [list(r[0]) for r in phrases.select(phrase).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} phrases in one beam search")
    return found


def _plus(*xs: float) -> float:
    top = max(xs)
    return top if top == -np.inf else top + float(np.log(sum(np.exp(x - top) for x in xs)))


def prefix_beam(frames: list[list[tuple[int, float]]], beam: int, blank: int = 0, trie: Phrases | None = None) -> list[tuple[tuple[int, ...], float, tuple[int, ...]]]:
    """(tokens, score, times) of the best prefixes; each frame is its likeliest (token, log probability) pairs. Times are those of the likeliest single path."""
    inf = -np.inf
    # prefix -> [log p ending in blank, log p ending in token, best path ending in blank and its times, best path ending in token and its times, node, bonus]
    beams: dict[tuple[int, ...], list] = {(): [0.0, inf, 0.0, (), inf, (), 0, 0.0]}
    for t, pairs in enumerate(frames):
        new: dict[tuple[int, ...], list] = defaultdict(lambda: [inf, inf, inf, (), inf, (), 0, 0.0])
        for prefix, (b, nb, vb, tb, vn, tn, node, extra) in beams.items():
            best, times = (vb, tb) if vb >= vn else (vn, tn)
            for token, p in pairs:
                if token == blank:
                    x = new[prefix]
                    x[0], x[6], x[7] = _plus(x[0], b + p, nb + p), node, extra
                    if best + p > x[2]:
                        x[2], x[3] = best + p, times
                    continue
                if prefix and token == prefix[-1]:
                    x = new[prefix]
                    x[1], x[6], x[7] = _plus(x[1], nb + p), node, extra
                    if vn + p > x[4]:
                        x[4], x[5] = vn + p, tn
                    grown, path, since = b + p, vb + p, tb
                else:
                    grown, path, since = _plus(b + p, nb + p), best + p, times
                x = new[(*prefix, token)]
                x[1] = _plus(x[1], grown)
                if trie:
                    to, add = trie.step(node, token)
                    x[6], x[7] = to, extra + add
                if path > x[4]:
                    x[4], x[5] = path, (*since, t)
        beams = dict(sorted(new.items(), key=lambda kv: (-(_plus(kv[1][0], kv[1][1]) + kv[1][7]), kv[0]))[:beam])
    out = [(k, _plus(v[0], v[1]) + v[7] + (trie.end(v[6]) if trie else 0.0), v[3] if v[2] >= v[4] else v[5]) for k, v in beams.items()]
    return sorted((r for r in out if r[1] > -np.inf), key=lambda r: (-r[1], r[0]))


def prefix_beam_search(frames: DataFrame, key: str = "key", scores: str = "logp", beam: int = 10, blank: int = 0, phrases: list[list[int]] | None = None, bonus: float = 0.0) -> DataFrame:
    """(key, rank, tokens, score, times): n-best lists. Frames are cut to their beam likeliest tokens before they are grouped."""
    pruned = frames.select(key, "frame_idx", top_k(F.col(scores), beam).alias("top"))
    whole = pruned.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("frame_idx", "top"))).alias("f"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = Phrases(phrases, bonus) if phrases else None
        for pdf in batches:
            rows = []
            for k, f in zip(pdf[key], pdf["f"], strict=True):
                found = prefix_beam([[(int(p["token"]), float(p["score"])) for p in x["top"]] for x in f], beam, blank, trie)
                rows += [(k, i, list(tokens), score, list(times)) for i, (tokens, score, times) in enumerate(found)]
            yield pd.DataFrame(rows, columns=[key, "rank", "tokens", "score", "times"])

    kind = frames.schema[key].dataType.simpleString()
    return whole.mapInPandas(run, f"{key} {kind}, rank int, tokens array<int>, score double, times array<int>")
