"""Sequential cuts of a long shard in many tasks.

Where a batch ends depends on where it starts alone. So each block of a shard's rows finds, for every row of its own, where a
batch that started there would end, looking some rows beyond its end; by doubling these steps it knows, for each place where
a batch might enter the block, how many batches follow within it and where they leave it. One short fold over these maps, a
step a block, gives the true entries; then each block emits the batches that start in it.

A rule has ``next_starts``, ``batch``, and ``columns`` that a batch's rows get. It must end each
batch within REACH rows of its start, or ``cut`` gives None, and the caller folds the shard in one task instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.places import numbered
from ..functions.stage import materialise
from ..functions.text import SWITCH

BLOCK, REACH = 1 << 16, 1 << 12
TASKS = 4_096  # that blocks are dealt to at most
END = 1 << 60  # no further start in the window


class Rule(Protocol):
    columns: dict[str, str]  # names and types of what a batch's rows get

    def next_starts(self, w: pd.DataFrame, first: int, m: int, reach: int) -> np.ndarray:
        """For starts at the rows first to first + m - 1 of a window: the row where the next batch starts, or END. Row first - 1, if any, comes before the block."""

    def batch(self, w: pd.DataFrame, start: int, end: int) -> tuple[np.ndarray, list]:
        """Rows of the batch that starts and the next one's start (or the window's end), and their values of the rule's columns."""


def _scan(first: int, m: int, size: int, reach: int, over: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """For each of m starts, the first row after it where over(k, starts still open, their k-th rows after them) is true, or END."""
    out, live = np.full(m, END), np.arange(m)
    for k in range(1, reach + 1):
        live = live[live + first + k < size]
        if not len(live):
            break
        closed = over(k, live, live + first + k)
        out[live[closed]] = live[closed] + first + k
        live = live[~closed]
    return out


class Budget:
    """A batch ends before its longest length times its count would pass ``most``. With drop_trigger the row that causes the cut is lost, and its length stays in force."""

    columns: dict[str, str] = {}

    def __init__(self, most: float, drop_trigger: bool = False) -> None:
        self.most, self.lost = most, int(drop_trigger)

    def next_starts(self, w: pd.DataFrame, first: int, m: int, reach: int) -> np.ndarray:
        length = w["length"].fillna(0).to_numpy("float64")
        longest = length[first : first + m].copy()
        if self.lost:
            longest = np.maximum(longest, np.concatenate([length[:first] if first else [0.0], length[first : first + m - 1]]))

        def over(k: int, live: np.ndarray, at: np.ndarray) -> np.ndarray:
            longest[live] = np.maximum(longest[live], length[at])
            return longest[live] * (k + 1) > self.most

        out = _scan(first, m, len(length), reach, over)
        return np.where(out < END, out + self.lost, END)

    def batch(self, w: pd.DataFrame, start: int, end: int) -> tuple[np.ndarray, list]:
        cut = end < END
        return np.arange(start, (end - self.lost) if cut else len(w)), []


class OnePerJob(Budget):
    """A budget in which a job's later rows in a batch are left out."""

    columns = {"taken": "boolean"}

    def _earlier(self, w: pd.DataFrame) -> np.ndarray:
        """The row of the same job before each row, -1 if there is none."""
        code = pd.factorize(w["job"], use_na_sentinel=False)[0]
        order, out = np.argsort(code, kind="stable"), np.full(len(code), -1)
        same = code[order[1:]] == code[order[:-1]]
        out[order[1:][same]] = order[:-1][same]
        return out

    def next_starts(self, w: pd.DataFrame, first: int, m: int, reach: int) -> np.ndarray:
        length, earlier = w["length"].fillna(0).to_numpy("float64"), self._earlier(w)
        longest, n = length[first : first + m].copy(), np.ones(m, dtype=np.int64)

        def over(_: int, live: np.ndarray, at: np.ndarray) -> np.ndarray:
            fresh = earlier[at] < live + first
            more = np.maximum(longest[live], length[at])
            full = fresh & (more * (n[live] + 1) > self.most)
            taken = fresh & ~full
            longest[live[taken]] = more[taken]
            n[live[taken]] += 1
            return full

        return _scan(first, m, len(length), reach, over)

    def batch(self, w: pd.DataFrame, start: int, end: int) -> tuple[np.ndarray, list]:
        rows = np.arange(start, end if end < END else len(w))
        jobs = pd.factorize(w["job"].iloc[rows], use_na_sentinel=False)[0]
        taken = np.zeros(len(rows), dtype=bool)
        taken[np.unique(jobs, return_index=True)[1]] = True
        return rows, [taken]


class Merge:
    """Rows are merged until one is too short to extend, long enough, or the limits are met; their separators tell whether the speaker changes."""

    columns = {"sep": "string"}

    def __init__(self, least: float, enough: float, most: float, n_most: int) -> None:
        self.least, self.enough, self.most, self.n_most = least, enough, most, n_most

    def next_starts(self, w: pd.DataFrame, first: int, m: int, reach: int) -> np.ndarray:
        seconds = w["seconds"].to_numpy("float64")
        total = seconds[first : first + m].copy()

        def over(k: int, live: np.ndarray, at: np.ndarray) -> np.ndarray:
            t = total[live]
            total[live] = t + seconds[at]
            return (t < self.least) | (t > self.enough) | (k >= self.n_most) | (t + seconds[at] > self.most)

        return _scan(first, m, len(seconds), reach, over)

    def batch(self, w: pd.DataFrame, start: int, end: int) -> tuple[np.ndarray, list]:
        rows = np.arange(start, end if end < END else len(w))
        who = w["speaker"].iloc[rows].tolist()
        return rows, [["", *[" " if a == b else f" {SWITCH} " for a, b in zip(who, who[1:], strict=False)]]]


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """((shard, block), rows in order) of rows that are sorted by these."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        last = None if not held else (held[-1]["_shard"].iloc[-1], held[-1]["_block"].iloc[-1])
        for key, own in pdf.groupby(["_shard", "_block"], sort=False):
            if held and key != last:
                yield last, pd.concat(held, ignore_index=True)
                held = []
            held.append(own)
            last = key
    if held:
        yield last, pd.concat(held, ignore_index=True)


def _window(w: pd.DataFrame, block: int, size: int, rule: Rule, reach: int) -> tuple[int, int, np.ndarray, bool]:
    """(first, m, next start of each own row, whether all are known) of a block's window."""
    pos, n = w["_pos"].to_numpy("int64"), int(w["_n"].iloc[0])
    first = int(pos[0] < block * size)
    m = int(np.count_nonzero(pos // size == block))
    succ = rule.next_starts(w, first, m, reach)
    still = np.flatnonzero(succ == END) + first  # these go on to the shard's end, if the window has it and they were followed so far
    return first, m, succ, not len(still) or bool(pos[-1] == n - 1 and still[0] + reach >= len(w) - 1)


def _maps(size: int, reach: int, rule: Rule):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (shard, block), w in _blocks(batches):
            first, m, succ, known = _window(w, block, size, rule, reach)
            to, count = np.where(succ < END, succ - first, END), np.ones(m, dtype=np.int64)
            while len(inner := np.flatnonzero(to < m)):
                step = to[inner]
                count[inner], to[inner] = count[inner] + count[step], to[step]
            entries = min(m, reach + 1)
            exits = np.where(to[:entries] < END, to[:entries] + block * size, END)
            yield pd.DataFrame({"_shard": [shard], "_block": [block], "exits": [exits], "counts": [count[:entries]], "known": [known]})

    return run


def _entries(size: int):
    """The true entry of each block of a shard, and how many batches start before it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for pdf in batches for r in pdf.itertuples(index=False, name=None))
        for shard, own in groupby(rows, lambda r: r[0]):
            at, done = 0, 0
            for _, block, exits, counts in own:
                inside = at < END and at - block * size < len(exits)
                yield pd.DataFrame({"_shard": [shard], "_block": [block], "_entry": [at if inside else END], "_done": [done]})
                if inside:
                    at, done = int(exits[at - block * size]), done + int(counts[at - block * size])

    return run


def cut(df: DataFrame, shard: str, order: list[str], key: str, columns: dict[str, str], rule: Rule, size: int = BLOCK, reach: int = REACH) -> DataFrame | None:
    """(shard, key, batch_id, the rule's columns), or None where a batch has more than ``reach`` rows. columns: the rule's names of df's columns."""
    if reach > size:
        raise ValueError("a batch may span two blocks at most")
    named = df.select(
        F.coalesce(F.concat(F.lit("1"), F.col(shard).cast("string")), F.lit("0")).alias("_shard"), F.col(shard).alias("_shard_value"), F.col(key).alias("_key"),
        *[F.col(c).alias(n) for n, c in columns.items()], *[F.col(c).alias(f"_order{i}") for i, c in enumerate(order)],
    )
    rows = numbered(named, "_shard", [F.col(f"_order{i}").asc_nulls_last() for i in range(len(order))]).drop(*[f"_order{i}" for i in range(len(order))])
    rows = rows.withColumnsRenamed({"pos": "_pos", "n": "_n"})
    block, inside = F.floor(F.col("_pos") / size), F.col("_pos") % size
    # A row is in its own block's window, in that of the block before if it is one of the first, and in the next one's if it is the last.
    near = F.array(block, F.when((inside < reach) & (block > 0), block - 1), F.when(inside == size - 1, block + 1))
    rows = rows.withColumn("_block", F.explode(F.array_compact(near))).filter(F.col("_block") * size < F.col("_n"))
    rows = materialise(rows, "cut-windows")
    n_blocks = rows.select("_shard", "_block").distinct().count()
    dealt = lambda x: x.repartition(max(1, min(n_blocks, TASKS)), "_shard", "_block").sortWithinPartitions("_shard", "_block", "_pos")
    maps = materialise(dealt(rows).mapInPandas(_maps(size, reach, rule), "_shard string, _block long, exits array<long>, counts array<long>, known boolean"), "cut-maps")
    if not maps.filter("NOT known").isEmpty():
        return None
    entries = maps.drop("known").repartition("_shard").sortWithinPartitions("_shard", "_block").mapInPandas(_entries(size), "_shard string, _block long, _entry long, _done long")
    entries = materialise(entries, "cut-entries")

    def batches_of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (_, number), w in _blocks(parts):
            first, m, succ, _ = _window(w, number, size, rule, reach)
            at, batch, found = int(w["_entry"].iloc[0]), int(w["_done"].iloc[0]), []
            at = at - number * size + first if at < END else END
            while at < first + m:
                taken, more = rule.batch(w, at, int(succ[at - first]))
                found.append((taken, np.full(len(taken), batch), more))
                at, batch = int(succ[at - first]), batch + 1
            if found:
                taken = np.concatenate([x[0] for x in found])
                out = {shard: w["_shard_value"].iloc[taken].array, key: w["_key"].iloc[taken].array, "batch_id": np.concatenate([x[1] for x in found])}
                yield pd.DataFrame(out | {c: [v for x in found for v in x[2][i]] for i, c in enumerate(rule.columns)})

    kinds = [df.schema[c].dataType.simpleString() for c in (shard, key)]
    schema = ", ".join([f"`{shard}` {kinds[0]}", f"`{key}` {kinds[1]}", "batch_id long", *[f"{c} {k}" for c, k in rule.columns.items()]])
    return dealt(rows.join(entries, ["_shard", "_block"])).mapInPandas(batches_of, schema)
