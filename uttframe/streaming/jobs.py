"""Streaming forms: tumbling and sliding chunks, batches and merges with state, dedup, quotas, and running error rates.

Batches and merges are processors over a shard's state (``transformWithStateInPandas``, whose state is in RocksDB). A
micro-batch's rows of a shard are taken in the order of pos and key; what a micro-batch leaves open is added to the state,
without writing again what is there. A row whose ``last`` is true ends its shard: what is open is sent. So is what a shard
holds when it is quiet for wait_ms. Numbers of batches go on afterwards. A query with such timers makes batches without data
for ever; one that is to end with its input (``availableNow``) needs ``spark.sql.streaming.noDataMicroBatches.enabled=false``.
"""

from __future__ import annotations

import heapq
import json
import threading
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from ..functions.files import system
from ..functions.text import SWITCH


REASONS = ("minlen", "maxlen", "lbl_minlen", "lbl_maxlen", "min_ratio", "max_ratio")
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def chunks(stream: DataFrame, ts: str, aggs: list[Column], *by: str, seconds: int = 10, late: str = "1 minute") -> DataFrame:
    """Fixed chunks of a stream, each on its own."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, f"{seconds} seconds").alias("chunk"), *by).agg(*aggs)


def context_chunks(stream: DataFrame, ts: str, aggs: list[Column], *by: str, seconds: int = 10, left: int = 1, late: str = "1 minute") -> DataFrame:
    """Chunks that also see ``left`` chunks before them."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, f"{(left + 1) * seconds} seconds", f"{seconds} seconds").alias("chunk"), *by).agg(*aggs)


def running_wer(counts: DataFrame, *by: str) -> DataFrame:
    """Micro averages so far, for update or complete mode."""
    return counts.groupBy(*by).agg(F.sum("num_errors").alias("num_errors"), F.sum("num_ref").alias("num_ref"), (F.sum("num_errors") / F.sum("num_ref")).alias("wer"))


def one_per_job(stream: DataFrame, ts: str, job: str = "job", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([job])


def rejections(stream: DataFrame, reason: Column, name: str = "rejections") -> DataFrame:
    """The stream without rejected rows; counts by reason go to the query's listeners, such as ``CountTable``."""
    counts = [F.count(F.when(reason == k, 1)).alias(k) for k in REASONS]
    return stream.observe(name, F.count(F.lit(1)).alias("rows"), *counts).filter(reason.isNull())


class CountTable(StreamingQueryListener):
    """Appends what queries observe under a name to a table of JSON lines at path: (query, batch, stage, reason, n). ``ended`` is set when a query ends."""

    def __init__(self, path: str, *names: str) -> None:
        self.path, self.names, self.ended = path, names, threading.Event()

    def onQueryStarted(self, event) -> None:
        self.ended.clear()

    def onQueryProgress(self, event) -> None:
        p = event.progress
        found = [(name, row.asDict()) for name, row in p.observedMetrics.items() if name in self.names]
        append_counts(self.path, [{"query": str(p.id), "batch": p.batchId, "stage": name, "reason": k, "n": n} for name, counts in found for k, n in counts.items()])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.set()


def append_counts(path: str, rows: list[dict]) -> None:
    """A file of JSON lines in a folder; few rows, so the driver writes them."""
    if rows:
        where, name = system(path)
        where.create_dir(name)
        with where.open_output_stream(f"{name}/{uuid.uuid4().hex}.json") as f:
            f.write("".join(json.dumps(r) + "\n" for r in rows).encode())


def count_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("query string, batch long, stage string, reason string, n long").json(path)


WAIT_MS = 5_000


class _Shard(StatefulProcessor):
    """What the processors below share: a timer that waits for a quiet shard, and its rows in order."""

    wait_ms = WAIT_MS
    #: Columns of the results.
    names: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def close(self) -> None:
        pass

    def take(self, rows: list[tuple]) -> Iterator[tuple]:
        """Results of rows (named tuples) in order."""
        raise NotImplementedError

    def flush(self) -> Iterator[tuple]:
        raise NotImplementedError

    def _results(self, key: tuple, found: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        if some := [(key[0], *r) for r in found]:
            yield pd.DataFrame(some, columns=self.names)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        every = pd.concat(list(rows), ignore_index=True)
        every = every.sort_values("pos" if every["pos"].is_unique else ["pos", "key"], kind="stable")
        yield from self._results(key, self.take(list(every.itertuples(index=False))))
        if every["last"].any():
            yield from self._results(key, self.flush())
        else:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._results(key, self.flush())


def _processed(stream: DataFrame, shard: str, processor: _Shard, schema: str, columns: dict[str, Column], last: Column | None, part: Column | None = None) -> DataFrame:
    """The processor over the shards of a stream, whose rows have columns and last; over parts of shards where these are given."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    processor.names = [c.split()[0] for c in schema.split(", ")]
    rows = stream.select(F.col(shard).cast("string").alias("shard"), *[c.alias(n) for n, c in columns.items()], F.coalesce(last if last is not None else F.lit(False), F.lit(False)).alias("last"), *([part.alias("part")] if part is not None else []))
    return rows.groupBy("shard", *(["part"] if part is not None else [])).transformWithStateInPandas(processor, schema, "append", "processingTime")


class Budgeted(_Shard):
    """Batches that a frame budget cuts, with one row a job and quotas of words where these are asked for."""

    def __init__(self, most: float, one_per_job: bool, per_epoch: int, per_batch: int, quiet_ms: int) -> None:
        self.most, self.one_per_job, self.per_epoch, self.per_batch, self.quiet_ms = most, one_per_job, per_epoch, per_batch, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getValueState("open", "batch long, n int, longest double")
        self.held = handle.getListState("held", "key string")
        self.jobs = handle.getMapState("jobs", "job string", "here boolean")
        self.of_batch = handle.getMapState("of_batch", "word string", "n long")
        self.of_epoch = handle.getMapState("of_epoch", "word string", "n long", self.quiet_ms)

    def take(self, rows: list[tuple]) -> Iterator[tuple]:
        batch, n, longest = self.open.get() if self.open.exists() else (0, 0, 0.0)
        stored = n > 0  # the state has rows of the open batch; each call of the state is a round trip, so a batch that began here makes none
        fresh: list[tuple] = []  # of the open batch, not in the state yet
        jobs = {k[0] for k in self.jobs.keys()} if self.one_per_job else set()
        new_jobs: set = set()
        quotas = [(q, state, {}) for q, state in ((self.per_epoch, self.of_epoch), (self.per_batch, self.of_batch)) if q > 0]

        def seen(state, counts: dict, word: str) -> int:
            if word not in counts:
                known = (state is self.of_epoch or stored) and state.containsKey((word,))
                counts[word] = state.getValue((word,))[0] if known else 0
            return counts[word]

        for r in rows:
            words = (r.txt or "").split(" ") if quotas else []
            if self.one_per_job and (r.job or "") in jobs or not all(any(seen(state, counts, w) < q for w in words) for q, state, counts in quotas):
                continue
            longest = max(longest, float(r.length))
            if n and longest * (n + 1) > self.most:
                yield batch, [*([h[0] for h in self.held.get()] if stored else []), *[f[0] for f in fresh]]
                if stored:
                    for state in (self.held, self.jobs, self.of_batch):
                        state.clear()
                    stored = False
                batch, n, longest, fresh, jobs, new_jobs = batch + 1, 0, float(r.length), [], set(), set()
                for q in quotas:
                    if q[1] is self.of_batch:
                        q[2].clear()
            n += 1
            fresh.append((r.key,))
            jobs.add(r.job or "")
            new_jobs.add(r.job or "")
            for w in words:
                for _, state, counts in quotas:
                    counts[w] = seen(state, counts, w) + 1
        if fresh:
            self.held.appendList(fresh)
        for job in new_jobs if self.one_per_job else ():
            self.jobs.updateValue((job,), (True,))
        for _, state, counts in quotas:
            for w, count in counts.items() if state is self.of_epoch or n else ():
                state.updateValue((w,), (count,))
        self.open.update((batch, n, longest))

    def flush(self) -> Iterator[tuple]:
        batch, n, _ = self.open.get() if self.open.exists() else (0, 0, 0.0)
        if n:
            yield batch, [h[0] for h in self.held.get()]
            for state in (self.held, self.jobs, self.of_batch):
                state.clear()
            self.open.update((batch + 1, 0, 0.0))


def budget_batches(
    stream: DataFrame, shard: str, key: str, pos: str, length: str, most: float = 12000, wait_ms: int = WAIT_MS, last: Column | None = None, *,
    job: str | None = None, text: str | None = None, max_words_per_epoch: int = -1, max_words_per_batch: int = -1, quiet_ms: int = 86_400_000,
) -> DataFrame:
    """(shard, batch_id, keys) of batches that a frame budget cuts, in order.

    With job, a batch has one row of each job, and later ones are left out; with text and quotas, a row is taken if any of its
    words is below its quota in the shard so far, and in the batch. A word's count of the shard goes when the word isn't met for
    quiet_ms.
    """
    processor = Budgeted(most, job is not None, max_words_per_epoch if text else -1, max_words_per_batch if text else -1, quiet_ms)
    processor.wait_ms = wait_ms
    none = F.lit(None).cast("string")
    columns = {"key": F.col(key).cast("string"), "pos": F.col(pos), "length": F.col(length).cast("double"), "job": F.col(job).cast("string") if job else none, "txt": F.col(text).cast("string") if text else none}
    return _processed(stream, shard, processor, "shard string, batch_id long, keys array<string>", columns, last)


class Merged(_Shard):
    """Utterances that follow each other put together, as ``batching.merges`` does; the state has what is open as one text."""

    def __init__(self, least: float, enough: float, most: float, n_most: int) -> None:
        self.least, self.enough, self.most, self.n_most = least, enough, most, n_most

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getValueState("open", "pos long, total double, n int, speaker string, txt string")

    def take(self, rows: list[tuple]) -> Iterator[tuple]:
        held = self.open.get() if self.open.exists() else None
        for r in rows:
            if held is not None and not (held[1] < self.least or held[1] > self.enough or held[2] >= self.n_most or held[1] + r.seconds > self.most):
                between = " " if r.key == held[3] else f" {SWITCH} "
                held = (held[0], held[1] + r.seconds, held[2] + 1, r.key, held[4] + between + r.txt)
                continue
            if held is not None:
                yield self._row(held)
            held = (int(r.pos), float(r.seconds), 1, r.key, r.txt)
        self.open.update(held)

    @staticmethod
    def _row(held: tuple) -> tuple:
        return held[0], held[1], held[4].replace(f"{SWITCH} {SWITCH}", SWITCH)

    def flush(self) -> Iterator[tuple]:
        if self.open.exists():
            yield self._row(self.open.get())
            self.open.clear()


def merged_utterances(stream: DataFrame, shard: str, speaker: str, pos: str, seconds: str, text: str, wait_ms: int = WAIT_MS, last: Column | None = None, **limits: float) -> DataFrame:
    """(shard, first pos, seconds, txt) of merged utterances, in order of pos."""
    rule = {"least": 1.0, "enough": 10.0, "most": 20.0, "n_most": 7} | limits
    processor = Merged(**rule)
    processor.wait_ms = wait_ms
    columns = {"key": F.coalesce(F.col(speaker).cast("string"), F.lit("")), "pos": F.col(pos).cast("long"), "seconds": F.col(seconds).cast("double"), "txt": F.coalesce(text, F.lit(""))}
    return _processed(stream, shard, processor, "shard string, pos long, seconds double, txt string", columns, last)


class Grouped(_Shard):
    """Batches of groups (length buckets, or any window's keys), each full at its size; with a bound on the rows held, the largest group goes when they reach it."""

    def __init__(self, max_held: int) -> None:
        self.max_held = max_held

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.groups = handle.getMapState("groups", "grp long", "n int, batch long, opened long")
        self.held = handle.getMapState("held", "grp long, place int", "key string")
        self.count = handle.getValueState("count", "rows long, opened long")

    def _keys(self, group: int, stored: int, fresh: list[str]) -> list[str]:
        """A group's rows, which leave the state."""
        out = [self.held.getValue((group, i))[0] for i in range(stored)]
        for i in range(stored):
            self.held.removeKey((group, i))
        return [*out, *fresh]

    def take(self, rows: list[tuple]) -> Iterator[tuple]:
        total, opened = self.count.get() if self.count.exists() else (0, 0)
        groups = {g[0]: [*v, v[0], []] for g, v in self.groups.iterator()}  # n, batch, when it was opened, rows in the state, others
        sizes = [(-v[0], v[2], g) for g, v in groups.items() if v[0]] if self.max_held else []  # asked for at the bound alone
        heapq.heapify(sizes)
        touched = set()

        def send(group: int) -> tuple:
            v = groups[group]
            out = (group, v[1], self._keys(group, v[3], v[4]))
            groups[group] = [0, v[1] + 1, v[2], 0, []]
            return out

        for r in rows:
            g = int(r.group)
            v = groups.setdefault(g, [0, 0, 0, 0, []])
            if not v[0]:
                v[2], opened = opened, opened + 1
            v[0] += 1
            v[4].append(r.key)
            total += 1
            touched.add(g)
            if v[0] >= r.size:
                total -= v[0]
                yield send(g)
            elif self.max_held:
                heapq.heappush(sizes, (-v[0], v[2], g))
            if total == self.max_held:
                while sizes:  # entries of a group's earlier sizes are passed over
                    n, since, largest = heapq.heappop(sizes)
                    if groups[largest][0] == -n and groups[largest][2] == since:
                        total += n
                        touched.add(largest)
                        yield send(largest)
                        break
        for g in touched:
            n, batch, since, stored, fresh = groups[g]
            for i, key in enumerate(fresh):
                self.held.updateValue((g, stored + i), (key,))
            self.groups.updateValue((g,), (n, batch, since))
        self.count.update((total, opened))

    def flush(self) -> Iterator[tuple]:
        """All groups that hold rows, in the order in which they were opened."""
        for g, (n, batch, since) in sorted(((g[0], v) for g, v in self.groups.iterator() if v[0]), key=lambda x: x[1][2]):
            yield g, batch, self._keys(g, n, [])
            self.groups.updateValue((g,), (0, batch + 1, since))
        if self.count.exists():
            self.count.update((0, self.count.get()[1]))


def group_batches(stream: DataFrame, shard: str, key: str, pos: str, group: Column, size: Column, wait_ms: int = WAIT_MS, last: Column | None = None, max_held: int = 0) -> DataFrame:
    """(shard, group, batch_id, keys): rows of a shard and group in batches of the group's size; with max_held, a shard holds fewer rows than that."""
    processor = Grouped(max_held)
    processor.wait_ms = wait_ms
    columns = {"key": F.col(key).cast("string"), "pos": F.col(pos), "group": group.cast("long"), "size": size.cast("int")}
    return _processed(stream, shard, processor, "shard string, group long, batch_id long, keys array<string>", columns, last)


class Rationed(_Shard):
    """Rows any of whose words is below its quota so far; with single, a row's text is one word, and parts of a shard have words of their own."""

    def __init__(self, quota: int, quiet_ms: int, single: bool) -> None:
        self.quota, self.quiet_ms, self.single = quota, quiet_ms, single

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.words = handle.getMapState("words", "word string", "n long", self.quiet_ms)

    def take(self, rows: list[tuple]) -> Iterator[tuple]:
        counts: dict[str, int] = {}
        for r in rows:
            words = [r.key] if self.single else r.key.split(" ")
            for w in words:
                if w not in counts:
                    counts[w] = self.words.getValue((w,))[0] if self.words.containsKey((w,)) else 0
            if any(counts[w] < self.quota for w in words):
                for w in words:
                    counts[w] += 1
                yield int(r.pos), r.key
        for w, n in counts.items():
            self.words.updateValue((w,), (n,))

    def flush(self) -> Iterator[tuple]:
        return iter(())


PARTS = 64  # of a shard whose rows are single words


def word_quota(stream: DataFrame, shard: str, pos: str, text: str, quota: int, quiet_ms: int = 86_400_000, single: bool = False) -> DataFrame:
    """(shard, pos, txt) of rows any of whose words is below its quota in the shard so far; a word's count goes when it isn't met for quiet_ms.

    With single, the whole text is one word, so rows of different texts don't depend on each other: a shard's texts are dealt to
    PARTS keys of the state, and few long shards keep many tasks busy.
    """
    processor = Rationed(quota, quiet_ms, single)
    processor.wait_ms = quiet_ms
    txt = F.coalesce(text, F.lit(""))
    part = F.pmod(F.xxhash64(txt), F.lit(PARTS)).cast("int") if single else None
    return _processed(stream, shard, processor, "shard string, pos long, txt string", {"key": txt, "pos": F.col(pos).cast("long")}, None, part)
