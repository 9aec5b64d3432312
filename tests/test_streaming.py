"""Streams give what batches give."""

from __future__ import annotations

import random
import time
import uuid
from collections import Counter, namedtuple

import pytest
from pyspark.sql import functions as F

from uttframe.functions import text as T
from uttframe.operators import batching
from uttframe.streaming import jobs


def run(df, mode="append"):
    """All rows that a streaming frame emits."""
    name = "q" + uuid.uuid4().hex
    writer = df.writeStream.format("memory").queryName(name).outputMode(mode)
    df.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # as timers make such batches for ever
    q = writer.trigger(availableNow=True).start()
    df.sparkSession.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    if not q.awaitTermination(60):
        q.stop()
        raise AssertionError("the query didn't end")
    return q, name


@pytest.fixture
def stream(spark, tmp_path):
    def of(df, parts=1):
        path = str(tmp_path / uuid.uuid4().hex)
        df.repartition(parts).write.parquet(path)
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)

    return of


def test_chunks_and_context(spark, stream):
    df = spark.range(100).select(F.timestamp_seconds(F.col("id") * 3).alias("ts"), (F.col("id") % 2).alias("u"), F.lit(1).alias("v"))
    q, name = run(jobs.chunks(stream(df), "ts", [F.sum("v").alias("n")], "u"), "complete")
    want = df.groupBy(F.window("ts", "10 seconds").alias("chunk"), "u").agg(F.sum("v").alias("n"))
    assert spark.table(name).select(want.columns).exceptAll(want).count() == 0 and spark.table(name).count() == want.count()
    q.stop()
    q, name = run(jobs.context_chunks(stream(df), "ts", [F.sum("v").alias("n")], left=1), "complete")
    assert spark.table(name).agg(F.sum("n")).first()[0] == 200  # each row is in its chunk and in the next one's context
    q.stop()


def test_running_error_rate_and_dedup(spark, stream):
    counts = spark.createDataFrame([("s", 1, 10), ("s", 2, 20), ("t", 3, 30)], "suite string, num_errors long, num_ref long")
    q, name = run(jobs.running_wer(stream(counts, 3), "suite"), "complete")
    assert {r.suite: r.wer for r in spark.table(name).collect()} == {"s": 0.1, "t": 0.1}
    q.stop()
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "job string, s int").withColumn("ts", F.timestamp_seconds("s"))
    q, name = run(jobs.one_per_job(stream(rows), "ts"))
    assert sorted(r.job for r in spark.table(name).collect()) == ["a", "b"]
    q.stop()


def test_rejections(spark, stream):
    df = spark.createDataFrame([(1, None), (2, "minlen"), (3, "minlen")], "i int, reason string")
    q, name = run(jobs.rejections(stream(df), F.col("reason")))
    assert [r.i for r in spark.table(name).collect()] == [1]
    assert sum(p["observedMetrics"]["rejections"]["minlen"] for p in q.recentProgress if p["observedMetrics"]) == 2
    q.stop()


def in_order(spark, stream_path, df, n=4):
    """df written in n files of pos ranges, each older than the next, and the stream that takes one a trigger."""
    top = df.agg(F.max("pos")).first()[0] + 1
    for i in range(n):
        df.filter(F.floor(F.col("pos") * n / top) == i).coalesce(1).write.mode("append").parquet(stream_path)
        time.sleep(0.05)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(stream_path)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    sizes = {"s": 90, "t": 41, "u": 1}
    out = [(s, i, f"{s}{i}", float(rng.choice([100, 400, 1500, 3000])), f"job{rng.randrange(9)}", " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 4))), "ab"[rng.randrange(2)], rng.randrange(1, 9) / 2, i == n - 1) for s, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(out, "shard string, pos long, key string, length double, job string, txt string, speaker string, seconds double, last boolean")


def keys_by_batch(found) -> dict:
    out: dict = {}
    for r in sorted(found, key=lambda r: r.pos):
        if r.batch_id is not None:
            out.setdefault((r.shard, r.batch_id), []).append(r.key)
    return out


def test_budgets_with_jobs_and_quotas_equal_the_batch_form(spark, tmp_path, rows):
    place = rows.select("shard", "key", "pos")
    for i, more in enumerate(({}, {"job": "job"}, {"job": "job", "text": "txt", "max_words_per_epoch": 12, "max_words_per_batch": 3})):
        q, name = run(jobs.budget_batches(in_order(spark, str(tmp_path / str(i)), rows), "shard", "key", "pos", "length", 6000.0, 3_600_000, F.col("last"), **more))
        got = {(r.shard, r.batch_id): r["keys"] for r in spark.table(name).collect()}
        if more:
            want = batching.distribute_batch(rows, "shard", ["pos"], "key", "length", "job", "txt", 6000.0, True, more.get("max_words_per_epoch", -1), more.get("max_words_per_batch", -1))
        else:
            want = batching.dynamic_batch(rows, "shard", ["pos"], "key", "length", 6000.0)
        assert got == keys_by_batch(want.join(place, ["shard", "key"]).collect()) and len(got) > 12
        assert sum(p["numInputRows"] > 0 for p in q.recentProgress) == 4


def test_merged_utterances_equal_the_batch_form(spark, tmp_path, rows):
    spoken = rows.withColumn("key", F.concat("speaker", F.lit("-"), "pos"))
    want = Counter((r.shard, r.txt, r.seconds) for r in batching.merge_utterances(spoken.withColumn("_s", F.col("speaker")), "shard", ["pos"]).collect())
    who = spoken.withColumn("speaker", T.speaker_of(F.col("key")))
    q, name = run(jobs.merged_utterances(in_order(spark, str(tmp_path / "m"), who), "shard", "speaker", "pos", "seconds", "txt", 3_600_000, F.col("last")))
    assert Counter((r.shard, r.txt, r.seconds) for r in spark.table(name).collect()) == want and sum(want.values()) > 30


def plain_groups(rows: list, size: dict, max_held: int) -> list:
    """A loop over rows (group, key): (group, number, keys) in the order in which they are sent."""
    held: dict = {}
    number: dict = {}
    out = []

    def send(g):
        out.append((g, number.get(g, 0), held.pop(g)))
        number[g] = number.get(g, 0) + 1

    for g, key in rows:
        held.setdefault(g, []).append(key)
        if len(held[g]) == size[g]:
            send(g)
        if sum(map(len, held.values())) == max_held:
            send(max(held, key=lambda x: len(held[x])))  # the first opened of the largest
    for g in list(held):
        send(g)
    return out


@pytest.mark.parametrize("max_held", [0, 7, 3])
def test_groups_with_a_bound_equal_a_plain_loop(spark, tmp_path, rows, max_held):
    group = F.pmod(F.xxhash64("key"), F.lit(4))
    size = F.element_at(F.array(*map(F.lit, (3, 5, 9, 40))), (group + 1).cast("int"))
    q, name = run(jobs.group_batches(in_order(spark, str(tmp_path / "g"), rows), "shard", "key", "pos", group, size, 3_600_000, F.col("last"), max_held))
    got = {(r.shard, r.group, r.batch_id, tuple(r["keys"])) for r in spark.table(name).collect()}
    want = set()
    for shard in "stu":
        own = rows.filter(F.col("shard") == shard).orderBy("pos").select(group.alias("g"), "key").collect()
        want |= {(shard, g, n, tuple(keys)) for g, n, keys in plain_groups([(r.g, r.key) for r in own], {0: 3, 1: 5, 2: 9, 3: 40}, max_held)}
    assert got == want and sum(len(x[3]) for x in got) == rows.count()


def test_numbers_go_on_after_a_quiet_time(spark, tmp_path, rows):
    path, s = str(tmp_path / "q"), rows.filter("shard = 's'").withColumn("last", F.lit(False))
    s.filter("pos < 40").coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(s.schema).parquet(path)
    name = "q" + uuid.uuid4().hex
    q = jobs.group_batches(stream, "shard", "key", "pos", F.lit(0), F.lit(16), 500).writeStream.format("memory").queryName(name).start()

    def wait(n):
        end = time.time() + 60
        while spark.table(name).count() < n and time.time() < end:
            time.sleep(0.3)
        return sorted((r.batch_id, len(r["keys"])) for r in spark.table(name).collect())

    assert wait(3) == [(0, 16), (1, 16), (2, 8)]
    s.filter("pos BETWEEN 40 AND 60").coalesce(1).write.mode("append").parquet(path)
    assert wait(5) == [(0, 16), (1, 16), (2, 8), (3, 16), (4, 5)]
    q.stop()


def test_word_quotas_over_four_batches(spark, tmp_path, rows):
    q, name = run(jobs.word_quota(in_order(spark, str(tmp_path / "w"), rows), "shard", "pos", "txt", 5))
    want = set()
    for shard in "stu":
        seen: Counter = Counter()
        for r in rows.filter(F.col("shard") == shard).orderBy("pos").collect():
            words = r.txt.split(" ")
            if any(seen[w] < 5 for w in words):
                seen.update(words)
                want.add((shard, r.pos))
    assert {(r.shard, r.pos) for r in spark.table(name).collect()} == want


def test_word_quotas_of_single_words_in_parts_of_a_shard(spark, tmp_path, rows):
    """A text with a blank is one word too; the parts make up the shard."""
    q, name = run(jobs.word_quota(in_order(spark, str(tmp_path / "w"), rows), "shard", "pos", "txt", 2, single=True))
    want, seen = set(), Counter()
    for r in rows.orderBy("shard", "pos").collect():
        seen[r.shard, r.txt] += 1
        if seen[r.shard, r.txt] <= 2:
            want.add((r.shard, r.pos))
    assert {(r.shard, r.pos) for r in spark.table(name).collect()} == want and len(want) < rows.count()
    q.stop()


class Calls:
    """A handle and its states, empty, that count what is asked of them."""

    def __init__(self) -> None:
        self.n = 0

    def __getattr__(self, name: str):
        def call(*args):
            self.n += name not in ("getValueState", "getListState", "getMapState")
            return self if name.endswith("State") else iter(()) if name in ("get", "keys", "iterator") else False

        return call


def test_the_state_is_not_asked_for_each_batch():
    row = namedtuple("row", "key pos length job txt last group size")
    rows = [row(str(i), i, 100.0, f"j{i}", "w", False, 0, 6) for i in range(600)]
    for processor in (jobs.Budgeted(650.0, True, -1, -1, 1000), jobs.Grouped(0)):
        handle = Calls()
        processor.init(handle)
        assert [k for _, _, k in processor.take(rows)] if isinstance(processor, jobs.Grouped) else len(list(processor.take(rows))) == 99
        assert handle.n < 20


def test_a_query_of_few_shards_has_few_parts_of_state(spark, tmp_path, monkeypatch):
    from uttframe.plans import arrays, base

    spark.createDataFrame([(i, i, "ab"[i % 2]) for i in range(40)], "event_id long, user_id long, event_type string").withColumn("ts", F.timestamp_seconds("event_id")).write.parquet(str(tmp_path / "events.parquet"))
    seen, was = [], spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(arrays, "_runs", lambda *a: (seen.append(int(spark.conf.get("spark.sql.shuffle.partitions"))), a[2].drop("_top").write.parquet(f"{a[1]}/out")))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "300")
        found = arrays._streamed(base.Tables(spark, str(tmp_path)), None, "append", []).filter("last").collect()
        assert seen == [2 * spark.sparkContext.defaultParallelism] and spark.conf.get("spark.sql.shuffle.partitions") == "300"
        assert sorted((r.event_type, r.event_id) for r in found) == [("a", 38), ("b", 39)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_counts_that_a_listener_writes(spark, stream, tmp_path):
    df = spark.createDataFrame([(i, [None, "minlen", "maxlen"][i % 3]) for i in range(9)], "i int, reason string")
    listener = jobs.CountTable(str(tmp_path / "counts"), "rejections")
    spark.streams.addListener(listener)
    run(jobs.rejections(stream(df, 3), F.col("reason")))
    assert listener.ended.wait(30)
    spark.streams.removeListener(listener)
    found = {r.reason: r.n for r in jobs.count_table(spark, str(tmp_path / "counts")).groupBy("reason").agg(F.sum("n").alias("n")).collect()}
    assert (found["rows"], found["minlen"], found["maxlen"], found["min_ratio"]) == (9, 3, 3, 0)
