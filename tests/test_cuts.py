"""Cuts in parallel blocks against the fold of a whole shard."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from uttframe.operators import batching, cuts


def rows_of(df) -> Counter:
    return Counter(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def shards(spark):
    rng = random.Random(8)
    sizes = {"long": 700, "mid": 64, "short": 3, None: 129, "": 65}
    rows = [(s, i, f"{s}-{i}", rng.choice([0.0, 1.0, 5.0, 20.0, 30.0]) if i % 11 else None, f"j{rng.randrange(6)}" if i % 7 else None, f"p{rng.randrange(2)}") for s, n in sizes.items() for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "shard string, pos int, key string, length double, job string, speaker string").repartition(5)


@pytest.mark.parametrize(("size", "reach"), [(64, 40), (100, 100), (7, 7), (4096, 64)])
@pytest.mark.parametrize("lost", [False, True])
def test_budgets(shards, size, reach, lost):
    filled = shards.fillna({"length": 0.0})
    most = 150.0 if reach > 7 else 30.0
    filled = filled.withColumn("length", F.greatest("length", F.lit(5.0)))
    want = batching._fold(filled, "shard", ["pos"], ["key", "length"], lambda rows: batching.budget(rows, most, lost), "key string, batch_id long")
    got = cuts.cut(filled, "shard", ["pos"], "key", {"length": "length"}, cuts.Budget(most, lost), size, reach)
    assert got is not None and rows_of(got) == rows_of(want)


def test_one_row_a_job(shards):
    filled = shards.fillna({"length": 0.0}).withColumn("length", F.col("length") + 10)
    step = lambda rows: batching.quotas(rows, 70.0, True, -1, -1)
    want = batching._fold(filled.withColumn("w", F.array(F.lit(1))), "shard", ["pos"], ["key", "length", "job", "w"], step, "key string, batch_id long")
    got = cuts.cut(filled, "shard", ["pos"], "key", {"length": "length", "job": "job"}, cuts.OnePerJob(70.0), 64, 64)
    assert rows_of(got.select("shard", "key", F.when(F.col("taken"), F.col("batch_id")))) == rows_of(want)


def test_merges(shards):
    filled = shards.fillna({"length": 0.5})
    want = batching._fold(filled, "shard", ["pos"], ["key", "speaker", "length"], lambda rows: batching.merges(rows, 1, 10, 20, 7), "key string, group_id long, sep string")
    got = cuts.cut(filled, "shard", ["pos"], "key", {"speaker": "speaker", "seconds": "length"}, cuts.Merge(1, 10, 20, 7), 64, 16)
    assert rows_of(got) == rows_of(want)


def test_batches_beyond_the_reach_are_left_to_the_fold(shards):
    assert cuts.cut(shards, "shard", ["pos"], "key", {"length": "length"}, cuts.Budget(1e9), 64, 16) is None
    empty = shards.limit(0)
    assert cuts.cut(empty, "shard", ["pos"], "key", {"length": "length"}, cuts.Budget(100.0), 64, 16).collect() == []


def test_one_shard_of_many_rows_uses_many_tasks(spark, monkeypatch):
    df = spark.range(200_000).select(F.lit("s").alias("shard"), F.col("id").alias("pos"), F.col("id").alias("key"), (F.pmod(F.xxhash64("id"), F.lit(500)) + 10).cast("double").alias("length"))
    got = batching.dynamic_batch(df, "shard", ["pos"], "key", "length")
    assert got.withColumn("task", F.spark_partition_id()).select("task").distinct().count() >= 3
    monkeypatch.setattr(cuts, "BLOCK", 1 << 40)
    assert got.exceptAll(batching.dynamic_batch(df, "shard", ["pos"], "key", "length")).isEmpty() and got.count() == 200_000
