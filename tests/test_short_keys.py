"""Queries over keys of any number of frames: the last key of a table is seldom whole."""

from __future__ import annotations

import random

import pytest
from uttframe.plans import QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Keys of 1 to 25 embeddings of 64 values, and a region."""
    rng = random.Random(4)
    path = str(tmp_path_factory.mktemp("short"))
    rows = [(25 * k + i, [rng.uniform(-1, 1) for _ in range(64)], rng.randrange(10)) for k in range(25) for i in range(k + 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([(0, "a")], "r_regionkey int, r_name string").write.parquet(f"{path}/region.parquet")
    return path


@pytest.mark.parametrize(("name", "bins", "count"), [
    ("filter_bank_frames", 23, lambda n: 1 + int((n - 200) / 80)),
    ("resampled_cepstra", 40, lambda n: 1 + int((2 * n - 400) / 160)),
    ("log_mel_frames", 80, lambda n: n // 160 - 1),
])
def test_frames_of_short_waves(spark, folder, name, bins, count):
    got = {(r.key, r.n_frames, r.n_bins) for r in QUERIES[name](spark, folder).collect()}
    assert got == {(k, count(64 * (k + 1)), bins) for k in range(25)}


def test_trimmed_lengths_of_short_keys(spark, folder):
    assert [tuple(r) for r in QUERIES["trimmed_lengths"](spark, folder).collect()] == [(25, True, True, True)]


def test_tasks_are_the_rows_own(spark, tmp_path):
    spark.createDataFrame([(1, "a b", "en", 3), (2, "c", "de", 1), (3, None, None, 0)], "doc_id long, text string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.task for r in QUERIES["task_columns"](spark, str(tmp_path)).collect()} == {1: "en", 2: "de", 3: None}


def test_token_objects_share_files(spark, tmp_path):
    rows = [(i, 1, "user", f"a\tb  {i} \"c\\") for i in range(200)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = QUERIES["token_info"](spark, str(tmp_path))
    assert {r.file for r in out.filter("n_tokens > 0").collect()} == set(range(200)) and len(out.inputFiles()) < 50


@pytest.mark.parametrize("name", ["posterior_records", "network_times"])
def test_pairs_reach_python_in_small_batches(spark, folder, name):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert QUERIES[name](spark, folder).count() == 325 and int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500


def test_masks_of_short_keys(spark, folder):
    """Trimming goes by a key's own frames: none is left out of a key of one or two, and larger keys lose some."""
    left = {r.key: r["count"] for r in QUERIES["masked_features"](spark, folder).groupBy("key").count().collect()}
    assert left[0] == 1 and left[1] == 2 and all(left[k] < k + 1 for k in range(10, 25))
