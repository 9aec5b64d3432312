"""The pipeline: each stage's rows against a plain version of its rule, on the smallest corpus; and on an empty one."""

from __future__ import annotations

import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from test_operators import classes

import corpus_pipeline
from uttframe.llm import contamination, mixing, quality
from uttframe.llm.common import materialise

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows after each stage, the documents first."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start, out = docs.columns, [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), "test-stage")
        assert docs.columns == start or name == "sharding"
        out.append(docs.collect())
    assert docs.columns == [*start, "shard"]
    return out


def key(r) -> tuple:
    return r.doc_id, r.text, r.lang, r.source, r.n_chars


def test_quality_stage(stages):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({quality.ORACLE}) WHERE kept").fetchall()}
    assert Counter(map(key, stages[1])) == Counter(key(r) for r in stages[0] if r.doc_id in kept)
    assert 0 < len(stages[1]) < len(stages[0])


def test_join_stage(stages):
    rows = [(r.doc_id, r.text) for r in stages[1]]
    first = {c for _, c, _ in classes(rows)}  # every kept text has words
    assert Counter(map(key, stages[2])) == Counter(key(r) for r in stages[1] if r.doc_id in first)


def holds(text: str, segments: np.ndarray, budgets: np.ndarray) -> bool:
    """Whether the text has a place for one of the segments (a row each, of one length) within its budget, by the whole table of edits."""
    c = contamination.normal(text)[0].astype(np.int64)
    cost = np.zeros((len(segments), len(c) + 1), dtype=np.int32)
    steps = np.arange(len(c) + 1, dtype=np.int32)
    for i in range(segments.shape[1]):
        new = np.empty_like(cost)
        new[:, 0] = i + 1
        np.minimum(cost[:, :-1] + (c != segments[:, i : i + 1]), cost[:, 1:] + 1, out=new[:, 1:])
        cost = np.minimum.accumulate(new - steps, axis=1) + steps
    return bool((cost.min(axis=1) <= budgets).any())


def test_decontamination_stage(spark, stages):
    by_length: dict[int, list] = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        n = contamination.normal(r.text)[0].astype(np.int64)
        for a, b in contamination.cuts(len(n)):
            if b - a == min(len(n), contamination.QUOTE):  # a longer segment within its budget need not hold a short one
                by_length.setdefault(b - a, []).append(n[a:b])
    gone = {r.doc_id for r in stages[2]} - {r.doc_id for r in stages[3]}
    tables = {n: np.stack(xs) for n, xs in by_length.items()}
    found = {r.doc_id for r in stages[2] if any(holds(r.text, x, np.full(len(x), contamination.budget(n))) for n, x in tables.items())}
    assert found <= gone and gone
    for doc_id in gone - found:  # what only a whole or a long segment shows
        text = next(r.text for r in stages[2] if r.doc_id == doc_id)
        assert contamination.Index([(i, r.text) for i, r in enumerate(spark.read.parquet(f"{SF}/benchmark.parquet").collect())]).leaks(text)
    assert Counter(map(key, stages[3])) == Counter(key(r) for r in stages[2] if r.doc_id not in gone)


def test_mixing_stage(stages):
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    before, after = Counter(map(key, stages[3])), Counter(map(key, stages[4]))
    assert set(after) <= set(before) and all(n <= 3 * before[k] for k, n in after.items())
    totals, taken, largest = Counter(), Counter(), Counter()
    for r in stages[3]:
        totals[r.source] += size(r)
        largest[r.source] = max(largest[r.source], size(r))
    for r in stages[4]:
        taken[r.source] += size(r)
    target = mixing.source_targets(dict(totals))
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in totals)


def test_sharding_stage(stages):
    assert Counter(map(key, stages[4])) == Counter(map(key, stages[5]))
    sums, shards = Counter(), {}
    for r in stages[5]:
        sums[r.shard] += len(r.text.encode()) + 1
        shards.setdefault(r.text, set()).add(r.shard)
    largest = max(len(t.encode()) + 1 for t in shards)
    ideal = sum(sums.values()) / 16
    assert set(sums) <= set(range(16)) and max(sums.values()) <= max(1.35 * ideal, 3 * largest)
    assert all(len(s) == 1 for s in shards.values())


def test_an_empty_corpus(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*docs.columns, "shard"] and out.count() == 0
