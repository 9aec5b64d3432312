"""The pipeline on hard rows, and sharding against a plain differencing."""

from __future__ import annotations

import heapq
import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from uttframe.llm import sharding

from test_operators import prose

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, slot string, size string, digest string, part string, quality string"


def test_pipeline_with_nulls_repeats_clashing_columns_and_a_very_long_text(spark, tmp_path):
    rng = random.Random(12)
    item = prose(rng, 60)
    texts = [prose(rng, 80) for _ in range(30)]
    long = prose(rng, 60_000)
    rows = [(i, t, "en", "abc"[i % 3], len(t)) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, texts[1], None, None, None), (40, None, "en", "a", None), (41, "", "en", "a", 0), (None, None, None, None, None)]
    rows += [(50, f"{texts[2]} {item} {prose(rng, 30)}", "en", "a", 1), (51, long, "en", None, len(long))]
    docs = spark.createDataFrame([(*r, *[f"x{i}"] * 6) for i, r in enumerate(rows)], DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*[c for c in docs.columns if c != "shard"], "shard"] and out.schema["shard"].dataType.simpleString() == "int"
    found = out.collect()
    kept = Counter(r.text for r in found)
    assert not {None, ""} & set(kept) and not [t for t in kept if item in t]
    # Repeats of mixing are of one row; of equal texts one row has stayed.
    assert set(kept) <= {*texts, long} and all(len({r.doc_id for r in found if r.text == t}) == 1 for t in kept)
    assert long in kept or Counter(r.source for r in found)  # its source's share may leave a long text out
    assert {r.shard for r in found} <= set(range(16))


def largest_differencing(sizes: list[int], ways: int) -> int:
    """The spread of the shards' sums by the plain method: the two partitions of largest spread are joined, the largest sums with the smallest."""
    heap = [(-s, i, [s] + [0] * (ways - 1)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        sums = sorted((x + y for x, y in zip(sorted(a, reverse=True), sorted(b), strict=True)), reverse=True)
        base = sums[-1]
        n += 1
        heapq.heappush(heap, (-(sums[0] - base), n, [s - base for s in sums]))
    return -heap[0][0]


def test_spread_of_shards_is_that_of_plain_differencing(spark):
    for seed in range(3):
        rng = random.Random(seed)
        sizes = [rng.randrange(1, 400) for _ in range(50)]
        docs = spark.createDataFrame([(i, f"{i:03d}" + "x" * s, "en", "a", s) for i, s in enumerate(sizes)], "doc_id long, text string, lang string, source string, n_chars long")
        sums = {r.shard: r.n for r in sharding.query(docs).groupBy("shard").agg(F.sum("size").alias("n")).collect()}
        sums = [sums.get(i, 0) for i in range(16)]
        plain = largest_differencing([s + 4 for s in sizes], 16)
        assert max(sums) - min(sums) == plain
