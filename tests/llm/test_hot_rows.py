"""Repetitive texts, hot passages and hot lines."""

from __future__ import annotations

import random
import time
import tracemalloc

from uttframe.llm import contamination, log_templates, passages

from test_operators import prose


def test_pieces_of_a_text_give_the_same_leaks(monkeypatch):
    rng = random.Random(6)
    items = [(i, prose(rng, 40)) for i in range(30)] + [(90, "ab cd " * 60), (91, "a b c")]
    index = contamination.Index(items)
    texts = []
    for _ in range(12):
        parts = [prose(rng, rng.randrange(5, 300)) if rng.random() < 0.6 else rng.choice(items)[1] for _ in range(12)]
        texts.append(" ".join(parts))
    texts += ["", "a", "ab cd " * 3_000, "x " * 5_000]
    whole = []
    monkeypatch.setattr(contamination, "CHUNK", 1 << 24)
    for t in texts:
        whole.append(index.leaks(t))
    for size in (1 << 11, 1 << 14):
        monkeypatch.setattr(contamination, "CHUNK", size)
        assert [index.leaks(t) for t in texts] == whole
    assert sum(map(len, whole)) > 20


def test_memory_of_a_very_repetitive_text():
    index = contamination.Index([(1, "ab cd " * 100)])
    text = "ab cd " * 333_000
    tracemalloc.start()
    began = time.time()
    (leak,) = index.leaks(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert leak == (1, 0, len(text) - 1, 0) and peak < 500e6 and time.time() - began < 120


def test_items_with_ids_of_text(spark):
    rng = random.Random(2)
    item = prose(rng, 60)
    docs = spark.createDataFrame([(1, f"{prose(rng, 30)} {item} end"), (2, prose(rng, 50))], "doc_id long, text string")
    benchmark = spark.createDataFrame([("q-1", item), (None, prose(rng, 60))], "item_id string, text string")
    assert [(r.doc_id, r.item_id) for r in contamination.query(docs, benchmark).collect()] == [(1, "q-1")]
    assert [r.doc_id for r in contamination.drop_leaks(docs, benchmark).collect()] == [2]


def test_one_passage_and_one_line_in_every_row(spark):
    rng = random.Random(3)
    passage, line = prose(rng, 60), "connection reset by peer 17 after 3 tries"
    rows = [(i, f"{prose(rng, 12)} {passage} {prose(rng, 12)}\n{line}") for i in range(2_500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    found = {r.doc_id: r for r in passages.query(docs).collect()}
    assert found[0].n_removed == 0 and all(found[i].removed_words >= 60 for i in range(1, 2_500))
    gone = {r.doc_id: r.dropped_lines for r in log_templates.query(docs).collect()}
    assert all(gone[i] == "1" for i in range(2_500))


def test_sets_of_a_large_family_are_not_repeated_as_rows(spark):
    """A family of 600 near copies in blocks of 16: its blocks go to their pairs as whole rows, and no link is lost."""
    from uttframe.llm import chosen_path

    rng = random.Random(3)
    words = prose(rng, 120).split()
    texts = [" ".join([*words[: i % 60], f"v{i}", *words[i % 60 :]]) for i in range(600)]
    rows, sent = [(i, t) for i, t in enumerate(texts)], []
    by_bucket = chosen_path._by_bucket
    try:
        chosen_path._by_bucket = lambda df, *order: (sent.append(df), by_bucket(df, *order))[1]
        out = chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), small=10, block=16, recall=0.9999)
        got = {(r.class_id, r.n_links) for r in out.collect()}
        assert got == {(0, 599)} and sum(df.count() for df in sent) < 10 * 600 * 16
    finally:
        chosen_path._by_bucket = by_bucket
