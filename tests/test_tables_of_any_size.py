"""Dictionaries and phrases as tables, against the forms with maps and tries."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from uttframe.operators import sequences, vocab


def test_dictionaries_as_tables_equal_maps(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(40)] + ["中"]
    table = {w: i for i, w in enumerate(words[:30])} | {"<unk>": 99}
    pieces = {w: f"{w}@@ x" for w in words[::3]}
    rows = [(i, [rng.choice(words) for _ in range(rng.randrange(9))], " ".join(rng.choice(words) for _ in range(6)) + "中文") for i in range(60)] + [(100, None, None), (None, ["w1"], "w1")]
    df = spark.createDataFrame(rows, "k int, t array<string>, txt string")
    vocabulary = spark.createDataFrame(list(table.items()), "token string, id int")
    want = {r.k: r.x for r in df.select("k", F.coalesce(vocab.encode(F.col("t"), table), F.array().cast("array<int>")).alias("x")).collect()}
    ids = vocab.encode_join(df, "k", "t", vocabulary)
    assert {r.k: r.ids for r in ids.collect()} == want
    back = {r.k: r.tokens for r in vocab.decode_join(ids, "k", "ids", vocabulary).collect()}
    assert back == {k: [w for i in x for w in table if table[w] == i] for k, x in want.items()}
    with pytest.raises(Exception, match="no token of id 99"):
        vocab.decode_join(ids, "k", "ids", vocabulary.filter("id < 99")).collect()
    found = {r.k: r.tokens for r in vocab.segment_join(df, "k", "txt", spark.createDataFrame(list(pieces.items()), "word string, pieces string")).collect()}
    assert found == {r.k: r.x for r in df.select("k", F.coalesce(vocab.segment(F.col("txt"), pieces), F.array().cast("array<string>")).alias("x")).collect()}


def test_a_large_dictionary_plans_fast(spark):
    table = spark.range(200_000).select(F.concat(F.lit("w"), "id").alias("token"), F.col("id").cast("int").alias("id"))
    df = spark.createDataFrame([(1, ["w5", "w199999", "none"])], "k int, t array<string>")
    began = time.time()
    out = vocab.encode_join(df, "k", "t", table)
    out._jdf.queryExecution().optimizedPlan()
    assert time.time() - began < 2 and out.first().ids == [5, 199999]


def plain_bonus(tokens: list, phrases: list, bonus: float) -> float:
    known = {tuple(p) for p in phrases if p}
    return sum(bonus * len(p) for i in range(len(tokens)) for p in known if tuple(tokens[i : i + len(p)]) == p)


def test_phrases_as_a_table_equal_a_plain_search_and_the_trie(spark):
    rng = random.Random(7)
    phrases = [[rng.randrange(4) for _ in range(rng.randrange(1, 5))] for _ in range(25)] + [[]]
    rows = [(i, [rng.randrange(4) for _ in range(rng.randrange(15))]) for i in range(80)] + [(200, None)]
    df = spark.createDataFrame(rows, "k int, t array<int>")
    table = spark.createDataFrame(list(enumerate(phrases)), "o int, phrase array<int>")
    got = {r.k: r.bonus for r in sequences.phrase_bonus_join(df, "k", "t", table, 0.5).collect()}
    assert got == {k: plain_bonus(t or [], phrases, 0.5) for k, t in rows}
    trie = {r.k: r.b for r in df.filter("t IS NOT NULL").select("k", sequences.phrase_bonus(F.col("t"), phrases, 0.5).alias("b")).collect()}
    assert all(trie[k] == pytest.approx(got[k]) for k in trie)
    places = {(r.k, r.place, tuple(r.phrase)) for r in sequences.phrase_matches(df, "k", "t", table).collect()}
    assert places == {(k, i, tuple(p)) for k, t in rows for i in range(len(t or [])) for p in phrases if p and t[i : i + len(p)] == p}


def test_phrases_that_end_at_new_nodes_alone(spark):
    phrases = [[1, 2, 3], [1, 2], [4], [4, 5], [4], [6]]
    table = spark.createDataFrame(list(enumerate(phrases)), "o int, phrase array<int>")
    kept = [tuple(r.phrase) for r in sequences.ending(table, "phrase", "o").collect()]
    assert sorted(kept) == [(1, 2, 3), (4,), (4, 5), (6,)]  # 1 2 came when its node was there
    df = spark.createDataFrame([(1, [1, 2, 3, 1, 2, 4])], "k int, t array<int>")
    assert sequences.phrase_bonus_join(df, "k", "t", table, 1.0, order="o").first().bonus == 4
    assert sequences.phrase_bonus_join(df, "k", "t", table, 1.0).first().bonus == 8
    with pytest.raises(ValueError, match="more than 3"):
        sequences.phrase_list(table, most=3)
    assert sequences.phrase_list(table) == phrases


def test_a_hundred_thousand_phrases(spark):
    phrases = spark.range(100_000).select(F.array((F.col("id") % 1000).cast("int"), (F.col("id") / 1000).cast("int")).alias("phrase"))
    df = spark.range(200).select("id", F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.pmod(F.xxhash64("id", i), F.lit(1000)).cast("int")).alias("t"))
    rows = df.collect()
    got = {r.id: r.bonus for r in sequences.phrase_bonus_join(df, "id", "t", phrases, 1.0).collect()}
    assert got == {r.id: 2.0 * sum(b < 100 for b in r.t[1:]) for r in rows} and sum(got.values()) > 100


def test_readable_text_of_many_tokens(spark):
    from uttframe.functions import text as T

    many = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(30_000)), lambda i: F.when(i % 5 == 0, "th@@").when(i % 7 == 0, "中").otherwise("word")).alias("t"))
    began = time.time()
    out = many.select(T.beautify(F.col("t")).alias("x")).first().x
    assert time.time() - began < 20 and out.startswith("thword word word word thword中word word thword ") and out.count("中") == sum(i % 7 == 0 and i % 5 != 0 for i in range(30_001))


def test_ngrams_are_counted_in_their_text_and_not_shuffled(spark):
    from collections import Counter

    from uttframe.operators import language

    texts = ["", None, "a", "Ab\t ab  AB", "\U0001f600\U0001f600\U0001f600x\U0001f600\U0001f600\U0001f600", "der hund und die katze"]
    df = spark.createDataFrame([(i, t, "ab"[i % 2]) for i, t in enumerate(texts)], "k int, t string, lang string")
    for n in (3, 4):
        rows = df.select("k", language.ngram_counts(F.col("t"), n).alias("x")).collect()
        plain = lambda t: f" {' '.join(t.lower().split())} "
        assert {r.k: {x.ngram: x.c for x in r.x or []} for r in rows} == {i: dict(Counter(plain(t)[j : j + n] for j in range(len(plain(t)) - n + 1))) if t else {} for i, t in enumerate(texts)}
    out = language.detect(df, language.train(df, "t", "lang"), "k", "t")
    assert "hashpartitioning(ngram" not in out._jdf.queryExecution().executedPlan().toString() and out.filter("k >= 3").count() == 3




def test_a_phrase_does_not_match_a_longer_window_with_nulls(spark):
    """Tokens are hashed one by one, so a null is a token of its own and not left out of a window."""
    df = spark.createDataFrame([("k", [None, "x", "p", "q"]), ("n", None), ("e", [])], "key string, w array<string>")
    phrases = spark.createDataFrame([(["x"],), (["p", "q"],), (["x"],), ([],), (["q", "p"],)], "phrase array<string>")
    found = sequences.phrase_matches(df, "key", "w", phrases).collect()
    assert sorted((r.key, r.place, r.n_tokens, r.phrase) for r in found) == [("k", 1, 1, ["x"]), ("k", 2, 2, ["p", "q"])]
    assert sequences.phrase_matches(df, "key", "w", phrases.filter("size(phrase) = 0")).count() == 0
