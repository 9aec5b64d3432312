"""Randomised and sequential operators against plain versions of their rules."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from uttframe.functions.rand import below
from uttframe.operators import batching, bias, features, language, sequences, speakers


def collapsed(path, blank=0):
    return [x for i, x in enumerate(path) if x != blank and (i == 0 or path[i - 1] != x)]


def test_forced_paths_are_the_best_of_all():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n, labels = int(rng.integers(2, 6)), rng.integers(1, 3, int(rng.integers(1, 3)))
        if len(labels) + np.count_nonzero(labels[1:] == labels[:-1]) > n:
            continue
        logp = np.log(rng.dirichlet(np.ones(3), n))
        got = sequences.forced_path(logp, labels)
        every = [p for p in product(range(3), repeat=n) if collapsed(p) == labels.tolist()]
        score = lambda p: sum(logp[t, x] for t, x in enumerate(p))
        assert collapsed(got.tolist()) == labels.tolist() and np.isclose(score(got), max(map(score, every)))


def test_phrases_and_distractors(spark):
    rng = random.Random(2)
    vocab = [a + b for a in "bdfg" for b in ("al", "el", "il", "ol")]
    texts = [" ".join(rng.choice(vocab) for _ in range(20)) + f" rare{'abcdefghij'[i]}" + " tail 42" * (i % 2) for i in range(10)] + ["alone", "", None]
    df = spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(texts)], "key string, txt string")
    counts = Counter(w for t in texts if t for w in t.split())
    rare = {w for w, n in counts.items() if n <= 3 and w.isalpha()}
    table = bias.rare_words(bias.word_counts(df, "txt"), 3)
    assert {r.word for r in table.collect()} == rare
    rows = {r.key: r for r in bias.bias_phrases(df, table, n_order=3).collect()}
    assert set(rows) == {f"k{i}" for i, t in enumerate(texts) if t and set(t.split()) & rare}
    for i, t in enumerate(texts):
        if f"k{i}" not in rows:
            continue
        words, r = t.split(), rows[f"k{i}"]
        at = [j for j, w in enumerate(words) if w in rare]
        assert len(r.phrases) == len(r.distractors) == len(at)
        for j, phrase, other in zip(at, r.phrases, r.distractors, strict=True):
            n = len(phrase.split())
            assert 1 <= n <= 3 and phrase.split() == words[j - n + 1 : j + 1]
            found = other.split()
            assert words[j] not in found and len(found) <= n and all(w in words or w in rare for w in found)
    assert all(not r.phrases and not r.distractors for r in bias.bias_phrases(df, table, p_keep=0.0).collect())
    again = {r.key: r for r in bias.bias_phrases(df.repartition(5), table).collect()}
    assert again == {r.key: r for r in bias.bias_phrases(df, table).collect()}


def test_phrases_without_the_places_of_common_words(spark):
    """The list of common words has the most frequent ones, never a rare one, and leaves the result as it is."""
    texts = ["a b a c rare a b", "a b c c a other a b", "a rare b d d d d", "", None]
    df = spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(texts)], "key string, txt string")
    counts = bias.word_counts(df, "txt")
    rare = bias.rare_words(counts, 2)
    assert [r.word for r in bias.common_words(counts, 2, 2).orderBy("word").collect()] == ["a", "b"] and {r.word for r in bias.common_words(counts, 2).collect()} == {"a", "b", "c", "d"}
    want = {r.key: r for r in bias.bias_phrases(df, rare).collect()}
    assert set(want) == {"k0", "k1", "k2"}
    for most in (0, 2, 50):
        assert {r.key: r for r in bias.bias_phrases(df, rare, common=bias.common_words(counts, 2, most)).collect()} == want


def test_each_rare_word_may_be_the_other_one(spark):
    """Of 6,000 rare words each is drawn about as often as any other, and never by its own places."""
    words = ["".join(p) for p in product("abcdefghijklmnopqr", repeat=3)] + [f"zz{a}{b}{c}" for a, b, c in product("abcdefgh", "abcde", "abcde")][:168]
    texts = [" ".join(words[(i * 20 + j * 7) % 6000] for j in range(20)) for i in range(1500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "key int, txt string")
    rare = spark.createDataFrame([(w,) for w in [*words, *words[:50], None]], "word string")
    rows = bias.bias_phrases(df, rare, n_order=1).collect()
    assert {r.key: r.phrases for r in rows} == {i: t.split() for i, t in enumerate(texts)}
    pairs = [(p, d) for r in rows for p, d in zip(r.phrases, r.distractors, strict=True)]
    drawn = Counter(d for _, d in pairs)
    assert len(pairs) == 30_000 and all(p != d for p, d in pairs) and set(drawn) <= set(words)
    assert len(drawn) > 5_900 and max(drawn.values()) < 25  # 5,960 and 16 are to be expected of 30,000 even draws
    lists = bias.bias_list(spark.createDataFrame(rows).withColumn("batch", F.lit(0)), "batch", ratio=1.0).first()
    assert Counter(lists.words) == Counter(x for pair in pairs for x in pair)


def test_few_rare_words_and_first_places(spark):
    """Each distractor has another rare word while there is one, and words of the utterance for rare words at its start too."""
    df = spark.createDataFrame([(i, f"{'abc'[i % 3] * 3} u v w x y z") for i in range(60)] + [(60, "aaa"), (61, "bbb u")], "key int, txt string")
    rows = bias.bias_phrases(df, spark.createDataFrame([("aaa",), ("bbb",), ("ccc",)], "word string")).collect()
    assert len(rows) == 62 and all(len(r.phrases) == len(r.distractors) == 1 for r in rows)
    for r in rows:
        others = {"aaa", "bbb", "ccc"} - set(r.phrases)
        assert len(others) == 2 and len(others & set(r.distractors[0].split())) == 1
    assert {(r.phrases[0], w) for r in rows for w in r.distractors[0].split() if len(w) == 3} == {(a * 3, b * 3) for a in "abc" for b in "abc" if a != b}
    assert {len(r.distractors[0].split()) for r in rows if r.key < 60} == {1, 2, 3}
    assert max(len(r.distractors[0].split()) for r in rows if r.key >= 60) <= 2
    alone = bias.bias_phrases(df, spark.createDataFrame([("aaa",)], "word string"), n_order=1).collect()
    assert len(alone) == 21 and all((r.phrases, r.distractors) == (["aaa"], [""]) for r in alone)
    assert not bias.bias_phrases(df, spark.createDataFrame([], "word string")).collect()


def test_lists_of_a_batch(spark):
    rows = [(0, ["a b", "c"], ["x", "y z"]), (0, ["d"], [f"q{i}" for i in range(8)]), (1, [], []), (1, ["e"], ["w"])]
    df = spark.createDataFrame(rows, "batch int, phrases array<string>, distractors array<string>")
    for epoch, most in ((0, 9), (2, 9), (9, 9)):
        for r in bias.bias_list(df, "batch", epoch=epoch, max_epoch=most).collect():
            phrases = {p for b, ps, _ in rows if b == r.batch for p in ps}
            others = {d for b, _, ds in rows if b == r.batch for d in ds}
            whole = len(phrases) + round(0.2 * len(others))
            assert len(r.words) == len(set(r.words)) == min(whole, -(-whole * (epoch + 1) // (most + 1)))
            assert set(r.words) <= phrases | others
            if epoch == most:
                assert phrases <= set(r.words)


def test_masks_by_their_own_draws(spark):
    frames = spark.createDataFrame([(k, t, [float(10 * t + b + 1) for b in range(8)]) for k in range(6) for t in range(12)], "key int, frame_idx int, feat array<float>")
    draw = lambda n, op: below(n, "key", op=op, seed=5)
    cols = [draw(12, f"time_start{i}").alias(f"t{i}") for i in range(2)] + [draw(4, f"time_length{i}").alias(f"tl{i}") for i in range(2)]
    cols += [draw(8, f"bin_start{i}").alias(f"b{i}") for i in range(2)] + [draw(3, f"bin_length{i}").alias(f"bl{i}") for i in range(2)]
    drawn = {r.key: r for r in frames.select("key", *cols).distinct().collect()}
    out = features.mask_features(frames, F.lit(12), longest=4, widest=3, seed=5).collect()
    assert len(out) == 72
    for r in out:
        d = drawn[r.key]
        dark = any(d[f"t{i}"] <= r.frame_idx < d[f"t{i}"] + 1 + d[f"tl{i}"] for i in range(2))
        for b, x in enumerate(r.feat):
            gone = dark or any(d[f"b{i}"] <= b < d[f"b{i}"] + 1 + d[f"bl{i}"] for i in range(2))
            assert x == (0.0 if gone else 10.0 * r.frame_idx + b + 1)
    assert any(0.0 in r.feat for r in out) and not all(set(r.feat) == {0.0} for r in out)
    for r in features.substitute_earlier(frames, F.lit(12), longest=4, seed=5).collect():  # each frame is itself or an earlier one
        place = (r.feat[0] - 1) / 10
        assert place == int(place) and 0 <= place <= r.frame_idx
    left = Counter(r.key for r in features.trim_tail(frames, F.lit(12), longest=9, seed=5).collect())
    cut = {r.key: 1 + r.c for r in frames.select("key", draw(9, "trim").alias("c")).distinct().collect()}
    assert left == {k: 12 - (c if c < 6 else 0) for k, c in cut.items()}


def test_quota_batches_row_by_row(spark):
    rng = random.Random(3)
    rows = [(s, i, rng.randrange(10, 60), rng.choice(["j1", "j2", "j3", None]), " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 5)))) for s in "xy" for i in range(60)]
    df = spark.createDataFrame(rows, "shard string, id int, n int, job string, txt string")
    got = {(r.shard, r.id): r.batch_id for r in batching.distribute_batch(df, "shard", ["id"], "id", "n", "job", "txt", max_frames=150, max_words_per_epoch=12, max_words_per_batch=3).collect()}
    for s in "xy":
        batch, held, jobs, here, epoch = 0, [], set(), Counter(), Counter()
        for _, i, n, job, txt in [r for r in rows if r[0] == s]:
            words = txt.split(" ")
            if job in jobs or all(epoch[w] >= 12 for w in words) or all(here[w] >= 3 for w in words):
                assert got[s, i] is None
                continue
            if held and max([*held, n]) * (len(held) + 1) > 150:
                batch, held, jobs, here = batch + 1, [], set(), Counter()
            held.append(n)
            jobs.add(job)
            here.update(words)
            epoch.update(words)
            assert got[s, i] == batch


def test_languages_of_held_out_texts(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = language.train(df.filter("doc_id % 2 = 0"), "text", "lang")
    rows = language.detect(df.filter("doc_id % 2 = 1"), model, "doc_id", "text").join(df, "doc_id").collect()
    right = sum(r.language == r.lang for r in rows)
    assert right >= 0.9 * len(rows)


def test_speakers_against_every_segment(spark):
    rng = random.Random(4)
    words = [(f, i, round(rng.uniform(0, 90), 2), rng.choice([0.0, 0.3, 2.0])) for f in "ab" for i in range(60)]
    segments = [(f, a, a + rng.uniform(0.5, 25), rng.choice("xyz")) for f in "ab" for a in (round(rng.uniform(0, 80), 2) for _ in range(12))]
    w = spark.createDataFrame(words, "file string, word_id int, start double, dur double")
    s = spark.createDataFrame(segments, "file string, start double, end double, label string")
    got = {(r.file, r.word_id): r.speaker for r in speakers.assign_speakers(w, s).collect()}
    for f, i, start, dur in words:
        by, first = defaultdict(float), {}
        for g, a, b, label in segments:
            if g == f and a < start + dur and start < b:
                by[label] += min(b, start + dur) - max(a, start)
                first[label] = min(a, first.get(label, a))
        if dur and by:
            want = min(by, key=lambda x: (-by[x], first[x], x))
        else:
            want = min((max(a - start - dur, start - b, 0.0), a, label) for g, a, b, label in segments if g == f)[2]
        assert got[f, i] == want or by and abs(by[got[f, i]] - by[want]) < 1e-9
    total = {(r.file, r.label): r.seconds for r in speakers.overlap_seconds(w, s).collect()}
    want = defaultdict(float)
    for f, _, start, dur in words:
        for g, a, b, label in segments:
            if g == f and a < start + dur and start < b:
                want[f, label] += min(b, start + dur) - max(a, start)
    assert set(total) == set(want) and all(abs(total[k] - want[k]) < 1e-6 for k in want)
