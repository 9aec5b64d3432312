"""Known values of features, long alignments, mixed-script text, configured pipelines and stage folders."""

from __future__ import annotations

import math
import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from uttframe.functions import stage
from uttframe.functions import text as T
from uttframe.operators import features, scoring
from uttframe.plans import pipeline
from uttframe.sources import ark


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_mixed_script_text(spark):
    at = lambda *tokens: value(spark, T.beautify(F.array(*map(F.lit, tokens))))
    assert at("hello", "3") == "hello3" and at("hello", "@", "you") == "hello@you" and at("你 ", "3") == "你3"
    assert at("don't", "he@@", "llo") == "don't hello" and at("a", "-", "b") == "a -b" and at("你", "a@@", "好", "b") == "你好ab"


def plain_power(frame: np.ndarray, n_fft: int) -> list[float]:
    """Power of each bin by the sum itself."""
    out = []
    for k in range(n_fft // 2 + 1):
        re = sum(x * math.cos(2 * math.pi * k * i / n_fft) for i, x in enumerate(frame))
        im = sum(x * math.sin(2 * math.pi * k * i / n_fft) for i, x in enumerate(frame))
        out.append(re * re + im * im)
    return out


def plain_mel(power: list[float], n_mels: int, n_fft: int, rate: int, low: float) -> list[float]:
    mel = lambda f: 1127 * math.log(1 + f / 700)
    edges = [mel(low) + (mel(rate / 2) - mel(low)) * i / (n_mels + 1) for i in range(n_mels + 2)]
    out = []
    for a, b, c in zip(edges, edges[1:], edges[2:], strict=False):
        weights = [max(0.0, min((mel(k * rate / n_fft) - a) / (b - a), (c - mel(k * rate / n_fft)) / (c - b))) for k in range(n_fft // 2 + 1)]
        out.append(sum(w * p for w, p in zip(weights, power, strict=True)))
    return out


def test_filter_bank_and_cepstra_by_plain_sums():
    rng = np.random.default_rng(1)
    x = np.sin(np.arange(320) * 0.3) * 0.4 + rng.normal(size=320) * 0.05
    got, rate = features.filter_bank(x, 8000), 8000
    assert got.shape == (2, 23)
    for t in range(2):
        frame = x[80 * t : 80 * t + 200] * 32768
        frame = frame - frame.mean()
        frame = np.array([frame[i] - 0.97 * frame[max(i - 1, 0)] for i in range(200)])
        frame *= np.array([(0.5 - 0.5 * math.cos(2 * math.pi * i / 199)) ** 0.85 for i in range(200)])
        want = np.log(plain_mel(plain_power(frame, 256), 23, 256, rate, 20.0))
        assert got[t] == pytest.approx(want, rel=1e-6)
    ceps, banks = features.mfcc(x, rate, n_mels=23, n_ceps=13), got
    for k in range(13):
        scale = math.sqrt((1 if k == 0 else 2) / 23) * (1 + 11 * math.sin(math.pi * k / 22))
        assert ceps[0, k] == pytest.approx(scale * sum(banks[0, i] * math.cos(math.pi * k * (i + 0.5) / 23) for i in range(23)), rel=1e-6, abs=1e-9)


def test_log_mel_of_a_tone():
    rate, tone = 16000, 1000
    x = np.sin(2 * np.pi * tone * np.arange(1600) / rate)
    got = features.log_mel_spectrogram(x)
    assert got.shape == (10, 80) and got.max() - got.min() <= 2 + 1e-9  # eight decades over four
    bank = features.mel_bank(80, 400, rate)
    assert got[5].argmax() == bank[:, 25].argmax()  # bin 25 is 1 kHz
    frame = np.pad(x, 200, mode="reflect")[800:1200] * np.array([0.5 - 0.5 * math.cos(2 * math.pi * i / 400) for i in range(400)])
    loudest = math.log10(bank[got[5].argmax()] @ np.array(plain_power(frame, 400)))
    assert got[5].max() == pytest.approx((loudest + 4) / 4, rel=1e-6)


def test_impulse_and_resampling():
    impulse = np.zeros(16000 * 2)
    impulse[int(16000 * 1.01) + 3] = 5.0
    x = np.arange(50, dtype=float)
    assert features.convolve_impulse(x, impulse).tolist() == pytest.approx([0, 0, 0, *x[:-3]])
    slow = features.resample(np.sin(np.arange(800) * 0.05), 8000, 16000)
    assert slow[200:1400] == pytest.approx(np.sin(np.arange(200, 1400) * 0.025), abs=2e-3)


def plain_counts(ref, hyp):
    best = [[0] * (len(hyp) + 1) for _ in range(len(ref) + 1)]
    for i in range(len(ref) + 1):
        for j in range(len(hyp) + 1):
            options = [best[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1])] if i and j else []
            options += [best[i - 1][j] + 1] if i else []
            options += [best[i][j - 1] + 1] if j else []
            best[i][j] = min(options, default=0)
    i, j, n = len(ref), len(hyp), [0, 0, 0, 0]
    while i or j:
        if i and j and best[i][j] == best[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1]):
            n[0 if ref[i - 1] == hyp[j - 1] else 1] += 1
            i, j = i - 1, j - 1
        elif i and best[i][j] == best[i - 1][j] + 1:
            n[2] += 1
            i -= 1
        else:
            n[3] += 1
            j -= 1
    return tuple(n)


def test_alignment_against_a_full_table():
    rng = random.Random(2)
    for _ in range(60):
        ref = [rng.choice("abcd") for _ in range(rng.randrange(0, 40))]
        hyp = [w for w in ref if rng.random() < 0.8] + [rng.choice("abcd") for _ in range(rng.randrange(0, 5))]
        assert scoring.edit_counts(ref, hyp) == plain_counts(ref, hyp)
    long = [str(i % 97) for i in range(6000)]
    assert scoring.edit_counts(long, long[:3000] + ["x"] + long[3000:]) == (6000, 0, 0, 1)


def test_binary_pairs():
    posterior, times = [[(3, 0.5), (9, 0.25)], [], [(1, 1.0)]], [(0.0, 0.5), (0.5, 1.25)]
    data = b"a " + ark.encode_pairs("posterior", posterior) + b"b " + ark.encode_pairs("posterior", [])
    assert [(r["key"], r["posterior"]) for r in ark.records(data, "posterior")] == [("a", posterior), ("b", [])]
    data = b"k " + ark.encode_pairs("times", times)
    assert data[2:9] == b"\0B\4" + (2).to_bytes(4, "little") and [r["times"] for r in ark.records(data, "times")] == [times]


def test_a_pipeline_makes_tokens_once_and_orders_places_alone(spark, monkeypatch):
    """Rows that share a key and texts of any kind count as before; no step but the first sees a text."""
    texts = ["ab c", " x\ty ", "", None, "\U0001F600 é", "a" * 9]
    made = [("s" if i % 3 else None, i, f"k{i // 2 if i < 4 else i}", texts[i % 6], 30 + i) for i in range(24)]
    rows = spark.createDataFrame(made, "shard string, pos int, key string, txt string, n_frames int")
    conf = {"tokenize_conf": {"vocab": {"<unk>": 1, T.SPACE: 2, "a": 3}}, "filter_conf": {"min_length": 0}, "sort_conf": {"buffer": 5}, "batch_conf": {"max_frames": 100}}
    staged = []
    monkeypatch.setattr(pipeline, "materialise", lambda df, name: (staged.append((name, df.columns)), stage.materialise(df, name))[1])
    built = pipeline.build_pipeline(conf)(rows)
    assert [name for name, _ in staged] == ["pipeline-rows", "pipeline-ranks"] and not {"txt", "tokens", "label"} & set(staged[1][1])
    # The same stages one by one.
    tokens = rows.withColumn("tokens", T.char_tokens(F.col("txt"))).withColumn("label", pipeline.vocab.encode(F.col("tokens"), conf["tokenize_conf"]["vocab"]))
    kept = pipeline.filters.task(pipeline.filters.length_filter(tokens, F.col("n_frames"), F.size("label"), pipeline.filters.Bounds(min_length=0)))
    ranked = pipeline.ranking.sorted_blocks(kept.withColumn("_o", F.xxhash64("key", F.lit(0), F.lit(0))), ["shard"], ["_o", "key"], "n_frames", 5).drop("_o")
    cut = pipeline.batching.dynamic_batch(ranked, "shard", ["block", "rank"], "key", "n_frames", 100)
    want = ranked.join(cut.filter("batch_id IS NOT NULL"), ["shard", "key"])
    assert built.columns == want.columns and sorted(map(repr, built.collect())) == sorted(map(repr, want.collect())) and want.count() > 8


def test_presets_and_quotas(spark):
    conf = {"batch_conf": {"batch_type": "distribute", "max_frames": 100, "job": "lang"}, "tokenize_conf": {"vocab": {"<unk>": 1}}, "filter_conf": {"max_length": 1e9, "min_length": 0}, "shuffle": False}
    rows = spark.createDataFrame([("s", i, f"k{i}", f"text {i}", 30, "ab"[i % 2], f"p{i % 2}") for i in range(6)], "shard string, pos int, key string, txt string, n_frames int, lang string, speaker string")
    table = spark.createDataFrame([("p0", 7)], "speaker string, id int")
    more = {"speakers": True, "speakers_conf": {"table": table}, "category": True, "category_conf": {"column": "lang", "ids": {"a": 0, "b": 1}, "n": 2}, "bias": True, "bias_conf": {"threshold": 20}}
    out = pipeline.build_pipeline(conf | more)(rows).orderBy("key").collect()
    assert len(out) == 2 and {r.lang for r in out} == {"a", "b"}  # one of each job fits the one batch
    assert {r.speaker: r.speaker_id for r in out} == {"p0": 7, "p1": 0} and [r.category for r in out] == [[1.0, 0.0], [0.0, 1.0]] and all(r.phrases for r in out)
    assert pipeline.preset(conf, "cv")["batch_conf"]["batch_type"] == "dynamic"
    echo = pipeline.preset({"impulse_conf": {"bank": table, "n": 1}, "speed": True}, "echo")
    assert echo["impulse"] and echo["impulse_conf"]["p"] == 1.0 and echo["impulse_conf"]["n"] == 1 and not echo["speed"] and not echo["mask"]
    assert len(pipeline.build_pipeline(pipeline.preset(conf, "cv"))(rows).collect()) == 6


def test_stage_folder():
    session = lambda master, folder: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: folder), sparkContext=SimpleNamespace(master=master))
    assert stage.shared_dir(session("spark://host:7077", "hdfs://x/shared/")) == "hdfs://x/shared"
    assert stage.shared_dir(session("local[4]", None)) == stage.shared_dir(session("local", None)) != ""
    for master in ("spark://host:7077", "local-cluster[3,2,1024]", "yarn"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            stage.shared_dir(session(master, None))


def test_words_of_turns_in_as_many_tasks_as_their_bytes_ask_for(spark, tmp_path, monkeypatch):
    from uttframe.plans import base, speech

    rows = [(c, turn, "ab"[turn % 2], None if turn == 3 else f"w{c} x " * (turn + 1)) for c in range(30) for turn in range(5)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(1).write.parquet(str(tmp_path / "conversations.parquet"))
    t = base.Tables(spark, str(tmp_path))
    size = sum(len(r[3] or "") for r in rows)
    monkeypatch.setattr(speech, "SHARE", size // 20)
    words = speech._words(t)
    assert words.rdd.getNumPartitions() in (20, 21)
    want = sorted((c, i, w) for c in range(30) for i, w in enumerate(x for r in rows if r[0] == c for x in (r[3] or "").split()))
    assert sorted((r.file, r.word_id, r.word) for r in words.collect()) == want
    timed = speech.alignment.tokens_to_words(speech._tokens(t), ["file"], 40)
    assert timed.rdd.getNumPartitions() in (20, 21) and sorted((r.file, r.word) for r in timed.collect()) == sorted((c, w) for c, _, w in want)
