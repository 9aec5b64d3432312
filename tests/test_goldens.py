"""Literal examples, edge cases and properties of the speech operators."""

from __future__ import annotations

import io
import random
import struct
import tarfile
import wave
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from uttframe.functions import numeric as N
from uttframe.functions import rand
from uttframe.functions import text as T
from uttframe.operators import alignment, batching, bias, features, filters, language, ranking, scoring, sequences, speakers, vocab
from uttframe.plans.pipeline import DEFAULTS, build_pipeline, override, preset
from uttframe.sources import archives, ark, sinks
from uttframe.sources import text as S


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# scoring


def test_error_rate_summary(spark):
    counts = spark.createDataFrame([(6443, 8405, 14324, 29172, 374486)], "insertions long, deletions long, substitutions long, num_errors long, num_ref long")
    rates = scoring.word_error_rate(counts)
    assert [r.value for r in scoring.summary(rates).collect()] == ["WER:\t29172/374486 = 7.79%", "INS:\t6443/374486 = 1.72%", "DEL:\t8405/374486 = 2.24%", "SUB:\t14324/374486 = 3.82%"]
    with pytest.raises(Exception, match="no reference words"):
        scoring.word_error_rate(counts.limit(0).union(spark.createDataFrame([(0, 0, 0, 0, 0)], counts.schema))).collect()


def test_edit_counts_agree_with_distance(spark):
    rng = random.Random(1)
    pairs = [([rng.choice("abcd") for _ in range(rng.randrange(9))], [rng.choice("abcd") for _ in range(rng.randrange(9))]) for _ in range(60)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "k int, ref array<string>, hyp array<string>").cache()
    out = {r.k: r for r in scoring.align(rows, "k", "ref", "hyp").collect()}
    for r in rows.select("k", scoring.distance(F.col("ref"), F.col("hyp")).alias("d")).collect():
        x = out[r.k]
        assert x.num_errors == r.d and x.num_ref == len(pairs[r.k][0]) and x.correct + x.substitutions + x.insertions == len(pairs[r.k][1])
    assert scoring.edit_counts(["color"], ["colour"], {"colour": "color"}) == (1, 0, 0, 0)


def test_pairs_report_missing_references(spark):
    hyps = spark.createDataFrame([("a/x.ctm",), ("b/x.ctm",)], "path string")
    out = {r.hyp: r for r in scoring.pair(hyps, spark.createDataFrame([("a/x.nlp",)], "path string"), spark.createDataFrame([("a/x.norm.json",)], "path string")).collect()}
    assert out["a/x.ctm"].ref == "a/x.nlp" and out["a/x.ctm"].norm == "a/x.norm.json" and out["a/x.ctm"].log == "a/x.log.json" and not out["b/x.ctm"].has_ref


# speakers


def test_speakers_against_all_pairs(spark):
    rng = random.Random(2)
    words = [(f, i, float(rng.randrange(900)), float(rng.choice([0, 3, 5, 20]))) for f in ("a", "b", "c") for i in range(60)]
    segments = [(f, s := float(rng.randrange(900)), s + rng.randrange(1, 60), rng.choice("xyz")) for f in ("a", "b") for _ in range(12)]
    got = {(r.file, r.word_id): r.speaker for r in speakers.assign_speakers(spark.createDataFrame(words, "file string, word_id int, start double, dur double"), spark.createDataFrame(segments, "file string, start double, end double, label string")).collect()}
    for f, i, start, dur in words:
        own, end = [s for s in segments if s[0] == f], start + dur
        hits = [s for s in own if s[1] < end and start < s[2]]
        if not own:
            want = ""
        elif hits:
            total = {}
            for _, s, e, x in hits:
                o, first = total.get(x, (0, s))
                total[x] = (o + min(e, end) - max(s, start), min(first, s))
            want = min(total, key=lambda x: (-total[x][0], total[x][1], x))
        else:
            want = min(own, key=lambda s: (max(s[1] - end, start - s[2], 0), s[1], s[3]))[3]
        assert got[f, i] == want


# alignment


def loop_offset(words, adj):
    out, last = [], 0
    for s, e in words:
        by = min(adj, s - last)
        out.append((s - by, e - by))
        last = e - by
    return out


def test_offset_closed_form(spark):
    rng = random.Random(3)
    rows = []
    for k in range(30):
        t = 0
        for _ in range(20):
            s = t + rng.choice([0, 0, 10, 50, 100, 400])
            t = s + rng.randrange(10, 300)
            rows.append((k, s, t))
    got = alignment.offset_words(spark.createDataFrame(rows, "k int, start_ms long, end_ms long"), ["k"])
    for k in range(30):
        assert sorted((r.start_ms, r.end_ms) for r in got.filter(f"k = {k}").collect()) == loop_offset([r[1:] for r in rows if r[0] == k], 230)
    assert alignment.offset_words(spark.createDataFrame(rows, "k int, start_ms long, end_ms long"), ["k"], adjustment=0).exceptAll(spark.createDataFrame(rows, "k int, start_ms long, end_ms long")).count() == 0


def test_collapse_and_peaks(spark):
    assert value(spark, alignment.collapse_array(F.array(*map(F.lit, [0, 1, 1, 0, 1, 2, 2, 0])))) == [1, 1, 2]
    frames = spark.createDataFrame([("u", i, t) for i, t in enumerate([0, 1, 1, 0, 1, 2, 2, 0])], "k string, frame_idx int, token int")
    assert [(r.peak, r.token) for r in alignment.peak_times(frames, ["k"]).orderBy("peak").collect()] == [(1, 1), (4, 1), (5, 2)]
    assert [r.token for r in alignment.repeats_to_blank(frames, ["k"]).orderBy("frame_idx").collect()] == [0, 1, 0, 0, 1, 2, 0, 0]
    one = alignment.intervals_from_fires(spark.createDataFrame([("u", 4, 30)], "k string, peak int, n int"), ["k"], "n").collect()
    assert [(r.start, r.end) for r in one] == [(0.07, 0.6)]


def test_tokens_to_words(spark):
    s = T.SPACE
    tokens = [(f"{s}he", 5, 10, 0.5), ("llo", 6, 12, 0.9), ("<sw>", 9, 20, 0.7), (f"{s}you", 7, 40, 0.2), (s, 8, 60, 0.1)]
    rows = spark.createDataFrame([("u", i, *t) for i, t in enumerate(tokens)], "k string, idx int, token string, unit int, time int, confidence double")
    got = [(r.word, r.unit_id, r.start_ms, r.end_ms, r.confidence, r.unit_ids) for r in alignment.tokens_to_words(rows, ["k"], 10, shift_ms=1000).orderBy("first_idx").collect()]
    assert got == [("hello", -1, 1000, 1160, 0.9, [5, 6]), ("<sw>", 9, 1160, 1200, 0.7, [9]), ("you", -1, 1300, 1400, 0.2, [7])]


def test_chunks_and_masks(spark):
    frames = spark.createDataFrame([("u", i, i) for i in range(4)], "k string, frame_idx int, v int")
    seen = alignment.left_context(frames, ["k"], F.col("v"), 2, 0).orderBy("frame_idx").collect()
    assert [(r.first_frame, r.n_visible) for r in seen] == [(0, 2), (0, 2), (2, 2), (2, 2)]
    assert alignment.chunked(frames, ["k"], "v", -1, 3).orderBy("chunk_idx").collect()[1]["values"] == [3, -1, -1]
    assert [value(spark, batching.pad_mask(F.lit(n), F.lit(5))) for n in (5, 3, 2)] == [[False] * 5, [False] * 3 + [True] * 2, [False] * 2 + [True] * 3]
    assert [value(spark, batching.pad(F.array(*[F.lit(1)] * n), F.lit(4), 0)) for n in (4, 2, 1)] == [[1] * 4, [1, 1, 0, 0], [1, 0, 0, 0]]


# text


def test_text_functions(spark):
    at = lambda c: value(spark, c)
    assert at(T.split_cjk(F.lit("你好 it's 世 me"))) == ["你", "好", "it's", "世", "me"]
    assert at(T.char_tokens(F.lit(" a b<sw>c "), symbols=True)) == ["A", T.SPACE, "B", "<SW>", "C"]
    assert at(T.detokenize(F.array(F.lit(f"{T.SPACE}he"), F.lit("y"), F.lit(f"{T.SPACE}you")))) == "hey you"
    assert at(T.beautify(F.array(*map(F.lit, ["<sos>", "你", "好", "<eos>"])))) == "你好"
    assert at(T.beautify(F.array(*map(F.lit, ["he@@", "llo", "you"])))) == "hello you"
    assert at(T.beautify(F.array(*map(F.lit, ["你", "he@@", "llo", "好"])))) == "你hello好"
    assert at(T.clean_for_subword(F.lit("a <sw> b <unk>"))) == "a b <unknown>"
    assert at(T.job_id(F.lit("TC0000000P-00.aligned.nlp.wav-A-000"))) == "TC0000000P-00.aligned" and at(T.job_id(F.lit("a.b"))) is None
    assert at(T.speaker_of(F.lit("x-A-000"))) == "x-A"
    assert at(vocab.encode(F.array(*map(F.lit, ["a", "z", "b"])), {"a": 1, "b": 2})) == [1, 2]
    assert at(vocab.segment(F.lit("ab 你cd"), {"ab": "a@@ b"})) == ["a@@", "b", "你", "cd"]
    with pytest.raises(Exception, match="no token of id"):
        at(vocab.decode(F.array(F.lit(9)), {"a": 1}))


def test_numeric_functions(spark):
    at = lambda c: value(spark, c)
    ints = lambda *x: F.array(*map(F.lit, x))
    assert at(N.insert_blanks(ints(3, 4))) == [0, 3, 0, 4, 0]
    assert at(N.log_sum(F.array(F.lit(float("-inf"))))) == float("-inf") and at(N.log_sum(F.array(F.lit(0.0), F.lit(0.0)))) == pytest.approx(np.log(2))
    assert at(N.half_even(F.lit(0.125))) == "0.12" and at(N.half_even(F.lit(1.005), 3)) == "1.005"
    assert at(N.length_penalty(F.lit(7), "wu", 1.0)) == 2 and at(N.coverage_penalty(F.array(F.lit(0.5), F.lit(2.0)), "summary", 2.0)) == 2
    assert at(N.distort(F.array(F.lit(0.5), F.lit(-2.0)), N.gain(20), F.lit(1), rate=1)) == [0.997, pytest.approx(-20)]
    assert at(N.distort(F.array(F.lit(-0.5), F.lit(0.0), F.lit(0.01)), N.fence(), F.lit(1), rate=1)) == [1.0, 0.0, 1.0]
    assert abs(at(N.mu_law(F.lit(0.3))) - 0.3) < 0.01 and at(N.mu_law(F.lit(1.0))) == pytest.approx(1)
    assert [at(x) for x in N.framed(ints(1, 2), 8, 9)] == [[8, 1, 2], [1, 2, 9], [8, 2, 1], [2, 1, 9]]


# filters


def test_length_bounds_are_inclusive(spark):
    rows = [(10.0, 1), (9.9, 1), (10240.0, 1), (10241.0, 1), (100.0, 0), (100.0, 201), (100.0, None), (100000.0, 1), (100.0, 101)]
    got = [r.x for r in spark.createDataFrame(rows, "f double, n int").select(filters.length_reason(F.col("f"), F.col("n"), filters.Bounds(max_length=10240)).alias("x")).collect()]
    assert got == [None, "minlen", "min_ratio", "maxlen", "lbl_minlen", "lbl_maxlen", None, "maxlen", "max_ratio"]


def test_special_tokens(spark):
    conf = filters.SpecialTokens(("<bad>",), ("<rm>",), (("a", "b"),), True)
    at = lambda s: value(spark, filters.clean_special(F.lit(s), conf))
    assert at(" a x- <rm> c") == "b x c" and at("a <bad>") is None and at("<rm>") is None


def test_categories(spark):
    assert value(spark, filters.category_vector(F.lit("a c"), {"a": 0, "b": 1, "c": 2}, 3)) == [0.5, 0.0, 0.5]
    with pytest.raises(Exception, match="unknown label"):
        value(spark, filters.category_vector(F.lit("z"), {"a": 0}, 3))
    assert [value(spark, filters.output_frame_ms(F.lit(x))) for x in ("linear", "conv2d8", "other")] == [10, 80, 40]
    assert value(spark, filters.verbatimicity(0.25)) == [0.25, 0.75]


def test_random_operators_ignore_partitioning(spark):
    df = spark.range(500).select(F.format_string("k%d", "id").alias("key"), F.lit("a <sw> b").alias("txt"))
    kept = [sorted(r.key for r in filters.skip_tagged(x, F.col("txt"), F.col("key"), 0.3).collect()) for x in (df.repartition(1), df.repartition(7))]
    assert kept[0] == kept[1] and 300 < len(kept[0]) < 400
    assert 0 <= df.select(F.min(rand.uniform("key", op="x")).alias("m")).first().m < 0.05


# batches


def test_dynamic_batch_keeps_all_rows_within_the_budget(spark):
    rng = random.Random(4)
    rows = [(i % 3, i, rng.randrange(1, 3000)) for i in range(300)]
    df = spark.createDataFrame(rows, "s int, i int, n int")
    out = batching.dynamic_batch(df, "s", ["i"], "i", "n").join(df, ["s", "i"]).groupBy("s", "batch_id").agg(F.max("n").alias("m"), F.count("*").alias("c")).collect()
    assert sum(r.c for r in out) == 300 and all(r.m * r.c <= 12000 or r.c == 1 for r in out)
    assert len(list(batching.budget(iter([(0, 9), (1, 9), (2, 9)]), 10, drop_trigger=True))) < 3


def test_quotas_and_merges():
    rows = [("a", 1, "j", "x y"), ("b", 1, "j", "x"), ("c", 1, None, "x"), ("d", 1, None, "z")]
    assert list(batching.quotas(iter(rows), 100, True, -1, -1)) == [("a", 0), ("b", None), ("c", 0), ("d", None)]
    assert list(batching.quotas(iter(rows), 100, False, 1, -1)) == [("a", 0), ("b", None), ("c", None), ("d", 0)]
    assert [m[1:] for m in batching.merges(iter([(0, "s", 0.5), (1, "s", 4), (2, "t", 5), (3, "t", 4), (4, "t", 30)]), 1, 10, 20, 7)] == [(0, ""), (1, ""), (1, " <sw> "), (1, " "), (2, "")]


def test_merge_utterances(spark):
    rows = [("c", i, f"k-{s}-{i}", t, d) for i, (s, t, d) in enumerate([("a", "one <sw>", 4.0), ("b", "two", 4.0), ("b", "three", 14.0)])]
    out = batching.merge_utterances(spark.createDataFrame(rows, "c string, i int, key string, txt string, seconds double"), "c", ["i"]).orderBy("seconds").collect()
    assert [(r.key, r.n, r.txt) for r in out] == [("k-a-0", 2, "one <sw> two"), ("k-b-2", 1, "three")]


def test_collate_orders_and_pads(spark):
    df = spark.createDataFrame([(0, "a", [1.0], [1, 2]), (0, "b", [1.0, 2.0], [3])], "b int, k string, x array<double>, y array<int>")
    r = batching.collate(df, ["b"], "k", "x", "y").first()
    assert (r["keys"], r.feats, r.labels, r.feat_lengths, r.mask) == (["b", "a"], [[1.0, 2.0], [1.0, 0.0]], [[3, -1], [1, 2]], [2, 1], [[False, False], [False, True]])


# top-k and runs


def test_ranking(spark):
    assert [(p.token, p.score) for p in value(spark, ranking.top_k(F.array(*map(F.lit, [1.0, 3.0, 3.0, 2.0])), 3))] == [(1, 3.0), (2, 3.0), (3, 2.0)]
    runs = spark.createDataFrame([(1, 1, 0.5, "a"), (2, 2, 0.1, "b"), (3, 3, 0.2, "a")], "epoch int, step int, loss double, tag string")
    assert [r.step for r in ranking.best_snapshots(runs, 2, tag="a").collect()] == [3, 1]
    with pytest.raises(ValueError, match="snapshots match"):
        ranking.best_snapshots(runs, 3, tag="a")
    batches = spark.createDataFrame([(2.0, 3, 0.5), (float("inf"), 4, 0.7), (1.0, 0, 0.9)], "loss double, n_utts int, acc double")
    assert ranking.cv_loss(batches).first().loss == 6 / 4


def test_curriculum(spark):
    assert [value(spark, bias.sample_size(F.lit(10), e, 3)) for e in range(4)] == [3, 5, 8, 10]


# sequences


def brute_beam(logp):
    import itertools

    best: dict = {}
    n, v = logp.shape
    for path in itertools.product(range(v), repeat=n):
        out = tuple(t for i, t in enumerate(path) if t and (i == 0 or path[i - 1] != t))
        best[out] = np.logaddexp(best.get(out, -np.inf), sum(logp[i, t] for i, t in enumerate(path)))
    return sorted(best.items(), key=lambda kv: -kv[1])


def test_prefix_beam_finds_the_best_labelling():
    rng = np.random.default_rng(5)
    for _ in range(5):
        logp = np.log(rng.dirichlet(np.ones(3), 5))
        got = sequences.prefix_beam([[(t, logp[i, t]) for t in range(3)] for i in range(5)], 400)
        want = brute_beam(logp)
        assert [g[0] for g in got[:3]] == [w[0] for w in want[:3]] and got[0][1] == pytest.approx(want[0][1])
        assert all(len(g[2]) == len(g[0]) for g in got)


def test_forced_path():
    logp = np.log(np.array([[0.1, 0.8, 0.1], [0.8, 0.1, 0.1], [0.1, 0.8, 0.1], [0.1, 0.1, 0.8]]))
    assert sequences.forced_path(logp, np.array([1, 1, 2])).tolist() == [1, 0, 1, 2]
    assert sequences.forced_path(logp, np.array([], dtype=int)).tolist() == [0] * 4


def test_phrase_bonus(spark):
    df = spark.createDataFrame([([1, 2, 9],), ([1, 2, 3],), ([1, 9],), ([1, 1, 2],), ([2, 3],), ([],)], "t array<int>")
    got = [r.b for r in df.select(sequences.phrase_bonus(F.col("t"), [[1, 2], [1, 2, 3], [2, 3]], 1.0).alias("b")).collect()]
    assert got == [2, 2 + 3 + 2, 0, 2, 2, 0]


# features and sources


def test_statistics_and_masks(spark):
    rows = [("u", i, [float(i), 5.0]) for i in range(4)]
    df = spark.createDataFrame(rows, "key string, frame_idx int, feat array<float>")
    table = features.normaliser(features.statistics(df)).first()
    assert table.mean == [1.5, 5.0] and table.istd[0] == pytest.approx(1 / np.sqrt(1.25)) and table.istd[1] == pytest.approx(1e10)
    assert features.trim_tail(df, F.lit(4), longest=1).count() == 3
    out = features.substitute_earlier(df, F.lit(4), longest=2)
    assert out.count() == 4 and all(r.feat[0] <= r.frame_idx for r in out.collect())


def test_waves_to_features(spark):
    x = np.sin(np.arange(16000) * 2 * np.pi * 440 / 16000) * 0.5
    data = io.BytesIO()
    with wave.open(data, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(16000)
        w.writeframes((x * 32767).astype("<i2").tobytes())
    rows = spark.createDataFrame([("a", bytearray(data.getvalue()), None), ("b", bytearray(b"no"), None)], "key string, wav binary, error string")
    good, bad = S.quarantine(archives.waves(rows).cache())
    assert bad.count() == 1 and good.first().sample_rate == 16000
    assert features.to_frames(good, features.log_mel_spectrogram).count() == 100
    banks = features.to_frames(good, features.filter_bank)
    assert banks.count() == 98 and len(banks.first().feat) == 23
    assert len(features.to_frames(good, features.mfcc).first().feat) == 40
    y = features.resample(x, 16000, 8000)
    assert len(y) == 8000 and np.allclose(y[100:-100], x[::2][100:-100], atol=0.02)
    assert len(features.speed(good).first().samples) in (17778, 16000, 14545, 17777)
    assert value(spark, S.slice_audio(F.array(*map(F.lit, range(10))), F.lit(2), F.lit(1.0), F.lit(2.5))) == [2, 3, 4]


def test_archives(spark, tmp_path):
    def tar(name, members):
        with tarfile.open(tmp_path / name, "w:gz") as t:
            for n, d in members:
                info = tarfile.TarInfo(n)
                info.size = len(d)
                t.addfile(info, io.BytesIO(d))

    tar("s.tar.gz", [("a.wav", b"1"), ("a.txt", " é \n".encode()), ("b.txt", b"\xff"), ("b.wav", b"2"), ("c.1.spk", b"x"), ("c.1.txt", b"last")])
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        for n, d in [("p.wav", b"3"), ("p.txt", b"t"), ("q.wav", b"4"), ("readme", b"-")]:
            z.writestr(n, d)
    (tmp_path / "x.rar").write_bytes(b"?")
    out = {r.key: r for r in archives.archives(spark, str(tmp_path / "*")).collect()}
    assert out["a"].txt == "é" and bytes(out["a"].wav) == b"1" and out["b"].error and out["c.1"].extras == {"spk": "x"} and out["c.1"].txt == "last"
    assert out["p"].txt == "t" and out["q"].txt is None and out[None].error == "unknown kind of archive"


def test_ark_round_trip(spark, tmp_path):
    rows = [("a", [1, -2], None, None), ("b", None, [0.5, 1.5], None), ("c", None, None, [[1.0, 2.0], [3.0, 4.0]]), ("d", [], None, None)]
    df = spark.createDataFrame(rows, ark.SCHEMA).coalesce(1)
    ark.register(spark)
    df.write.format("ark").mode("append").save(str(tmp_path / "out"))
    got = {r.key: tuple(r) for r in ark.read_ark(spark, str(tmp_path / "out/*.ark")).collect()}
    assert got == {r[0]: r for r in rows}
    index = ark.index_lines(spark, str(tmp_path / "out/*.scp"))
    assert {r.key: r.vector for r in ark.read_index(index).collect()}["b"] == [0.5, 1.5]
    text = b"k1 1 2 3\nm1  [\n 1 2\n 3 4 ]\nf1  [ 1.5 2 ]\n"
    assert [(r["key"], r["ints"] or r["vector"] or r["matrix"]) for r in ark.records(text)] == [("k1", [1, 2, 3]), ("m1", [[1, 2], [3, 4]]), ("f1", [1.5, 2])]
    packed = b"z \0BCM2 " + struct.pack("<ffii", 0.0, 65535.0, 1, 2) + np.array([0, 65535], "<u2").tobytes()
    assert next(ark.records(packed))["matrix"] == [[0.0, 65535.0]]


def test_line_formats(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    m = S.manifest(spark, put("m.json", '{"key":"a","wav":"w","txt":"t","x":1}\n{"key":"b"}\nnot json\n')).collect()
    assert [(r.key, r.error) for r in m] == [("a", None), ("b", "lacks wav, txt"), (None, "not JSON")] and m[0].extras == {"x": "1"}
    assert [tuple(r) for r in S.symbol_table(spark, put("units", "<blank> 0\n a  1 \n")).collect()] == [("<blank>", 0), ("a", 1)]
    with pytest.raises(Exception, match="not a token and an id"):
        S.symbol_table(spark, put("bad", "a b c\n")).collect()
    with pytest.raises(Exception, match="not a bracketed symbol"):
        S.bracketed_symbols(spark, put("nl", "<a>\n[b]\nc\n")).collect()
    assert S.ctm(spark, put("c.ctm", 'f 0 1.00 0.50 "hi 0.9\n')).first().word == '"hi'
    assert tuple(S.rttm(spark, put("r", "SPEAKER f 1 1.5 2.0 <NA> <NA> s1 <NA> <NA>\nSPKR-INFO f\n")).first()) == ("f", 1.5, 3.5, "s1")
    assert S.alignment_counts(spark, put("l.json", '{"wer": {"bestWER": {"insertions": 1, "deletions": 2, "substitutions": 3, "numErrors": 6,\n "numWordsInReference": 9}}}')).first().num_ref == 9
    assert {r.word: r.freq for r in S.word_frequencies(spark, put("w.json", '{"a": 3,\n "b": 1}')).collect()} == {"a": 3, "b": 1}
    snap = S.snapshots(spark, put("epoch_1.yaml", "epoch: 1\nstep: 20\nloss: 1.5  # low\ntag: epoch_1\nlist:\n- x\n")).first()
    assert (snap.epoch, snap.step, snap.loss, snap.tag) == (1, 20, 1.5, "epoch_1")
    stats = [tuple(r) for r in S.cmvn(spark, put("cmvn.json", '{"mean_stat": [2.0, 4.0],\n "var_stat": [4.0, 8.0], "frame_num": 2}')).collect()]
    assert stats == [(0, 2, 2.0, 4.0), (1, 2, 4.0, 8.0)]
    assert [(r.dim, r.n, r.total, r.squares) for r in S.cmvn_text(spark, put("cmvn", " [ 2 4 2\n 4 8 0 ]\n")).collect()] == stats
    assert [r.frame_idx for r in S.segment_frames(spark, put("seg", "u r 0.005 0.035\n")).collect()] == [0, 1, 2, 3]
    assert value(spark, sinks.stm_line(F.lit("f"), F.lit("s"), F.lit(1.0), F.lit(2.5), F.lit("w"))) == "f 1 s 1.000 2.500 w"
    words = spark.createDataFrame([("f", 1, "b"), ("f", 0, "a")], "file string, i int, word string")
    sinks.write_lines(words, F.col("word"), str(tmp_path / "out"), ["file"], ["i"])
    assert [r.value for r in spark.read.text(str(tmp_path / "out/file=f")).collect()] == ["a", "b"]


def test_language_detection(spark):
    rows = [(i, "the cat and the hat", "en") for i in range(5)] + [(10 + i, "der hund und die katze", "de") for i in range(5)]
    df = spark.createDataFrame(rows, "k int, t string, lang string")
    assert {r.k: r.language for r in language.detect(df, language.train(df, "t", "lang"), "k", "t", ["de", "en"]).collect()} == {r[0]: r[2] for r in rows}


def test_pipeline_configuration(spark):
    conf = override(DEFAULTS, "batch_conf.n 4", "shuffle false", "batch_conf.batch_type static")
    assert conf["batch_conf"]["n"] == 4 and conf["shuffle"] is False and DEFAULTS["batch_conf"]["n"] == 16
    assert preset(override(DEFAULTS, "batch_conf.batch_type distribute"), "cv")["batch_conf"]["batch_type"] == "dynamic"
    df = spark.createDataFrame([("s", i, f"k{i}", "abc " * 5, 100 + i) for i in range(10)], "shard string, pos int, key string, txt string, n_frames int")
    out = build_pipeline(conf)(df)
    assert out.count() == 10 and out.select("batch_id").distinct().count() == 3
    assert build_pipeline(preset(DEFAULTS, "eval"))(df).count() == 10


def test_folds_stream_shards_over_batches(spark):
    """A shard never is one frame: batches stay small, state goes on over them, and no text enters Python."""
    rng = random.Random(19)
    rows = [(i, rng.choice(["a", "b", None]), rng.randrange(1, 60), rng.choice(["x", "y", None]), " ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.randrange(5)))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, shard string, n long, job string, text string").repartition(5)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = batching.distribute_batch(df, "shard", ["id"], "id", "n", "job", "text", 200, True, 40, 6)
        got = {(r.shard, r.id): r.batch_id for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    want = {(s, k): b for s in ("a", "b", None) for k, b in batching.quotas(((r[0], r[2], r[3], r[4]) for r in rows if r[1] == s), 200, True, 40, 6)}
    assert got == want and "MapInPandas" in plan and "FlatMapGroups" not in plan


def test_forced_alignment_of_whole_label_sequences(spark):
    from itertools import groupby

    from uttframe.plans import QUERIES
    from uttframe.plans.speech import Tables, _vectors

    want, got = {}, {}
    for r in _vectors(Tables(spark, "/root/testdata/sf0.001")).select("key", "frame_idx", "label").orderBy("key", "frame_idx").collect():
        want.setdefault(r.key, []).append(r.label + 1)
    for r in QUERIES["forced_alignment"](spark, "/root/testdata/sf0.001").orderBy("key", "frame_idx").collect():
        got.setdefault(r.key, []).append(r.token)
    assert {k: [t for t, _ in groupby(x) if t] for k, x in got.items()} == {k: [t for t, _ in groupby(x)] for k, x in want.items()}
    frames = spark.createDataFrame([(1, i, [-1.0, -1.0]) for i in range(2)], "key int, frame_idx int, logp array<double>")
    assert [r.token for r in sequences.forced_alignment(frames, spark.createDataFrame([(1, [1, 1])], "key int, labels array<int>")).collect()] == [None, None]
