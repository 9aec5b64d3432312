"""Alignment against alternatives, compared with all expansions; readers of synonyms and normalised forms; repeated snapshot fields."""

from __future__ import annotations

import itertools
import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from uttframe.operators import scoring
from uttframe.sources import text as S


def edits(ref: list[str], hyp: list[str]) -> tuple[int, int, int]:
    """The least (errors, -correct, substitutions) of all alignments, by the plain table."""
    table = {(0, 0): (0, 0, 0)}
    for i, j in itertools.product(range(len(ref) + 1), range(len(hyp) + 1)):
        ways = []
        if i and j:
            e, c, s = table[i - 1, j - 1]
            ways.append((e, c - 1, s) if ref[i - 1] == hyp[j - 1] else (e + 1, c, s + 1))
        if i:
            e, c, s = table[i - 1, j]
            ways.append((e + 1, c, s))
        if j:
            e, c, s = table[i, j - 1]
            ways.append((e + 1, c, s))
        if ways:
            table[i, j] = min(ways)
    return table[len(ref), len(hyp)]


def expansions(ref: list[str], others: list[tuple[int, int, list[str]]], at: int = 0):
    """All readings of a reference."""
    if at == len(ref):
        yield []
        return
    for end, words in [(at + 1, [ref[at]]), *[(e, w) for s, e, w in others if s == at and s < e <= len(ref)]]:
        for rest in expansions(ref, others, end):
            yield [*words, *rest]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=6), st.lists(st.sampled_from("abcd"), max_size=7), st.lists(st.tuples(st.integers(0, 5), st.integers(1, 6), st.lists(st.sampled_from("abd"), max_size=3)), max_size=4))
def test_the_best_of_all_readings(ref, hyp, others):
    c, s, d, i = scoring.graph_counts(ref, hyp, others)
    best = min(edits(r, hyp) for r in expansions(ref, others))
    assert (s + d + i, -c, s) == best and c + s + i == len(hyp)


def test_rules_and_readings_of_rows(spark, tmp_path):
    (tmp_path / "syn").write_text("# informal\ngoing to | gonna ; gunna\nwant to | wanna\nno other\n")
    (tmp_path / "a.norm.json").write_text(json.dumps({"1": {"class": "CARDINAL", "candidates": [{"probability": 1.0, "verbalization": ["one", "hundred"]}, {"verbalization": ["a", "hundred"]}]}}))
    rules = [(r.phrase, r.other) for r in S.synonyms(spark, str(tmp_path / "syn")).collect()]
    assert rules == [(["going", "to"], ["gonna"]), (["going", "to"], ["gunna"]), (["want", "to"], ["wanna"])]
    norms = [(r.label, r.words) for r in S.norms(spark, str(tmp_path / "*.norm.json")).collect()]
    assert norms == [("1", ["one", "hundred"]), ("1", ["a", "hundred"])]
    own = [(2, 3, words) for _, words in norms]
    rows = [
        (1, "i am going to pay".split(), "i am gonna pay".split(), None),
        (2, "we pay 100 now".split(), "we pay a hundred now".split(), own),
        (3, "we pay 100 now".split(), "we pay a hundred now".split(), None),
        (4, None, ["x"], own), (5, ["x"], None, None), (6, "you want to".split(), "you wanna".split(), None),
    ]
    df = spark.createDataFrame(rows, "k int, ref array<string>, hyp array<string>, own array<struct<start:int,end:int,words:array<string>>>")
    got = {r.k: (r.num_errors, r.num_ref, r.correct) for r in scoring.align_readings(df, "k", "ref", "hyp", rules, "own").collect()}
    assert got == {1: (0, 4, 4), 2: (0, 5, 5), 3: (2, 4, 3), 4: (1, 0, 0), 5: (1, 1, 0), 6: (0, 2, 2)}
    plain = {r.k: (r.num_errors, r.num_ref) for r in scoring.align_readings(df, "k", "ref", "hyp").collect()}
    assert plain[1] == (2, 5) and plain[6] == (2, 3)


def test_long_transcripts(spark):
    rng = random.Random(2)
    ref = [rng.choice("abcdefghij") for _ in range(3_000)]
    others = [(i, i + 2, ["z"]) for i in range(0, 2_990, 10)]
    hyp = [w for i in range(0, 3_000, 10) for w in (["z", *ref[i + 2 : i + 10]] if i < 2_990 else ref[i:])]
    assert scoring.graph_counts(ref, hyp, others) == (len(hyp), 0, 0, 0)


def test_snapshots_with_repeated_fields(spark, tmp_path):
    (tmp_path / "s.yaml").write_text("epoch: 1\nstep: 2\nepoch: 3\nloss: 0.5\ntag: x\n")
    r = S.snapshots(spark, str(tmp_path / "s.yaml")).first()
    assert (r.epoch, r.step, r.loss, r.tag) == (3, 2, 0.5, "x")
