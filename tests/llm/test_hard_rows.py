"""Corpus operators against brute force, and on hard rows: clashing columns, nulls, very long texts, ties, repeats, hot groups."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from uttframe.llm import chosen_path, contamination, licenses, log_templates, mixing, passages, quality, secrets, sharding, warc
from uttframe.llm.common import materialise, pieces, spread_join, stage_path, word_hashes, code_points

from test_operators import classes, prose

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Documents with columns that operators might use themselves, and rows with nulls, empties and repeats.
CLASHING = ["shard", "slot", "size", "hash", "key_a", "key_b", "_id", "_row", "_text", "a", "b", "n", "path", "removed", "quality", "dropped", "_pattern", "_own", "_size", "_copies", "template", "digest", "kept", "words", "part"]


def clashing_rows() -> list[tuple]:
    rng = random.Random(31)
    texts = [prose(rng, 40) for _ in range(12)] + [None, "", "one", prose(rng, 40)]
    rows = [(i, t, "en", "ab"[i % 2], 1) for i, t in enumerate(texts)]
    return [*rows, rows[2], (None, texts[3], None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def clashing(spark):
    rows = clashing_rows()
    return spark.createDataFrame([(*r, *[f"{c} {i}" for c in CLASHING]) for i, r in enumerate(rows)], ", ".join([DOCS, *[f"`{c}` string" for c in CLASHING]]))


def rows_of(df) -> Counter:
    return Counter(tuple(r) for r in df.collect())


def test_tables_with_clashing_columns(spark, clashing):
    want = rows_of(clashing)
    benchmark = spark.createDataFrame([(1, "nothing like this stands in any of the texts of this table", "x")], "item_id long, text string, edits string")
    for out in (contamination.drop_leaks(clashing, benchmark), log_templates.drop_templates(clashing)):
        assert out.columns == clashing.columns and rows_of(out) == want
    kept = rows_of(quality.keep_good(clashing))
    assert kept and not kept - want
    once = chosen_path.keep_one(clashing)
    assert once.columns == clashing.columns and not rows_of(once) - want and len({r.text for r in once.collect() if r.text and r.text.strip()}) == 14
    mixed = mixing.mix_documents(clashing)
    assert mixed.columns == clashing.columns and set(rows_of(mixed)) <= set(want)
    cut = passages.drop_repeats(clashing)
    assert cut.columns == clashing.columns and cut.count() == clashing.count()
    sharded = sharding.shard_documents(clashing)
    assert sharded.columns == [*[c for c in clashing.columns if c != "shard"], "shard"] and sharded.schema["shard"].dataType.simpleString() == "int"
    path = stage_path(spark, "clashing")
    sharded.write.parquet(path)  # no column twice
    assert spark.read.parquet(path).count() == clashing.count()
    for query in (secrets.query, licenses.query, quality.query, mixing.query, sharding.query, passages.query, log_templates.query, chosen_path.query):
        assert Counter(r.doc_id for r in query(clashing).collect()) == Counter(r.doc_id for r in clashing.collect())


def test_very_long_texts(spark):
    rng = random.Random(32)
    long = prose(rng, 60_000)
    near = long.replace(" ", " extra ", 3)
    item = prose(rng, 30)
    texts = [long, near, "x" * 700_000, prose(rng, 30_000) + " " + item + " " + prose(rng, 20_000), long + "\nmit license\npassword: abcdefghijklmnop"]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    found = {r.doc_id: (r.class_id, r.n_links) for r in chosen_path.query(df).collect()}
    assert found == {0: (0, 2), 1: (0, 2), 2: (2, 0), 3: (3, 0), 4: (0, 2)}
    leaks = contamination.query(df, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, texts[3][r.start : r.end]) for r in leaks] == [(3, 7, item)]
    spans = {r.doc_id: r.removed_words for r in passages.query(df).collect()}
    assert spans[0] == spans[2] == spans[3] == 0 and spans[4] >= 60_000 and spans[1] >= 59_900
    assert {r.doc_id: r.base_labels for r in licenses.query(df).collect()}[4] == "mit"
    assert {r.doc_id: r.n_assign for r in secrets.query(df).collect()}[4] == 1
    assert {r.doc_id: r.n_words for r in quality.query(df).collect()}[0] == 60_000
    assert sharding.query(df).count() == mixing.query(df).count() == log_templates.query(df).count() == 5
    pages = spark.createDataFrame([(i, "u", t) for i, t in enumerate(texts)], "page_id long, url string, html string")
    assert {r.page_id: r.payload_bytes for r in warc.query(pages).collect()} == {i: len(t) for i, t in enumerate(texts)}


def test_words_do_not_depend_on_pieces():
    rng = random.Random(33)
    text = " ".join("".join(rng.choice("abcé_9-　") for _ in range(rng.randrange(1, 9))) for _ in range(3000))
    whole = word_hashes(code_points(text), "_")[0].tolist()
    parts = [h for p in pieces(text, 50) for h in word_hashes(code_points(p), "_")[0].tolist()]
    assert whole == parts and "".join(pieces(text, 50)) == text
    words = re.findall(r"\w+", text)
    assert len(words) == len(whole) and len(set(words)) == len(set(whole))


def test_buckets_are_split_to_any_depth(spark):
    rng = random.Random(34)
    common, rows = prose(rng, 60), []
    for i in range(150):  # a long common passage makes large buckets of texts that are not alike
        rows.append((i, common + " " + prose(rng, 60), "en", "s", 1))
    family = prose(rng, 120).split()
    for i in range(40):
        words = list(family)
        words[rng.randrange(120)] = f"w{i}"
        rows.append((200 + i, " ".join(words), "en", "s", 1))
    rows += [(300 + i, r[1] + " tail", "en", "s", 1) for i, r in enumerate(rows[:20])]
    df = spark.createDataFrame(rows, DOCS)
    got = Counter((r._id, r.class_id, r.n_links) for r in chosen_path.near_duplicates(df, small=5, block=16, recall=0.9999).collect())
    assert got == Counter(classes(rows))
    assert chosen_path.miss(50) ** chosen_path.n_runs(0.98) <= 0.02


def test_signatures_lose_no_pair():
    import numpy as np

    rng = np.random.default_rng(35)
    for n in (3, 60, 64, 65, 700):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        for changed in range(0, max(1, n // 9) + 1):
            b = a.copy()
            b[:changed] = rng.integers(0, 1 << 63, changed, dtype=np.uint64)
            extra = rng.integers(0, 1 << 63, changed // 2, dtype=np.uint64)
            b = np.concatenate((b, extra))
            both = n - changed
            if both >= 0.8 * (n + len(b) - both):
                sizes = np.array([n, len(b)])
                assert chosen_path._fits([chosen_path.signature(a), chosen_path.signature(b)], sizes, np.array([0]), np.array([1]), 0.8)[0]


# passages


def later_spans(texts: list[str], least: int = 25) -> list[list[tuple[int, int]]]:
    """Word spans to remove, by comparing every word of a text with every word before it in the corpus."""
    words = [[(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+", t)] for t in texts]
    out = []
    for i, ws in enumerate(words):
        gone = set()
        for j in range(i + 1):
            for start in range(len(ws)):
                for at in range(len(words[j]) if j < i else start):
                    if start and at and ws[start - 1][0] == words[j][at - 1][0]:
                        continue  # not the longest
                    n = 0
                    while start + n < len(ws) and at + n < len(words[j]) and ws[start + n][0] == words[j][at + n][0]:
                        n += 1
                    if n >= least:
                        gone |= set(range(start, start + n))
        spans = []
        for k in sorted(gone):
            if spans and spans[-1][1] == k:
                spans[-1] = spans[-1][0], k + 1
            else:
                spans.append((k, k + 1))
        out.append([(ws[a][1], ws[b - 1][2]) for a, b in spans])
    return out


def test_passages_against_brute_force(spark):
    rng = random.Random(36)
    shared = [prose(rng, n) for n in (30, 40, 55, 80, 20)]
    texts = []
    for i in range(30):
        parts = [prose(rng, rng.randrange(5, 30))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(shared), prose(rng, rng.randrange(5, 30))]
        texts.append(" - ".join(parts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [tuple(map(int, x.split(":"))) for x in r.removed_spans.split(",") if x] for r in passages.query(df).collect()}
    assert [got[i] for i in range(30)] == later_spans(texts)


def test_lines_against_brute_force(spark):
    rng = random.Random(37)
    lines = [prose(rng, rng.randrange(1, 9)) for _ in range(12)]
    texts = ["\n".join(rng.choice(lines) if rng.random() < 0.5 else prose(rng, 6) for _ in range(10)) for _ in range(25)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, want = set(), {}
    for i, t in enumerate(texts):  # no blank lines, so a text is one paragraph
        at, spans = 0, []
        for line in t.split("\n"):
            if line in seen:
                if spans and spans[-1][1] == at - 1:
                    spans[-1] = spans[-1][0], at + len(line)
                else:
                    spans.append((at, at + len(line)))
            seen.add(line)
            at += len(line) + 1
        want[i] = spans
    got = {r.doc_id: [tuple(map(int, x.split(":"))) for x in r.removed_spans.split(",") if x] for r in passages.query(df).collect()}
    assert got == want


# decontamination


def least_edits(pattern: str, text: str) -> int:
    before = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        row = [i]
        for j, x in enumerate(text, 1):
            row.append(min(before[j - 1] + (p != x), before[j] + 1, row[-1] + 1))
        before = row
    return min(before)


def test_leaks_against_brute_force(spark):
    rng = random.Random(38)
    as_text = lambda t: "".join(map(chr, contamination.normal(t)[0]))
    items = ["".join(rng.choice("abc de") for _ in range(n)) for n in (1, 2, 5, 7, 8, 12, 13, 14, 15, 16, 19, 24, 40, 80) for _ in range(3)]
    items = [x for x in items if as_text(x)]
    texts = []
    for item in items:
        t = list("".join(rng.choice("xyz w") for _ in range(30)) + as_text(item) + "".join(rng.choice("xyz w") for _ in range(30)))
        for _ in range(rng.randrange(contamination.budget(len(as_text(item))) + 3)):
            at = 30 + rng.randrange(len(as_text(item)))
            t[at : at + rng.randrange(2)] = rng.choice(["", "q", "r", "q"])
        texts.append("".join(t))
    texts += [texts[4], texts[4], None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items), (3, items[3]), (None, "a null id " * 3), (99, None)], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in contamination.query(docs, bench).collect())
    want = Counter((d, i) for d, t in enumerate(texts) if t for i, x in enumerate(items) if least_edits(as_text(x), as_text(t)) <= contamination.budget(len(as_text(x))))
    assert got == want


def test_parts_of_a_benchmark(spark, monkeypatch):
    rng = random.Random(39)
    items = [prose(rng, 25) for _ in range(12)]
    docs = spark.createDataFrame([(i, prose(rng, 20) + " " + items[i % 12] + " " + prose(rng, 20)) for i in range(15)] + [(50, prose(rng, 60))], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    monkeypatch.setattr(contamination, "PART_CHARS", 600)
    assert contamination._n_parts(bench) > 2
    assert Counter((r.doc_id, r.item_id) for r in contamination.query(docs, bench).collect()) == Counter((i, i % 12) for i in range(15))
    assert [r.doc_id for r in contamination.drop_leaks(docs, bench).collect()] == [50]


# sharding


def test_groups_of_equal_texts(spark):
    rng = random.Random(40)
    rows = [(i, "z" * 950) for i in range(60)]  # 0.95 of an ideal shard together: stays whole
    rows += [(100 + i, "y" * rng.randrange(300, 700) + str(i)) for i in range(790)]
    rows += [(None, "same without an id")] * 30 + [(i, "same text") for i in range(2000, 2020)]
    total = sum(len(t) + 1 for _, t in rows)
    pad = "x" * ((60 * 951 * 8 * 100 // 95 - total) // 4)
    rows += [(3000 + i, pad + str(i)) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.query(df, 8).collect()
    by_text = {}
    for r in out:
        by_text.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    sums = Counter()
    for r in out:
        sums[r.shard] += r["size"]
    assert max(sums.values()) - min(sums.values()) < 0.02 * sum(sums.values()) / 8


def test_hot_keys_are_dealt(spark):
    left = spark.range(5000).select((F.col("id") % 7).alias("k"), F.col("id").alias("x")).withColumn("k", F.when(F.col("x") % 3 == 0, 1).otherwise(F.col("k")))
    right = spark.range(6).select(F.col("id").alias("k"), (F.col("id") * 10).alias("y"))
    hot = left.groupBy("k").count().filter("count > 1000").select("k")
    for how in ("inner", "left", "left_semi"):
        got, want = spread_join(left, right, ["k"], hot, F.col("x"), how), left.join(right, "k", how)
        assert rows_of(got.select(*sorted(got.columns))) == rows_of(want.select(*sorted(want.columns)))


# mixing


def test_mix_goes_through_shared_texts(spark):
    """Source a has two texts, one of which b has too and needs in full: the flow takes a's other text instead of half of each."""
    a_only = [(i, f"only {i} " + "w " * 8, "a") for i in range(100)]
    both = [(1000 + 2 * i + k, f"both {i} " + "w " * 8, s) for i in range(100) for k, s in enumerate("ab")]
    df = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in [*a_only, *both]], DOCS)
    out = mixing.query(df).collect()
    target = {s: t for s, t in {(("a" if r.source_size == 2000 else "b"), r.target) for r in out}}
    assert target == pytest.approx(mixing.source_targets({"a": 2000, "b": 1000}))
    taken = Counter()
    for r in out:
        taken["only" if r.doc_id < 1000 else "ab"[r.doc_id % 2]] += r.taken
    assert abs(taken["a"] + taken["only"] - target["a"]) <= 10 and abs(taken["b"] - target["b"]) <= 10
    plain = target["a"] / 2  # what each half of a would give by size alone
    assert abs(taken["only"] - plain) > 50 and taken["only"] > taken["a"]
    flow = mixing.min_cost_flow({("a",): 1000, ("a", "b"): 1000}, {s: int(t) for s, t in target.items()}, 3, {(("a",), "a"): 1000, (("a", "b"), "a"): 1000, (("a", "b"), "b"): 1000})
    assert abs(taken["only"] - flow[("a",), "a"]) <= 10 and abs(taken["b"] - flow[("a", "b"), "b"]) <= 10


def test_mix_of_many_patterns(spark, monkeypatch):
    rng = random.Random(41)
    sources = [f"s{i}" for i in range(40)]
    rows = []
    for i in range(300):
        text = prose(rng, rng.randrange(5, 40))
        for s in rng.sample(sources, rng.choice([1, 2, 3])):
            rows.append((len(rows), text, "en", s, 1))
    df = spark.createDataFrame(rows, DOCS)
    want = mixing.source_targets({s: sum(len(r[1].split()) for r in rows if r[3] == s) for s in {r[3] for r in rows}})
    for most in (mixing.MAX_CELLS, 60):  # all patterns in the network, and few of them
        monkeypatch.setattr(mixing, "MAX_CELLS", most)
        out = {r.doc_id: r for r in mixing.query(df).collect()}
        taken = Counter()
        for i, _, _, s, _ in rows:
            assert out[i].target == pytest.approx(want[s]) and out[i].taken <= 3 * out[i]["size"]
            taken[s] += out[i].taken
        assert len(out) == len(rows) and all(abs(taken[s] - want[s]) <= 3 * 40 for s in want)


def brute_flow(patterns: dict, quotas: dict, cells: dict, tiers: int) -> float:
    """The least cost of meeting the quotas a word at a time, over all ways."""
    from functools import cache
    from itertools import product

    names = list(cells)

    best = float("inf")
    for amounts in product(*[range(3 * cells[c] + 1) for c in names]):
        got, by = Counter(), Counter()
        for (p, s), n in zip(names, amounts, strict=True):
            got[s] += n
            by[p] += n
        if all(got[s] == q for s, q in quotas.items()):
            cost = sum(min(k // patterns[p], tiers - 1) ** 2 for p, n in by.items() for k in range(n))
            best = min(best, cost)
    return best


def test_flow_against_brute_force():
    rng = random.Random(42)
    for _ in range(12):
        patterns = {("a",): rng.randrange(1, 3), ("a", "b"): rng.randrange(1, 3), ("b",): rng.randrange(1, 3)}
        cells = {(p, s): patterns[p] for p in patterns for s in p}
        quotas = {s: rng.randrange(1, 3 * sum(n for (_, x), n in cells.items() if x == s)) for s in "ab"}
        flow = mixing.min_cost_flow(patterns, quotas, 3, cells)
        got, by = Counter(), Counter()
        for (p, s), n in flow.items():
            got[s] += n
            by[p] += n
        assert dict(got) == quotas
        assert sum(min(k // patterns[p], mixing.TIERS - 1) ** 2 for p, n in by.items() for k in range(n)) == brute_flow(patterns, quotas, cells, mixing.TIERS)


# secrets


def test_repositories_are_counted_by_themselves(spark):
    value = "d7f2a09b1c4e8f6a5b3c"
    rows = [(i % 5, f"{i} {value}", "en", f"o{i % 2}", 1) for i in range(10)]  # five repositories under two owners each
    found = materialise(secrets.scan(spark.createDataFrame(rows, DOCS), "doc_id", "source"), "secrets-test")
    (owned,) = secrets.ownership(found).collect()
    assert (owned.n_repos, owned.n_owners) == (5, 2)


def test_wholly_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    for out in (passages.drop_repeats(empty), log_templates.drop_templates(empty), mixing.mix_documents(empty), sharding.shard_documents(empty), chosen_path.keep_one(empty)):
        assert out.count() == 0
