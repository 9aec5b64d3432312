"""Token counts, token links and Merkle witnesses against the libraries and plain versions, and on hard rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from uttframe.llm import merkle, token_counts, token_links

DOCS = "doc_id long, text string, lang string, source string, n_chars long, pos string, n string, grp string, node string, pairs string, x string, root string"
LETTERS = "aabbccdeeeinorst'sSΣİßéÅé1２٣ \n\t.,;:!?-=#\x1c\x85  中文字한국🙂👩‍👩́̀\U00011de0▁<s>"
SPECIAL = "a <|endoftext|>b<|startoftext|><|ENDOFTEXT|> <s> </s> <|<|endoftext|>|>"


def hard_texts() -> list[str | None]:
    rng = random.Random(5)
    mixed = ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(60))) for _ in range(300)]
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9))) for _ in range(500)]
    long = " ".join(rng.choice(words) for _ in range(120_000))
    return [None, "", " ", "  ", "\n", "a▁b", SPECIAL, "a" * 3_000, "=" * 3_000, "ab" * 2_000, "1" * 3_000, long, long, *mixed, *mixed[:5]]


def hard_rows() -> list[tuple]:
    texts = hard_texts()
    rows = [(i, t, [None, "", "en", "de"][i % 4], "ab"[i % 2], None if i % 5 == 0 else i) for i, t in enumerate(texts)]
    return [(*r, *["x"] * 7) for r in [*rows, rows[20], rows[20], (20, "other text", "en", "a", 3), (None, "no id", "en", None, 7), (None, None, None, None, None)]]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(hard_rows(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def words_library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(token_counts.WORD_BPE))


@pytest.fixture(scope="module")
def both():
    return token_links.Aligner(*token_links._paths(None, None))


@pytest.fixture(scope="module")
def plain_links(both):
    """A text's tokens, groups and end links by the libraries and plain loops."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_library = Tokenizer.from_file(public_tokenizers.path(token_links.BYTE_BPE))
    a_library.encode_special_tokens = True
    b_library = SentencePieceProcessor(model_file=public_tokenizers.path(token_links.PIECE_BPE))

    def of(text: str | None) -> tuple[list[int], list[int], list[tuple[list[int], list[int]]], int]:
        want = (" " + (text or "")).encode()
        a, b = a_library.encode(" " + (text or ""), add_special_tokens=False).ids, b_library.encode(text or "")
        spans = []
        for ids, names in ((a, both.a.bytes), (b, both.b.bytes)):
            ends = np.cumsum([len(names[i]) for i in ids]).tolist()
            spans.append(list(zip([0, *ends], ends, strict=False)))
            if b"".join(names[i] for i in ids) != want:
                return [], [], [], 0
        if not text:
            return [], [], [], 0
        overlaps = sum(1 for s, e in spans[0] for t, f in spans[1] if s < f and t < e) if len(a) < 3_000 else -1
        groups, i, j = [], 0, 0
        for cut in sorted({e for _, e in spans[0]} & {e for _, e in spans[1]}):
            ga, gb = [], []
            while i < len(a) and spans[0][i][1] <= cut:
                ga.append(a[i])
                i += 1
            while j < len(b) and spans[1][j][1] <= cut:
                gb.append(b[j])
                j += 1
            groups.append((ga, gb))
        return a, b, groups, overlaps

    return of


def test_token_counts_are_the_librarys(hard, words_library):
    got = Counter(tuple(r) for r in token_counts.query(hard).collect())
    want = Counter()
    for r in hard_rows():
        n = len(words_library.encode(r[1] or "", add_special_tokens=False).ids)
        want[r[0], len((r[1] or "").encode()), n, n > 2048] += 1
    assert got == want


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_counts_of_any_text(text):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(token_counts.WORD_BPE))
    assert token_counts.counter(public_tokenizers.path(token_counts.WORD_BPE)).counts([text]) == [len(library.encode(text, add_special_tokens=False).ids)]


def test_counts_of_all_code_points_and_small_batches(words_library, monkeypatch):
    texts = [" ".join(f"a{chr(c)}b {chr(c)}'S{chr(c)}{chr(c + 1)}" for c in range(at, at + 300) if not 0xD7FF <= c < 0xE000) for at in range(0, 0x30000, 300)]
    counter = token_counts.WordCounter(public_tokenizers.path(token_counts.WORD_BPE))
    want = [len(e.ids) for e in words_library.encode_batch_fast(texts, add_special_tokens=False)]
    assert counter.counts(texts) == want
    for name, value in (("PIECE", 40), ("AT_ONCE", 7), ("BATCH_CHARS", 100), ("KEPT", 50)):
        monkeypatch.setattr(token_counts, name, value)
    assert counter.counts(texts[:60]) == want[:60]


def test_merging_overlapping_pairs_from_the_left():
    letters = token_counts.byte_letters()
    vocab = {x: i for i, x in enumerate([*letters, *[x + "</w>" for x in letters], "aa", "aaaa", "aaa</w>", "ab</w>"])}
    merges = token_counts.Merges(vocab, [["a", "a"], ["aa", "aa"], ["aa", "a</w>"], ["a", "b</w>"]], "</w>")
    # aaaaa</w>: aa aa a</w>, then aaaa a</w>; aaa</w>: aa a</w>, then one; xaab</w>: x aa b</w>; ab</w>: one.
    assert merges.surviving([b"aaaaa", b"aaa", b"xaab", b"ab", b"z"]).tolist() == [2, 1, 3, 1, 1]


def test_token_links_are_the_plain_ones(hard, plain_links):
    rows = {r: plain_links(r[1]) for r in set(hard_rows())}
    counts: Counter = Counter()
    for r in hard_rows():
        counts.update((ga[-1], gb[-1]) for ga, gb in rows[r][2])
    highest: dict[int, int] = {}
    for (_, b), n in counts.items():
        highest[b] = max(n, highest.get(b, 0))
    want = Counter()
    for r in hard_rows():
        a, b, groups, _ = rows[r]
        links = [(ga[-1], gb[-1]) for ga, gb in groups]
        text = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        want[r[0], len(a), len(b), len(groups), len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links), sha, sum(len(ga) * len(gb) for ga, gb in groups)] += 1
    found = token_links.query(hard).drop("n_overlaps")
    assert found.columns[:8] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r) for r in found.collect()) == want


def test_links_by_kind(spark, plain_links):
    texts = ["some plain words, and 2,345 more", "Zażółć gęślą\n\njaźń 中文", "a▁b", None, "== x ==  y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = token_links.links(docs, ("end", "overlap", "group")).collect()
    for i, text in enumerate(texts):
        a, b, groups, overlaps = plain_links(text)
        of = {k: [r for r in got if r.doc_id == i and r.kind == k] for k in ("end", "overlap", "group")}
        assert len(of["overlap"]) == overlaps and len(of["end"]) == len(groups) and len(of["group"]) == sum(len(x) * len(y) for x, y in groups)
        assert [(r.a_id, r.b_id) for r in of["end"]] == [(x[-1], y[-1]) for x, y in groups]
        assert all(a[r.a_place] == r.a_id and b[r.b_place] == r.b_id for k in of for r in of[k])
        assert sum(r.n_bytes for r in of["overlap"]) == (len((" " + text).encode()) if a else 0)


def test_segments_in_small_pieces(both, plain_links, monkeypatch):
    texts = [t for t in hard_texts() if t and len(t) < 5_000]
    for name, value in (("PIECE", 30), ("BATCH_CHARS", 200), ("KEPT_SEGMENTS", 40), ("AT_ONCE", 3)):
        monkeypatch.setattr(token_links, name, value)
    for text, row in zip(texts, both.digests(texts), strict=True):
        a, b, groups, overlaps = plain_links(text)
        assert row[:4] == (len(a), len(b), len(groups), len(groups)) and row[5] in (overlaps, row[5] if overlaps < 0 else overlaps)


def test_products_are_those_of_dense_matrices():
    rng = np.random.default_rng(3)

    def csr(dense: np.ndarray) -> token_links.Csr:
        return token_links.Csr(np.concatenate([[0], np.cumsum(dense.sum(axis=1))]), np.nonzero(dense)[1], dense.shape[1])

    for _ in range(50):
        n, m, k = rng.integers(1, 8, size=3)
        a, b = rng.integers(0, 2, size=(n, m)), rng.integers(0, 2, size=(m, k))
        out = np.zeros((n, k), dtype=int)
        for i, j, v in token_links.product(csr(a), csr(b), 2):
            out[i, j] = v
        assert (out == a @ b).all() and (csr(a).transpose().indptr == csr(a.T).indptr).all()
        assert (token_links.product_sizes(csr(a), csr(b)) == (a @ b).sum(axis=1)).all()


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves: list[str]) -> tuple[str, list[list[tuple[str | None, bool]]]]:
    """The root, and for each leaf its siblings from below: (digest or None, whether it is on the left)."""
    paths, nodes, of = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(nodes) > 1:
        for i, at in enumerate(of):
            other = at ^ 1
            paths[i].append((nodes[other] if other < len(nodes) else None, at % 2 == 1))
        nodes, of = [sha(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)], [at // 2 for at in of]
    return nodes[0], paths


def plain_manifest(rows: list[tuple]) -> Counter:
    def leaf(r: tuple, more: int = 0) -> str:
        doc_id, text, lang, source, n_chars = r[:5]
        values = [doc_id, source, lang, None if n_chars is None else n_chars + more, text]
        return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = (mine, *plain_tree([leaf(r) for r in mine]))
    root, tops = plain_tree([trees[x][1] for x in langs])
    out: Counter = Counter()
    for lang, top in zip(langs, tops, strict=True):
        mine, subroot, paths = trees[lang]
        for r, path in zip(mine, paths, strict=True):
            whole = path + top
            h = leaf(r, 1) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else leaf(r)
            for other, left in whole:
                h = sha(*([other, h] if left else [h, other]) if other else [h])
            out[r[0], leaf(r), subroot, root, sha(*[o for o, _ in whole if o]), h, h == root] += 1
    return out


def test_manifest_of_hard_rows(hard, empty):
    assert Counter(tuple(r) for r in merkle.query(hard).collect()) == plain_manifest(hard_rows())
    assert merkle.query(empty).collect() == [] and merkle.query(empty).columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("bits", [1, 2])
def test_manifest_in_many_levels_of_blocks(spark, bits):
    rows = [(i, f"t{i}", lang, "s", i) for lang, size in (("a", 1), ("b", 13), (None, 16), ("é", 3)) for i in range(size)]
    found = merkle.query(spark.createDataFrame([(*r, *["x"] * 7) for r in rows], DOCS), bits)
    assert Counter(tuple(r) for r in found.collect()) == plain_manifest(rows)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 70))
def test_appended_trees_are_the_plain_ones(n):
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    tree = merkle.Appender()
    for leaf in leaves:
        tree.append(leaf)
    root, paths = plain_tree([x.hex() for x in leaves])
    assert tree.close((n - 1).bit_length()).hex() == root
    assert [[w and w.hex() for w in ws] for ws in tree.witnesses] == [[o for o, _ in p] for p in paths]


def test_empty_tables(empty):
    assert token_counts.query(empty).collect() == [] and token_links.query(empty).collect() == []
