"""Alignment of two tokenizers over the same texts, through sparse incidence matrices of tokens and bytes.

Both tokenizers cover the bytes of one space and the text. A token's row in its incidence matrix has its bytes as columns;
the product of one matrix with the other's transpose, row by row, gives the overlap links: pairs of token occurrences and
how many bytes they share. Pairs that end at one byte are end links; their ends cut the tokens into groups. Incidence of
tokens and groups, multiplied alike, gives the pairs that share a group (``links``); ``query`` needs only how many these
are, from the sizes of the rows, and doesn't form them.

Of two tokens that end together the shorter one's bytes end the longer one's. So all end links of any corpus are of at most
sum(token lengths) different pairs of ids, some 500,000 for two vocabularies of 50,000: the corpus-wide counts of pairs are
a table of that bound, and every task gets it. Documents are tokenised once, into a written table of their pairs of ids.

Rows: each row of the input gives one row, repeated rows and null ids too. A null or empty text has no tokens, nor has one
whose tokens' bytes differ from the space and text in either tokenizer (a text with U+2581, say). Special strings in texts
are plain text. Texts are cut into segments at single spaces between other characters, where both tokenizers begin a token in
any case; segments are aligned once as long as a worker keeps them. Very long texts come in pieces of such segments; a task
holds the matrices of some 1M characters, or of one longer segment without such a space. Ties for a B id's highest count are all best. Other columns, whatever their
names, are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PIECE, light_batches, materialise
from .token_counts import byte_letters, known, ragged

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A single space, where both tokenizers begin a token: between characters that none of them takes for a blank.
CUT = regex.compile(r"(?<=[^\s\x1c-\x1f]) (?=[^\s\x1c-\x1f])")
#: Rows of a product formed at once, segments that a worker keeps, characters aligned at once, segments in one text for B.
BLOCK_ROWS, KEPT_SEGMENTS, BATCH_CHARS, AT_ONCE = 1 << 16, 1 << 17, 1 << 20, 256
DIGEST = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_overlaps long, n_shared long, pairs array<long>, times array<long>"


class Csr(NamedTuple):
    """A sparse matrix of zeros and ones by rows: row i has the columns indices[indptr[i]:indptr[i + 1]], ascending."""

    indptr: np.ndarray
    indices: np.ndarray
    columns: int

    def transpose(self) -> Csr:
        rows = np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))
        order = np.argsort(self.indices, kind="stable")
        return Csr(np.concatenate([[0], np.cumsum(np.bincount(self.indices, minlength=self.columns))]), rows[order], len(self.indptr) - 1)


def incidence(sizes: np.ndarray) -> Csr:
    """Tokens by bytes: token i has the sizes[i] bytes after those of the tokens before it."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return Csr(ends, np.arange(ends[-1]), int(ends[-1]))


def members(groups: np.ndarray, n_groups: int) -> Csr:
    """Tokens by groups: token i is in groups[i] alone."""
    return Csr(np.arange(len(groups) + 1), groups, n_groups)


def product_sizes(a: Csr, b: Csr) -> np.ndarray:
    """How many terms each row of the product a b has, before equal columns meet."""
    terms = np.concatenate([[0], np.cumsum(np.diff(b.indptr)[a.indices])])
    return np.diff(terms[a.indptr])


def product(a: Csr, b: Csr, block: int = BLOCK_ROWS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The product a b row by row: row i is the sum of b's rows that a's row i names. In blocks of rows: row, column, value."""
    sizes = np.diff(b.indptr)
    for at in range(0, len(a.indptr) - 1, block):
        ptr = a.indptr[at : at + block + 1]
        named = a.indices[ptr[0] : ptr[-1]]
        n = sizes[named]
        rows = np.repeat(np.repeat(np.arange(at, at + len(ptr) - 1), np.diff(ptr)), n)
        key = rows * b.columns + b.indices[ragged(b.indptr[named], n)]
        if len(key) and (key[1:] >= key[:-1]).all():  # as it is for rows that follow each other
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            key, value = key[first], np.diff(np.append(first, len(key)))
        else:
            key, value = np.unique(key, return_counts=True)
        yield key // max(b.columns, 1), key % max(b.columns, 1), value


class ByteLevel:
    """Byte-level tokenizer A. Where a file numbers its entries in the order of their merges, its pieces go to a faster library with the same ids."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        place = {x: i for i, x in enumerate(byte_letters())}
        vocab = {bytes(place[x] for x in entry): i for entry, i in spec["model"]["vocab"].items()}
        self.bytes = [b""] * self.library.get_vocab_size()
        for entry, i in vocab.items():
            self.bytes[i] = entry
        made = [vocab[bytes(place[x] for x in "".join(m if isinstance(m, list) else m.split(" ")))] for m in spec["model"]["merges"]]
        in_order = made == list(range(256, 256 + len(made))) and spec["normalizer"] is None and spec["pre_tokenizer"]["type"] == "ByteLevel" and spec["pre_tokenizer"]["use_regex"]
        self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab, special_tokens={}) if in_order else None

    def ids(self, piece: str) -> np.ndarray:
        if self.ranks and known(piece):
            return np.array(self.ranks.encode_ordinary(piece), dtype=np.int64)
        return np.array(self.library.encode_batch_fast([piece], add_special_tokens=False)[0].ids, dtype=np.int64)


class Pieces:
    """Tokenizer B of a sentencepiece model, which puts a space before a text by itself."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        ids = range(self.library.get_piece_size())
        of = self.library.id_to_piece
        self.bytes = [b"" if self.library.is_control(i) or self.library.is_unknown(i) else bytes([int(of(i)[3:-1], 16)]) if self.library.is_byte(i) else of(i).replace("▁", " ").encode() for i in ids]
        if any(b" " in b.lstrip(b" ") for b in self.bytes):
            raise ValueError(f"{path}: pieces with a space after other characters can't be cut at spaces")

    def ids(self, texts: list[str]) -> np.ndarray:
        """Of texts that begin with the space, one after the other."""
        return np.array(list(chain.from_iterable(self.library.encode([t[1:] for t in texts], num_threads=1))), dtype=np.int64)


class Aligned(NamedTuple):
    """Tokens of both sides over the same bytes: ids, groups, places of end links, and overlap links as (row, column, shared bytes)."""

    a: np.ndarray
    b: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    end_a: np.ndarray
    end_b: np.ndarray
    overlaps: list[tuple[np.ndarray, np.ndarray, np.ndarray]]


class Segments:
    """What is known of segments by number: sizes as columns of ``n`` (A tokens, B tokens, end links, overlap links, pairs of a group), whether both sides give its bytes, pairs and groups."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.n, self.sound, self.groups = np.zeros((0, 5), dtype=np.int64), np.zeros(0, dtype=bool), []
        self.pairs, self.ends = np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64)

    def add(self, names: list[str], n: np.ndarray, sound: np.ndarray, groups: list[str], pairs: np.ndarray) -> None:
        self.number.update(zip(names, range(len(self.number), len(self.number) + len(names)), strict=True))
        self.n, self.sound, self.pairs = np.concatenate([self.n, n]), np.concatenate([self.sound, sound]), np.concatenate([self.pairs, pairs])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(n[:, 2])])
        self.groups += groups


class Digest:
    """The row of a text, from its segments."""

    def __init__(self) -> None:
        self.n, self.sound, self.sha, self.first = np.zeros(5, dtype=np.int64), True, hashlib.sha256(), True
        self.pairs, self.times = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def add(self, known_ones: Segments, at: np.ndarray) -> None:
        self.sound = self.sound and bool(known_ones.sound[at].all())
        if not self.sound:
            return
        self.n += known_ones.n[at].sum(axis=0)
        self.sha.update((("" if self.first else ";") + ";".join([known_ones.groups[i] for i in at.tolist()])).encode())
        self.first = False
        found = known_ones.pairs[ragged(known_ones.ends[at], known_ones.n[at, 2])]
        found, times = np.unique(found, return_counts=True)
        if len(self.pairs):
            found, which = np.unique(np.concatenate([self.pairs, found]), return_inverse=True)
            times = np.bincount(which, weights=np.concatenate([self.times, times])).astype(np.int64)
        self.pairs, self.times = found, times

    def row(self) -> tuple:
        if self.first or not self.sound:
            return 0, 0, 0, 0, "", 0, 0, [], []
        n_a, n_b, n_links, n_overlaps, n_shared = self.n.tolist()
        return n_a, n_b, n_links, n_links, self.sha.hexdigest(), n_overlaps, n_shared, self.pairs, self.times


class Aligner:
    """Both tokenizers in one worker. Segments met lately are kept."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t.bytes], dtype=np.int64) for t in (self.a, self.b))
        self.names = [[f"{i}{mark}" for i in range(max(len(self.a_sizes), len(self.b_sizes)))] for mark in ",|;"]
        self.kept = Segments()

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Of texts that begin with the space, one after the other; None if the tokens' bytes are not theirs."""
        text = "".join(texts)
        want, out = text.encode(), (self.a.ids(text), self.b.ids(texts))
        same = all(b"".join(map(side.bytes.__getitem__, ids.tolist())) == want for side, ids in zip((self.a, self.b), out, strict=True))
        return out if same else None

    def align(self, a: np.ndarray, b: np.ndarray) -> Aligned:
        """Tokens that cover the same bytes."""
        by_byte = [incidence(self.a_sizes[a]), incidence(self.b_sizes[b])]
        last = [m.indptr[1:] for m in by_byte]
        overlaps = list(product(by_byte[0], by_byte[1].transpose()))
        together = [(i[same], j[same]) for i, j, _ in overlaps if len(same := np.flatnonzero(last[0][i] == last[1][j]))]
        end_a, end_b = (np.concatenate(x) for x in zip(*together, strict=True))
        group = [np.searchsorted(ends, np.arange(len(m)), side="left") for ends, m in ((end_a, a), (end_b, b))]
        return Aligned(a, b, group[0], group[1], end_a, end_b, overlaps)

    def written(self, x: Aligned) -> list[str]:
        """Each token's id and mark, A's of a group before B's: a1, a2| b1; a3| b2, b3;"""
        n_a, n_b = len(x.a), len(x.b)
        mark_a, mark_b = np.zeros(n_a, dtype=np.int64), np.zeros(n_b, dtype=np.int64)
        mark_a[x.end_a], mark_b[x.end_b] = 1, 2
        code = np.empty(n_a + n_b, dtype=np.int64)
        code[np.arange(n_a) + np.concatenate([[0], x.end_b + 1])[x.a_group]] = x.a * 3 + mark_a
        code[np.arange(n_b) + (x.end_a + 1)[x.b_group]] = x.b * 3 + mark_b
        names = self.names
        return [names[c % 3][c // 3] for c in code.tolist()]

    def learn(self, segments: list[str]) -> None:
        """Aligns new segments, together where they can stand in one text: each begins and ends with a token of both sides."""
        plain = [x for x in segments if x and not x[0].isspace() and not x[-1].isspace()]
        if plain and (found := self.tokens([" " + " ".join(plain[i : i + AT_ONCE]) for i in range(0, len(plain), AT_ONCE)])):
            self._learn(plain, found)
        else:
            plain = []
        for x in segments if not plain else [x for x in segments if x not in self.kept.number]:
            self._learn([x], self.tokens([" " + x]))

    def _learn(self, segments: list[str], found: tuple[np.ndarray, np.ndarray] | None) -> None:
        if found is None:
            self.kept.add(segments, np.zeros((len(segments), 5), dtype=np.int64), np.zeros(len(segments), dtype=bool), [""] * len(segments), np.zeros(0, dtype=np.int64))
            return
        x = self.align(*found)
        byte_ends = np.cumsum([1 + len(s.encode()) for s in segments])
        ends = [1 + np.searchsorted(np.cumsum(sizes[ids]), byte_ends) for sizes, ids in zip((self.a_sizes, self.b_sizes), found, strict=True)]
        sizes = np.column_stack([np.diff(e, prepend=0) for e in ends])
        of_a = np.repeat(np.arange(len(segments)), sizes[:, 0])
        groups = [members(x.a_group, len(x.end_a)), members(x.b_group, len(x.end_b))]
        count = lambda owner, weights=None: np.bincount(owner, weights=weights, minlength=len(segments)).astype(np.int64)
        n = np.column_stack([sizes, count(of_a[x.end_a]), sum(count(of_a[i]) for i, _, _ in x.overlaps), count(of_a, product_sizes(groups[0], groups[1].transpose()))])
        names, at = self.written(x), (ends[0] + ends[1]).tolist()
        texts = ["".join(names[start:end])[:-1] for start, end in zip([0, *at], at, strict=False)]
        self.kept.add(segments, n, np.ones(len(segments), dtype=bool), texts, x.a[x.end_a] * len(self.b_sizes) + x.b[x.end_b])

    def digests(self, texts: Iterable[str | None]) -> list[tuple]:
        """The rows of DIGEST."""
        texts = [t or "" for t in texts]
        out, held, chars = [Digest() for _ in texts], [], 0
        for digest, text in zip(out, texts, strict=True):
            for piece in spaced(text):
                held.append((digest, CUT.split(piece)))
                chars += len(piece)
                if chars > BATCH_CHARS:
                    self._settle(held)
                    held, chars = [], 0
        self._settle(held)
        return [d.row() for d in out]

    def _settle(self, held: list[tuple[Digest, list[str]]]) -> None:
        if len(self.kept.number) > KEPT_SEGMENTS or len(self.kept.pairs) > 8 * KEPT_SEGMENTS:
            self.kept = Segments()
        number = self.kept.number
        if new := [s for s in set().union(*(segments for _, segments in held)) if s not in number]:
            self.learn(new)
        for digest, segments in held:
            digest.add(self.kept, np.fromiter(map(number.__getitem__, segments), dtype=np.int64, count=len(segments)))


def spaced(text: str) -> Iterator[str]:
    """A text in pieces of about PIECE characters, cut at (and without) places of CUT."""
    at = 0
    while at < len(text):
        found = CUT.search(text, at + PIECE) if at + PIECE < len(text) else None
        yield text[at : found.start() if found else len(text)]
        at = found.end() if found else len(text)


@cache
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _paths(a_path: str | None, b_path: str | None) -> tuple[str, str]:
    return a_path or public_tokenizers.path(BYTE_BPE), b_path or public_tokenizers.path(PIECE_BPE)


def pair_bound(a_bytes: Iterable[bytes], b_bytes: Iterable[bytes]) -> int:
    """How many pairs of ids can end together: one token's bytes end the other's."""
    sides = [{}, {}]
    for of, tokens in zip(sides, (a_bytes, b_bytes), strict=True):
        for t in tokens:
            of[t] = of.get(t, 0) + bool(t)
    suffixes = lambda one, other, least: sum(n * other.get(t[i:], 0) for t, n in one.items() for i in range(least, len(t)))
    return suffixes(sides[0], sides[1], 0) + suffixes(sides[1], sides[0], 1)


def digests(text: Column, a_path: str | None = None, b_path: str | None = None) -> Column:
    """A struct of DIGEST. pairs are A id * (B's number of ids) + B id of the end links, each once, and times how often."""
    a_path, b_path = _paths(a_path, b_path)

    @F.pandas_udf(DIGEST)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in DIGEST.split(", ")]
        for texts in batches:
            yield pd.DataFrame(aligner(a_path, b_path).digests(texts), columns=names)

    return of(text)


def pair_counts(digested: DataFrame, n_b: int) -> DataFrame:
    """pair, n (end links of the corpus) and best: whether n is the highest of the pair's B id."""
    counted = digested.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))
    counted = materialise(counted, "pair-counts")
    highest = counted.groupBy(F.pmod("pair", F.lit(n_b)).alias("b")).agg(F.max("n").alias("most"))
    return counted.withColumn("b", F.pmod("pair", F.lit(n_b))).join(highest, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def links(docs: DataFrame, kinds: tuple[str, ...] = ("end", "overlap"), *, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """A row per link: id_col, kind, places and ids of both tokens, and the bytes they share (null for kind group).

    Kind group has all pairs of a group, as many as the product of its sizes; they are made in blocks of rows.
    """
    a_path, b_path = _paths(a_path, b_path)
    kind_of = docs.schema[id_col].dataType.simpleString()
    light_batches(docs.sparkSession)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = aligner(a_path, b_path)

        def out(row_id: object, kind: str, x: Aligned, i: np.ndarray, j: np.ndarray, value: object, at: tuple[int, int]) -> pd.DataFrame:
            return pd.DataFrame({"id": pd.Series([row_id] * len(i), dtype=object), "kind": kind, "a_place": i + at[0], "b_place": j + at[1], "a_id": x.a[i], "b_id": x.b[j], "n_bytes": value})

        for batch in batches:
            for row_id, text in zip(batch["id"].tolist(), batch["text"].tolist(), strict=True):
                found = [both.tokens([" " + piece]) for piece in spaced(text or "")]
                at = (0, 0)
                for a, b in found if all(x is not None for x in found) else []:
                    x = both.align(a, b)
                    for i, j, value in x.overlaps if "overlap" in kinds else []:
                        yield out(row_id, "overlap", x, i, j, value, at)
                    if "end" in kinds:
                        shared = np.minimum(both.a_sizes[x.a[x.end_a]], both.b_sizes[x.b[x.end_b]])
                        yield out(row_id, "end", x, x.end_a, x.end_b, shared, at)
                    if "group" in kinds:
                        for i, j, _ in product(members(x.a_group, len(x.end_a)), members(x.b_group, len(x.end_b)).transpose(), 1 << 10):
                            yield out(row_id, "group", x, i, j, None, at)
                    at = (at[0] + len(x.a), at[1] + len(x.b))

    pairs = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    made = pairs.mapInPandas(rows, "id string, kind string, a_place long, b_place long, a_id long, b_id long, n_bytes long")
    return made.select(F.col("id").cast(kind_of).alias(id_col), *made.columns[1:])


def query(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    light_batches(spark)
    a_path, b_path = _paths(a_path, b_path)
    digested = materialise(docs.select("doc_id", digests(F.col("text"), a_path, b_path).alias("x")).select("doc_id", "x.*"), "token-links")
    both = aligner(a_path, b_path)
    counted = pair_counts(digested, len(both.b_sizes)).toPandas().sort_values("pair")  # of pair_bound rows at most, whatever the corpus
    if len(counted) > pair_bound(both.a.bytes, both.b.bytes):
        raise RuntimeError("more pairs of ids end together than the vocabularies allow")
    shared = spark.sparkContext.broadcast((counted["pair"].to_numpy("int64"), counted["n"].to_numpy("int64"), counted["best"].to_numpy("bool")))

    @F.pandas_udf("n_best long, count_sum long")
    def scored(pairs: pd.Series, times: pd.Series) -> pd.DataFrame:
        pair, n, best = shared.value
        out = []
        for p, t in zip(pairs, times, strict=True):
            at = np.searchsorted(pair, p)
            out.append((int(t[best[at]].sum()), int((t * n[at]).sum())) if len(p) else (0, 0))
        return pd.DataFrame(out, columns=["n_best", "count_sum"])

    found = digested.select("doc_id", "n_a", "n_b", "n_groups", "n_links", scored("pairs", "times").alias("y"), "groups_sha256", "n_overlaps", "n_shared")
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "y.n_best", "y.count_sum", "groups_sha256", "n_overlaps", "n_shared")
