"""Token counts of whole texts under a byte-pair vocabulary, by merging arrays of pre-tokens rank by rank.

The words of a batch of texts that a worker has not met lately are held as one ragged array of symbols. In each round every
sequence finds its lowest-ranked pair and merges all its places at once, from the left where they overlap; sequences without
a pair in the table leave with the number of symbols that survive. Where no entry of the vocabulary holds two neighbouring
symbols, no merge ever crosses them, so a long word is cut there first. The rounds of a sequence are at most the different
pairs that it merges, so a task holds some arrays of its longest word.

The file is read for its own rules: pattern of pre-tokens, lower-casing, composed characters, mark of word ends, special
strings. Texts are normalised and split by regular expressions; pieces with code points that this Python's Unicode tables
don't know yet go through the library's normaliser and splitter, whose tables are newer.

Rows: each row of the input gives one row, repeated rows and null ids too. A null text counts as an empty one, without
tokens. Special strings inside texts are one token each. Very long texts are split at blanks into pieces of some 256K
characters, and no pre-token crosses a blank. Rows are counted one by one, so there are no ties. Other columns, whatever
their names, are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain, islice

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PIECE, light_batches, pieces

WORD_BPE = "word_bpe_49k.json"
NEVER = np.int64(1) << 40
#: Words that a worker remembers, and their longest; characters of a batch of words; words taken at once from a text without blanks.
KEPT, KEPT_CHARS, BATCH_CHARS, AT_ONCE = 1 << 18, 64, 1 << 20, 1 << 17
ASCII_BLANK = re.compile("[ \t\n\r]")


@cache
def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level files: printable bytes for themselves, the others from U+0100 on, in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


@cache
def _assigned(ch: str) -> bool:
    return unicodedata.category(ch) != "Cn"


def known(piece: str) -> bool:
    """Whether this Python's Unicode tables have all characters of the piece."""
    return piece.isascii() or all(map(_assigned, set(piece)))


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... (sizes[i] of them) for each i, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Merges:
    """The pair table of a byte-level file with marks of word ends, as arrays."""

    def __init__(self, vocab: dict[str, int], merges: list[list[str]], suffix: str) -> None:
        self.size = max(vocab.values(), default=0) + 1
        pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], dtype=np.int64).reshape(-1, 3)
        keys = pairs[:, 0] * self.size + pairs[:, 1]
        self.rank_of = np.argsort(keys, kind="stable")
        self.keys, self.made = keys[self.rank_of], pairs[:, 2]
        letters = byte_letters()
        self.inside = np.array([vocab[x] for x in letters], dtype=np.int64)
        self.last = np.array([vocab[x + suffix] for x in letters], dtype=np.int64)
        # Which bytes stand next to each other in an entry, by themselves and at its end.
        place = {x: i for i, x in enumerate(letters)}
        self.meet = np.zeros((2, 256, 256), dtype=bool)
        for entry in vocab:
            ends = bool(suffix) and entry.endswith(suffix)
            b = [place[x] for x in (entry.removesuffix(suffix) if ends else entry) if x in place]
            for i in range(len(b) - 1):
                self.meet[int(ends and i == len(b) - 2), b[i], b[i + 1]] = True

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        return np.where(self.keys[at] == keys, self.rank_of[at], NEVER) if len(self.keys) else np.full(len(keys), NEVER)

    def surviving(self, words: list[bytes]) -> np.ndarray:
        """How many symbols each word, of one byte or more, has in the end."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        ends = np.cumsum(sizes)
        symbols, final = self.inside[data], np.zeros(len(data), dtype=bool)
        final[ends - 1] = True
        symbols[final] = self.last[data[final]]
        word = np.repeat(np.arange(len(words)), sizes)
        # A sequence ends with its word, and wherever two symbols meet in no entry.
        over = final.copy()
        over[:-1] |= ~self.meet[final[1:].astype(np.int8), data[:-1], data[1:]]
        first = np.concatenate([[True], over[:-1]])
        rank = np.full(len(data), NEVER)
        inner = np.flatnonzero(~over)
        rank[inner] = self.ranks(symbols[inner], symbols[inner + 1])
        out = np.zeros(len(words), dtype=np.int64)
        while len(symbols):
            starts = np.flatnonzero(first)
            lowest = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.append(starts, len(symbols)))
            done = lowest == NEVER
            np.add.at(out, word[starts[done]], lengths[done])
            live = np.repeat(~done, lengths)
            symbols, word, first, rank, low = symbols[live], word[live], first[live], rank[live], np.repeat(lowest, lengths)[live]
            at = np.flatnonzero(rank == low)
            if not len(at):
                break
            # Neighbouring places of one pair (x, x) overlap: of such a streak every other one is merged, from its first on.
            fresh = np.concatenate([[True], np.diff(at) > 1])
            at = at[(np.arange(len(at)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            rank[at] = rank[at + 1]
            stay = np.ones(len(symbols), dtype=bool)
            stay[at + 1] = False
            # What now follows a merged symbol, or comes before it, makes a new pair. A sequence's end is where the next begins.
            merged = np.zeros(len(symbols), dtype=bool)
            merged[at] = True
            symbols, word, first, rank, merged = symbols[stay], word[stay], first[stay], rank[stay], merged[stay]
            last = np.append(first[1:], True)
            changed = np.flatnonzero((merged | np.append(merged[1:], False)) & ~last)
            rank[last] = NEVER
            rank[changed] = self.ranks(symbols[changed], symbols[changed + 1])
        return out


class WordCounter:
    """Counts tokens under a file of words with end marks; one per worker and file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = Merges(model["vocab"], merges, model["end_of_word_suffix"] or "")
        plain = [x["type"] for x in spec["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"] and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"])
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if not plain or split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError(f"{path}: only files of lower-cased, composed words that a pattern finds are counted")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.library = Tokenizer.from_file(path)
        self.letters = {x: i for i, x in enumerate(byte_letters())}
        self.kept: dict[str, int] = {}

    def words(self, piece: str) -> Iterator[list[str]]:
        """The pre-tokens of a piece, a bounded number at a time."""
        if known(piece):
            found = self.pattern.finditer(unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()) if len(piece) > 2 * PIECE else None
            if found is None:
                yield self.pattern.findall(unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower())
            else:
                while some := [m.group() for m in islice(found, AT_ONCE)]:
                    yield some
        else:
            parts = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))
            yield [bytes(self.letters[x] for x in part).decode() for part, _ in parts]

    def parts(self, text: str) -> Iterator[str]:
        return chain.from_iterable(pieces(part, blank=ASCII_BLANK) for part in (self.special.split(text) if self.special else [text]) if part)

    def counts(self, texts: Iterable[str | None]) -> list[int]:
        texts = [t or "" for t in texts]
        out = [len(self.special.findall(t)) if self.special else 0 for t in texts]
        held: list[tuple[int, list[str]]] = []
        chars = 0
        for i, text in enumerate(texts):
            for part in self.parts(text):
                for words in self.words(part):
                    held.append((i, words))
                    chars += sum(map(len, words)) if len(part) > PIECE else len(part)
                    if chars > BATCH_CHARS:
                        self._settle(held, out)
                        held, chars = [], 0
        self._settle(held, out)
        return out

    def _settle(self, held: list[tuple[int, list[str]]], out: list[int]) -> None:
        """Adds the tokens of held words to their texts' counts."""
        new = [w for w in set().union(*(words for _, words in held)) if w not in self.kept]
        self.kept.update(zip(new, self.merges.surviving([w.encode() for w in new]).tolist(), strict=True) if new else [])
        for i, words in held:
            out[i] += sum(map(self.kept.__getitem__, words))
        if len(self.kept) > KEPT:
            self.kept.clear()
        else:
            for w in new:
                if len(w) > KEPT_CHARS:
                    del self.kept[w]


@cache
def counter(path: str) -> WordCounter:
    return WordCounter(path)


def token_counts(text: Column, path: str | None = None) -> Column:
    """Tokens of a text under the file at path, a folder that all workers have."""
    path = path or public_tokenizers.path(WORD_BPE)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(counter(path).counts(texts), dtype="int64")

    return count(text)


def query(docs: DataFrame, limit: int = 2048) -> DataFrame:
    light_batches(docs.sparkSession)
    out = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), token_counts(F.col("text")).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
