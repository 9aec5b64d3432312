"""Tokenizers as column functions: text to tokens, tokens to ids, and back. Other libraries plug in as callables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import vocab
from . import text as T


class Tokenizer(Protocol):
    def tokens(self, text: Column) -> Column: ...
    def ids(self, tokens: Column) -> Column: ...
    def from_ids(self, ids: Column) -> Column: ...
    def text(self, tokens: Column) -> Column: ...


class _WithVocab:
    def __init__(self, vocabulary: dict[str, int], unk: str = "<unk>") -> None:
        self.vocabulary, self.unk = vocabulary, unk

    def ids(self, tokens: Column) -> Column:
        return vocab.encode(tokens, self.vocabulary, self.unk)

    def from_ids(self, ids: Column) -> Column:
        return vocab.decode(ids, self.vocabulary)


class CharTokenizer(_WithVocab):
    """Characters, with bracketed symbols whole if asked for."""

    def __init__(self, vocabulary: dict[str, int], unk: str = "<unk>", symbols: bool = False, split_with_space: bool = False, joiner: str = "") -> None:
        super().__init__(vocabulary, unk)
        self.symbols, self.split_with_space, self.joiner = symbols, split_with_space, joiner

    def tokens(self, text: Column) -> Column:
        return T.char_tokens(text, self.symbols, self.split_with_space)

    def text(self, tokens: Column) -> Column:
        return T.detokenize(tokens, self.joiner)


class SegmentTokenizer(_WithVocab):
    """CJK characters, and other words as a dictionary's pieces."""

    def __init__(self, vocabulary: dict[str, int], pieces: dict[str, str], unk: str = "<unk>") -> None:
        super().__init__(vocabulary, unk)
        self.pieces = pieces

    def tokens(self, text: Column) -> Column:
        return vocab.segment(text, self.pieces)

    def text(self, tokens: Column) -> Column:
        return T.beautify(tokens)


class LibraryTokenizer(_WithVocab):
    """A library's tokenizer: load() gives a function of a text to its pieces, once in each worker."""

    def __init__(self, vocabulary: dict[str, int], load: Callable[[], Callable[[str], list[str]]], unk: str = "<unk>", clean: bool = True) -> None:
        super().__init__(vocabulary, unk)
        self.load, self.clean = load, clean

    def tokens(self, text: Column) -> Column:
        load = self.load

        @F.pandas_udf("array<string>")
        def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            cut = load()
            for texts in batches:
                yield pd.Series([cut(t) if t is not None else None for t in texts], dtype=object)

        return split(T.clean_for_subword(text) if self.clean else text)

    def text(self, tokens: Column) -> Column:
        return T.detokenize(tokens)


KINDS: dict[str, Callable[..., Tokenizer]] = {"char": CharTokenizer, "segment": SegmentTokenizer, "library": LibraryTokenizer}


def tokenizer(kind: str, **conf: Any) -> Tokenizer:
    return KINDS[kind](**conf)


def phrases(texts: Column, by: Tokenizer) -> tuple[Column, Column]:
    """Nested tokens and ids of an array of phrases."""
    return F.transform(texts, by.tokens), F.transform(texts, lambda p: by.ids(by.tokens(p)))


def has_prefix(name: Column, prefixes: Column) -> Column:
    """Whether a name starts with any of an array's prefixes."""
    return F.exists(prefixes, lambda p: name.startswith(p))


def unmatched_prefixes(names: Column, prefixes: Column) -> Column:
    """The prefixes that no name of an array starts with."""
    return F.filter(prefixes, lambda p: ~F.exists(names, lambda n: n.startswith(p)))
