"""Helpers that the corpus operators share: row keys, joins on hot keys, and words and their hashes in numpy."""

from __future__ import annotations

import re
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stage import materialise, stage_path
from ..functions.text import bind as let

__all__ = ["WORD", "is_word", "code_points", "let", "light_batches", "materialise", "mix", "pieces", "row_hash", "row_key", "spread_join", "stage_path", "table", "word_hashes"]

#: Runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: A key is hot if it has more than one in so many rows, so there are at most so many hot keys.
HOT_KEYS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def light_batches(spark: SparkSession) -> None:
    """Few rows at a time to Python workers of this session, as a row may be a whole text: a worker then holds some MB."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def row_key(*cols: Column) -> list[Column]:
    """Two 64-bit hashes: rows that agree in cols agree in them, and others don't in practice."""
    return [F.xxhash64(F.lit(1), *cols).alias("key_a"), F.xxhash64(F.lit(2), *cols).alias("key_b")]


def row_hash(docs: DataFrame, row: Column | None = None) -> Column:
    """A hash of all columns that can be hashed, of docs or of a struct that has its columns."""
    return F.xxhash64(*[F.col(f"`{c}`") if row is None else row[c] for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])


def spread_join(left: DataFrame, right: DataFrame, on: list[str], hot: DataFrame, by: Column, how: str = "inner", salts: int = 64) -> DataFrame:
    """left joined with right on the columns ``on``. The rows of a hot key are dealt by ``by`` to ``salts`` tasks, each of which gets right's rows of that key.

    hot has the hot keys as columns ``on``, some HOT_KEYS of them at most, so their hashes are part of the plan. A key that
    shares its hash with a hot one is dealt alike.
    """
    hashes = [r[0] for r in hot.select(F.xxhash64(*on)).collect()]
    is_hot = F.xxhash64(*on).isin(hashes or [0])
    dealt = left.withColumn("_deal", F.when(is_hot, F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).otherwise(0))
    spread = right.withColumn("_deal", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(spread, [*on, "_deal"], how).drop("_deal")


@cache
def _alnum(more: str) -> np.ndarray:
    out = np.fromiter((chr(i).isalnum() for i in range(0x110000)), dtype=bool, count=0x110000)
    out[[ord(ch) for ch in more]] = True
    return out


def is_word(c: np.ndarray, more: str = "") -> np.ndarray:
    """Which code points are letters or digits, or in more."""
    return _alnum(more)[c]


def mix(x: np.ndarray) -> np.ndarray:
    """A well-mixed hash of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


PIECE = 1 << 18
_BLANK = re.compile(r"\s")
STEP = 0x9E3779B97F4A7C15


@cache
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP to the powers from 0, and its inverse to the same powers, mod 2 ** 64."""
    out = []
    for base in (STEP, pow(STEP, -1, 1 << 64)):
        p = np.full(size, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def pieces(text: str, size: int = PIECE, blank: re.Pattern = _BLANK) -> list[str]:
    """A text in pieces of about ``size`` characters that end at blanks, so that a worker's arrays stay small however long it is."""
    out, at = [], 0
    while at < len(text):
        found = blank.search(text, at + size - 1) if at + size < len(text) else None
        end = found.end() if found else len(text)
        out.append(text[at:end])
        at = end
    return out


def word_hashes(c: np.ndarray, more: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes, starts and ends of the runs of letters, digits and ``more`` in code points."""
    word = np.zeros(len(c) + 2, dtype=bool)
    word[1:-1] = is_word(c, more)
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    size = 1 << max(10, len(c).bit_length())
    up, down = powers(size)
    sums = np.zeros(len(c) + 1, dtype=np.uint64)
    np.cumsum((c + np.uint64(1)) * up[: len(c)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts, ends
