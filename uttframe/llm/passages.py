"""Substring dedup by hashing normalised units: the earliest ranked occurrence stays, the rest is removed.

Words are lower-cased and without punctuation. Two kinds of units have 64-bit digests: whole lines and paragraphs (lines
between lines without words) of any length, and grams of GRAM words wherever they stand. Of each WINDOW grams in a row the one of
least hash is taken (winnowing), so that equal passages of GRAM + WINDOW - 1 words share a gram, whatever line ends,
punctuation and text are around. Digests are grouped over the corpus and each keeps its earliest occurrence, ranked by id
(nulls last), then by the row's hash, then by position.

Every later occurrence of a line or paragraph that has a word is removed. Later grams that touch form runs. The first and
last gram of a run are compared word by word with what surrounds their first occurrence: a passage goes on for less than
WINDOW words beyond its outermost common gram, so that many words on each side give its exact ends. A run is removed if it has at
least ``min_words`` words then (GRAM + WINDOW - 1 at least); shorter ones are chance phrases and stay, unless they are lines.
Offsets of removed spans are code points of the original text.

Only texts that hold a repeated unit, or a first occurrence of one, have their words compared. Digests that very many rows
share are dealt to several tasks. Very long texts are hashed in pieces; a worker holds the word hashes of one text.

A null text counts as an empty one. Rows that agree in id and text are one occurrence: all of them keep what the first
keeps, and each gets its row of the result; ties of rank do not arise otherwise. An empty table gives an empty table. Other
columns, whatever their names, are ignored by ``query`` and kept by ``drop_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import takewhile

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import HOT_KEYS, code_points, light_batches, materialise, mix, pieces, row_key, spread_join, word_hashes

GRAM = WINDOW = 12
STEP = np.uint64(0x9E3779B97F4A7C15)
POWERS = [np.uint64(pow(int(STEP), n, 1 << 64)) for n in (1, 2, 4)]
BROADCAST_ROWS = 1_000_000
PLACES = 4  # a unit's number is PLACES times its first word, plus 0 for a gram, 1 for a line, 2 for a paragraph


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts)


def _pack(x: np.ndarray) -> bytes:
    return x.astype(np.uint8 if x.max(initial=0) < 256 else np.uint32).tobytes()


def _unpack(x: bytes, n: int) -> np.ndarray:
    return np.frombuffer(x, dtype=np.uint8 if len(x) == n else np.uint32).astype(np.int64)


def _grams(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams taken: those that are the least of some WINDOW in a row."""
    if len(h) < GRAM + WINDOW - 1:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    pairs = h[:-1] * POWERS[0] + h[1:]
    fours = pairs[:-2] * POWERS[1] + pairs[2:]
    eights = fours[:-4] * POWERS[2] + fours[4:]
    g = mix(eights[:-4] * POWERS[2] + fours[8:])
    least = g
    for shift in (1, 2, 4, 4):
        least = np.minimum(least[:-shift], least[shift:])
    most = np.concatenate((np.zeros(WINDOW - 1, dtype=np.uint64), least, np.zeros(WINDOW - 1, dtype=np.uint64)))
    for shift in (1, 2, 4, 4):
        most = np.maximum(most[:-shift], most[shift:])
    at = np.flatnonzero(g == most)
    return at, g[at]


def _words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of a text's words, and the line that each is in."""
    low = text.lower()
    if len(low) != len(text):  # some capitals have longer lower forms: these stay, so that offsets hold
        low = "".join(x if len(x) == 1 else y for x, y in ((ch.lower(), ch) for ch in text))
    found, at, line = [], 0, 0
    for piece in pieces(low):
        c = code_points(piece)
        h, starts, ends = word_hashes(c)
        breaks = np.flatnonzero(c == 10)
        found.append((h, starts + at, ends + at, np.searchsorted(breaks, starts) + line))
        at, line = at + len(c), line + len(breaks)
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _units(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests, numbers and word counts of the units of a text."""
    h, _, _, line = _words(text)
    n = len(h)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    at, grams = _grams(h)
    digests, numbers, sizes = [grams], [at * PLACES], [np.full(len(at), GRAM)]
    new = np.append(0, np.diff(line))
    first = None
    for kind, begins in ((1, new > 0), (2, new > 1)):
        begins[0] = True
        lines, first = first, np.flatnonzero(begins)
        size = np.diff(np.append(first, n))
        digest = mix(_sums(mix(h + (np.arange(n) - np.repeat(first, size)).astype(np.uint64) * STEP), first))
        if lines is not None:  # a paragraph of one line is that line
            several = np.diff(np.append(np.searchsorted(lines, first), len(lines))) > 1
            first, size, digest = first[several], size[several], digest[several]
        digests.append(digest)
        numbers.append(first * PLACES + kind)
        sizes.append(size)
    return np.concatenate(digests).view(np.int64), np.concatenate(numbers), np.concatenate(sizes)


def _table(text: str) -> tuple[bytes, bytes, bytes]:
    """Hashes and lengths of a text's words, and the gaps before them."""
    h, starts, ends, _ = _words(text)
    return (h >> np.uint64(32)).astype(np.uint32).tobytes(), _pack(ends - starts), _pack(starts - np.append(0, ends[:-1])) if len(h) else b""


def _each(f, schema: str):
    """f of a text as a column function."""

    @F.pandas_udf(schema)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [x.split(" ")[0] for x in schema.split(", ")]
        for texts in batches:
            yield pd.DataFrame([f(t or "") for t in texts], columns=names)

    return of


UNITS = "digests array<long>, numbers array<int>, sizes array<int>"
WORDS = "words binary, lengths binary, gaps binary"


def around():
    """The words on both sides of grams."""

    @F.pandas_udf("array<struct<number:int,before:binary,after:binary>>")
    def sides(words: pd.Series, numbers: pd.Series) -> pd.Series:
        side, out = 4 * (WINDOW - 1), []
        for w, ns in zip(words, numbers, strict=True):
            ats = [(int(n), 4 * (int(n) // PLACES)) for n in ns]
            out.append([(n, w[max(0, at - side) : at], w[at + 4 * GRAM : at + 4 * GRAM + side]) for n, at in ats])
        return pd.Series(out)

    return sides


HITS = "array<struct<number:int,size:int,opens:boolean,closes:boolean,before:binary,after:binary>>"
SPANS = "array<struct<start:int,end:int,words:int>>"


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _same(a: bytes, b: bytes, step: int) -> int:
    """How many words agree, from the front (step 1) or from the back (-1)."""
    pairs = zip(np.frombuffer(a, dtype=np.uint32)[::step], np.frombuffer(b, dtype=np.uint32)[::step], strict=False)
    return sum(1 for _ in takewhile(lambda x: x[0] == x[1], pairs))


def _spans(words: bytes, hits: list[dict], min_words: int) -> list[tuple[int, int]]:
    """Word spans to remove, from the later lines and the outermost later grams of runs, with what is around their first occurrences."""
    side, lines, found, start = 4 * (WINDOW - 1), [], [], 0
    for x in sorted(hits, key=lambda x: (x["number"], not x["opens"])):
        at = x["number"] // PLACES
        if x["number"] % PLACES:
            lines.append((at, at + x["size"]))
            continue
        if x["opens"]:
            start = at - _same(words[max(0, 4 * at - side) : 4 * at], x["before"], -1)
        if x["closes"]:
            end = at + GRAM
            found.append((start, end + _same(words[4 * end : 4 * end + side], x["after"], 1)))
    return _joined(lines + [(a, b) for a, b in _joined(found) if b - a >= min_words])


def runs(min_words: int):
    """From the words of a text and the units of it that occurred before: spans to remove."""

    @F.pandas_udf(SPANS)
    def find(words: pd.Series, lengths: pd.Series, gaps: pd.Series, hits: pd.Series) -> pd.Series:
        out = []
        for w, n, g, x in zip(words, lengths, gaps, hits, strict=True):
            spans = _spans(w, list(x), min_words) if len(x) else []
            if spans:
                n = _unpack(n, len(w) // 4)
                ends = np.cumsum(n + _unpack(g, len(n)))
                spans = [(int(ends[a] - n[a]), int(ends[b - 1]), b - a) for a, b in spans]
            out.append(spans)
        return pd.Series(out)

    return find


def _same_row(id_col: str, key: str) -> Column:
    return (F.col("key_a") == F.col(key)) & F.col("_id").eqNullSafe(F.col(id_col))


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 25) -> DataFrame:
    """A row for each row of docs: _id, key_a, n_units, and removed (structs of start, end, words)."""
    light_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("_id"), row_key(F.col(id_col), F.col(text_col))[0], F.col(text_col).alias("_text"))
    rows = materialise(docs.select("_id", "key_a", _each(_units, UNITS)(F.col("_text")).alias("u")).select("_id", "key_a", "u.*"), "passage-units")
    each = rows.select("_id", "key_a", F.explode_outer(F.arrays_zip("digests", "numbers", "sizes")).alias("x")).select("_id", "key_a", F.col("x.digests").alias("digest"), F.col("x.numbers").alias("number"), F.col("x.sizes").alias("size"))
    # Digests are counted first, by themselves; only what is found twice takes its place in the ranking along.
    twice = materialise(each.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1 AND digest IS NOT NULL"), "passage-twice")
    total = twice.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = twice.filter(F.col("n") > max(1_000, total // HOT_KEYS)).select("digest")
    found = materialise(spread_join(each, twice.select("digest"), ["digest"], hot, F.col("key_a"), "left_semi"), "passage-found")
    rank = F.struct(F.col("_id").isNull().alias("null_id"), F.col("_id"), F.col("key_a"), F.col("number"))
    first = materialise(found.groupBy("digest").agg(F.min(rank).alias("first")), "passage-first")
    later = spread_join(found, first, ["digest"], hot, F.col("key_a")).filter(rank != F.col("first"))

    # Of the grams of a run only the outermost go on.
    is_gram, nth = F.col("number") % PLACES == 0, Window.partitionBy("_id", "key_a", "gram").orderBy("number")
    later = later.withColumn("gram", is_gram).withColumns({"opens": F.coalesce(F.col("number") - F.lag("number").over(nth) > GRAM * PLACES, F.lit(True)), "closes": F.coalesce(F.lead("number").over(nth) - F.col("number") > GRAM * PLACES, F.lit(True))})
    later = later.filter(~F.col("gram") | F.col("opens") | F.col("closes"))
    later = materialise(later.select("_id", "key_a", "number", "size", "gram", "opens", "closes", F.col("first._id").alias("_fi"), F.col("first.key_a").alias("_fk"), F.col("first.number").alias("_fn")), "passage-later")
    wanted = later.filter("gram").groupBy("_fi", "_fk").agg(F.collect_set("_fn").alias("_wanted"))

    # The words of the texts on either side of a repeat.
    keys = materialise(later.select("key_a").unionByName(wanted.select(F.col("_fk").alias("key_a"))).distinct(), "passage-keys")
    texts = docs.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, "key_a", "left_semi").dropDuplicates(["_id", "key_a"])
    texts = materialise(texts.select("_id", "key_a", _each(_table, WORDS)(F.col("_text")).alias("t")).select("_id", "key_a", "t.*"), "passage-words")
    sides = texts.select("_id", "key_a", "words").join(wanted, _same_row("_fi", "_fk")).select("_fi", "_fk", F.explode(around()("words", "_wanted")).alias("s"))
    first_id = F.coalesce(F.concat(F.lit("1"), F.col("_fi").cast("string")), F.lit("0")).alias("_fs")
    sides = sides.select(first_id, "_fk", F.col("s.number").alias("_fn"), "s.before", "s.after")

    # A passage of very many texts has one first occurrence, whose words go to each of the tasks that its later ones are dealt to.
    hit, place = ["_id", "key_a", "number", "size", "opens", "closes"], ["_fs", "_fk", "_fn"]
    grams = later.filter("gram").select(*hit, first_id, "_fk", "_fn")
    sizes = materialise(grams.groupBy(*place).agg(F.count("*").alias("n")).filter("n > 1000"), "passage-hot")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    common = sizes.filter(F.col("n") > total // HOT_KEYS).select(*place)
    grams = spread_join(grams, sides, place, common, F.col("key_a")).select(*hit, "before", "after")
    lines = later.filter("NOT gram").select(*hit, F.lit(None).cast("binary").alias("before"), F.lit(None).cast("binary").alias("after"))
    hits = grams.unionByName(lines).groupBy(F.col("_id").alias("_i"), F.col("key_a").alias("_k")).agg(F.collect_set(F.struct(*hit[2:], "before", "after")).alias("hits"))
    spans = texts.join(hits, _same_row("_i", "_k")).select("_i", "_k", runs(min_words)("words", "lengths", "gaps", F.col("hits").cast(HITS)).alias("removed"))
    out = rows.select("_id", "key_a", F.size("digests").alias("n_units")).join(spans, _same_row("_i", "_k"), "left")
    return out.select("_id", "key_a", "n_units", F.coalesce("removed", F.array().cast(SPANS)).alias("removed"))


def drop_repeats(docs: DataFrame, **options) -> DataFrame:
    """docs with the removed spans taken out of their texts."""
    spans = materialise(repeats(docs, **options).dropDuplicates(["_id", "key_a"]), "passage-spans").filter(F.size("removed") > 0).select(F.col("_id").alias("_i"), F.col("key_a").alias("_k"), "removed")
    row = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), row_key(F.col("doc_id"), F.col("text"))[0], F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    row = row.join(spans, (F.col("key_a") == F.col("_k")) & F.col("_id").eqNullSafe(F.col("_i")), "left")
    cut = F.aggregate("removed", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
                      lambda acc, x: F.struct(x["end"].alias("at"), F.concat(acc["out"], F.substr(F.col("_text"), acc["at"] + 1, x["start"] - acc["at"])).alias("out")),
                      lambda acc: F.concat(acc["out"], F.substr(F.col("_text"), acc["at"] + 1)))
    return row.select(F.col("_row").withField("text", F.when(F.col("removed").isNull(), F.col("_text")).otherwise(cut)).alias("_row")).select("_row.*")


def query(docs: DataFrame) -> DataFrame:
    """doc_id, n_units, n_removed (spans), removed_words, and the spans as start:end of code points."""
    out = repeats(docs.select("doc_id", "text"))
    return out.select(
        F.col("_id").alias("doc_id"), F.col("n_units").cast("long").alias("n_units"), F.size("removed").cast("long").alias("n_removed"),
        F.aggregate("removed", F.lit(0).cast("long"), lambda acc, x: acc + x["words"]).alias("removed_words"),
        F.array_join(F.transform("removed", lambda x: F.concat_ws(":", x["start"], x["end"])), ",").alias("removed_spans"),
    )
