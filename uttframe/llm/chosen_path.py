"""N-gram Jaccard join by chosen paths.

A text is the set of its five-word shingles (lower-case words; a shorter text is one shingle of all its words). Texts with
equal sets collapse to one set. In each run a set of n shingles takes each of its shingles as a path with probability
1 / (threshold * n), by a hash that all sets share; sets that meet on a path form a bucket. A bucket of more than ``small``
sets is split again: each of its sets extends the path by further shingles, chosen alike, and so on to any depth. A bucket
is left whole where no shingle splits it, that is where an extension takes nearly all its sets along (a family of near
copies). What remains is compared by brute force.

Recall. Two sets of similarity ``threshold`` share on average one extension of a shared path at the first two levels, and
``LATER`` ones from the third on, so they share a bucket of any depth in a run with a probability of 0.35 at least, of
0.63 at depth 1. Runs are repeated until this gives the recall at any depth.

Buckets are never capped. Those over ``block`` sets, or ``block_tokens`` shingles, are cut into blocks, and each pair of
blocks is a group of its own. A block is one row, which goes to its groups as it is: sets are not repeated as rows. A pair that meets in several buckets counts in the first of them, so no pairs are emitted: a
bucket gives, for each set, its number of links and the root of its component there. Shingles are sent only for sets that
have a partner which sizes and signatures leave possible. A signature has the parity of the number of a set's shingles in
each of about n cells; two sets differ in at least as many shingles as their signatures do in bits, so no link is lost.

Rows: one for each row of the input, with ``class_id`` (the least id of the class) and ``n_links`` (other rows that are
linked to it: equal sets, and sets of similarity of the threshold or more). A null text, or one without words, is its own
class without links. Null ids sort last in a class. Ties do not arise: a class has one least id, and rows of that id are
told apart by the hash of their text. Repeated rows are members like others. Very long texts are read in pieces; a task
holds the shingles of one text, or of two blocks. An empty table gives an empty table. Other columns, whatever their
names, are ignored by ``near_duplicates`` and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, exp, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, code_points, light_batches, materialise, mix, pieces, row_key, spread_join, word_hashes
from .components import components

LATER = 1.5  # shared extensions of a shared path from the third level on
SPLIT = 0.75  # an extension that takes along this share of a bucket does not split it
BROADCAST_ROWS = 1_000_000
WHOLE = float(1 << 64)


def miss(depth: int) -> float:
    """The probability that two sets at the threshold share no path of this depth in a run."""
    q = 0.0
    for level in range(depth, 0, -1):
        q = exp((LATER if level > 2 else 1) * (q - 1))
    return q


def n_runs(recall: float, depth: int = 100) -> int:
    return ceil(log(1 - recall) / log(miss(depth)))


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted 64-bit hashes of a text's k-word shingles."""
    parts = [word_hashes(code_points(p), "_")[0] for p in pieces(text.lower())] if text else []
    w = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
    if not len(w):
        return w
    n = min(k, len(w))
    h = w[: len(w) - n + 1] + np.uint64(n)
    for j in range(1, n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[j : j + len(h)]
    h = np.sort(mix(h))
    return h[np.append(True, h[1:] != h[:-1])]


def _room(threshold: float, n: int, factor: float = 1.0) -> np.uint64:
    return np.uint64(min(factor * WHOLE / (threshold * n), WHOLE - 2048))


def _extend(m: np.ndarray, paths: np.ndarray, room: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Which shingles, given by their mixed hashes, extend which paths: numbers of paths and of shingles."""
    found = []
    for low in range(0, len(m), 8_192):
        p, i = np.nonzero(m[low : low + 8_192] * (paths | np.uint64(1))[:, None] < room)
        found.append((p, i + low))
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def _short(m: np.ndarray) -> np.ndarray:
    return (m >> np.uint64(32)).astype(np.uint32).view(np.int32)


def signature(m: np.ndarray) -> bytes:
    """The parities of the number of hashes in each of about len(m) cells."""
    width = 1 << max(6, (len(m) - 1).bit_length())
    return np.packbits((np.bincount((m & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes()


SECOND = "array<struct<up:long,path:long,used:array<int>>>"
SETS = f"a long, b long, n int, first array<long>, second {SECOND}, bits binary"


def describe(text: Column, k: int, threshold: float, runs: int) -> Column:
    """Fingerprints, size and signature of a text's set, and its paths of depth 1 and 2 (with the short hashes of their shingles)."""

    @F.pandas_udf(SETS)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        seeds = mix(np.arange(1, runs + 1, dtype=np.uint64))
        for texts in batches:
            rows = []
            for t in texts:
                m = mix(shingles(t, k))
                if not len(m):
                    rows.append((None, None, 0, [], [], b""))
                    continue
                room, short = _room(threshold, len(m)), _short(m)
                r, i = _extend(m, seeds, room)
                first = mix(m[i] + seeds[r])
                p, j = _extend(m, first, room)
                other = i[p] != j
                p, j = p[other], j[other]
                paths = mix(m[j] + first[p]).view(np.int64)
                first = first.view(np.int64)
                second = list(zip(first[p].tolist(), paths.tolist(), np.stack((short[i[p]], short[j]), axis=1).tolist(), strict=True))
                a, b = m.sum(dtype=np.uint64).view(np.int64), np.bitwise_xor.reduce(m).view(np.int64)
                rows.append((int(a), int(b), len(m), first, second, signature(m)))
            yield pd.DataFrame(rows, columns=["a", "b", "n", "first", "second", "bits"]).astype({"a": "Int64", "b": "Int64"})

    return of(text)


def deeper(k: int, threshold: float) -> Callable:
    """From a text and paths (with the shingles on them) to the extensions of these paths."""

    @F.pandas_udf(SECOND)
    def of(texts: pd.Series, paths: pd.Series) -> pd.Series:
        out = []
        for t, ups in zip(texts, paths, strict=True):
            m = mix(shingles(t, k))
            short, found = _short(m), []
            paths = np.array([x["path"] for x in ups], dtype=np.int64).view(np.uint64)
            p, j = _extend(m, paths, _room(threshold, len(m), LATER))
            for x, path, one in zip(p.tolist(), mix(m[j] + paths[p]).view(np.int64).tolist(), short[j].tolist(), strict=True):
                if one not in ups[x]["used"]:
                    found.append({"up": ups[x]["path"], "path": path, "used": [*ups[x]["used"], one]})
            out.append(found)
        return pd.Series(out)

    return of


def _tokens(text: Column, k: int) -> Column:
    @F.pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, k).view(np.int64) for t in texts])

    return of(text)


# Comparing the sets of a bucket


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists one after another, and the list that each is in."""
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))


def _shared(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many values each pair of n lists has in common."""
    out = np.zeros((n, n), dtype=np.float32)
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    twice = count[column] > 1
    owner, column = owner[twice], (np.cumsum(count > 1) - 1)[column[twice]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        part = slice(*np.searchsorted(column, [low, low + 2048]))
        x = np.zeros((n, min(2048, int(column[-1]) + 1 - low)), dtype=np.float32)
        x[owner[part], column[part] - low] = 1
        out += x @ x.T
    return out


def _fits(bits: list[bytes], n: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Of pairs i, j of sets, which ones' signatures differ in no more bits than sets of the threshold may differ in shingles."""
    most = (1 - threshold) / (1 + threshold) * (n[i] + n[j]) + 1e-6
    keep, width = np.zeros(len(i), dtype=bool), np.array([len(x) for x in bits])
    least = np.minimum(width[i], width[j])
    for w in np.unique(least):
        mine = np.flatnonzero(least == w)
        rows = np.unique(np.concatenate((i[mine], j[mine])))
        folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(bits[r], dtype=np.uint8).reshape(-1, w), axis=0) for r in rows]).view(np.uint64)
        at = np.zeros(len(width), dtype=np.int64)
        at[rows] = np.arange(len(rows))
        for part in np.array_split(mine, max(1, ceil(len(mine) * (w // 8) / 500_000))):
            keep[part] = np.bitwise_count(folded[at[i[part]]] ^ folded[at[j[part]]]).sum(axis=1) <= most[part]
    return keep


def _pairs(group: pa.Table, threshold: float) -> np.ndarray:
    """Which pairs of a group's sets are its business: of two blocks that should meet here, possible by sizes and signatures, and not counted in an earlier bucket."""
    n, block = group["n"].to_numpy(), group["own"].to_numpy()
    m = np.minimum(n[:, None], n) >= threshold * np.maximum(n[:, None], n)
    if group["i"][0].as_py() != group["j"][0].as_py():
        m &= block[:, None] != block
    i, j = np.nonzero(np.triu(m, 1))
    keep = _fits(group["bits"].to_pylist(), n, i, j, threshold)
    i, j = i[keep], j[keep]
    m = np.zeros(m.shape, dtype=bool)
    if len(i):
        values, owner = _flat(group["leaves"])
        earlier = values < group["path"][0].as_py()
        both = _shared(values[earlier], owner[earlier], len(n))
        fresh = both[i, j] == 0
        m[i[fresh], j[fresh]] = m[j[fresh], i[fresh]] = True
    return m


def _groups(batches: Iterator[pa.RecordBatch], least: int = 2) -> Iterator[pa.Table]:
    """The groups of (path, i, j) with ``least`` rows or more in a partition that is ordered by them."""
    rest: pa.Table | None = None
    for batch in batches:
        whole = pa.Table.from_batches([batch])
        if rest is not None and len(rest):
            whole = pa.concat_tables([rest, whole]).combine_chunks()
        keys = np.stack([whole[c].to_numpy() for c in ("path", "i", "j")])
        edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        bounds = [0, *edges.tolist()]
        yield from (whole.slice(a, b - a) for a, b in zip(bounds, bounds[1:], strict=False) if b - a >= least)
        rest = whole.slice(bounds[-1])
    if rest is not None and len(rest) >= least:
        yield rest


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The groups of rows that are whole blocks, with a row a set."""
    for group in _groups(batches, 1):
        blocks = group["sets"].combine_chunks()
        sets, sizes = blocks.flatten(), blocks.value_lengths().to_numpy(zero_copy_only=False)
        keys = {c: pa.array(np.repeat(group[c].to_numpy(), sizes)) for c in ("path", "i", "j", "own")}
        yield pa.table(dict(zip([f.name for f in sets.type], sets.flatten(), strict=True)) | keys)


def _in_batches(rows: Iterator[dict[str, np.ndarray]], schema: pa.Schema, least: int = 2_000) -> Iterator[pa.RecordBatch]:
    def batch(found: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[f.name] for x in found]), f.type) for f in schema], schema=schema)

    found: list[dict[str, np.ndarray]] = []
    n = 0
    for x in rows:
        found.append(x)
        n += len(x[schema.names[0]])
        if n > least:
            yield batch(found)
            found, n = [], 0
    if found:
        yield batch(found)


def _schema(**types: pa.DataType) -> pa.Schema:
    return pa.schema(list(types.items()))


LIKELY = _schema(a=pa.int64(), b=pa.int64(), path=pa.int64(), i=pa.int32(), j=pa.int32(), own=pa.int32())
MET = _schema(path=pa.int64(), i=pa.int32(), j=pa.int32())
LINKS = _schema(a=pa.int64(), b=pa.int64(), links=pa.int64(), ra=pa.int64(), rb=pa.int64())


def _likely(threshold: float) -> Callable:
    """The rows of groups whose sets have a possible partner there."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        for group in _groups(batches):
            x = _pairs(group, threshold).any(axis=1)
            if x.any():
                yield {c: group[c].to_numpy()[x] for c in LIKELY.names}

    return lambda batches: _in_batches(rows(batches), LIKELY)


def _met(threshold: float) -> Callable:
    """The groups of blocks with a pair that is possible there."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        for group in _unpacked(batches):
            if _pairs(group, threshold).any():
                yield {c: group[c].to_numpy()[:1] for c in MET.names}

    return lambda batches: _in_batches(rows(batches), MET)


def _links(threshold: float, groups: Callable = _groups) -> Callable:
    """For each set with links in a group: their number in rows, and the root of its component there."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        for group in groups(batches):
            m = _pairs(group, threshold)
            if not m.any():
                continue
            n = group["n"].to_numpy()
            both = _shared(*_flat(group["tokens"]), len(n))
            m &= both >= threshold * (n[:, None] + n - both) - 1e-6
            x = m.any(axis=1)
            if not x.any():
                continue
            label = np.arange(len(m))
            while True:
                lower = np.minimum(label, np.where(m, label, len(m)).min(axis=1))
                if (lower == label).all():
                    break
                label = lower
            a, b = group["a"].to_numpy(), group["b"].to_numpy()
            yield {"a": a[x], "b": b[x], "links": (m @ group["copies"].to_numpy())[x], "ra": a[label[x]], "rb": b[label[x]]}

    return lambda batches: _in_batches(rows(batches), LINKS)


def _by_bucket(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("path", "i", "j").sortWithinPartitions("path", "i", "j", *order)


def _packed(rows: DataFrame, *cols: str) -> DataFrame:
    """A row for each block: path, own, h, sets."""
    return rows.groupBy("path", "own").agg(F.first("h").alias("h"), F.collect_list(F.struct(*cols)).alias("sets"))


# Buckets


def _sizes(members: DataFrame) -> DataFrame:
    """path, m (its sets), w (their shingles)."""
    return members.groupBy("path").agg(F.count("*").alias("m"), F.sum("n").alias("w")).filter("m > 1")


def _hot(sizes: DataFrame, total: int, key: str = "path") -> DataFrame:
    return sizes.filter(F.col("m") > max(1_000, total // HOT_KEYS)).select(key)


def _levels(sets: DataFrame, texts: Callable[[DataFrame], DataFrame], k: int, threshold: float, small: int) -> tuple[DataFrame, DataFrame, int]:
    """The buckets to compare (path, m, w), the sets in them (a, b, n, path), and the number of rows of the latter's levels.

    texts() adds the text of their first row to sets.
    """
    members = sets.select("a", "b", "n", F.explode("first").alias("path"), F.array().cast("array<int>").alias("used"))
    sizes = materialise(_sizes(members), "path-sizes")
    total = sizes.agg(F.sum("m")).first()[0] or 0
    parts, leaves, depth = [members], [], 1
    while True:
        large = sizes.filter(F.col("m") > small)
        if not large.count():
            leaves.append(sizes)
            break
        opened = large.select(F.col("path").alias("up"), F.col("m").alias("m_up"))
        hot = _hot(large, total).select(F.col("path").alias("up"))
        if depth == 1:
            kids = sets.select("a", "b", "n", F.inline("second"))
            kids = spread_join(kids, opened.select("up"), ["up"], hot, F.col("a"))
        else:
            inside = spread_join(members.withColumnRenamed("path", "up"), opened.select("up"), ["up"], hot, F.col("a"))
            inside = inside.groupBy("a", "b", "n").agg(F.collect_list(F.struct(F.col("up").alias("path"), "used")).alias("ups"))
            kids = texts(inside).select("a", "b", "n", F.inline(deeper(k, threshold)("_text", "ups")))
        kids = materialise(kids.select("a", "b", "n", "up", "path", "used"), "path-members")
        below = materialise(kids.groupBy("path").agg(F.count("*").alias("m"), F.sum("n").alias("w"), F.first("up").alias("up")).filter("m > 1"), "path-sizes")
        # A bucket that an extension takes along nearly whole stays as it is; of others the extensions go on.
        split = materialise(opened.join(below.groupBy("up").agg(F.max("m").alias("most")), "up", "left").select("up", (F.coalesce("most", F.lit(0)) < SPLIT * F.col("m_up")).alias("apart")), "path-split")
        whole = split.filter("NOT apart").select(F.col("up").alias("path"))
        leaves.append(sizes.filter(F.col("m") <= small).unionByName(large.join(whole, "path")))
        sizes = below.join(split.filter("apart").select("up"), "up", "left_semi").select("path", "m", "w")
        sizes = materialise(sizes, "path-sizes")
        members, depth = kids.drop("up"), depth + 1
        parts.append(members)
    # A path's hash tells its level, so members of all levels meet the leaves of all levels in one join.
    every, ends = parts[0], leaves[0]
    for p, x in zip(parts[1:], leaves[1:], strict=True):
        every, ends = every.unionByName(p), ends.unionByName(x)
    return materialise(ends, "path-leaves"), every.select("a", "b", "path"), total


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.8, recall: float = 0.98, small: int = 200, block: int = 512, block_tokens: int = 200_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: _id, key_a, key_b, a, b; sets: a, b, first row, copies; links: a, b, links, ra, rb)."""
    light_batches(docs.sparkSession)
    seen = docs.select(F.col(id_col).alias("_id"), *row_key(F.col(id_col), F.col(text_col)), describe(F.col(text_col), k, threshold, n_runs(recall)).alias("x"))
    rows = materialise(seen.select("_id", "key_a", "key_b", "x.*"), "path-rows")
    tops = rows.filter("n > 0").groupBy("a", "b").agg(
        F.min(F.struct(F.col("_id").isNull().alias("null_id"), F.col("_id").alias("id"), "key_a", "key_b")).alias("top"), F.count("*").alias("copies"), F.first("n").alias("n"),
        F.first("first").alias("first"), F.first("second").alias("second"), F.first("bits").alias("bits"))
    sets = materialise(tops, "path-sets")

    def with_text(some: DataFrame) -> DataFrame:
        """some, of columns a and b, with the text of each set's first row."""
        some = materialise(some.join(sets.select("a", "b", "top.key_a", "top.key_b"), ["a", "b"]), "path-some")
        keys = some.select("key_a")
        texts = docs.select(*row_key(F.col(id_col), F.col(text_col)), F.col(text_col).alias("_text"))
        texts = texts.join(F.broadcast(keys) if some.count() <= BROADCAST_ROWS else keys, "key_a", "left_semi").dropDuplicates(["key_a", "key_b"])
        return some.join(texts, ["key_a", "key_b"]).drop("key_a", "key_b")

    leaves, members, total = _levels(sets, with_text, k, threshold, small)
    placed = spread_join(members, leaves, ["path"], _hot(leaves, total), F.col("a"))
    blocks = F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("w") / block_tokens)).cast("int")
    placed = placed.groupBy("a", "b").agg(F.collect_set(F.struct("path", blocks.alias("h"))).alias("buckets"))
    placed = materialise(sets.select("a", "b", "n", "copies", "bits").join(placed, ["a", "b"]).withColumn("leaves", F.transform("buckets", lambda x: x["path"])), "path-placed")

    at = placed.select("a", "b", "n", "copies", "bits", "leaves", F.inline("buckets"))
    at = at.withColumn("own", F.pmod(F.xxhash64(F.lit(9), "a", "b"), F.col("h")).cast("int"))
    whole = at.filter("h = 1").select("a", "b", "n", "bits", "leaves", "path", F.lit(0).alias("i"), F.lit(0).alias("j"), "own")
    likely = _by_bucket(whole, "a", "b").mapInArrow(_likely(threshold), "a long, b long, path long, i int, j int, own int")
    likely = likely.groupBy("a", "b").agg(F.collect_list(F.struct("path", "i", "j", "own")).alias("groups"))

    full = with_text(placed.drop("buckets").join(likely, ["a", "b"]))
    full = full.select("a", "b", "n", "copies", "bits", "leaves", "groups", _tokens(F.col("_text"), k).alias("tokens"))
    compared = _by_bucket(full.select("a", "b", "n", "copies", "bits", "leaves", "tokens", F.inline("groups")), "a", "b")
    types = "a long, b long, links long, ra long, rb long"
    links = compared.mapInArrow(_links(threshold), types)

    if leaves.filter(blocks > 1).count():
        # Block x of a bucket of h blocks meets each block y: in the group (x, y), or (y, x) if y is less.
        cut = at.filter("h > 1")
        group = [F.least("own", "_y").alias("i"), F.greatest("own", "_y").alias("j")]
        pairs = _packed(cut, "a", "b", "n", "bits", "leaves").withColumn("_y", F.explode(F.sequence(F.lit(0), F.col("h") - 1)))
        met = materialise(_by_bucket(pairs.select("path", *group, "own", "sets"), "own").mapInArrow(_met(threshold), "path long, i int, j int"), "path-met")
        ends = met.select("path", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("own"))
        mine = cut.join(ends.select("path", "own").distinct(), ["path", "own"], "left_semi").groupBy("a", "b").agg(F.collect_list(F.struct("path", "own", "h")).alias("blocks"))
        full = with_text(placed.drop("buckets").join(mine, ["a", "b"]))
        full = full.select("a", "b", "n", "copies", "bits", "leaves", "blocks", _tokens(F.col("_text"), k).alias("tokens"))
        packed = _packed(full.select("a", "b", "n", "copies", "bits", "leaves", "tokens", F.inline("blocks")), "a", "b", "n", "copies", "bits", "leaves", "tokens")
        compared = _by_bucket(packed.join(ends, ["path", "own"]).select("path", "i", "j", "own", "sets"), "own")
        links = links.unionByName(compared.mapInArrow(_links(threshold, _unpacked), types))
    return rows, sets, materialise(links, "path-links")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """A row for each row of docs: _id, key_a, key_b, class_id, n_links, alone (no words), is_first (of its class, by id and then the row's key)."""
    rows, sets, links = join(docs, **options)
    node = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    roots = components(links.select(node("a", "b").alias("u"), node("ra", "rb").alias("v"))).select("node.a", "node.b", "root")
    own = F.coalesce("root", node("a", "b"))
    linked = sets.select("a", "b", "top", "copies").join(roots, ["a", "b"], "left").join(links.groupBy("a", "b").agg(F.sum("links").alias("links")), ["a", "b"], "left")
    linked = materialise(linked.select("a", "b", own.alias("root"), "top", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "path-linked")
    n_sets, n_rows = linked.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    tops = linked.groupBy("root").agg(F.min("top").alias("top"), F.count("*").alias("m"))
    classes = spread_join(linked.drop("top"), tops.select("root", "top"), ["root"], _hot(tops, n_sets, "root"), F.col("a")).drop("root")
    # Rows without words have no key; dealt by their own, they meet nothing, wherever they go.
    alone = F.col("a").isNull()
    keyed = rows.select("_id", "key_a", "key_b", F.coalesce("a", "key_a").alias("a"), "b", alone.alias("alone"))
    many = linked.filter(F.col("copies") > max(1_000, n_rows // HOT_KEYS)).select("a", "b")
    out = spread_join(keyed, classes.drop("copies"), ["a", "b"], many, F.col("key_a"), "left")
    return out.select(
        "_id", "key_a", "key_b", F.when(F.col("alone"), F.col("_id")).otherwise(F.col("top.id")).alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        "alone", (F.col("alone") | (F.struct("key_a", "key_b") == F.struct("top.key_a", "top.key_b"))).alias("is_first"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs without all but the first row of each class: the least id, then the row's key; texts without words stay."""
    first = materialise(near_duplicates(docs, **options).filter("is_first").select("key_a", "key_b", "alone").distinct(), "path-first")
    row = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), *row_key(F.col("doc_id"), F.col("text")))
    kept = row.join(first, ["key_a", "key_b"])
    once = kept.filter("NOT alone").dropDuplicates(["key_a", "key_b"])  # repeated rows are one class
    return once.unionByName(kept.filter("alone")).select("_row.*")


def query(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and n_links."""
    return near_duplicates(docs.select("doc_id", "text")).select(F.col("_id").alias("doc_id"), "class_id", "n_links")
