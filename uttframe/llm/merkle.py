"""Merkle manifest of a dataset with a witness for each leaf, built by appends.

A group's leaves are appended in order. Open subtrees stand at multiples of their size; each has the witnesses of its leaves
so far. A new leaf is a subtree of its own; whenever the last two open subtrees have one size, the later completes the
earlier: the witnesses of either side gain the other's root, and both become one subtree. What is left over at the end is
raised alone, level by level. This runs in blocks of 1,024 leaves, wherever these lie; the blocks' roots are appended as
leaves of a further tree in the same way, and so on, and the groups' roots to the tree of all groups. A leaf's witness is
that of its block, followed by its block's.

Places of leaves come from a range sort, whose parts count their rows by group; nothing of a group is ever in one task but
one block.

Rows: each row of the input is a leaf. Nulls in the hashed columns give ``-``; a null group is the first group, a null
doc_id sorts first and is never tampered with. Rows of equal doc_id (ties) are ordered by their leaf, and equal leaves are the same
whatever their order, so repeated rows have the same leaf but proofs of their own places. Very long texts are hashed as
they are; only digests are sorted and sent. Other columns, whatever their names, are not hashed. An empty table gives an
empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_KEYS, materialise, spread_join

#: A block has 2 ** BITS leaves.
BITS = 10
HASHED = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(*cols: Column) -> Column:
    """SHA-256 in hex of the columns, each with its length in bytes before it."""
    value = [c.cast("string") for c in cols]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in value]), 256)


def node(*children: bytes) -> bytes:
    return hashlib.sha256("".join([c.hex() for c in children]).encode()).digest()


class Appender:
    """Open subtrees, each (level, root, first leaf, end), and the witnesses of all leaves so far; None where a node was raised alone."""

    def __init__(self) -> None:
        self.open: list[tuple[int, bytes, int, int]] = []
        self.witnesses: list[list[bytes | None]] = []

    def append(self, leaf: bytes) -> None:
        self.witnesses.append([])
        self.open.append((0, leaf, len(self.witnesses) - 1, len(self.witnesses)))
        self._complete()

    def _complete(self) -> None:
        while len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
            (level, left, start, middle), (_, right, _, end) = self.open[-2:]
            for w in self.witnesses[start:middle]:
                w.append(right)
            for w in self.witnesses[middle:end]:
                w.append(left)
            self.open[-2:] = [(level + 1, node(left, right), start, end)]

    def close(self, levels: int) -> bytes:
        """The root, that many levels above the leaves."""
        while len(self.open) > 1 or self.open[0][0] < levels:
            level, root, start, end = self.open[-1]
            for w in self.witnesses[start:end]:
                w.append(None)
            self.open[-1] = (level + 1, node(root), start, end)
            self._complete()
        return self.open[0][1]


def _appended(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of (grp, pos), whole blocks, with the witness of each within its block, and the block's root."""
    held: list[pa.RecordBatch] = []
    size = 1 << bits

    def settled(rows: pa.RecordBatch) -> pa.RecordBatch:
        groups, places, sizes, leaves = (rows.column(c).to_pylist() for c in ("grp", "pos", "n", "node"))
        witnesses, roots, at = [], [], 0
        while at < len(leaves):
            end = at + min(size - places[at] % size, sizes[at] - places[at])
            block = Appender()
            for leaf in leaves[at:end]:
                block.append(leaf)
            root = block.close(min(bits, (sizes[at] - 1).bit_length()))
            witnesses += block.witnesses
            roots += [root] * (end - at)
            at = end
        if at != len(groups):
            raise ValueError("leaves of a block are missing")
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(witnesses, pa.list_(pa.binary())), pa.array(roots, pa.binary())], [*rows.schema.names, "witness", "block_root"])

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        pos, n = batch.column("pos")[-1].as_py(), batch.column("n")[-1].as_py()
        whole = joined()
        kept = 0 if pos == n - 1 or pos % size == size - 1 else min(pos % size + 1, whole.num_rows)  # rows of a block that goes on
        held = [whole.slice(whole.num_rows - kept)] if kept else []
        if kept < whole.num_rows:
            yield settled(whole.slice(0, whole.num_rows - kept))
    if held:
        yield settled(joined())


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with pos, a row's place in its group from 0, and n, the group's rows. group is never null; of equal rows any order."""
    keys = [group, *order, "_tie"]
    sorted_rows = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    placed = materialise(sorted_rows.withColumn("_seq", F.monotonically_increasing_id()), "merkle-sorted").withColumn("_part", F.shiftright("_seq", 33))
    runs = placed.groupBy("_part", group).agg(F.min("_seq").alias("_first"), F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(group).orderBy("_part")) - F.col("_rows")
    runs = runs.select("_part", group, (F.col("_first") - before).alias("_start"), F.sum("_rows").over(Window.partitionBy(group)).alias("n"))
    return placed.join(runs, ["_part", group]).withColumn("pos", F.col("_seq") - F.col("_start")).drop("_seq", "_part", "_start")


def witnessed(leaves: DataFrame, bits: int = BITS) -> DataFrame:
    """leaves (grp, pos, n, node in bytes, and others) with block, witness up to the block's root, and up (the rest up to the group's root) and root."""
    others = [f"`{c}` {t}" for c, t in leaves.dtypes]
    dealt = leaves.repartition("grp", F.shiftright("pos", bits)).sortWithinPartitions("grp", "pos")
    low = materialise(dealt.mapInArrow(partial(_appended, bits=bits), ", ".join([*others, "witness array<binary>", "block_root binary"])), "merkle-blocks").withColumn("block", F.shiftright("pos", bits))
    heads = low.filter(F.col("pos") % (1 << bits) == 0)
    if (heads.agg(F.max("n")).first()[0] or 0) <= 1 << bits:
        return low.select("*", F.array().cast("array<binary>").alias("up"), F.col("block_root").alias("root"))
    blocks = witnessed(heads.select("grp", F.col("block").alias("pos"), F.ceil(F.col("n") / (1 << bits)).alias("n"), F.col("block_root").alias("node")), bits)
    blocks = blocks.select("grp", F.col("pos").alias("block"), F.concat("witness", "up").alias("up"), "root")
    return low.join(blocks, ["grp", "block"])


def manifest(rows: DataFrame, group: str, order: list[str], leaf: str, bits: int = BITS) -> DataFrame:
    """rows with path (the siblings from leaf to root, null where there is none), place (its bits tell a leaf's sides from below), subroot and root in hex.

    leaf is the name of a column of digests in hex. Groups are ordered by their bytes, a null one first. The columns of rows must
    not be named as those here and in ``witnessed``: give it the columns that order and name the leaves alone.
    """
    keyed = rows.withColumns({"grp": F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0")), "node": F.unhex(leaf)})
    low = witnessed(numbered(keyed, "grp", [*order, "node"]), bits)
    heads = materialise(low.filter(F.col("pos") % (1 << bits) == 0).select("grp", "block", "pos", "n", "up", "root"), "merkle-heads")
    tops = numbered(heads.filter("pos = 0").select(F.lit("").alias("all"), "grp", F.col("root").alias("node")), "all", ["grp"])
    tops = witnessed(tops.select(F.lit("").alias("grp"), F.col("grp").alias("of"), "node", "pos", "n"), bits)
    tops = tops.select(F.col("of").alias("grp"), F.col("pos").alias("top_pos"), F.concat("witness", "up").alias("top"), F.col("root").alias("whole"))
    many = heads.filter("pos = 0").filter(F.col("n") > max(1_000, heads.count() // HOT_KEYS) << bits).select("grp")
    blocks = spread_join(heads.select("grp", "block", "up", "root"), tops, ["grp"], many, F.col("block"))
    full = low.drop("up", "root").join(blocks, ["grp", "block"])
    place = F.col("pos") + F.col("top_pos") * F.pow(F.lit(2), F.size("witness") + F.size("up")).cast("long")
    return full.select(
        *rows.columns, F.concat("witness", "up", "top").alias("path"), place.alias("place"), F.lower(F.hex("root")).alias("subroot"), F.lower(F.hex("whole")).alias("root"),
    )


def folded(leaf: Column, place: Column, path: Column) -> Column:
    """The root in hex that a leaf and its siblings give."""

    def step(acc: Column, sibling: Column) -> Column:
        other, left = F.lower(F.hex(sibling)), acc["place"] % 2 == 1
        up = F.when(sibling.isNull(), acc["node"]).when(left, F.concat(other, acc["node"])).otherwise(F.concat(acc["node"], other))
        return F.struct(F.sha2(up, 256).alias("node"), F.shiftright(acc["place"], 1).alias("place"))

    return F.aggregate(path, F.struct(leaf.alias("node"), place.alias("place")), step, lambda acc: acc["node"])


def query(docs: DataFrame, bits: int = BITS) -> DataFrame:
    hashed = [F.col(c) for c in HASHED]
    changed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in HASHED]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, leaf_digest(*changed))
    rows = materialise(docs.select("doc_id", F.col("lang").cast("string").alias("lang"), leaf_digest(*hashed).alias("leaf"), tampered.alias("tampered")), "merkle-leaves")
    found = manifest(rows, "lang", ["doc_id"], "leaf", bits)
    proof = F.sha2(F.lower(F.array_join(F.transform(F.filter("path", lambda x: x.isNotNull()), lambda x: F.hex(x)), "")), 256)
    found = found.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("place"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _oracle() -> str:
    def leaf(cols: list[str]) -> str:
        return "sha256(" + " || ".join(f"coalesce(octet_length(encode(({c})::VARCHAR))::VARCHAR || ':' || ({c})::VARCHAR, '-')" for c in cols) + ")"

    def levels(name: str, source: str) -> str:
        """All nodes of trees: g, lev, pos, node, n (nodes of the level)."""
        return f"""{name} AS (SELECT g, 0 AS lev, pos, node, n FROM {source}
  UNION ALL SELECT g, lev + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (n + 1) // 2 FROM {name} WHERE n > 1 GROUP BY g, lev, pos // 2, n)"""

    return f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i)) AS tab),
d AS (SELECT doc_id, coalesce('1' || lang, '0') AS g, {leaf(list(HASHED))} AS leaf, {leaf([f"{c} + 1" if c == "n_chars" else c for c in HASHED])} AS changed,
             xor(list_reduce(string_split(doc_id::VARCHAR, ''), lambda c, x: xor(c >> 8, tab[(xor(c, ascii(x)) & 255) + 1]), 4294967295), 4294967295) AS sum32 FROM documents, crc),
l AS (SELECT row_number() OVER (ORDER BY g, doc_id, leaf) AS rid, doc_id, g, leaf AS node, CASE WHEN sum32 % 7 = 0 THEN changed ELSE leaf END AS held,
             row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d),
{levels("t", "l")},
s AS (SELECT g AS lang, '' AS g, node, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
{levels("u", "s")},
steps AS (SELECT rid, t.lev AS k, o.node AS other, (l.pos >> t.lev) & 1 = 1 AS is_left FROM l JOIN t ON t.g = l.g AND t.n > 1 AND t.pos = l.pos >> t.lev
            LEFT JOIN t o ON o.g = t.g AND o.lev = t.lev AND o.pos = xor(t.pos, 1)
          UNION ALL SELECT rid, u.lev + (SELECT max(lev) FROM t WHERE t.g = l.g), o.node, (s.pos >> u.lev) & 1 = 1 FROM l JOIN s ON s.lang = l.g JOIN u ON u.n > 1 AND u.pos = s.pos >> u.lev
            LEFT JOIN u o ON o.lev = u.lev AND o.pos = xor(u.pos, 1)),
f AS (SELECT rid, 0 AS k, held AS h FROM l
  UNION ALL SELECT f.rid, f.k + 1, sha256(CASE WHEN is_left THEN coalesce(other, '') || h ELSE h || coalesce(other, '') END) FROM f JOIN steps x ON x.rid = f.rid AND x.k = f.k),
p AS (SELECT rid, string_agg(other, '' ORDER BY k) AS others FROM steps GROUP BY rid),
e AS (SELECT rid, arg_max(h, k) AS h FROM f GROUP BY rid)
SELECT doc_id, l.node AS leaf, s.node AS subroot, r.node AS root, sha256(coalesce(others, '')) AS proof_sha256, e.h AS folded_root, e.h = r.node AS verified
FROM l JOIN s ON s.lang = l.g JOIN e ON e.rid = l.rid LEFT JOIN p ON p.rid = l.rid, (SELECT node FROM u WHERE n = 1) r
"""


ORACLE = _oracle()
