"""Sharding by largest differencing: byte balance for groups that stay whole.

Rows with equal texts form a group, which goes to one shard whole. Only a group with more bytes than an ideal shard, which
no assignment could balance whole, is cut into parts by a hash of the row's id. Groups are dealt to nodes of about
``node_items``; in each node the partial partitions with the largest spread are combined, oppositely ordered, until one is
left. Nodes are then combined alike, ``fan_in`` at a time, level by level, so no task and no driver ever holds more than
one node. Rows of a group with very many rows are dealt to several tasks on their way to its shard. Sizes are UTF-8 bytes
plus 1, so very long texts count as large items and are read by no one.

A null text has size 1, and null texts are one group. Rows without an id are told apart by their other columns, and in
``query`` by their place in the input, where a group has to be cut. Repeated rows go to one shard, unless they are cut as
such. Groups of equal size are ordered by their hashes. An empty table gives an empty table. ``shard_documents`` keeps
all columns of its input, whatever their names, and adds the shard, in place of a column ``shard`` if there is one.
"""

from __future__ import annotations

import heapq
from math import ceil

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import HOT_KEYS, materialise, row_hash, spread_join

SALTS = 1024


def combine(partials: list[list[int]], n_slots: int) -> list[list[int]]:
    """For each partial partition (a sum for each slot, empty ones 0), the slot of the whole that each of its slots goes to."""
    follows = [-1] * (len(partials) * n_slots)
    heap = []
    for i, sums in enumerate(partials):
        slots = sorted(((s, i * n_slots + j, i * n_slots + j) if s else (0, -1, -1) for j, s in enumerate(sums)), reverse=True)
        heap.append((slots[-1][0] - slots[0][0], i, slots))
    heapq.heapify(heap)
    number = len(partials)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        merged = []
        for (s, head, tail), (t, head2, tail2) in zip(a, reversed(b), strict=True):
            if head2 >= 0:
                if head >= 0:
                    follows[tail] = head2
                else:
                    head = head2
                tail = tail2
            merged.append((s + t, head, tail))
        merged.sort(reverse=True)
        low = merged[-1][0]
        heapq.heappush(heap, (low - merged[0][0], number, [(s - low, h, t) for s, h, t in merged]))
        number += 1
    out = [[-1] * n_slots for _ in partials]
    for slot, (_, at, _) in enumerate(heap[0][2] if heap else []):
        while at >= 0:
            out[at // n_slots][at % n_slots] = slot
            at = follows[at]
    for row in out:  # slots that hold nothing may go anywhere that is free
        free = [s for s in range(n_slots) if s not in row]
        row[:] = [s if s >= 0 else free.pop() for s in row]
    return out


def _level(items: DataFrame, n_slots: int, fan_in: int) -> DataFrame:
    """From (node, sums) to (node, to): the shard that each slot of each node ends in."""
    def join_nodes(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        return pd.DataFrame({"node": pdf["node"], "up": pdf["up"], "to": combine([list(map(int, x)) for x in pdf["sums"]], n_slots)})

    n = items.count()
    if n <= 1:
        return items.select("node", F.sequence(F.lit(0), F.lit(n_slots - 1)).alias("to"))
    n_up = ceil(n / fan_in)
    grouped = items.withColumn("up", F.pmod(F.xxhash64(F.lit(n), "node"), F.lit(n_up)))
    moved = materialise(grouped.groupBy("up").applyInPandas(join_nodes, "node long, up long, to array<int>"), "shard-level")
    if n_up == 1:
        return moved.select("node", "to")
    sums = items.join(moved, "node").select("up", F.posexplode(F.arrays_zip("sums", "to"))).groupBy("up", F.col("col.to").alias("slot")).agg(F.sum("col.sums").alias("s"))
    higher = _level(materialise(_by_node(sums.withColumnRenamed("up", "node"), n_slots), "shard-sums"), n_slots, fan_in).select(F.col("node").alias("up"), F.col("to").alias("_to"))
    return moved.join(higher, "up").select("node", F.transform("to", lambda s: F.get(F.col("_to"), s)).alias("to"))


def _by_node(sums: DataFrame, n_slots: int) -> DataFrame:
    """(node, slot, s) to (node, sums)."""
    filled = F.map_from_entries(F.collect_list(F.struct("slot", "s")))
    return sums.groupBy("node").agg(filled.alias("m")).select("node", F.transform(F.sequence(F.lit(0), F.lit(n_slots - 1)), lambda j: F.coalesce(F.element_at("m", j), F.lit(0).cast("long"))).alias("sums"))


def plan(keyed: DataFrame, n_shards: int, node_items: int, fan_in: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups that are cut; the shard of each group or part of such a group; those of these with very many rows)."""
    parts = materialise(keyed.groupBy("_g1", "_g2", "_salt").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "shard-parts")
    total, rows = parts.agg(F.sum("bytes"), F.sum("n")).first()
    groups = parts.groupBy("_g1", "_g2").agg(F.sum("bytes").alias("bytes"))
    # Fewer than n_shards groups can be larger than an ideal shard.
    hot = materialise(groups.filter(F.col("bytes") * n_shards > (total or 0)).select("_g1", "_g2", F.lit(True).alias("_hot")), "shard-hot")
    part = F.when(F.col("_hot"), F.col("_salt")).otherwise(-1).alias("_part")
    items = parts.join(F.broadcast(hot), ["_g1", "_g2"], "left").groupBy("_g1", "_g2", part).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    n_nodes = max(1, ceil((rows or 0) / node_items))

    def first_level(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "_g1", "_g2", "_part"])
        slots = combine([[int(b)] + [0] * (n_shards - 1) for b in pdf["bytes"]], n_shards)
        return pdf.assign(slot=[x[0] for x in slots])

    dealt = items.withColumn("node", F.pmod(F.xxhash64(F.lit(3), "_g1", "_g2", "_part"), F.lit(n_nodes)))
    dealt = materialise(dealt.groupBy("node").applyInPandas(first_level, "_g1 long, _g2 long, _part int, bytes long, n long, node long, slot int"), "shard-items")
    nodes = materialise(_by_node(dealt.groupBy("node", "slot").agg(F.sum("bytes").alias("s")), n_shards), "shard-nodes")
    shards = dealt.join(_level(nodes, n_shards, fan_in), "node").select("_g1", "_g2", "_part", F.get("to", F.col("slot")).alias("shard"))
    return hot, shards, dealt.filter(F.col("n") > max(1_000, (rows or 0) // HOT_KEYS)).select("_g1", "_g2", "_part")


def with_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", apart: Column | None = None) -> DataFrame:
    """docs with size and the hashes that assign needs. Rows without an id are told apart by ``apart``, or by all their columns."""
    id_, text = F.col(id_col), F.col(text_col)
    salt = F.when(id_.isNull(), F.xxhash64(row_hash(docs) if apart is None else apart)).otherwise(F.xxhash64(id_))
    return docs.withColumns({
        "_g1": F.xxhash64(F.lit(1), text), "_g2": F.xxhash64(F.lit(2), text), "_salt": F.pmod(salt, F.lit(SALTS)).cast("int"),
        "size": (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long"),
    })


def assign(keyed: DataFrame, n_shards: int = 16, *, node_items: int = 20_000, fan_in: int = 2_000) -> DataFrame:
    """The rows of with_keys() with shard."""
    hot, shards, many = plan(keyed, n_shards, node_items, fan_in)
    part = F.when(F.col("_hot"), F.col("_salt")).otherwise(-1)
    split = keyed.join(F.broadcast(hot), ["_g1", "_g2"], "left").withColumn("_part", part).drop("_hot")
    return spread_join(split.drop("shard"), shards, ["_g1", "_g2", "_part"], many, F.col("_salt")).drop("_part")


def with_slots(placed: DataFrame, rows: int, n_shards: int = 16, *, id_col: str = "doc_id", bucket_rows: int = 20_000) -> DataFrame:
    """The rows of assign() with slot: the place within the shard, from 0 without gaps. Hash buckets are counted, then numbered one by one."""
    n_buckets = max(1, ceil(rows / (n_shards * bucket_rows)))
    placed = placed.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(5), F.col(id_col), "_g1", "_salt"), F.lit(n_buckets)))
    counts = placed.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = counts.select("shard", "_bucket", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy(id_col, "_g1", "_g2"))
    return placed.join(before, ["shard", "_bucket"]).withColumn("slot", (F.col("_before") + place - 1).cast("long")).drop("_bucket", "_before")


def shard_documents(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """docs with the shard of each row."""
    row = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    apart = row_hash(docs, F.col("_row"))
    out = assign(with_keys(row, "_id", "_text", apart), n_shards)
    return out.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c != "shard"], "shard")


def query(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32")
    keyed = with_keys(docs.select("doc_id", "text", crc), "doc_id", "text", F.monotonically_increasing_id())
    light = materialise(keyed.drop("text"), "shard-rows")  # places in the input hold from here on
    placed = materialise(assign(light, n_shards), "shard-placed")
    out = with_slots(placed, placed.count(), n_shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
