"""Batches: by count, length bucket, window, frame budget; collation; shards; merging of utterances.

Order is explicit everywhere: ``shard`` and ``order`` columns. Budgets are sequential. Where shards are short, each is a fold
in one task; where one has more than ``cuts.BLOCK`` rows, blocks of its rows are cut in parallel (``cuts``), with the same
result. Word quotas depend on all rows before, and batches of more than ``cuts.REACH`` rows on too many, so these are folds
in any case. Only keys, lengths and word hashes enter Python, in Arrow batches. A fold holds a batch of rows and its own
state (for word quotas, the counts of a shard's distinct words), never a whole shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType
from pyspark.sql.window import Window

from ..functions.stage import materialise
from ..functions.text import SWITCH, speaker_of
from . import cuts


ROWS = 10_000  # of a fold's result in a batch


def _pos(shard: list[str], order: list[str]) -> Column:
    return F.row_number().over(Window.partitionBy(*shard).orderBy(*order)) - 1


def static_batch(df: DataFrame, shard: list[str], order: list[str], n: int = 16) -> DataFrame:
    return df.withColumn("batch_id", F.floor(_pos(shard, order) / n))


def bucket_of(length: Column, boundaries: list[float]) -> Column:
    """The first bucket whose boundary is above the length, one more than the boundaries in all."""
    out = F.lit(len(boundaries))
    for i, b in reversed(list(enumerate(boundaries))):
        out = F.when(length < b, i).otherwise(out)
    return out


def window_batch(df: DataFrame, shard: list[str], order: list[str], key: Column, size: Column) -> DataFrame:
    """df with group_key and batch_id: rows of a key in groups of the key's size."""
    keyed = df.withColumn("group_key", key)
    return keyed.withColumn("batch_id", F.floor(_pos([*shard, "group_key"], order) / size))


def bucket_batch(df: DataFrame, shard: list[str], order: list[str], length: str, boundaries: list[float], sizes: list[int]) -> DataFrame:
    size = F.element_at(F.array(*[F.lit(s) for s in sizes]), F.col("group_key") + 1)
    return window_batch(df, shard, order, bucket_of(F.col(length), boundaries), size).withColumnRenamed("group_key", "bucket")


def _fold(df: DataFrame, shard: str, order: list[str], columns: list[str], step, schema: str) -> DataFrame:
    """step(rows in order) for each shard; yields tuples of the schema after the shard."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for pdf in batches for r in pdf[[shard, *columns]].itertuples(index=False, name=None))
        for key, own in groupby(rows, lambda r: None if pd.isna(r[0]) else r[0]):
            out = ((key, *r) for r in step(r[1:] for r in own))
            while some := list(islice(out, ROWS)):
                yield pd.DataFrame(some, columns=names)

    kind = df.schema[shard].dataType.simpleString()
    names = [shard, *[c.split()[0] for c in schema.split(", ")]]
    rows = df.select(*dict.fromkeys([shard, *order, *columns])).repartition(shard)
    return rows.sortWithinPartitions(shard, *[F.col(c).asc_nulls_last() for c in order]).mapInPandas(run, f"{shard} {kind}, {schema}")


def budget(rows: Iterator[tuple], most: float, drop_trigger: bool = False) -> Iterator[tuple]:
    """(key, batch) of (key, length): a batch is cut before its longest length times its count would pass the budget. With drop_trigger the row that causes the cut is lost, as some loaders do."""
    batch, n, longest = 0, 0, 0.0
    for key, length in rows:
        longest = max(longest, length)
        if n and longest * (n + 1) > most:
            batch += 1
            if drop_trigger:
                n, longest = 0, length
                continue
            n, longest = 0, length
        n += 1
        yield key, batch


def _long(df: DataFrame, shard: str) -> bool:
    """Whether a shard is worth cutting in parallel."""
    return (df.groupBy(shard).count().agg(F.max("count")).first()[0] or 0) > cuts.BLOCK


def dynamic_batch(df: DataFrame, shard: str, order: list[str], key: str, length: str, max_frames: float = 12000, drop_trigger: bool = False) -> DataFrame:
    """(shard, key, batch_id)."""
    if _long(df, shard) and (found := cuts.cut(df, shard, order, key, {"length": length}, cuts.Budget(max_frames, drop_trigger))) is not None:
        return found
    kind = df.schema[key].dataType.simpleString()
    return _fold(df, shard, order, [key, length], lambda rows: budget(rows, max_frames, drop_trigger), f"{key} {kind}, batch_id long")


def quotas(rows: Iterator[tuple], most: float, one_per_job: bool, per_epoch: int, per_batch: int) -> Iterator[tuple]:
    """(key, batch or None) of (key, length, job, words): a budget, one row a job in a batch, and word quotas. A row is taken if any word is below its quota."""
    batch, n, longest = 0, 0, 0.0
    jobs: set = set()
    epoch: dict = {}
    words_of_batch: dict = {}
    for key, length, job, words in rows:
        words = words.split(" ") if isinstance(words, str) else [""] if words is None else words
        short = lambda counts, quota: quota <= 0 or any(counts.get(w, 0) < quota for w in words)
        if (one_per_job and job in jobs) or not short(epoch, per_epoch) or not short(words_of_batch, per_batch):
            yield key, None
            continue
        longest = max(longest, length)
        if n and longest * (n + 1) > most:
            batch, n, longest = batch + 1, 0, length
            jobs, words_of_batch = set(), {}
        n += 1
        jobs.add(job)
        for w in words:
            epoch[w] = epoch.get(w, 0) + 1
            words_of_batch[w] = words_of_batch.get(w, 0) + 1
        yield key, batch


def distribute_batch(df: DataFrame, shard: str, order: list[str], key: str, length: str, job: str, text: str, max_frames: float = 12000, one_per_job: bool = True, max_words_per_epoch: int = -1, max_words_per_batch: int = -1) -> DataFrame:
    """(shard, key, batch_id), batch_id null for rows that a rule leaves out; rows without a job count as one job."""
    if one_per_job and max(max_words_per_epoch, max_words_per_batch) <= 0 and _long(df, shard):
        found = cuts.cut(df, shard, order, key, {"length": length, "job": job}, cuts.OnePerJob(max_frames))
        if found is not None:
            return found.select(shard, key, F.when(F.col("taken"), F.col("batch_id")).alias("batch_id"))
    kind = df.schema[key].dataType.simpleString()
    step = lambda rows: quotas(rows, max_frames, one_per_job, max_words_per_epoch, max_words_per_batch)
    words = F.transform(F.split(F.coalesce(text, F.lit("")), " ", -1), lambda w: F.xxhash64(w))
    return _fold(df.withColumn("_words", words), shard, order, [key, length, job, "_words"], step, f"{key} {kind}, batch_id long")


def pad(xs: Column, n: Column, value: object) -> Column:
    return F.concat(xs, F.array_repeat(value if isinstance(value, Column) else F.lit(value), (n - F.size(xs)).cast("int")))


def collate(
    df: DataFrame, batch: list[str], key: str, feats: str, label: str, feat_pad: float = 0.0, label_pad: int = -1,
    more: tuple[str, ...] = (), padded: tuple[str, ...] = (),
) -> DataFrame:
    """One row a batch, longest first: keys, padded feats and labels, their lengths, and the mask of padding.

    Frames may be numbers or vectors, which are padded by vectors of zeros. more: columns that go along as arrays in the same order
    (speakers, languages, tasks). padded: array columns that are padded by zeros, each with its lengths (waves, category
    vectors), a null one as an empty one.
    """
    frames = df.schema[feats].dataType.elementType
    pads = F.get("_r", F.lit(0))["x"]
    filler = feat_pad if not isinstance(frames, ArrayType) else F.array_repeat(F.lit(feat_pad).cast(frames.elementType), F.size(F.get(pads, F.lit(0))))
    own = [F.col(c).alias(f"m{i}") for i, c in enumerate(more)] + [F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType)).alias(f"p{i}") for i, c in enumerate(padded)]
    row = F.struct((-F.size(feats)).alias("minus"), F.col(key).alias("key"), F.col(feats).alias("x"), F.col(label).alias("y"), *own)
    rows = df.groupBy(*batch).agg(F.array_sort(F.collect_list(row)).alias("_r"))
    field = lambda f: F.transform("_r", lambda r: r[f])
    sizes = lambda f: F.transform("_r", lambda r: F.size(r[f]))

    def filled(f: str, longest: Column, value: object) -> Column:
        return F.transform("_r", lambda r: pad(r[f], longest, value))

    rows = rows.withColumns({"_nx": F.array_max(sizes("x")), "_ny": F.array_max(sizes("y"))} | {f"_np{i}": F.array_max(sizes(f"p{i}")) for i in range(len(padded))})
    extra = [field(f"m{i}").alias(c) for i, c in enumerate(more)]
    for i, c in enumerate(padded):
        zero = F.lit(0).cast(df.schema[c].dataType.elementType)
        extra += [filled(f"p{i}", F.col(f"_np{i}"), zero).alias(c), sizes(f"p{i}").alias(f"{c}_lengths")]
    return rows.select(
        *batch, field("key").alias("keys"), filled("x", F.col("_nx"), filler).alias("feats"), sizes("x").alias("feat_lengths"),
        filled("y", F.col("_ny"), label_pad).alias("labels"), sizes("y").alias("label_lengths"),
        F.transform("_r", lambda r: pad_mask(F.size(r["x"]), F.col("_nx"))).alias("mask"), *extra,
    )


def with_lists(batches: DataFrame, lists: DataFrame, batch: list[str], column: str = "ids", name: str = "bias") -> DataFrame:
    """Batches with the nested list of (batch, column) rows, such as a batch's bias phrases as ids: padded by zeros, with the lengths."""
    found = lists.select(*batch, F.coalesce(F.col(column), F.array().cast(lists.schema[column].dataType)).alias("_l"))
    out = batches.join(found, batch, "left").withColumn("_l", F.coalesce("_l", F.array().cast(lists.schema[column].dataType)))
    longest = F.coalesce(F.array_max(F.transform("_l", lambda x: F.size(x))), F.lit(0))
    return out.select(*batches.columns, F.transform("_l", lambda x: pad(x, longest, 0)).alias(name), F.transform("_l", lambda x: F.size(x)).alias(f"{name}_lengths"))


def pad_mask(length: Column, longest: Column) -> Column:
    """True where a place is padding."""
    return F.transform(F.sequence(F.lit(1), longest), lambda i: i > length)


def shard_of(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """df with shard: the i-th row goes to i modulo n. Range partitions are written with their numbers, so that counting and numbering see the same ones."""
    spread = materialise(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "shard-ranges")
    sizes = spread.groupBy("_p").agg(F.count("*").alias("n"))
    before = sizes.select("_p", (F.sum("n").over(Window.orderBy("_p")) - F.col("n")).alias("_before"))  # a row a partition
    pos = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return spread.join(F.broadcast(before), "_p").withColumn("shard", F.pmod(F.col("_before") + pos, F.lit(n))).drop("_p", "_before")


def merges(rows: Iterator[tuple], least: float, enough: float, most: float, n_most: int) -> Iterator[tuple]:
    """(key, group, separator) of (key, speaker, seconds): consecutive rows are merged until one is too short to extend, long enough, or the limits are met."""
    group, total, n, last = -1, 0.0, 0, None
    for key, speaker, seconds in rows:
        if group < 0 or total < least or total > enough or n >= n_most or total + seconds > most:
            group, total, n, sep = group + 1, seconds, 1, ""
        else:
            total, n, sep = total + seconds, n + 1, " " if speaker == last else f" {SWITCH} "
        last = speaker
        yield key, group, sep


def merge_utterances(df: DataFrame, shard: str, order: list[str], key: str = "key", text: str = "txt", seconds: str = "seconds", least: float = 1, enough: float = 10, most: float = 20, n_most: int = 7) -> DataFrame:
    """(shard, key of the first, n, seconds, txt) of merged utterances."""
    kind = df.schema[key].dataType.simpleString()
    keyed = df.withColumn("_spk", speaker_of(F.col(key).cast("string")))
    groups = cuts.cut(keyed, shard, order, key, {"speaker": "_spk", "seconds": seconds}, cuts.Merge(least, enough, most, n_most)) if _long(df, shard) else None
    if groups is None:
        groups = _fold(keyed, shard, order, [key, "_spk", seconds], lambda rows: merges(rows, least, enough, most, n_most), f"{key} {kind}, group_id long, sep string")
    groups = groups.withColumnRenamed("batch_id", "group_id")
    rows = df.join(groups, [shard, key]).groupBy(shard, "group_id").agg(
        F.array_sort(F.collect_list(F.struct(*order, F.col(key).alias("_key"), F.col("sep").alias("_sep"), F.col(text).alias("_text")))).alias("r"), F.sum(seconds).alias("seconds"), F.count("*").alias("n"))
    joined = F.array_join(F.transform("r", lambda x: F.concat(x["_sep"], x["_text"])), "")
    return rows.select(shard, F.get("r", F.lit(0))["_key"].alias(key), "n", "seconds", F.replace(joined, F.lit(f"{SWITCH} {SWITCH}"), F.lit(SWITCH)).alias(text))
