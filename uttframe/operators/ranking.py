"""Sorting, shuffling, top-k, rescoring, and experiment bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import blank_penalty
from ..functions.rand import order_key


def sorted_blocks(df: DataFrame, shard: list[str], order: list[str], length: str, buffer: int = 500, reverse: bool = False) -> DataFrame:
    """df with block and rank: rows sorted by length within consecutive blocks, stable."""
    pos = F.row_number().over(Window.partitionBy(*shard).orderBy(*order))
    blocks = df.withColumn("_pos", pos).withColumn("block", F.floor((F.col("_pos") - 1) / buffer))
    by = Window.partitionBy(*shard, "block").orderBy(F.desc(length) if reverse else F.asc(length), "_pos")
    return blocks.withColumn("rank", F.row_number().over(by)).drop("_pos")


def shuffled(df: DataFrame, key: str, seed: int = 0, epoch: int = 0, block: str | None = None) -> DataFrame:
    """df in hash order, over all or within blocks."""
    x = order_key(key, op="shuffle", seed=seed, epoch=epoch)
    return df.orderBy(block, x, key) if block else df.orderBy(x, key)


def best_snapshots(runs: DataFrame, n: int, score: str = "loss", descending: bool = False, epochs: tuple[int, int] | None = None, steps: tuple[int, int] | None = None, tag: str | None = None, exact: bool = True) -> DataFrame:
    """The first n rows by score; with exact, fewer than n are an error."""
    for column, limits in (("epoch", epochs), ("step", steps)):
        if limits:
            runs = runs.filter(F.col(column).between(*limits))
    if tag:
        runs = runs.filter(F.col("tag").rlike(tag))
    top = runs.orderBy(F.desc(score) if descending else F.asc(score), "step").limit(n)
    if exact and (found := top.count()) != n:
        raise ValueError(f"{found} snapshots match, {n} are asked for")
    return top


def average_weights(values: DataFrame, chosen: DataFrame, n: int | None = None) -> DataFrame:
    """(param, values) averaged over chosen checkpoints; values has (checkpoint, param, values array)."""
    n = n or chosen.count()
    each = values.join(F.broadcast(chosen.select("checkpoint")), "checkpoint", "left_semi").select("param", F.posexplode("values").alias("i", "v"))  # chosen: the n rows of a ranking
    mean = each.groupBy("param", "i").agg((F.sum(F.col("v").cast("double")) / n).alias("v"))
    return mean.groupBy("param").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("x")).select("param", F.transform("x", lambda p: p["v"]).alias("values"))


def rescore(hyps: DataFrame, key: str, right_weight: float = 0.0, ctc_weight: float = 0.0) -> DataFrame:
    """The best hypothesis of each key by both directions' scores (l2r and r2l hold one log probability a token and one for the end); ties go to the lower rank."""
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    score = (1 - right_weight) * add(F.col("l2r")) + right_weight * add(F.col("r2l"))
    scored = hyps.withColumn("_base", score).withColumns({
        "score": F.col("_base") + ctc_weight * F.col("ctc"),
        "confidence": F.exp(F.col("_base") / F.size("l2r")),
        "tokens_confidence": F.zip_with(F.slice("l2r", 1, F.size("tokens")), F.reverse(F.slice("r2l", 1, F.size("tokens"))), lambda a, b: (F.exp(a) + F.exp(b)) / 2 if right_weight > 0 else F.exp(a)),
    }).drop("_base")
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "rank"))
    return scored.withColumn("_n", first).filter("_n = 1").drop("_n")


def best_of_beam(hyps: DataFrame, key: str, penalty: float) -> DataFrame:
    """The hypothesis with the best score by length to the power of the penalty; no length counts as 1."""
    value = F.col("score") / F.pow(F.greatest(F.col("length"), F.lit(1)).cast("double"), F.lit(penalty))
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("normalised"), "rank"))
    return hyps.withColumn("normalised", value).withColumn("_n", first).filter("_n = 1").drop("_n")


def top_k(scores: Column, k: int) -> Column:
    """The k largest scores with their places, the lower place first among equal ones."""
    pairs = F.transform(scores, lambda x, i: F.struct(x.alias("score"), (-i).alias("minus")))
    return F.transform(F.slice(F.sort_array(pairs, asc=False), 1, k), lambda p: F.struct((-p["minus"]).alias("token"), p["score"].alias("score")))


def with_blank_penalty(frames: DataFrame, scores: str, penalty: float, blank: int = 0) -> DataFrame:
    return frames.withColumn(scores, blank_penalty(F.col(scores), penalty, blank))


CONDITIONS = ("plain", "tel", "echo", "tel_echo")


def loss_table(losses: DataFrame, conditions: tuple[str, ...] = CONDITIONS) -> DataFrame:
    """A row for each dataset and checkpoint from (dataset, checkpoint, condition, loss, acc_att); the first condition gives the plain names."""
    wide = losses.groupBy("dataset", "checkpoint").pivot("condition", list(conditions)).agg(F.first("loss").alias("loss"), F.first("acc_att").alias("acc_att"))
    named = [F.col(f"{c}_{m}").alias(m if c == conditions[0] else f"{m}_{c}") for c in conditions for m in ("loss", "acc_att")]
    return wide.select("dataset", "checkpoint", *named)


def cv_loss(batches: DataFrame, *by: str, start: int = 1) -> DataFrame:
    """Loss weighted by utterances over batches that have any, with a count that begins at ``start``; accuracy unweighted. Non-finite losses are left out."""
    sound = batches.filter((F.col("n_utts") > 0) & ~F.isnan("loss") & (F.abs("loss") != float("inf")))
    return sound.groupBy(*by).agg((F.sum(F.col("loss") * F.col("n_utts")) / (start + F.sum("n_utts"))).alias("loss"), F.avg("acc").alias("acc"))


def token_accuracy(df: DataFrame, pred: Column, target: Column, ignore: Column | int, *by: str) -> DataFrame:
    used = target != ignore
    hits, n = F.sum(F.when(used & (pred == target), 1).otherwise(0)), F.sum(F.when(used, 1).otherwise(0))
    return df.groupBy(*by).agg(hits.alias("n_right"), n.alias("n_used"), (hits / F.when(n != 0, n)).alias("accuracy"))


def seen(df: DataFrame, frames: Column, *by: str, frame_shift_ms: int = 10) -> DataFrame:
    total = F.sum(frames)
    return df.groupBy(*by).agg(total.alias("frames"), (total / (1000 / frame_shift_ms * 3600)).alias("hours"))
