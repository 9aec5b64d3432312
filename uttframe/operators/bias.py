"""Rare words, bias phrases with distractors, and curriculum-sized samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.places import numbered
from ..functions.rand import below, order_key, uniform
from ..functions.text import split_words


def word_counts(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.explode(split_words(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))


def rare_words(counts: DataFrame, threshold: int = 20) -> DataFrame:
    """Words of letters alone that are seen threshold times at most."""
    return rare_counts(counts, threshold).select("word")


def rare_counts(counts: DataFrame, threshold: int = 20) -> DataFrame:
    """The rows of counts (word, freq) of rare words. Only words that are rare meet the pattern, so it stays behind the count."""
    return counts.filter(F.when(F.col("freq") <= threshold, F.col("word")).rlike(r"^\p{L}+$"))


def common_words(counts: DataFrame, threshold: int = 20, most: int = 50_000) -> DataFrame:
    """The most frequent words, ``most`` at most, of those that are seen more than threshold times: a list that every task can hold."""
    return counts.filter(F.col("freq") > threshold).orderBy(F.desc("freq"), "word").limit(most).select("word")


def bias_phrases(df: DataFrame, rare: DataFrame, key: str = "key", text: str = "txt", n_order: int = 3, p_keep: float = 1.0, seed: int = 0, common: DataFrame | None = None) -> DataFrame:
    """(key, phrases, distractors) of utterances with a rare word.

    Each rare occurrence gives the phrase of up to n words before it and the word, and a distractor: n words drawn from the
    utterance (without those equal to the rare word) wherever in it the rare word stands, and one other of all rare words,
    any of them as likely, in hash order. With probability 1 - p_keep the lists are empty. common: words that are surely not
    rare, a list that every task can hold; their places, most of all, are left out before places meet the rare words. Common
    words that are not in the list meet the rare words and find none, so its length changes no result.
    """
    # Rare words have numbers without gaps, of which a place draws one that is not its own word's; only places and words
    # are joined, and a text's hits meet it again as one array.
    ring = numbered(rare.select(F.col("word").alias("_word"), F.lit(0).alias("_all")).filter("_word IS NOT NULL").distinct(), "_all", [F.col("_word")])
    each = df.select(key, F.posexplode(split_words(F.col(text))).alias("_i", "_word"))
    if common is not None:
        each = each.join(F.broadcast(common.select(F.col("word").alias("_word"))), "_word", "left_anti")
    drawn = F.when(F.col("_n") > 1, F.pmod(order_key(key, "_i", op="rare", seed=seed), F.col("_n") - 1))
    own = ring.select("_word", F.col("pos").alias("_pos"), F.col("n").alias("_n"))
    hits = each.join(own, "_word").select(key, "_i", "_word", (drawn + (drawn >= F.col("_pos")).cast("int")).alias("_at"))
    hits = hits.join(ring.select(F.col("pos").alias("_at"), F.col("_word").alias("_other")), "_at", "left")
    by_key = hits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_i", "_word", "_other"))).alias("_hits"))
    # Texts meet their hits as they are, and those with hits are cut into words again: arrays of words are several times as long.
    rows = df.select(key, F.col(text).alias("_text")).join(by_key, key).select(key, "_hits", split_words(F.col("_text")).alias("_w"))

    def count(h: Column) -> Column:
        n = below(n_order, F.col(key), h["_i"], op="n", seed=seed)
        return F.when(n < F.size("_w"), n).otherwise(1)

    def phrase(h: Column) -> Column:
        n = F.least(count(h), h["_i"])
        return F.array_join(F.slice("_w", h["_i"] - n + 1, n + 1), " ")

    def distractor(h: Column) -> Column:
        at = F.when(count(h) > 0, F.sequence(F.lit(1), count(h))).otherwise(F.array().cast("array<int>"))
        others = F.transform(at, lambda j: F.get("_w", F.pmod(order_key(F.col(key), h["_i"], j, op="other", seed=seed), F.size("_w")).cast("int")))
        found = F.filter(F.array_append(others, h["_other"]), lambda w: w.isNotNull() & (w != h["_word"]))
        turned = F.transform(found, lambda w: F.struct(order_key(F.col(key), h["_i"], w, op="order", seed=seed).alias("h"), w.alias("w")))
        return F.array_join(F.transform(F.array_sort(turned), lambda x: x["w"]), " ")

    keep = uniform(key, op="keep", seed=seed) < p_keep
    none = F.array().cast("array<string>")
    return rows.select(key, F.when(keep, F.transform("_hits", phrase)).otherwise(none).alias("phrases"), F.when(keep, F.transform("_hits", distractor)).otherwise(none).alias("distractors"))


def sample_size(n: Column, epoch: int, max_epoch: int) -> Column:
    """How many of n a curriculum takes: its share grows with the epoch."""
    return F.least(n, F.ceil(n * (epoch + 1) / (max_epoch + 1)))


def first_by_hash(xs: Column, n: Column, key: Column, op: str, seed: int = 0) -> Column:
    """n items of an array, chosen by the hash of key, place and item."""
    ranked = F.array_sort(F.transform(xs, lambda x, i: F.struct(order_key(key, i, x, op=op, seed=seed).alias("h"), i.alias("i"), x.alias("x"))))
    return F.transform(F.slice(ranked, 1, n.cast("int")), lambda r: r["x"])


def bias_list(batches: DataFrame, batch: str, ratio: float = 0.2, epoch: int = 0, max_epoch: int = 0, seed: int = 0) -> DataFrame:
    """(batch, words): all phrases of a batch and a share of its distractors, then a curriculum sample."""
    both = batches.groupBy(batch).agg(F.flatten(F.collect_list("phrases")).alias("p"), F.flatten(F.collect_list("distractors")).alias("d"))
    some = first_by_hash(F.array_sort("d"), F.bround(F.lit(ratio) * F.size("d")), F.col(batch), "distractor", seed)
    whole = both.select(batch, F.concat(F.array_sort("p"), some).alias("_l"))
    return whole.select(batch, first_by_hash(F.col("_l"), sample_size(F.size("_l"), epoch, max_epoch), F.col(batch), "curriculum", seed).alias("words"))


def list_difference(files: DataFrame, gone: DataFrame, on: str = "path") -> DataFrame:
    return files.join(gone.select(on).distinct(), on, "left_anti")
