"""Joins with vocabularies, dictionaries and banks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rand import below, uniform
from ..functions.text import CJK, split_cjk, split_words


def encode(tokens: Column, vocab: dict[str, int], unk: str = "<unk>") -> Column:
    """Ids of tokens; others get the id of unk, or are left out if the vocabulary has none."""
    table = F.create_map(*[F.lit(x) for pair in vocab.items() for x in pair])
    ids = F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), F.lit(vocab.get(unk)).cast("int")))
    return ids if vocab.get(unk) is not None else F.filter(ids, lambda i: i.isNotNull())


#: Tasks that the rows of one token are dealt to, each with a copy of its entry.
SALTS = 16


def translate(df: DataFrame, key: str, items: str, table: DataFrame) -> DataFrame:
    """(key, found) of (key, items array) rows, a struct (item, to) for each item in its place, from a table (item, to) of any size; to is null where it has none.

    The items are joined with the table and put together again by place: no map is part of an expression. An item's different
    keys are dealt to SALTS tasks, so that a common one is no task of its own. Rows that share a key are one: their items
    follow each other by place. Null and empty arrays give empty ones. Of an item's several entries the least counts.
    """
    salt = F.pmod(F.xxhash64(F.col(key)), F.lit(SALTS)).cast("int")
    entries = table.select("item", "to").filter("item IS NOT NULL").groupBy("item").agg(F.min("to").alias("to"))
    entries = entries.select(F.col("item").alias("_item"), "to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    each = df.select(F.col(key).alias("_key"), salt.alias("_deal"), F.posexplode(items).alias("_i", "item"))
    met = each.join(entries, (F.col("item") == F.col("_item")) & (F.col("_deal") == F.col("_salt")), "left")
    found = met.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_i", "item", "to"))).alias("_x"))
    out = df.select(F.col(key).alias("_k")).distinct().join(found, F.col("_k").eqNullSafe(F.col("_key")), "left")
    kind = f"array<struct<item:{table.schema['item'].dataType.simpleString()},to:{table.schema['to'].dataType.simpleString()}>>"
    return out.select(F.col("_k").alias(key), F.coalesce(F.transform("_x", lambda x: F.struct(x["item"].alias("item"), x["to"].alias("to"))).cast(kind), F.array().cast(kind)).alias("found"))


def encode_join(df: DataFrame, key: str, tokens: str, vocab: DataFrame, unk: str = "<unk>") -> DataFrame:
    """(key, ids) by a join with a table (token, id) of any size; tokens that it lacks get the id of unk, or are left out if it has none."""
    spare = vocab.filter(F.col("token") == unk).agg(F.min("id").alias("_unk"))  # one row
    out = translate(df, key, tokens, vocab.select(F.col("token").alias("item"), F.col("id").alias("to"))).crossJoin(F.broadcast(spare))
    return out.select(key, F.filter(F.transform("found", lambda x: F.coalesce(x["to"], F.col("_unk"))), lambda i: i.isNotNull()).alias("ids"))


def decode_join(df: DataFrame, key: str, ids: str, vocab: DataFrame) -> DataFrame:
    """(key, tokens) of ids by a join with a table (token, id) of any size; an unknown id is an error."""
    out = translate(df, key, ids, vocab.select(F.col("id").alias("item"), F.col("token").alias("to")))
    return out.select(key, F.transform("found", lambda x: F.coalesce(x["to"], F.raise_error(F.concat(F.lit("no token of id "), x["item"].cast("string"))))).alias("tokens"))


def segment_join(df: DataFrame, key: str, text: str, pieces: DataFrame) -> DataFrame:
    """(key, tokens): ``segment`` with a dictionary table (word, pieces) of any size."""
    words = df.select(key, F.flatten(F.transform(split_cjk(F.col(text)), split_words)).alias("_words"))
    out = translate(words, key, "_words", pieces.select(F.col("word").alias("item"), F.col("pieces").alias("to")))
    return out.select(key, F.flatten(F.transform("found", lambda x: F.when(x["item"].rlike(f"^{CJK}$") | x["to"].isNull(), F.array(x["item"])).otherwise(F.split(x["to"], " ")))).alias("tokens"))


def decode(ids: Column, vocab: dict[str, int]) -> Column:
    """Tokens of ids; an unknown id is an error."""
    table = F.create_map(*[F.lit(x) for t, i in vocab.items() for x in (i, t)])
    return F.transform(ids, lambda i: F.coalesce(F.try_element_at(table, i), F.raise_error(F.concat(F.lit("no token of id "), i.cast("string")))))


def segment(text: Column, pieces: dict[str, str]) -> Column:
    """Words that aren't CJK as the dictionary's pieces, where it has them."""
    table = F.create_map(*[F.lit(x) for pair in pieces.items() for x in pair]) if pieces else F.lit(None).cast("map<string,string>")
    words = F.flatten(F.transform(split_cjk(text), split_words))
    return F.flatten(F.transform(words, lambda w: F.when(w.rlike(f"^{CJK}$"), F.array(w)).otherwise(F.coalesce(F.split(F.try_element_at(table, w), " "), F.array(w)))))


def not_done(todo: DataFrame, done: DataFrame, on: tuple[str, ...] = ("dataset", "checkpoint")) -> DataFrame:
    return todo.join(done.select(*on).distinct(), list(on), "left_anti")


def random_partner(df: DataFrame, bank: DataFrame, n: int, key: str = "key", p: float = 0.2, seed: int = 0) -> DataFrame:
    """df, with probability p joined to a row of a bank whose column bank_id runs from 0 to n - 1."""
    chosen = F.when(uniform(key, op="partner", seed=seed) < p, below(n, key, op="partner_id", seed=seed))
    return df.withColumn("bank_id", chosen).join(bank, "bank_id", "left")
