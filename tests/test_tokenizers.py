"""The tokenizer interface."""

from __future__ import annotations

from pyspark.sql import functions as F

from uttframe.functions import tokenizers as K


def value(spark, column):
    return spark.createDataFrame([("ab c", ["ab", "c z"])], "t string, p array<string>").select(column.alias("x")).first().x


def test_kinds(spark):
    units = {"a": 1, "b": 2, "c": 3, "▁": 4, "ab": 5, "<unk>": 0}
    char = K.tokenizer("char", vocabulary=units)
    assert value(spark, char.ids(char.tokens(F.col("t")))) == [1, 2, 4, 3]
    assert value(spark, char.text(char.from_ids(char.ids(char.tokens(F.col("t")))))) == "ab c"
    assert [value(spark, x) for x in K.phrases(F.col("p"), char)] == [[["a", "b"], ["c", "▁", "z"]], [[1, 2], [3, 4, 0]]]
    piece = K.tokenizer("segment", vocabulary=units, pieces={"ab": "a b"})
    assert value(spark, piece.tokens(F.col("t"))) == ["a", "b", "c"]
    other = K.tokenizer("library", vocabulary=units, load=lambda: str.split)
    assert value(spark, other.ids(other.tokens(F.col("t")))) == [5, 3]


def test_prefixes(spark):
    names, prefixes = F.array(F.lit("enc.a"), F.lit("dec.b")), F.array(F.lit("enc"), F.lit("ctc"))
    assert value(spark, K.has_prefix(F.lit("enc.a"), prefixes)) and not value(spark, K.has_prefix(F.lit("x"), prefixes))
    assert value(spark, K.unmatched_prefixes(names, prefixes)) == ["ctc"]
