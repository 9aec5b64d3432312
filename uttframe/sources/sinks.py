"""Writers of line formats: a column of lines, written as text by file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import half_even


def ctm_line(audio: Column, start_ms: Column, end_ms: Column, word: Column, confidence: Column) -> Column:
    return F.concat_ws(" ", audio, F.lit("0"), half_even(start_ms / 1000), half_even((end_ms - start_ms) / 1000), word, half_even(confidence))


def stm_line(file: Column, speaker: Column, start: Column, end: Column, token: Column) -> Column:
    return F.concat_ws(" ", file, F.lit("1"), speaker, half_even(start, 3), half_even(end, 3), token)


def rttm_line(file: Column, start: Column, end: Column, label: Column) -> Column:
    return F.concat_ws(" ", F.lit("SPEAKER"), file, F.lit("1"), half_even(start, 3), half_even(end - start, 3), F.lit("<NA> <NA>"), label, F.lit("<NA> <NA>"))


def label_line(start: Column, end: Column, token: Column) -> Column:
    return F.concat_ws(" ", half_even(start), half_even(end), token)


def transcripts(words: DataFrame, keys: list[str], order: str, word: str = "word") -> DataFrame:
    """(keys, txt): words joined in order."""
    rows = words.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, word))).alias("x"))
    return rows.select(*keys, F.array_join(F.transform("x", lambda r: r[word]), " ").alias("txt"))


def token_info(tokens: DataFrame, keys: list[str], order: str = "idx") -> DataFrame:
    """(keys, value): a JSON object of text, confidence and tokens with times, from (token, start, end, confidence) rows."""
    item = F.struct(order, F.struct("token", "start", "end", "confidence").alias("t"))
    rows = tokens.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("x"), F.avg("confidence").alias("confidence"))
    text = F.array_join(F.transform("x", lambda r: r["t"]["token"]), "")
    return rows.select(*keys, F.to_json(F.struct(text.alias("text"), "confidence", F.transform("x", lambda r: r["t"]).alias("tokens"))).alias("value"))


def write_lines(df: DataFrame, line: Column, path: str, by: list[str], order: list[str]) -> None:
    """One folder for each value of ``by``; lines of a file in order."""
    out = df.select(*by, *[c for c in order if c not in by], line.alias("value")).repartition(*by).sortWithinPartitions(*by, *order)
    out.select(*by, "value").write.partitionBy(*by).text(path)


def append_losses(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
