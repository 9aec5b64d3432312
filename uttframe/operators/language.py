"""Language detection: a naive Bayes of character n-grams, counted and scored as joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stage import materialise
from ..llm.common import light_batches
from .vocab import SALTS

BROADCAST_ROWS = 500_000  # n-grams of a model that all tasks get; a larger one is joined by n-gram


def ngram_counts(text: Column, n: int = 3) -> Column:
    """A text's different n-grams, lower-case with single blanks, and how often it has each."""
    padded = F.concat(F.lit(" "), F.lower(F.regexp_replace(text, r"\s+", " ")), F.lit(" "))

    @F.arrow_udf("array<struct<ngram:string,c:long>>")
    def of(texts: pa.Array) -> pa.Array:
        found, counts = [], []
        for t in texts.to_pylist():
            c = np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(c, n)) if len(c) >= n else np.zeros((0, n), dtype=np.uint32)
            if n <= 3:  # 21 bits a character
                ids = np.zeros(len(rows), dtype=np.uint64)
                for i in range(n):
                    ids = ids << np.uint64(21) | rows[:, i].astype(np.uint64)
                _, first, count = np.unique(ids, return_index=True, return_counts=True)
            else:
                _, first, count = np.unique(rows, axis=0, return_index=True, return_counts=True)
            found.append(rows[first])
            counts.append(count)
        sizes = [len(x) for x in counts]
        grams = np.concatenate(found) if found else np.zeros((0, n), dtype=np.uint32)
        text = grams.tobytes().decode("utf-32-le", "surrogatepass")
        values = pa.StructArray.from_arrays([pa.array([text[i : i + n] for i in range(0, len(text), n)], pa.string()), pa.array(np.concatenate(counts) if counts else [], pa.int64())], ["ngram", "c"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), values)

    return of(padded)


def train(df: DataFrame, text: str, lang: str, n: int = 3) -> DataFrame:
    """(lang, ngram, logp) with add-one smoothing; the row of ngram null holds unseen ones."""
    light_batches(df.sparkSession)
    each = df.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.inline(ngram_counts(F.col(text), n)))
    counts = materialise(each.groupBy("lang", "ngram").agg(F.sum("c").alias("c")), "ngram-counts")
    totals = counts.groupBy("lang").agg(F.sum("c").alias("total"), F.count("*").alias("kinds"))
    size = F.col("total") + F.col("kinds")
    seen = counts.join(F.broadcast(totals), "lang").select("lang", "ngram", F.log((F.col("c") + 1) / size).alias("logp"))
    return seen.unionByName(totals.select("lang", F.lit(None).cast("string").alias("ngram"), F.log(1 / size).alias("logp")))


def detect(df: DataFrame, model: DataFrame, key: str, text: str, langs: list[str] | None = None, n: int = 3) -> DataFrame:
    """(key, language, score): the likeliest of langs, the first by name of equal ones. An n-gram's gain over an unseen one is summed, so unseen ones need no rows.

    Languages are few, so they are columns of the model: a row has an n-gram's gains for all of them.
    """
    light_batches(df.sparkSession)
    if langs:
        model = model.filter(F.col("lang").isin(langs))
    unseen = {r.lang: r.logp for r in model.filter("ngram IS NULL").collect()}  # a row a language
    base = F.coalesce(*[F.when(F.col("lang") == x, F.lit(v)) for x, v in unseen.items()], F.lit(0.0))
    columns = {x: f"_g{i}" for i, x in enumerate(sorted(unseen))}
    gain = [F.coalesce(F.max(F.when(F.col("lang") == x, F.col("logp") - base)), F.lit(0.0)).alias(c) for x, c in columns.items()]
    gains = materialise(model.filter("ngram IS NOT NULL").groupBy("ngram").agg(F.count("*").alias("_n"), *gain).drop("_n"), "ngram-gains")
    each = df.select(key, F.inline(ngram_counts(F.col(text), n)))
    if gains.count() <= BROADCAST_ROWS:
        met = each.join(F.broadcast(gains), "ngram", "left")
    else:  # the keys of a common n-gram are dealt to several tasks, each with a copy of its gains
        dealt = each.withColumn("_deal", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
        met = dealt.join(gains.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["ngram", "_deal"], "left")
    summed = met.groupBy(key).agg(F.sum("c").alias("_n"), *[F.sum(F.col("c") * F.coalesce(c, F.lit(0.0))).alias(c) for c in columns.values()])
    score = lambda x: F.col("_n") * F.lit(unseen[x]) + F.col(columns[x])
    none = F.lit(None).cast("struct<s:double,l:string>")
    best = F.array_min(F.array(none, *[F.struct((-score(x)).alias("s"), F.lit(x).alias("l")) for x in columns]))
    return summed.select(key, best.alias("_b")).filter("_b IS NOT NULL").select(key, F.col("_b.l").alias("language"), (-F.col("_b.s")).alias("score"))
