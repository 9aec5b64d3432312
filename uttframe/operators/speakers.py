"""Words to speakers: interval joins by file and time cell, with the nearest segment where none overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import bind


def assign_speakers(words: DataFrame, segments: DataFrame, bucket: float = 10.0) -> DataFrame:
    """words (file, word_id, start, dur) with speaker, from segments (file, start, end, label).

    The label with the largest summed overlap wins, then the earlier start, then the label. A word that overlaps nothing,
    or has no length, gets the segment with the smallest gap (then the earlier start, then the label); a file without
    segments gives the empty label.

    Time is cut into cells no shorter than the longest word. A cell has the segments that a word which starts in it may meet,
    the one that ended last before these, and the one that starts next after these; so a word meets one row, its cell's.
    """
    longest = words.agg(F.max("dur")).first()[0] or 0
    width = float(max(bucket, longest))
    cell = lambda t: F.floor(t / width)
    w = words.withColumn("_cell", cell(F.col("start")))
    s = segments.select("file", F.col("start").cast("double").alias("s"), F.col("end").cast("double").alias("e"), "label").withColumns({"_from": cell(F.col("s") - longest), "_to": cell(F.col("e"))})

    inside = s.select("file", F.explode(F.sequence("_from", "_to")).alias("_cell"), F.struct("s", "e", "label").alias("x")).groupBy("file", "_cell").agg(F.collect_list("x").alias("_segments"))
    past = s.groupBy("file", (F.col("_to") + 1).alias("_cell")).agg(F.min(F.struct((-F.col("e")).alias("minus"), "s", "label")).alias("_past"))
    coming = s.groupBy("file", (F.col("_from") - 1).alias("_cell")).agg(F.min(F.struct("s", "label")).alias("_coming"))
    cells = w.select("file", "_cell").distinct()
    for part in (inside, past, coming):
        cells = cells.unionByName(part, allowMissingColumns=True)
    cells = cells.groupBy("file", "_cell").agg(F.first("_segments", ignorenulls=True).alias("_segments"), F.min("_past").alias("_past"), F.min("_coming").alias("_coming"))
    line = Window.partitionBy("file").orderBy("_cell")
    cells = cells.select(
        "file", "_cell", "_segments", F.min("_past").over(line.rowsBetween(Window.unboundedPreceding, 0)).alias("_past"),
        F.min("_coming").over(line.rowsBetween(0, Window.unboundedFollowing)).alias("_coming"),
    )
    return w.join(cells, ["file", "_cell"], "left").withColumn("speaker", _speaker(F.col("start").cast("double"), (F.col("start") + F.col("dur")).cast("double"))).drop("_cell", "_segments", "_past", "_coming")


def _speaker(start: Column, end: Column) -> Column:
    """The label of a word beside the columns of its cell."""
    met = F.filter("_segments", lambda x: (x["s"] < end) & (start < x["e"]))

    def best(hits: Column) -> Column:
        def of(label: Column) -> Column:
            own = F.filter(hits, lambda x: x["label"] == label)
            overlap = F.aggregate(own, F.lit(0.0), lambda a, x: a + F.least(end, x["e"]) - F.greatest(start, x["s"]))
            return F.struct((-overlap).alias("minus"), F.array_min(F.transform(own, lambda x: x["s"])).alias("s"), label.alias("label"))

        return F.array_min(F.transform(F.array_distinct(F.transform(hits, lambda x: x["label"])), of))["label"]

    gap = lambda g, x: F.struct(F.greatest(F.lit(0.0), *g).alias("gap"), x["s"].alias("s"), x["label"].alias("label"))
    near = F.concat(
        F.transform(F.coalesce("_segments", F.array().cast("array<struct<s:double,e:double,label:string>>")), lambda x: gap([start - x["e"], x["s"] - end], x)),
        F.array(F.when(F.col("_past").isNotNull(), gap([start + F.col("_past.minus")], F.col("_past"))), F.when(F.col("_coming").isNotNull(), gap([F.col("_coming.s") - end], F.col("_coming")))),
    )
    return F.coalesce(bind(met, best), F.array_min(near)["label"], F.lit(""))


def _in_cells(words: DataFrame, segments: DataFrame, bucket: float) -> DataFrame:
    """Words (start, end) and segments (s, e) of a file that share a time bucket, each pair in the first one."""
    cells = lambda a, b: F.sequence(F.floor(F.col(a) / bucket), F.floor(F.col(b) / bucket))
    pairs = words.withColumn("cell", F.explode(cells("start", "end"))).join(segments.withColumn("cell", F.explode(cells("s", "e"))), ["file", "cell"])
    return pairs.filter(F.greatest(F.floor(F.col("start") / bucket), F.floor(F.col("s") / bucket)) == F.col("cell"))


def overlap_seconds(words: DataFrame, segments: DataFrame, bucket: float = 10.0) -> DataFrame:
    """Seconds that each speaker's segments overlap the words of a file."""
    w = words.withColumn("end", F.col("start") + F.col("dur")).select("file", "start", "end")
    s = segments.select("file", F.col("start").alias("s"), F.col("end").alias("e"), "label")
    pairs = _in_cells(w, s, bucket).filter((F.col("s") < F.col("end")) & (F.col("start") < F.col("e")))
    return pairs.groupBy("file", "label").agg(F.sum(F.least("end", "e") - F.greatest("start", "s")).alias("seconds"))
