"""Places of rows in their group at any size, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stage import materialise


def numbered(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """rows with pos, a row's place in its group from 0, and n, the group's rows. group is never null; rows of equal order in any order.

    Rows are sorted by range, so a group may be in many parts; each part counts its rows of a group, and the counts are summed.
    """
    keys = [F.col(group), *order, F.col("_tie")]
    parts = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    placed = materialise(parts.withColumn("_seq", F.monotonically_increasing_id()), "numbered").withColumn("_part", F.shiftright("_seq", 33))
    runs = placed.groupBy("_part", group).agg(F.min("_seq").alias("_first"), F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(group).orderBy("_part")) - F.col("_rows")
    runs = runs.select("_part", group, (F.col("_first") - before).alias("_start"), F.sum("_rows").over(Window.partitionBy(group)).alias("n"))
    return placed.join(runs, ["_part", group]).withColumn("pos", F.col("_seq") - F.col("_start")).drop("_seq", "_part", "_start")
