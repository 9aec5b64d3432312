"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, materialise, spread_join


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """From (u, v) to (node, root), root the least node of its component; only nodes that have edges to others.

    Each round is written to the shared folder. The least neighbour is a plain aggregate, so a node with very many edges is
    pre-aggregated; its edges then meet the least neighbour in many tasks. Null nodes are left out.
    """
    both = lambda e: e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    edges = edges.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialise(edges, "components")
    before = None

    def with_least(near: DataFrame, total: int, least: F.Column) -> DataFrame:
        """near (u, v) with m, the least neighbour of u."""
        stars = materialise(near.groupBy("u").agg(least.alias("m"), F.count("*").alias("n")), "components-least")
        hot = stars.filter(F.col("n") > max(1_000, total // HOT_KEYS))
        return spread_join(near, stars.select("u", "m"), ["u"], hot, F.col("v"))

    count = edges.count()
    for _ in range(max_rounds if count else 0):
        near = with_least(both(edges), 2 * count, F.least(F.min("v"), F.first("u"))).filter("v > u")
        large = materialise(near.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "components")  # larger neighbours to the least
        small = with_least(large, count, F.min("v"))  # here u > v always
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = materialise(small.filter("u <> v").distinct(), "components")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, count = now, now[0]
    else:
        if count:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
