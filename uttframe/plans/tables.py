"""Queries over orders and lineitem as hypotheses, runs and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import batching, filters, ranking, scoring, vocab
from .base import Tables, query

SHARD, ORDER = ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
POS = "row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice)"
ID = ["l_suppkey", "l_orderkey", "l_linenumber"]


@query(f"SELECT l_suppkey, l_orderkey, l_linenumber, ({POS} - 1) // 16 AS batch_id FROM lineitem")
def static_batch(t: Tables) -> DataFrame:
    return batching.static_batch(t.lineitem, SHARD, ORDER).select(*ID, "batch_id")


@query(f"""WITH b AS (SELECT *, CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 30 THEN 1 ELSE 2 END AS bucket FROM lineitem)
    SELECT l_suppkey, l_orderkey, l_linenumber, bucket, (row_number() OVER (PARTITION BY l_suppkey, bucket ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1) // CASE bucket WHEN 0 THEN 32 WHEN 1 THEN 16 ELSE 8 END AS batch_id FROM b""")
def bucket_batch(t: Tables) -> DataFrame:
    return batching.bucket_batch(t.lineitem, SHARD, ORDER, "l_quantity", [10, 30], [32, 16, 8]).select(*ID, "bucket", "batch_id")


@query(f"""WITH b AS (SELECT *, ({POS} - 1) // 50 AS block, {POS} AS pos FROM lineitem)
    SELECT l_suppkey, l_orderkey, l_linenumber, block, row_number() OVER (PARTITION BY l_suppkey, block ORDER BY l_quantity, pos) AS rank FROM b""")
def sorted_blocks(t: Tables) -> DataFrame:
    return ranking.sorted_blocks(t.lineitem, SHARD, ORDER, "l_quantity", 50).select(*ID, "block", "rank")


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) % 7 AS shard FROM orders")
def rank_shards(t: Tables) -> DataFrame:
    return batching.shard_of(t.orders.select("o_orderkey"), ["o_orderkey"], 7)


@query("""SELECT l_orderkey, l_linenumber, round(s, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY s DESC, l_linenumber) AS n FROM
    (SELECT l_orderkey, l_linenumber, 0.7 * (0.0 + -l_discount + -l_tax) + 0.3 * (0.0 + -l_tax + -l_quantity / 100) + 0.1 * -(l_extendedprice / 10000) AS s FROM lineitem)) WHERE n = 1""")
def nbest_rescore(t: Tables) -> DataFrame:
    hyps = t.lineitem.select(
        "l_orderkey", F.col("l_linenumber").alias("rank"), F.array("l_linenumber").alias("tokens"), F.array(-F.col("l_discount"), -F.col("l_tax")).alias("l2r"),
        F.array(-F.col("l_tax"), -F.col("l_quantity") / 100).alias("r2l"), (-(F.col("l_extendedprice") / 10000)).alias("ctc"))
    return ranking.rescore(hyps, "l_orderkey", right_weight=0.3, ctc_weight=0.1).select("l_orderkey", F.col("rank").alias("l_linenumber"), F.round("score", 9).alias("score"))


@query("""SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice / sqrt(l_quantity) DESC, l_linenumber) AS n FROM lineitem) WHERE n = 1""")
def best_of_beam(t: Tables) -> DataFrame:
    hyps = t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("rank"), F.col("l_extendedprice").alias("score"), F.col("l_quantity").alias("length"))
    return ranking.best_of_beam(hyps, "l_orderkey", 0.5).select("l_orderkey", F.col("rank").alias("l_linenumber"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey BETWEEN 10 AND 10000 AND regexp_matches(o_orderpriority, 'HIGH|URGENT') ORDER BY o_totalprice, o_orderkey LIMIT 30")
def snapshot_topk(t: Tables) -> DataFrame:
    runs = t.orders.select(F.col("o_custkey").alias("epoch"), F.col("o_orderkey").alias("step"), F.col("o_totalprice").alias("loss"), F.col("o_orderpriority").alias("tag"))
    return ranking.best_snapshots(runs, 30, epochs=(10, 10000), tag="HIGH|URGENT", exact=False).select(F.col("step").alias("o_orderkey"), F.col("loss").alias("o_totalprice"))


@query("""WITH c AS (SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 100)
    SELECT l_linenumber AS param, [round(sum(l_discount) / 100, 9), round(sum(l_tax) / 100, 9)] AS values FROM lineitem WHERE l_orderkey IN (SELECT * FROM c) GROUP BY l_linenumber""")
def weight_average(t: Tables) -> DataFrame:
    runs = t.orders.select(F.col("o_orderkey").alias("checkpoint"), F.col("o_orderkey").alias("step"), F.col("o_totalprice").alias("loss"))
    values = t.lineitem.select(F.col("l_orderkey").alias("checkpoint"), F.col("l_linenumber").alias("param"), F.array("l_discount", "l_tax").alias("values"))
    out = ranking.average_weights(values, ranking.best_snapshots(runs, 100, exact=False), 100)
    return out.select("param", F.transform("values", lambda v: F.round(v, 9)).alias("values"))


@query("SELECT l_returnflag, round(sum(l_discount * l_quantity) / (1 + sum(l_quantity)), 9) AS loss, round(avg(l_tax), 9) AS acc FROM lineitem WHERE l_quantity > 0 GROUP BY l_returnflag")
def cv_loss(t: Tables) -> DataFrame:
    batches = t.lineitem.select("l_returnflag", F.col("l_discount").alias("loss"), F.col("l_quantity").alias("n_utts"), F.col("l_tax").alias("acc"))
    out = ranking.cv_loss(batches, "l_returnflag")
    return out.select("l_returnflag", F.round("loss", 9).alias("loss"), F.round("acc", 9).alias("acc"))


@query("""SELECT l_linestatus, count(*) FILTER (WHERE t <> 6 AND p = t) AS n_right, count(*) FILTER (WHERE t <> 6) AS n_used, count(*) FILTER (WHERE t <> 6 AND p = t) / nullif(count(*) FILTER (WHERE t <> 6), 0) AS accuracy
    FROM (SELECT l_linestatus, l_linenumber AS t, l_orderkey % 7 + 1 AS p FROM lineitem) GROUP BY l_linestatus""")
def token_accuracy(t: Tables) -> DataFrame:
    return ranking.token_accuracy(t.lineitem, F.col("l_orderkey") % 7 + 1, F.col("l_linenumber"), 6, "l_linestatus")


@query("""SELECT l_returnflag, sum(l_linenumber)::BIGINT AS insertions, sum(l_orderkey % 3)::BIGINT AS deletions, sum(l_partkey % 4)::BIGINT AS substitutions, (sum(l_quantity + 20) - sum(l_partkey % 4) - sum(l_orderkey % 3))::BIGINT AS correct, sum(l_quantity + 20)::BIGINT AS num_ref,
    sum(l_linenumber) / sum(l_quantity + 20) AS ins_rate, sum(l_orderkey % 3) / sum(l_quantity + 20) AS del_rate, sum(l_partkey % 4) / sum(l_quantity + 20) AS sub_rate, (sum(l_linenumber) + sum(l_orderkey % 3) + sum(l_partkey % 4)) / sum(l_quantity + 20) AS wer FROM lineitem GROUP BY l_returnflag""")
def wer_by_suite(t: Tables) -> DataFrame:
    n = {"insertions": F.col("l_linenumber").cast("long"), "deletions": F.col("l_orderkey") % 3, "substitutions": F.col("l_partkey") % 4}
    rows = t.lineitem.select("l_returnflag", *[c.alias(k) for k, c in n.items()], (n["insertions"] + n["deletions"] + n["substitutions"]).alias("num_errors"), (F.col("l_quantity") + 20).cast("long").alias("num_ref"))
    return scoring.word_error_rate(rows, "l_returnflag")


@query("SELECT o_orderkey, coalesce(c.id, 0) AS speaker_id FROM orders LEFT JOIN (SELECT c_custkey, (c_custkey * 10)::INT AS id FROM customer WHERE c_nationkey > 5) c ON o_custkey = c_custkey")
def speaker_ids(t: Tables) -> DataFrame:
    speakers = t.customer.filter("c_nationkey > 5").select(F.col("c_custkey").alias("speaker"), (F.col("c_custkey") * 10).cast("int").alias("id"))
    return filters.speaker_ids(t.orders.withColumn("speaker", F.col("o_custkey")), speakers).select("o_orderkey", "speaker_id")


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_suppkey = o.o_custkey)")
def skip_processed(t: Tables) -> DataFrame:
    done = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("o_custkey"))
    return vocab.not_done(t.orders.select("o_orderkey", "o_custkey"), done, ("o_orderkey", "o_custkey"))


@query("""SELECT o_orderstatus AS dataset, o_orderpriority AS checkpoint, max(o_totalprice) FILTER (WHERE o_orderkey % 4 = 0) AS loss, min(o_totalprice) FILTER (WHERE o_orderkey % 4 = 0) AS acc_att, max(o_totalprice) FILTER (WHERE o_orderkey % 4 = 1) AS loss_tel, min(o_totalprice) FILTER (WHERE o_orderkey % 4 = 1) AS acc_att_tel,
    max(o_totalprice) FILTER (WHERE o_orderkey % 4 = 2) AS loss_echo, min(o_totalprice) FILTER (WHERE o_orderkey % 4 = 2) AS acc_att_echo, max(o_totalprice) FILTER (WHERE o_orderkey % 4 = 3) AS loss_tel_echo, min(o_totalprice) FILTER (WHERE o_orderkey % 4 = 3) AS acc_att_tel_echo FROM orders GROUP BY ALL""")
def loss_table(t: Tables) -> DataFrame:
    condition = F.element_at(F.array(*[F.lit(c) for c in ranking.CONDITIONS]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    each = t.orders.groupBy(F.col("o_orderstatus").alias("dataset"), F.col("o_orderpriority").alias("checkpoint"), condition.alias("condition")).agg(F.max("o_totalprice").alias("loss"), F.min("o_totalprice").alias("acc_att"))
    return ranking.loss_table(each)


@query("SELECT o_orderkey FROM orders")
def shuffled_orders(t: Tables) -> DataFrame:
    return ranking.shuffled(t.orders.select("o_orderkey"), "o_orderkey", seed=3, epoch=1)


@query("SELECT count(*) AS n, count(DISTINCT o_orderkey) AS n_keys, true AS mixed FROM orders")
def shuffled_places(t: Tables) -> DataFrame:
    """Shuffled orders by their place: each order once, and about as often a smaller key after a larger one as the reverse."""
    rows = ranking.shuffled(t.orders.select("o_orderkey"), "o_orderkey", seed=3, epoch=1).withColumn("place", F.monotonically_increasing_id())
    part = F.shiftright("place", 33)
    before = F.lag("o_orderkey").over(Window.partitionBy(part).orderBy("place"))
    return rows.withColumn("_b", before).agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("n_keys"), (F.count(F.when(F.col("_b") > F.col("o_orderkey"), 1)) / F.count("_b")).between(0.45, 0.55).alias("mixed"))
