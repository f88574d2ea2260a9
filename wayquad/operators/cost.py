"""Merging of scan intervals and their cost: number of intervals and entropy of the gaps between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merge_intervals(raw: DataFrame) -> DataFrame:
    """(query_id, lo, hi): overlapping and touching intervals of a query become one; empty ones fall out."""
    order = Window.partitionBy("query_id").orderBy("lo", "hi")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    reached = raw.where("hi > lo").distinct().withColumn("reach", F.max("hi").over(before))
    islands = reached.withColumn("island", F.sum(F.when(F.col("lo") <= F.col("reach"), 0).otherwise(1)).over(order))
    return islands.groupBy("query_id", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def gaps(merged: DataFrame) -> DataFrame:
    """(query_id, gap) between consecutive merged intervals."""
    order = Window.partitionBy("query_id").orderBy("lo")
    return merged.select("query_id", (F.lead("lo").over(order) - F.col("hi")).alias("gap")).where("gap > 0")


def query_cost(queries: DataFrame, merged: DataFrame) -> DataFrame:
    """(query_id, n_intervals, entropy, cost) for every query; no interval costs 0, one costs 1."""
    found = gaps(merged)
    share = found.withColumn("p", F.col("gap") / F.sum("gap").over(Window.partitionBy("query_id")))
    entropy = share.groupBy("query_id").agg(F.count(F.lit(1)).alias("k"), (-F.sum(F.col("p") * F.log("p"))).alias("h"))
    normal = F.when(F.col("k") > 1, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("h") / F.log(F.col("k").cast("double"))))).otherwise(0.0)
    counted = merged.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_intervals"))
    all_of = queries.select("query_id").join(counted, "query_id", "left").join(entropy, "query_id", "left")
    return all_of.select("query_id", F.coalesce("n_intervals", F.lit(0)).cast("long").alias("n_intervals"), F.round(F.coalesce(normal, F.lit(0.0)), 6).alias("entropy")).withColumn(
        "cost", F.col("n_intervals") + F.col("entropy")
    )


def compare(code_cost: DataFrame, order_cost: DataFrame, found: DataFrame) -> DataFrame:
    """One row: mean costs under both orders, improvement in percent, summed gain, mean candidates and intervals."""
    counts = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("c"))
    joined = code_cost.select("query_id", F.col("cost").alias("a")).join(order_cost.select("query_id", F.col("cost").alias("b"), "n_intervals"), "query_id").join(counts, "query_id", "left")
    mean = joined.agg(
        F.avg("a").alias("mean_code"), F.avg("b").alias("mean_order"), F.sum(F.col("a") - F.col("b")).alias("gain"), F.avg(F.coalesce("c", F.lit(0))).alias("mean_candidates"), F.avg("n_intervals").alias("mean_intervals")
    )
    better = F.when(F.col("mean_code") > 0, (F.col("mean_code") - F.col("mean_order")) / F.col("mean_code") * 100).otherwise(0.0)
    return mean.select(*(F.round(c, 5).alias(n) for c, n in ((F.col("mean_code"), "mean_code"), (F.col("mean_order"), "mean_order"), (better, "improvement_pct"), (F.col("gain"), "global_reward"), (F.col("mean_candidates"), "mean_candidates"), (F.col("mean_intervals"), "mean_intervals"))))


def hgs_score(i_ref: float, i_test: float) -> float:
    """Improvement on the test set, reduced by its gap to the reference set."""
    return i_test * (1 - abs(i_ref - i_test) / max(i_ref, i_test, 1e-6))


def mean_score(validation: float, test: float) -> float:
    """The other score of the same name: the mean of two improvements."""
    return (validation + test) / 2
