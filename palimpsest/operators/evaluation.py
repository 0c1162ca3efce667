"""Retrieval quality and exact index percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranking_metrics(results: DataFrame, expected: DataFrame, by: str) -> DataFrame:
    """(by, queries, hit_at_1, mrr, recall): over the queries of ``expected`` (query_id, item_id, by).

    ``results``: query_id, item_id, rank. A query without hits counts 0. Metrics have 6 decimals.
    """
    judged = expected.select("query_id", "item_id", by).distinct().join(results.select("query_id", "item_id", "rank"), ["query_id", "item_id"], "left")
    per = judged.groupBy("query_id", by).agg(F.min("rank").alias("first"), F.count("rank").alias("found"), F.count("*").alias("wanted"))
    mean = lambda c: F.round(F.avg(c), 6)
    return per.groupBy(by).agg(
        F.count("*").alias("queries"), mean((F.coalesce("first", F.lit(0)) == 1).cast("double")).alias("hit_at_1"),
        mean(F.coalesce(F.try_divide(F.lit(1.0), F.col("first")), F.lit(0.0))).alias("mrr"), mean(F.col("found") / F.col("wanted")).alias("recall"),
    )


def weight_profile(channels: DataFrame, expected: DataFrame, grid: dict[str, dict[str, float]], constant: int = 60) -> DataFrame:
    """(profile, queries, mrr, place): how well each set of channel weights of ``grid`` ranks, best first.

    ``channels``: query_id, item_id, channel, rank; ``expected``: query_id, item_id. All profiles are fused in one pass;
    equal scores rank by item_id, a query without a hit counts 0, equal profiles are placed by name.
    """
    profiles = F.explode(F.array(*[F.struct(F.lit(name).alias("profile"), F.create_map(*[F.lit(x) for kv in w.items() for x in kv]).alias("w")) for name, w in grid.items()]))
    best = channels.groupBy("query_id", "item_id", "channel").agg(F.min("rank").alias("rank")).select("*", profiles.alias("p"))
    weight = F.coalesce(F.element_at("p.w", F.col("channel")), F.lit(0.0))
    fused = best.groupBy("p.profile", "query_id", "item_id").agg(F.round(F.sum(weight / (constant + F.col("rank"))), 9).alias("score"))
    ranked = fused.withColumn("rank", F.row_number().over(Window.partitionBy("profile", "query_id").orderBy(F.desc("score"), "item_id")))
    hits = ranked.join(expected.select("query_id", "item_id").distinct(), ["query_id", "item_id"]).groupBy("profile", "query_id").agg(F.min("rank").alias("first"))
    asked = expected.select("query_id").distinct().select("query_id", F.explode(F.array(*[F.lit(n) for n in grid])).alias("profile"))
    out = asked.join(hits, ["profile", "query_id"], "left").groupBy("profile").agg(F.count("*").alias("queries"), F.round(F.avg(F.coalesce(F.try_divide(F.lit(1.0), F.col("first")), F.lit(0.0))), 6).alias("mrr"))
    # One row per profile: placing them in one task is bounded.
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mrr"), "profile")))


def index_percentiles(df: DataFrame, by: str, value: str, buckets: int = 4096) -> DataFrame:
    """(by, n, p50, p95): values at index n // 2 and max(0, int(.95 n) - 1) of each group's ascending order.

    A histogram of equal-width buckets finds the two buckets that hold the answers; only their values, counted before the
    shuffle, are put in order. Nulls are left out; infinite values aren't allowed.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    span = counted.groupBy(by).agg(F.sum("c").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    part = F.coalesce(F.try_divide((F.col("v") - F.col("lo")).cast("double") * buckets, (F.col("hi") - F.col("lo")).cast("double")), F.lit(0.0))
    same = F.col(by).eqNullSafe(F.col("_by"))
    put = counted.join(span.withColumnRenamed(by, "_by"), same).drop("_by").withColumn("bucket", F.least(F.floor(part), F.lit(buckets - 1)))
    wanted = F.array(F.floor(F.col("n") / 2), F.greatest(F.lit(0).cast("long"), F.floor(F.col("n") * F.lit(0.95)) - 1))
    histogram = put.groupBy(by, "bucket").agg(F.sum("c").alias("c"), F.max("n").alias("n"))
    upto = histogram.withColumn("upto", F.sum("c").over(Window.partitionBy(by).orderBy("bucket")))
    holds = upto.withColumn("before", F.col("upto") - F.col("c")).where(F.exists(wanted, lambda i: (i >= F.col("before")) & (i < F.col("upto"))))
    inside = put.join(holds.select(F.col(by).alias("_by"), F.col("bucket").alias("_bucket"), "before"), same & (F.col("bucket") == F.col("_bucket")))
    placed = inside.withColumn("last", F.col("before") + F.sum("c").over(Window.partitionBy(by, "bucket").orderBy("v")))
    at = lambda k: F.min(F.when(F.col("last") > F.get(wanted, F.lit(k)), F.col("v")))
    return placed.groupBy(by).agg(F.max("n").alias("n"), at(0).alias("p50"), at(1).alias("p95"))
