"""Change detection between two states of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def change_set(before: DataFrame, after: DataFrame, keys: list[str], content: list[str]) -> DataFrame:
    """(keys, change): created, deleted, updated or unchanged by null-safe comparison of ``content``.

    Keys must be unique on each side and not null. An empty side makes everything created or deleted.
    """
    a = before.select(*keys, F.struct(*content).alias("a"))
    b = after.select(*keys, F.struct(*content).alias("b"))
    both = a.join(b, keys, "full_outer")
    change = F.when(F.col("a").isNull(), "created").when(F.col("b").isNull(), "deleted").when(F.col("a").eqNullSafe(F.col("b")), "unchanged").otherwise("updated")
    return both.select(*keys, change.alias("change"))


def moves(before: DataFrame, after: DataFrame, path: str, digest: str) -> DataFrame:
    """(path, digest, change, moved_to): a removed path whose digest stands at exactly one added path has moved there.

    Other removed paths are ``removed``, added ones that nothing moved to are ``added``, the rest ``changed`` or ``same``.
    Two removed paths may move to the same added one. Paths are unique on each side. A null digest matches nothing.
    """
    a, b = before.select(path, F.col(digest).alias("da")), after.select(path, F.col(digest).alias("db"))
    both = a.withColumn("in_a", F.lit(True)).join(b.withColumn("in_b", F.lit(True)), path, "full_outer")
    added = both.where("in_a is null")
    single = added.where("db is not null").groupBy(F.col("db").alias("da")).agg(F.count("*").alias("n"), F.min(path).alias("moved_to")).where("n = 1").drop("n")
    removed = both.where("in_b is null").join(single, "da", "left").select(
        path, F.col("da").alias("digest"), F.when(F.col("moved_to").isNull(), "removed").otherwise("move").alias("change"), "moved_to"
    )
    taken = removed.where("change = 'move'").select(F.col("moved_to").alias(path)).distinct()
    none = F.lit(None).cast("string").alias("moved_to")
    new = added.join(taken, path, "left_anti").select(path, F.col("db").alias("digest"), F.lit("added").alias("change"), none)
    kept = both.where("in_a and in_b").select(path, F.col("db").alias("digest"), F.when(F.col("da").eqNullSafe(F.col("db")), "same").otherwise("changed").alias("change"), none)
    return removed.unionByName(new).unionByName(kept)


def orphans(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one of two tables has. Null keys are left out."""
    a, b = left.where(F.col(key).isNotNull()).select(key).distinct(), right.where(F.col(key).isNotNull()).select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))
