"""Versions, as-of views and validity intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is greatest by ``order``, then by its other columns.

    One aggregation, combined before the shuffle, so a key with very many versions is no problem. Null keys form one
    key; null order values come first; repeated rows give one.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_best"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in df.columns])


def as_of(df: DataFrame, keys: list[str], order: list[str], recorded: str, moment: Column) -> DataFrame:
    """The rows that held at ``moment``: of those recorded up to then the latest of each key. Rows without a time never hold."""
    return latest_per_key(df.where(F.col(recorded) <= moment), keys, order)


def following(df: DataFrame, key: str, at: str, tie: str, name: str) -> DataFrame:
    """``df`` with the ``tie`` value of the next row of its key by (``at``, ``tie``), null dates first.

    In two levels: within each date of a key, and over the first rows of its dates, so a key with very many rows is no
    single group. Rows with a null key have one group of their own.
    """
    inner = F.lead(tie).over(Window.partitionBy(key, at).orderBy(tie))
    firsts = df.groupBy(key, at).agg(F.min(tie).alias("_first"))
    over = F.lead("_first").over(Window.partitionBy(key).orderBy(F.asc_nulls_first(at)))
    nexts = firsts.select(F.col(key).alias("_key"), F.col(at).alias("_at"), over.alias("_over"))
    both = df.withColumn(name, inner).join(nexts, F.col(key).eqNullSafe(F.col("_key")) & F.col(at).eqNullSafe(F.col("_at")), "left")
    return both.withColumn(name, F.coalesce(name, "_over")).drop("_key", "_at", "_over")


def _neighbours(df: DataFrame, key: str, number: str, inner: Column, bucketed: Column, outer: Column, name: str, bucket: int) -> DataFrame:
    """Two levels of a window over the integer ``number`` of a key: ``inner`` within buckets of numbers, ``outer`` over one value per bucket."""
    put = df.withColumn("_b", F.floor(F.col(number) / bucket)).withColumn("_inner", inner)
    per = put.groupBy(key, "_b").agg(bucketed.alias("_v"))
    per = per.select(F.col(key).alias("_key"), F.col("_b").alias("_bucket"), outer.alias("_outer"))
    both = put.join(per, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_b") == F.col("_bucket")), "left")
    return both.withColumn(name, F.coalesce("_inner", "_outer")).drop("_b", "_inner", "_key", "_bucket", "_outer")


def next_by_number(df: DataFrame, key: str, number: str, value: str, name: str, bucket: int = 1000) -> DataFrame:
    """``df`` with the ``value`` of the next row of its key by the integer ``number``, which is unique in its key, in two levels.

    Numbers may have gaps. The last row of a key has null.
    """
    inner = F.lead(value).over(Window.partitionBy(key, "_b").orderBy(number))
    outer = F.lead("_v").over(Window.partitionBy(key).orderBy("_b"))
    return _neighbours(df, key, number, inner, F.min(F.struct(number, value))[value], outer, name, bucket)


def greatest_before(df: DataFrame, key: str, number: str, value: Column, name: str, bucket: int = 1000) -> DataFrame:
    """``df`` with the greatest ``value`` of the rows of its key before it by the integer ``number``, in two levels.

    For values that grow with the number, nulls aside, that is the last one known. Before the first there is null.
    """
    df = df.withColumn("_value", value)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inner = F.max("_value").over(before(Window.partitionBy(key, "_b").orderBy(number)))
    outer = F.max("_v").over(before(Window.partitionBy(key).orderBy("_b")))
    return _neighbours(df, key, number, inner, F.max("_value"), outer, name, bucket).drop("_value")


def interval_allows(start: Column, end: Column, day: Column) -> Column:
    """Half-open: start <= day < end; null bounds are open."""
    return (start.isNull() | (start <= day)) & (end.isNull() | (end > day))


def classify(status: Column, start: Column, end: Column, day: Column) -> Column:
    """Where a version stands at ``day``: verified_in_scope, outside_effective_interval, unverified_metadata, not_evaluated.

    Without a day nothing is evaluated; a version that is not verified has unverified metadata unless its interval
    already rules it out; a version without start can't be in scope.
    """
    return (
        F.when(day.isNull(), "not_evaluated")
        .when(~F.coalesce(interval_allows(start, end, day), F.lit(False)), "outside_effective_interval")
        .when(status.isNull() | status.startswith("unverified") | start.isNull(), "unverified_metadata")
        .otherwise("verified_in_scope")
    )


def relation_view(relations: DataFrame, mode: str, day: Column, moment: Column) -> DataFrame:
    """Bitemporal view of relations with integer or date bounds ``s`` and ``e``.

    ``current``: the latest record of each relation, valid on ``day``; ``past``: the latest record, ended by ``day``;
    ``as_of``: the record that was the latest at ``moment``, valid on ``day``.
    """
    keys, order = ["relation_id"], ["recorded_at", "observed_at"]
    if mode == "as_of":
        return as_of(relations, keys, order, "recorded_at", moment).where(interval_allows(F.col("s"), F.col("e"), day))
    held = latest_per_key(relations, keys, order)
    if mode == "current":
        return held.where(interval_allows(F.col("s"), F.col("e"), day))
    if mode == "past":
        return held.where(F.col("e").isNotNull() & (F.col("e") <= day))
    raise ValueError(mode)


def reasons(**rules: Column) -> Column:
    """Array of the names of the rules that hold, in the order given; null conditions don't hold. Empty means admitted."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in rules.items()]))
