"""Problem 1: overlapping and gapped time intervals per entity.

Two-level merge. Level one clips every interval at the borders of time shards and merges inside each
(entity, shard); level two stitches what is left of the shards, together with the stretches of whole shards
that long intervals cover, into continuous periods.

Why no group grows with the data: before each window the rows are reduced to one row per (entity, start) with the
latest end, a partial aggregation that runs before the shuffle. A shard holds at most ``shard_days`` starts, so a
group of level one has at most that many rows however many intervals an entity has, and level two sees per entity
at most one run per two calendar days and one stretch per shard, whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.functions.dates import day_text, end_day, start_day, strip
from palimpsest.plans.session import table

SHARD_DAYS = 4096


def _longest(df: DataFrame, *keys: str) -> DataFrame:
    """One row per keys and start, with the latest end."""
    return df.groupBy(*keys, "s").agg(F.max("e").alias("e"))


def _coalesce(df: DataFrame, *keys: str) -> DataFrame:
    """Merge overlapping and touching [s, e) within ``keys``."""
    w = Window.partitionBy(*keys).orderBy("s")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = df.withColumn("new", (reach.isNull() | (F.col("s") > reach)).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "run").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("run")


def merge_intervals(intervals: DataFrame, keys: list[str], start: str, end: str, shard_days: int = SHARD_DAYS) -> DataFrame:
    """Continuous periods of each entity from half-open intervals of int or bigint bounds (days, microseconds).

    Output: ``keys``, ``s``, ``e``. Rows with a null key, start or end, or with end <= start, cover nothing. Repeated
    rows and touching intervals join one period. An empty input gives an empty output. Other columns are ignored.
    """
    kept = intervals.select(*[F.col(k) for k in keys], F.col(start).alias("s"), F.col(end).alias("e"))
    kept = kept.where(F.col("s") < F.col("e")).dropna(subset=keys)
    spans = _longest(kept, *keys)

    kind = dict(spans.dtypes)["s"]
    shard = lambda day: F.floor(day / F.lit(shard_days)).cast(kind)
    first, last = shard(F.col("s")), shard(F.col("e") - 1)
    piece = lambda no, s, e: F.struct(no.cast(kind).alias("shard"), s.cast(kind).alias("s"), e.cast(kind).alias("e"))
    clipped = F.when(first == last, F.array(piece(first, F.col("s"), F.col("e")))).otherwise(
        F.concat(
            F.array(piece(first, F.col("s"), (first + 1) * shard_days), piece(last, last * shard_days, F.col("e"))),
            # A stretch of whole shards belongs to no single shard; null marks it.
            F.when(last > first + 1, F.array(piece(F.lit(None), (first + 1) * shard_days, last * shard_days))).otherwise(F.array().cast(f"array<struct<shard:{kind},s:{kind},e:{kind}>>")),
        )
    )
    pieces = spans.select(*keys, F.explode(clipped).alias("p")).select(*keys, "p.shard", "p.s", "p.e")
    # Stretches of whole shards are a shard of their own; they start at shard borders, so they are few.
    local = _coalesce(_longest(pieces, *keys, "shard"), *keys, "shard")
    return _coalesce(_longest(local, *keys), *keys)


def periods_and_gaps(periods: DataFrame, keys: list[str]) -> DataFrame:
    """Each period, and the gap to the next one of the same entity where there is one: ``keys``, kind, s, e."""
    following = F.lead("s").over(Window.partitionBy(*keys).orderBy("s"))
    row = lambda kind, s, e: F.struct(F.lit(kind).alias("kind"), s.alias("s"), e.alias("e"))
    both = periods.withColumn("n", following).select(
        *keys,
        F.explode(
            F.when(F.col("n").isNull(), F.array(row("period", F.col("s"), F.col("e")))).otherwise(
                F.array(row("period", F.col("s"), F.col("e")), row("gap", F.col("e"), F.col("n")))
            )
        ).alias("x"),
    )
    return both.select(*keys, "x.kind", "x.s", "x.e")


def document_intervals(documents: DataFrame) -> DataFrame:
    """(entity_key, s, e) of source_documents; rows without source_key are left out."""
    return documents.where(F.col("source_key").isNotNull()).select(
        F.col("source_key").alias("entity_key"), start_day(F.col("effective_from")).alias("s"), end_day(F.col("effective_to")).alias("e")
    )


def relation_intervals(relations: DataFrame) -> DataFrame:
    """(entity_key, s, e) of evidence_relations; rows without an object are left out, a null subject or predicate reads as empty."""
    key = F.concat_ws("|", F.coalesce("subject_document_id", F.lit("")), F.lower(strip(F.coalesce("predicate", F.lit("")))), F.col("object_document_id"))
    return relations.where(F.col("object_document_id").isNotNull()).select(
        key.alias("entity_key"), start_day(F.col("valid_from")).alias("s"), end_day(F.col("valid_to")).alias("e")
    )


def found(spark, base: str) -> DataFrame:
    """p1_found: periods and gaps of both tables."""
    both = document_intervals(table(spark, base, "source_documents")).withColumn("entity_table", F.lit("source_documents")).unionByName(
        relation_intervals(table(spark, base, "evidence_relations")).withColumn("entity_table", F.lit("evidence_relations"))
    )
    keys = ["entity_table", "entity_key"]
    rows = periods_and_gaps(merge_intervals(both, keys, "s", "e"), keys)
    return rows.select(*keys, "kind", day_text(F.col("s")).alias("start_on"), day_text(F.col("e")).alias("end_on"))


def coverage(spark, base: str) -> DataFrame:
    """p1_coverage: per entity the number of periods, days covered and days in gaps."""
    both = document_intervals(table(spark, base, "source_documents")).withColumn("entity_table", F.lit("source_documents")).unionByName(
        relation_intervals(table(spark, base, "evidence_relations")).withColumn("entity_table", F.lit("evidence_relations"))
    )
    keys = ["entity_table", "entity_key"]
    p = merge_intervals(both, keys, "s", "e")
    days = F.sum((F.col("e") - F.col("s")).cast("long"))
    return p.groupBy(*keys).agg(
        F.count("*").alias("periods"), days.alias("days_covered"), (F.max("e").cast("long") - F.min("s") - days).alias("days_in_gaps")
    )
