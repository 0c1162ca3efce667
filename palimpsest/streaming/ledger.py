"""Event streams: deduplicated append, windowed counts, latest state per key, expiry."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.temporal import latest_per_key
from palimpsest.sources.tables import _fs, put_json


def event_stream(spark: SparkSession, folder: str, schema, late: str = "1 hour") -> DataFrame:
    """Events from arriving Parquet files, each event_id once within the time that late events may take."""
    events = spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def windowed_counts(events: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """Events and their value by window and type; needs a watermark on ts."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select("w.start", "w.end", "event_type", "n", "value")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Sessions of users by the gap between events; needs a watermark on ts."""
    return events.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select("s.start", "s.end", "user_id", "n")


def _numbers(fs, folder) -> list[int]:
    """Numbers of the committed manifests in ``folder``."""
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return sorted(int(n.removeprefix("state-").removesuffix(".json")) for n in names if n.startswith("state-") and n.endswith(".json"))


def _manifest(spark: SparkSession, path: str, number: int) -> dict[str, str]:
    return json.loads("".join(r.value for r in spark.read.text(f"{path}/state-{number}.json").collect()))


def keep_latest(path: str, keys: list[str], order: list[str], buckets: int = 64):
    """A ``foreachBatch`` function that keeps the latest row of each key below ``path``; read it with ``latest_state``.

    The state lies in folders by hash bucket of the key. A batch rewrites the buckets it touches and then commits a new
    manifest, which names the folder of each bucket, under the next free number: batch ids play no part, so gaps in
    them, a batch run again or a new checkpoint lose nothing (merging a batch twice changes nothing). Readers see the
    highest manifest; folders that the last two don't name are deleted. Null keys form one key; one query may write.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fs, root = _fs(spark, path)
        numbers = _numbers(fs, root)
        known = _manifest(spark, path, numbers[-1]) if numbers else {}
        batch = batch.persist()
        touched = sorted(r["b"] for r in batch.select(bucket.alias("b")).distinct().collect())  # at most ``buckets`` numbers
        before = [known[str(b)] for b in touched if str(b) in known]
        rows = batch.unionByName(spark.read.schema(batch.schema).parquet(*[f"{path}/{f}" for f in before]), allowMissingColumns=True) if before else batch
        folder = f"data-{uuid.uuid4().hex}"
        latest_per_key(rows, keys, order).withColumn("_bucket", bucket).write.partitionBy("_bucket").parquet(f"{path}/{folder}")
        batch.unpersist()
        now = known | {str(b): f"{folder}/_bucket={b}" for b in touched}
        put_json(spark, f"{path}/state-{numbers[-1] + 1 if numbers else 0}.json", now)
        in_use = {f.partition("/")[0] for f in [*now.values(), *known.values()]}
        for status in fs.listStatus(root):
            name = status.getPath().getName()
            if name.startswith("data-") and name not in in_use or name.startswith("state-") and name.endswith(".json") and int(name[6:-5]) < (numbers[-1] if numbers else 0):
                fs.delete(status.getPath(), True)

    return merge


def latest_state(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows that ``keep_latest`` has below ``path``; none if nothing was committed yet."""
    fs, root = _fs(spark, path)
    numbers = _numbers(fs, root)
    folders = sorted(_manifest(spark, path, numbers[-1]).values()) if numbers else []
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in folders]) if folders else spark.createDataFrame([], schema)


def expired(items: DataFrame, expires: str, now) -> DataFrame:
    """Items whose time has come at ``now``; null never expires."""
    return items.where(F.col(expires).isNotNull() & (F.col(expires) <= now))
