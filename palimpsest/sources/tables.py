"""Sinks: versioned releases of tables, Markdown export, JSON packages."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def put_json(spark: SparkSession, path: str, value) -> None:
    """Write ``value`` beside ``path`` and rename it there in one step, over what stands there; a reader finds the old or the new."""
    jvm = spark._jvm.org.apache.hadoop
    fs, target = _fs(spark, path)
    temp = jvm.fs.Path(f"{path.rpartition('/')[0]}/.new-{uuid.uuid4().hex}")
    stream = fs.create(temp, True)
    stream.write(bytearray(json.dumps(value), "utf-8"))
    stream.close()
    rename = getattr(jvm.fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    jvm.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(temp, target, over)


def write_release(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> str:
    """Write all tables below a new version folder, then point ``active.json`` there by one renaming.

    Readers see the old version or the new, never a mixture and never none. Old versions stay until they are deleted.
    """
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{root}/{version}/{name}")
    put_json(spark, f"{root}/active.json", {"version": version, "tables": sorted(tables)})
    return version


def read_release(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the active version."""
    active = json.loads("".join(r.value for r in spark.read.text(f"{root}/active.json").collect()))
    return spark.read.parquet(f"{root}/{active['version']}/{name}")


def export_markdown(blocks: DataFrame, path: str, buckets: int = 64) -> None:
    """Documents (document_id, ordinal, kind, text) as Markdown lines, whole documents in order within folders of document hashes."""
    line = F.concat(F.when(F.col("kind") == "heading", "## ").otherwise(""), F.coalesce("text", F.lit("")))
    put = blocks.select(F.pmod(F.xxhash64("document_id"), F.lit(buckets)).alias("bucket"), "document_id", "ordinal", line.alias("value"))
    put.repartitionByRange(buckets, "bucket", "document_id", "ordinal").sortWithinPartitions("bucket", "document_id", "ordinal").select("bucket", "value").write.partitionBy("bucket").text(path)


def export_package(tables: dict[str, DataFrame], path: str) -> None:
    """Tables as JSON lines, one folder each."""
    for name, df in tables.items():
        df.write.json(f"{path}/{name}")


def import_package(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """JSON lines with a stated schema; lines that don't fit keep their text in ``_corrupt``."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(f"{path}/{name}")
