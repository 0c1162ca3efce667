"""Session helpers: reading tables, cutting lineage on storage that outlives executors, and code for the workers."""

from __future__ import annotations

import io
import tempfile
import uuid
import warnings
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``base``."""
    return spark.read.parquet(f"{base}/{name}.parquet")


@cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-cut-", dir="/tmp")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only a master that runs in one process (``local``, ``local[...]``) may go without: it gets a folder of its own. Any
    other raises, as tables on one host's disk could come back short or empty on another.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all hosts of {master} share")
    return _own_folder()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of executors that don't have it installed, once per application.

    Warns if adaptive execution is off: joins with a hot key count on it to split them.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    for name in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled"):
        if spark.conf.get(name).lower() != "true":
            warnings.warn(f"{name} is off; joins with a hot key are not split", stacklevel=2)
    root = Path(__file__).resolve().parents[1]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    path = f"{shared_folder(spark)}/code-{uuid.uuid4().hex}.zip"
    fs, target = _path(spark, path)
    stream = fs.create(target, True)
    stream.write(bytearray(data.getvalue()))
    stream.close()
    fs.deleteOnExit(target)
    spark.sparkContext.addPyFile(path)


def in_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow``, with this package given to the workers before."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


_scratch: ContextVar[list[DataFrame] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that ``cut`` writes inside are deleted at the end; write or collect the results inside, too."""
    kept: list[DataFrame] = []
    token = _scratch.set(kept)
    try:
        yield
    finally:
        _scratch.reset(token)
        discard(*kept)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and continue from there.

    Used between rounds of iterative operators, and for small results that are needed twice: a lost executor then
    costs one re-read, not a replay, and the plan starts anew. The table is deleted by ``discard``, at the end of
    ``scratch``, or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._cut_path = path
    fs, target = _path(spark, path)
    fs.deleteOnExit(target)
    if (inside := _scratch.get()) is not None:
        inside.append(kept)
    return kept


def cut_counted(df: DataFrame, flag: str = "true") -> tuple[DataFrame, int]:
    """``cut``, and how many of its rows hold ``flag``, counted while they are written."""
    seen = Observation()
    kept = cut(df.observe(seen, F.count_if(F.expr(flag)).alias("n")))
    return kept, seen.get["n"]


def discard(*cuts: DataFrame) -> None:
    """Delete tables that ``cut`` wrote and nothing reads any more."""
    for df in cuts:
        fs, target = _path(df.sparkSession, df._cut_path)
        fs.delete(target, True)
        fs.cancelDeleteOnExit(target)


def small(df: DataFrame, most_rows: int = 100_000, most_bytes: int = 64 << 20) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most_rows`` rows and their text and numbers ``most_bytes``; beyond that the join shuffles."""
    width = [F.coalesce(F.octet_length(c), F.lit(0)) + 16 if kind in ("string", "binary") else F.lit(16) for c, kind in df.dtypes]
    seen = df.select(sum(width[1:], width[0]).cast("long").alias("b")).limit(most_rows + 1).agg(F.count("*").alias("n"), F.sum("b").alias("b")).head()
    return F.broadcast(df) if seen["n"] <= most_rows and (seen["b"] or 0) <= most_bytes else df
