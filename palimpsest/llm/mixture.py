"""Problem 7: mixing sources to target weights, by hash-threshold histograms.

Each record has a hash; a source contributes its records with the hashes below a threshold. The threshold comes from
histograms: tokens are summed by source and hash bucket, the bucket where the budget ends is found by a running sum
over the buckets, and only that bucket's records are summed again at a finer level. Nothing is sorted, and a larger
budget's records always contain a smaller one's. Tokens are counted once, over whole texts.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.plans.session import cut, in_arrow, small, table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pattern that splits text before the merges of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEVEL_BITS, LEVELS = 10, 4

_encodings: dict = {}


def _encoding(name: str, data: bytes):
    if name not in _encodings:
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}
        _encodings[name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[name]


def count_tokens(records: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, source, tokens) of records (bigint id, source, text); null and empty texts have 0 tokens.

    The vocabulary file (a megabyte) is read by the driver and broadcast, so executors need no such path.
    """
    shared = records.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(tokenizer, shared.value).encode_ordinary
        for batch in batches:
            tokens = [len(encode(text)) if text else 0 for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.int64())], names=["id", "source", "tokens"])

    return in_arrow(records.select("id", "source", "text"), run, "id bigint, source string, tokens bigint")


def plain_source(source):
    """Lower case, no blanks at the ends, hyphens, blanks and underscores between words as one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(source), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), r"[-_\s\p{Z}]+", "_")


ALL, EVEN = None, "even"


def thresholds(sized: DataFrame, targets: DataFrame, total: int | str | None = ALL) -> DataFrame:
    """Plan of each mix: mix_name, source, target_share, max_repeats, available, wanted, copies, below.

    ``sized`` has source (plain), tokens, u (a hash from 0 to 2^(bits) - 1). ``total`` is the size of a mix in tokens;
    without it, all tokens of the mix's sources; "even" is the largest total at which every source with records reaches
    its share within its repeats, so that no share drifts because another source is short (sources without any records
    stay out of the total's bound and are reported missing). Every record of a source is taken ``copies`` times, those with
    u < below once more. A source too small for its share at max_repeats copies falls short; one without records has
    available 0. Null or negative shares and repeats count as 0.
    """
    available = sized.groupBy("source").agg(F.sum("tokens").alias("available"))
    goal = targets.select(
        "mix_name", "source", F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats")
    ).join(available, "source", "left").fillna(0, ["available"])
    mix = Window.partitionBy("mix_name")
    bound = F.when((F.col("target_share") > 0) & (F.col("available") > 0), F.floor(F.col("available") * F.col("max_repeats") / F.col("target_share")))
    size = F.sum("available").over(mix) if total is ALL else F.coalesce(F.min(bound).over(mix), F.lit(0)) if total == EVEN else F.lit(total)
    plan = goal.withColumn("wanted", F.round(F.col("target_share") * size).cast("long"))
    copies = F.when(F.col("available") > 0, F.least(F.col("max_repeats").cast("long"), F.floor(F.col("wanted") / F.col("available")))).otherwise(F.lit(0))
    plan = plan.withColumn("copies", copies.cast("int")).withColumn(
        "rest", F.when((F.col("copies") < F.col("max_repeats")) & (F.col("available") > 0), F.col("wanted") - F.col("copies") * F.col("available")).otherwise(F.lit(0)).cast("long")
    ).withColumn("below", F.lit(0).cast("long"))
    plan = cut(plan)
    for level in range(1, LEVELS + 1):
        shift = LEVEL_BITS * (LEVELS - level)
        inside = sized.join(small(plan.select("mix_name", "source", "below").where("rest > 0")), "source")
        here = inside.where(F.shiftright("u", shift + LEVEL_BITS) == F.shiftright("below", shift + LEVEL_BITS)) if level > 1 else inside
        histogram = here.groupBy("mix_name", "source", F.shiftright("u", shift).alias("bucket")).agg(F.sum("tokens").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("mix_name", "source").orderBy("bucket"))
        ends = histogram.withColumn("upto", upto).join(plan.select("mix_name", "source", "rest"), ["mix_name", "source"])
        # The first bucket that does not fit whole; all before it do.
        step = ends.where("upto > rest").groupBy("mix_name", "source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("used"))).alias("x"))
        plan = cut(
            plan.join(step, ["mix_name", "source"], "left").select(
                "mix_name", "source", "target_share", "max_repeats", "available", "wanted", "copies", (F.col("rest") - F.coalesce("x.used", F.lit(0))).alias("rest"),
                F.coalesce(F.shiftleft("x.bucket", shift), F.col("below")).alias("below"),
            )
        )
    return plan.drop("rest")


def mix_records(records: DataFrame, targets: DataFrame, total: int | str | None = ALL, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(records of each mix: mix_name, id, source, tokens, copies; shares of each mix).

    Records (bigint id, source, text) whose source, plainly spelled, is in no mix, or null, are in none. The shares say
    per mix and source: available and wanted tokens, tokens mixed, the actual share of the mix, and what is missing.
    """
    wanted = small(targets.select(plain_source(F.col("source")).alias("source")).distinct())
    named = records.select("id", plain_source(F.col("source")).alias("source"), "text").join(wanted, "source", "left_semi")
    bits = LEVEL_BITS * LEVELS
    sized = cut(count_tokens(named, tokenizer).withColumn("u", F.shiftrightunsigned(F.xxhash64("id", F.lit("mixture")), 64 - bits)))
    plan = thresholds(sized, targets.withColumn("source", plain_source(F.col("source"))), total)
    taken = sized.join(small(plan.select("mix_name", "source", "copies", "below")), "source").select(
        "mix_name", "id", "source", "tokens", (F.col("copies") + (F.col("u") < F.col("below")).cast("int")).alias("copies")
    ).where("copies > 0")
    mixed = taken.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed"), F.count("*").alias("records"))
    whole = F.sum("mixed").over(Window.partitionBy("mix_name"))
    shares = plan.join(mixed, ["mix_name", "source"], "left").fillna(0, ["mixed", "records"]).select(
        "mix_name", "source", "target_share", "max_repeats", "available", "wanted", "records", "mixed",
        F.round(F.try_divide(F.col("mixed"), whole), 9).alias("actual_share"), (F.col("wanted") - F.col("mixed")).alias("missing"),
    )
    return taken, shares


def _inputs(spark, base: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, base, "documents").select(F.col("doc_id").alias("id"), "source", "text"), table(spark, base, "mix_targets")


def mix(spark, base: str) -> DataFrame:
    """p7_mix: the records of each mix and how often each is repeated."""
    return mix_records(*_inputs(spark, base))[0].withColumnRenamed("id", "doc_id")


def shares(spark, base: str) -> DataFrame:
    """p7_shares: target and actual shares of each mix, also of sources that fall short."""
    return mix_records(*_inputs(spark, base))[1]


def even_shares(spark, base: str) -> DataFrame:
    """p7_even: the shares of each mix at the largest total at which every source that has records holds its share."""
    return mix_records(*_inputs(spark, base), total=EVEN)[1]
