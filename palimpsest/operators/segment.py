"""Blocks to lines, groups and bounded segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.functions.text import squeeze, stable_id

# A line that begins an article or heading, and the size of a segment.
LABEL = r"^(第[零〇一二三四五六七八九十百千万\d]+条|Article \d+|#+ )"
SEGMENT_CHARS = 4500
ORDINALS_PER_BUCKET = 1000


def lines(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, line_no, line): the non-empty lines of each text, white space squeezed, numbered from 0 among all lines."""
    each = df.select(*keys, F.posexplode(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")).alias("line_no", "line"))
    return each.select(*keys, "line_no", squeeze(F.col("line")).alias("line")).where("line <> ''")


def running_count(df: DataFrame, key: str, order: str, flag: Column, name: str, bucket: int = ORDINALS_PER_BUCKET) -> DataFrame:
    """``df`` with the number of flagged rows of its key up to and including each row, by integer ``order``.

    In two levels: counted within buckets of the order, then the buckets' sums, so a key with very many rows is no
    single group. Rows of equal order count together.
    """
    put = df.withColumn("_bucket", F.floor(F.coalesce(F.col(order), F.lit(0)) / bucket)).withColumn("_flag", F.coalesce(flag, F.lit(False)).cast("long"))
    inner = Window.partitionBy(key, "_bucket").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    sums = put.groupBy(key, "_bucket").agg(F.sum("_flag").alias("_n"))
    before = sums.withColumn("_before", F.sum("_n").over(Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))).drop("_n")
    near = put.withColumn("_inside", F.sum("_flag").over(inner)).withColumnRenamed(key, "_key").withColumnRenamed("_bucket", "_b")
    both = near.join(before, F.col("_key").eqNullSafe(F.col(key)) & (F.col("_b") == F.col("_bucket")), "left")
    return both.withColumn(name, F.col("_inside") + F.coalesce("_before", F.lit(0))).drop(key, "_bucket", "_b", "_flag", "_inside", "_before").withColumnRenamed("_key", key)


def segments(blocks: DataFrame, most: int = SEGMENT_CHARS, stretch: int = ORDINALS_PER_BUCKET) -> DataFrame:
    """Blocks (document_id, ordinal, block_id, text) to segments: document_id, grp, part, n_blocks, n_chars, first_ordinal, last_ordinal, segment_id.

    A group begins at a block that starts with an article label or heading; its blocks are packed in order into parts
    of at most ``most`` characters, a line end between two; a longer block is cut every ``most`` characters first. A part
    does not go over a border of ``stretch`` ordinals, so what is packed in one go is bounded however long a group is;
    parts are numbered over the whole group. Repeated blocks count once, null texts as empty; each block without a
    document is a document of its own.
    """
    key = F.coalesce("document_id", F.concat(F.lit("?"), F.col("block_id")), F.lit("?")).alias("_doc")
    once = blocks.groupBy(key, "document_id", "ordinal", "block_id").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    numbered = running_count(once, "_doc", "ordinal", F.col("text").rlike(LABEL), "grp")
    sizes = F.when(F.length("text") == 0, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / most).cast("int")), lambda i: F.least(F.lit(most), F.length("text") - i * most)))
    keys = ["_doc", "document_id", "grp"]
    pieces = numbered.select(*keys, F.floor(F.coalesce("ordinal", F.lit(0)) / stretch).alias("stretch"), "ordinal", "block_id", F.posexplode(sizes).alias("i", "n"))
    listed = pieces.groupBy(*keys, "stretch").agg(F.array_sort(F.collect_list(F.struct("ordinal", "block_id", "i", "n"))).alias("x"))
    start = F.struct(F.array().cast("array<struct<part:int,ordinal:int,n:int>>").alias("out"), F.lit(1).alias("part"), F.lit(-1).alias("used"))

    def put(acc: Column, b: Column) -> Column:
        fits = (acc["used"] < 0) | (acc["used"] + 1 + b["n"] <= most)
        part = F.when(fits, acc["part"]).otherwise(acc["part"] + 1)
        used = F.when(fits & (acc["used"] >= 0), acc["used"] + 1 + b["n"]).otherwise(b["n"])
        return F.struct(F.array_append(acc["out"], F.struct(part.alias("part"), b["ordinal"].alias("ordinal"), b["n"].alias("n"))).alias("out"), part.alias("part"), used.alias("used"))

    packed = listed.select(*keys, "stretch", F.explode(F.aggregate("x", start, put)["out"]).alias("p"))
    out = packed.groupBy(*keys, "stretch", F.col("p.part").alias("inner")).agg(
        F.count("*").alias("n_blocks"), (F.sum("p.n") + F.count("*") - 1).cast("long").alias("n_chars"), F.min("p.ordinal").alias("first_ordinal"), F.max("p.ordinal").alias("last_ordinal")
    )
    # One row per stretch: the parts before it in its group.
    ends = out.groupBy("_doc", "grp", "stretch").agg(F.max("inner").alias("parts"))
    before = F.coalesce(F.sum("parts").over(Window.partitionBy("_doc", "grp").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.select("_doc", "grp", "stretch", before.alias("before"))
    out = out.join(ends, ["_doc", "grp", "stretch"]).withColumn("part", (F.col("before") + F.col("inner")).cast("int"))
    out = out.select("document_id", "grp", "part", "n_blocks", "n_chars", "first_ordinal", "last_ordinal", "_doc")
    return out.withColumn("segment_id", stable_id("seg", F.col("_doc"), F.col("grp"), F.col("part"))).drop("_doc")


def sections(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, section_no, title, n_chars): texts cut before lines that begin a section, row by row, without a shuffle."""
    parts = F.split(F.col(text), r"\n(?=#+ |第[零〇一二三四五六七八九十百千万\d]+条|Article \d+)")
    each = df.select(*keys, F.posexplode(parts).alias("section_no", "body"))
    first = F.substring_index("body", "\n", 1)
    return each.select(*keys, "section_no", F.when(F.col("body").rlike(LABEL), F.substring(F.trim(F.regexp_replace(first, r"^#+ ", "")), 1, 500)).otherwise("").alias("title"), F.length("body").alias("n_chars"))
