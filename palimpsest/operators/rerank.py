"""Hashed feature vectors of texts, and reranking of candidate lists by coverage, cosine and feedback.

Vectors are sparse rows (id, bucket, v), so they are built and compared by aggregations and equi-joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.functions.text import HAN, terms

DIMENSIONS = 512
# Weights of words, of triples of their characters, and of pairs of Han characters; weights of the ranking.
WORD, TRIPLE, PAIR = 3, 1, 2
COVERAGE, COSINE, UTILITY = 0.55, 0.35, 0.1


def feature_vectors(texts: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, bucket, v): hashed features of texts (id, text), v rounded to 9 decimals.

    Features are words, triples of characters in words and pairs of Han characters; each goes to a bucket and a sign by
    its MD5, with 1 + ln(1 + weighted count). Null and empty texts have no rows; ids are unique.
    """
    low = F.lower("text")
    named = lambda prefix, weight, found: F.transform(found, lambda x: F.struct(F.concat(F.lit(prefix), x).alias("f"), F.lit(weight).alias("c")))
    found = lambda pattern, group: F.regexp_extract_all(low, F.lit(pattern), F.lit(group))
    every = F.concat(named("w:", WORD, found("[a-z0-9]+", 0)), named("c:", TRIPLE, found("(?=([a-z0-9]{3}))", 1)), named("z:", PAIR, found(f"(?=([{HAN}]{{2}}))", 1)))
    counted = texts.where("text is not null").select("id", F.explode(every).alias("x")).groupBy("id", F.col("x.f").alias("f")).agg(F.sum("x.c").alias("c"))
    digest = F.md5(F.col("f"))
    part = lambda at, n: F.conv(F.substring(digest, at, n), 16, 10).cast("long")
    value = F.when(part(7, 1) % 2 == 1, 1.0).otherwise(-1.0) * (1 + F.log1p("c"))
    placed = counted.select("id", (part(1, 6) % dimensions).cast("int").alias("bucket"), value.alias("v"))
    return placed.groupBy("id", "bucket").agg(F.round(F.sum("v"), 9).alias("v")).where("v <> 0")


def quantized(vectors: DataFrame) -> DataFrame:
    """(id, bucket, q): the vectors at length one in whole numbers from -127 to 127; zeros are left out."""
    norm = vectors.groupBy("id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    q = F.round(F.round(F.col("v") / F.col("norm") * 127, 6)).cast("int")
    return vectors.join(norm, "id").select("id", "bucket", q.alias("q")).where("q <> 0")


def pair_cosine(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(query_id, item_id, cosine) of ``pairs`` (query_id, item_id) from sparse vectors; pairs without a common bucket are left out."""
    norm = lambda v: v.groupBy("id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    a, b = left.join(norm(left), "id"), right.join(norm(right), "id")
    q = a.select(F.col("id").alias("query_id"), "bucket", F.col("v").alias("va"), F.col("norm").alias("na"))
    i = b.select(F.col("id").alias("item_id"), "bucket", F.col("v").alias("vb"), F.col("norm").alias("nb"))
    met = pairs.select("query_id", "item_id").distinct().join(i, "item_id").join(q, ["query_id", "bucket"])
    return met.groupBy("query_id", "item_id").agg((F.sum(F.col("va") * F.col("vb")) / F.max("na") / F.max("nb")).alias("cosine"))


def rerank(queries: DataFrame, candidates: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, item_id, coverage, cosine, score, rank) of the candidate lists, best first.

    ``queries``: query_id, text; ``candidates``: query_id, item_id, utility (from -1 to 1, null as 0); ``items``:
    item_id, text. The score is the share of the query's terms that the item has, the cosine of their feature vectors
    and the utility of past feedback, weighted. Only the candidates' texts are looked at. Ties rank by item_id.
    """
    pairs = candidates.select("query_id", "item_id", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.col("utility").cast("double"), F.lit(0.0)))).alias("utility"))
    wanted = items.select("item_id", "text").join(pairs.select("item_id").distinct(), "item_id", "left_semi")
    asked = queries.select("query_id", F.array_distinct(terms(F.col("text"))).alias("q"))
    held = wanted.select("item_id", F.array_distinct(terms(F.col("text"))).alias("t"))
    coverage = F.size(F.array_intersect("q", "t")) / F.greatest(F.lit(1), F.size("q"))
    both = pairs.join(asked, "query_id").join(held, "item_id").select("query_id", "item_id", "utility", coverage.alias("coverage"))
    near = pair_cosine(pairs, feature_vectors(queries.select(F.col("query_id").alias("id"), "text")), feature_vectors(wanted.select(F.col("item_id").alias("id"), "text")))
    scored = both.join(near, ["query_id", "item_id"], "left").fillna(0.0, ["cosine"])
    total = COVERAGE * F.col("coverage") + COSINE * F.col("cosine") + UTILITY * F.col("utility")
    # A sum just below zero is zero, not minus zero.
    rounded = lambda c: F.when(F.round(c, 6) == 0, 0.0).otherwise(F.round(c, 6))
    out = scored.select("query_id", "item_id", F.round("coverage", 6).alias("coverage"), rounded(F.col("cosine")).alias("cosine"), rounded(total).alias("score"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")))
