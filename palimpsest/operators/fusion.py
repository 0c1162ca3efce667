"""Fusion of ranked channels and selection of results per query."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.plans.session import ship

# Fixed value: the constant of reciprocal-rank fusion.
RANK_CONSTANT = 60


def reciprocal_rank(channels: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(query_id, item_id, score, channels, rank) of (query_id, item_id, channel, rank): sum of weight / (60 + rank).

    An item counts once per channel, with its best rank. Channels without a weight count 0. Scores have 9 decimals,
    equal scores rank by item_id.
    """
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("channel")), F.lit(0.0))
    best = channels.groupBy("query_id", "item_id", "channel").agg(F.min("rank").alias("rank"))
    fused = best.groupBy("query_id", "item_id").agg(
        F.round(F.sum(weight / (RANK_CONSTANT + F.col("rank"))), 9).alias("score"), F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("channels")
    )
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")))


def best_view(scored: DataFrame) -> DataFrame:
    """Of an item's scores over several views of a query the best, the earliest view on ties: query_id, item_id, score, view."""
    best = F.max(F.struct("score", (-F.col("view")).alias("v")))
    return scored.groupBy("query_id", "item_id").agg(best.alias("b")).select("query_id", "item_id", "b.score", (-F.col("b.v")).alias("view"))


def first_fit(ranked: DataFrame, size: str, most_items: int, most_size: int) -> DataFrame:
    """(query_id, chosen item ids in rank order, used size): items that don't fit are skipped, later ones may.

    ``ranked`` holds the bounded candidate list of each query (query_id, item_id, rank, size). Null sizes count 0.
    """
    listed = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id", F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size")))).alias("x"))
    start = F.struct(F.array().cast("array<string>").alias("ids"), F.lit(0).cast("long").alias("used"))
    pick = F.aggregate(
        "x", start,
        lambda acc, i: F.when((F.size(acc["ids"]) < most_items) & (acc["used"] + i["size"] <= most_size), F.struct(F.array_append(acc["ids"], i["item_id"].cast("string")).alias("ids"), (acc["used"] + i["size"]).alias("used"))).otherwise(acc),
    )
    return listed.select("query_id", pick.alias("p")).select("query_id", F.col("p.ids").alias("ids"), F.col("p.used").alias("used"))


def fair_share(ranked: DataFrame, size: str, total: int, reserve: int) -> DataFrame:
    """(query_id, item_id, rank, share): characters each item gets, in rank order.

    An item gets what it needs of what is left, less ``reserve`` for each item still to come, and at least nothing.
    ``ranked`` holds the bounded candidate list of each query (query_id, item_id, rank, size); null sizes need nothing.
    """
    listed = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id", F.coalesce(F.col(size), F.lit(0)).cast("long").alias("need")))).alias("x"))
    numbered = listed.withColumn("x", F.transform("x", lambda v, i: F.struct(v["rank"].alias("rank"), v["item_id"].alias("item_id"), v["need"].alias("need"), (F.size("x") - 1 - i).cast("long").alias("after"))))
    kind = dict(ranked.dtypes)
    start = F.struct(F.array().cast(f"array<struct<rank:{kind['rank']},item_id:{kind['item_id']},share:bigint>>").alias("out"), F.lit(total).cast("long").alias("left"))

    def give(acc, v):
        share = F.greatest(F.lit(0).cast("long"), F.least(v["need"], acc["left"] - v["after"] * reserve))
        return F.struct(F.array_append(acc["out"], F.struct(v["rank"].alias("rank"), v["item_id"].alias("item_id"), share.alias("share"))).alias("out"), (acc["left"] - share).alias("left"))

    return numbered.select("query_id", F.explode(F.aggregate("x", start, give)["out"]).alias("o")).select("query_id", "o.item_id", "o.rank", "o.share")


def greedy_cover(candidates: DataFrame, most_items: int, most_size: int) -> DataFrame:
    """Greedy choice of items that add duties: query_id, item_id, place, adds.

    ``candidates``: the bounded list of each query (query_id, item_id, rank, size, duties array). Each step takes, of the
    items that fit, the one adding most uncovered duties, then the better rank, then item_id; it ends when none adds.
    Null sizes count 0, null duties are none.
    """

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        rows = [(r.item_id, r.rank, int(r.size_), frozenset(r.duties)) for r in group.itertuples()]
        covered, left, out = set(), most_size, []
        while len(out) < most_items:
            open_ = [(-len(d - covered), rank, i, n, d) for i, rank, n, d in rows if n <= left and d - covered]
            if not open_:
                break
            adds, _, i, n, d = min(open_, key=lambda x: x[:3])
            covered |= d
            left -= n
            out.append((group.query_id.iloc[0], i, len(out) + 1, -adds))
        return pd.DataFrame(out, columns=["query_id", "item_id", "place", "adds"])

    ship(candidates.sparkSession)
    kinds = dict(candidates.dtypes)
    schema = f"query_id {kinds['query_id']}, item_id {kinds['item_id']}, place int, adds int"
    plain = candidates.select("query_id", "item_id", "rank", F.coalesce("size", F.lit(0)).alias("size_"), F.coalesce("duties", F.array().cast("array<string>")).alias("duties"))
    return plain.groupBy("query_id").applyInPandas(pick, schema)


def diverse(ranked: DataFrame, group: str, k: int, *per: str) -> DataFrame:
    """Best ``k`` of each query with at most one item per group: query_id, item_id, score, rank. Null groups are one group.

    With ``per``, the same within each value of those columns.
    """
    first = Window.partitionBy(*per, "query_id", group).orderBy(F.desc("score"), "item_id")
    one = ranked.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "rank")
    place = F.row_number().over(Window.partitionBy(*per, "query_id").orderBy(F.desc("score"), "item_id"))
    return one.withColumn("rank", place).where(F.col("rank") <= k)


def retrieve(channels: DataFrame, items: DataFrame, queries: DataFrame, weights: dict[str, float], k: int, most_items: int, most_size: int) -> DataFrame:
    """(query_id, item_id, group, score, place): one answer list per query, from ranked channels to what fits a budget.

    ``channels``: query_id, item_id, channel, rank; ``items``: item_id, group, s, e, size; ``queries``: query_id, day.
    Items that are not valid on the query's day are dropped (half-open, null bounds open, a null day drops none), the
    rest is fused by reciprocal ranks, the best item of each of the best ``k`` groups goes on, and what fits
    ``most_items`` and ``most_size`` in rank order is taken. Null groups are one group.
    """
    day = queries.select("query_id", "day")
    valid = F.col("day").isNull() | ((F.col("s").isNull() | (F.col("s") <= F.col("day"))) & (F.col("e").isNull() | (F.col("e") > F.col("day"))))
    admitted = channels.join(items.select("item_id", "s", "e"), "item_id").join(day, "query_id").where(valid).select("query_id", "item_id", "channel", "rank")
    fused = reciprocal_rank(admitted, weights).join(items.select("item_id", "group", "size"), "item_id")
    best = diverse(fused.select("query_id", "item_id", "score", "rank", "group", "size"), "group", k)
    chosen = first_fit(best, "size", most_items, most_size).select("query_id", F.posexplode("ids").alias("place", "item_id"))
    kept = best.select("query_id", "item_id", "group", "score").join(chosen, ["query_id", "item_id"])
    return kept.select("query_id", "item_id", "group", "score", (F.col("place") + 1).alias("place"))


def partition_budget(ranked: DataFrame, total: int) -> DataFrame:
    """(query_id, item_id, tokens): ``total`` split over each query's items (query_id, item_id, score) in proportion to their scores.

    Whole numbers by largest remainders, ties by item_id; they add up to ``total``. Scores that are null or not above
    zero get nothing. The lists are bounded.
    """
    per = Window.partitionBy("query_id")
    usable = ranked.where("score > 0").select("query_id", "item_id", F.col("score").cast("double").alias("score"))
    exact = usable.withColumn("exact", F.round(F.col("score") / F.sum("score").over(per) * total, 6))
    floors = exact.withColumn("whole", F.floor("exact").cast("long")).withColumn("left", F.lit(total) - F.sum("whole").over(per))
    place = F.row_number().over(per.orderBy(F.desc(F.round(F.col("exact") - F.col("whole"), 6)), "item_id"))
    return floors.select("query_id", "item_id", (F.col("whole") + (place <= F.col("left")).cast("long")).alias("tokens"))


# Bonus for a group not chosen yet, and penalty for each item already chosen of it, at most the last.
NEW_GROUP, REPEATED, MOST_PENALTY = 0.002, 0.001, 0.004


def diverse_greedy(ranked: DataFrame, most: int) -> DataFrame:
    """(query_id, item_id, place): greedy choice by score with a bonus for new groups and a penalty for repeated ones.

    ``ranked``: the bounded list of each query (query_id, item_id, group, score). Each step takes the item with the
    highest score + bonus - penalty, the least item_id on ties. Null groups have neither. Spark folds each list in place.
    """
    listed = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("item_id", F.col("score").cast("double").alias("score"), F.col("group").cast("string").alias("group")))).alias("x"))
    start = F.struct(F.array().cast("array<string>").alias("ids"), F.array().cast("array<string>").alias("groups"), F.col("x").alias("rest"))

    def step(acc, _):
        again = lambda v: F.size(F.filter(acc["groups"], lambda g: g == v["group"]))
        change = lambda v: F.when(v["group"].isNull(), 0.0).when(again(v) == 0, NEW_GROUP).otherwise(-F.least(F.lit(MOST_PENALTY), REPEATED * again(v)))
        # The least of (negative objective, id) is the best.
        marked = F.transform(acc["rest"], lambda v: F.struct((-F.round(v["score"] + change(v), 9)).alias("o"), v["item_id"].alias("i"), v["group"].alias("g")))
        best = F.array_min(marked)
        return F.when(F.size(acc["rest"]) == 0, acc).otherwise(
            F.struct(F.array_append(acc["ids"], best["i"].cast("string")).alias("ids"), F.array_append(acc["groups"], best["g"]).alias("groups"), F.filter(acc["rest"], lambda v: v["item_id"] != best["i"]).alias("rest"))
        )

    ids = F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step)["ids"]
    return listed.select("query_id", F.posexplode(ids).alias("place", "item_id")).select("query_id", "item_id", (F.col("place") + 1).alias("place"))
