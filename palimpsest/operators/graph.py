"""Graph operators on edge tables (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import compact_text
from palimpsest.operators.temporal import following
from palimpsest.plans.session import cut, cut_counted, discard

# Freshness from best to worst.
FRESHNESS = ["fresh", "unknown", "stale", "invalidated"]


def k_hop(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(seed, node, hop): nodes reached from each seed (column seed) along the edges, with the fewest steps, the seed left out.

    Each round joins only the newly reached nodes. Repeated edges, loops and cycles are fine; null ends are ignored.
    """
    links = edges.where("src is not null and dst is not null").select("src", "dst").distinct()
    frontier = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hop")).distinct()
    seen = frontier
    for hop in range(1, hops + 1):
        step = frontier.join(links, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(frontier)
    return seen.where("hop > 0")


def reached(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(node, hop): nodes within ``hops`` steps of any seed (column node) along the edges, with the fewest steps, seeds left out.

    Each round joins only the newly reached nodes; null ends are ignored, cycles are fine.
    """
    links = edges.where("src is not null and dst is not null").select("src", "dst").distinct()
    seen = frontier = cut(seeds.where("node is not null").select("node", F.lit(0).alias("hop")).distinct())
    for hop in range(1, hops + 1):
        step = frontier.join(links, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(hop).alias("hop")))
        seen = seen.unionByName(frontier)
    return seen.where("hop > 0")


def worst_reached(states: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, state): the greatest state among a node and all it depends on.

    ``states``: node, state (int, unique nodes); ``edges``: src depends on dst. Nodes that are only in edges have state
    0. Only nodes whose state rose go on to the next round, so the work shrinks until nothing changes; cycles are fine.
    """
    links = cut(edges.where("src is not null and dst is not null").select("src", "dst").distinct())
    nodes = links.select(F.col("src").alias("node")).unionByName(links.select(F.col("dst").alias("node"))).unionByName(states.select("node")).distinct()
    now = cut(nodes.join(states, "node", "left").select("node", F.coalesce("state", F.lit(0)).alias("state")))
    risen = now.where("state > 0")
    while not risen.isEmpty():
        offered = risen.join(links, F.col("node") == F.col("dst")).groupBy(F.col("src").alias("node")).agg(F.max("state").alias("offer"))
        new = cut(now.join(offered, "node", "left").select("node", F.greatest("state", F.coalesce("offer", F.lit(0))).alias("state"), (F.coalesce("offer", F.lit(0)) > F.col("state")).alias("rose")))
        discard(now)
        now, risen = new, new.where("rose").select("node", "state")
    return now.select("node", "state")


def bridges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label, outside): nodes with an edge to another community, and the number of communities reached.

    ``labels``: node, label (unique nodes). Edges with an unlabelled end are ignored; direction doesn't matter.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    a, b = labels.select(F.col("node").alias("src"), F.col("label").alias("l1")), labels.select(F.col("node").alias("dst"), F.col("label").alias("l2"))
    out = both.join(a, "src").join(b, "dst").where("l1 <> l2")
    return out.groupBy(F.col("src").alias("node"), F.col("l1").alias("label")).agg(F.count_distinct("l2").alias("outside"))


def communities(edges: DataFrame, rounds: int = 25) -> DataFrame:
    """(node, label, settled): weighted label propagation, all nodes at once, ties to the least label, for at most ``rounds`` rounds.

    ``edges``: src, dst, weight; both directions count, loops don't. Labels are node names. Unlike the one-by-one order,
    two-coloured parts may swing; a node then keeps the smaller of its own and the winning label on odd rounds.
    ``settled`` tells if the node's neighbours voted for its label when the last round began; propagation ends when all
    nodes are settled, and nodes that are not when the rounds run out are shown by it.
    """
    clean = edges.where("src is not null and dst is not null and src <> dst")
    both = clean.select("src", "dst", "weight").unionByName(clean.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    links = cut(both.groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    now = cut(links.select(F.col("src").alias("node")).distinct().select("node", F.col("node").alias("label"), F.lit(False).alias("settled")))
    for i in range(rounds):
        votes = links.join(now.select(F.col("node").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.round(F.sum("weight"), 9).alias("w"))
        # The greatest weight, then the least label.
        best = votes.groupBy("src").agg(F.max("w").alias("w")).join(votes, ["src", "w"]).groupBy(F.col("src").alias("node")).agg(F.min("label").alias("won"))
        label = F.least("won", "label") if i % 2 else F.col("won")
        new, moving = cut_counted(now.join(best, "node").select("node", label.alias("label"), (F.col("won") == F.col("label")).alias("settled")), "not settled")
        discard(now)
        now = new
        if not moving:
            break
    return now


def name_bridges(names: DataFrame, letters: int = 8, weight: float = 0.35) -> DataFrame:
    """(src, dst, weight): weak edges between nodes (node, name) whose plain names begin with the same ``letters`` letters.

    Each node is tied to the next one of its bucket, so a bucket of any size gives one edge per node and not one per
    pair. Names under three letters, null names and null nodes have none; repeated rows count once.
    """
    plain = F.substring(compact_text(F.col("name")), 1, letters)
    keyed = names.where("node is not null").select("node", plain.alias("bucket")).where(F.length("bucket") >= 3).distinct()
    # Nodes are put in shards of their hash, so that a bucket of very many nodes is no single group.
    put = keyed.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(1024)))
    return following(put, "bucket", "shard", "node", "dst").where("dst is not null").select(F.col("node").alias("src"), "dst", F.lit(weight).alias("weight"))


def wiki_links(pages: DataFrame) -> DataFrame:
    """(page_id, place, target) of the [[links]] in page bodies (page_id, body), outside fenced and inline code.

    Escaped brackets are no links; targets have 1 to 2,048 characters and no line end. Null bodies have none.
    """
    plain = F.regexp_replace(F.regexp_replace(F.coalesce("body", F.lit("")), r"(?ms)^(```|~~~).*?(^\1[^\n]*$|\z)", ""), r"`[^`\n]*`", "")
    found = F.regexp_extract_all(plain, F.lit(r"(?<!\\)(?:\\\\)*\[\[([^\[\]\n]{1,2048})\]\]"), F.lit(1))
    return pages.select("page_id", F.posexplode(found).alias("place", "target"))


def resolve_links(links: DataFrame, registry: DataFrame) -> DataFrame:
    """(page_id, place, target, candidates, first_candidate, status) against registry (name, page_id): resolved, ambiguous or missing.

    ``candidates`` is the number of pages with the name and ``first_candidate`` the least of them; they are counted, not
    listed, so a name of very many pages is no large row.
    """
    names = registry.select(F.lower("name").alias("key"), F.col("page_id").alias("to_page")).distinct().groupBy("key").agg(F.count("to_page").alias("candidates"), F.min("to_page").alias("first_candidate"))
    keyed = links.withColumn("key", F.lower(F.trim(F.regexp_extract("target", r"^([^|#]+)", 1))))
    joined = keyed.join(names, "key", "left").fillna(0, ["candidates"])
    status = F.when(F.col("candidates") == 1, "resolved").when(F.col("candidates") > 1, "ambiguous").otherwise("missing")
    return joined.select("page_id", "place", "target", "candidates", "first_candidate", status.alias("status"))


def backlinks(links: DataFrame, cursor: tuple[str, str] | None = None, limit: int = 100) -> DataFrame:
    """(to_page, from_page, links): a page of the listing of backlinks after the keyset ``cursor`` (to_page, from_page).

    ``links``: resolved links (page_id, to_page). One aggregation, then the first ``limit`` rows after the cursor in
    order, of which each task keeps its own; rows without an end are left out.
    """
    counted = links.where("page_id is not null and to_page is not null").groupBy("to_page", F.col("page_id").alias("from_page")).agg(F.count("*").alias("links"))
    if cursor:
        a, b = F.lit(cursor[0]), F.lit(cursor[1])
        counted = counted.where((F.col("to_page") > a) | (F.col("to_page") == a) & (F.col("from_page") > b))
    return counted.orderBy("to_page", "from_page").limit(limit)


def link_degrees(links: DataFrame) -> DataFrame:
    """(page_id, outlinks, backlinks): distinct pages that a page links to, and that link to it."""
    pairs = links.where("page_id is not null and to_page is not null").select("page_id", "to_page").distinct()
    ends = pairs.select("page_id", F.lit(1).alias("o"), F.lit(0).alias("b")).unionByName(pairs.select(F.col("to_page").alias("page_id"), F.lit(0).alias("o"), F.lit(1).alias("b")))
    return ends.groupBy("page_id").agg(F.sum("o").alias("outlinks"), F.sum("b").alias("backlinks"))


def relation_paths(seeds: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """(seed, node, hop, via): the nodes reached from each seed with the fewest steps, and of the shortest paths the least one.

    ``via`` is the path's edge ids (column edge_id of ``edges``: src, dst, edge_id) joined by ``>``. A node that is
    reached is not passed again, so the rows are at most those of ``k_hop``; null ends are ignored.
    """
    links = edges.where("src is not null and dst is not null").groupBy("src", "dst").agg(F.min("edge_id").alias("edge_id"))
    seen = frontier = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hop"), F.lit("").alias("via")).distinct()
    for hop in range(1, hops + 1):
        via = F.concat("via", F.when(F.col("via") == "", "").otherwise(">"), "edge_id")
        step = frontier.join(links, F.col("node") == F.col("src")).groupBy("seed", F.col("dst").alias("node")).agg(F.min(via).alias("via"))
        frontier = cut(step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").select("seed", "node", F.lit(hop).alias("hop"), "via"))
        seen = seen.unionByName(frontier)
    return seen.where("hop > 0")
