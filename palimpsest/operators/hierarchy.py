"""Problem 3: parent-child links to full hierarchies, by heavy-path decomposition.

1. Pointer doubling over the links gives subtree sizes and separates cycles: after round k every open node points to
   its 2^k-th ancestor, so a chain of any length closes in log2(length) rounds of joins. Only open nodes are read and
   written again, so the work shrinks with the depth of the nodes. A round that closes no node leaves exactly the nodes
   on, or leading into, cycles.
2. The child with the largest subtree continues its parent's chain, every other child heads a new one. A path from
   any node to its root meets at most log2(n) chains.
3. A node's path is the list of chain segments (chain, from, to), its depth the sum of their lengths, and its
   descendants are the rest of its own chain plus all chains that leave it below the node. For all nodes neither is
   written out node by node, which for a chain of n nodes would be n^2 rows; ``path_nodes`` and ``descendant_nodes`` do
   it for the nodes that are asked for.

Every step is a join or an aggregation on node keys; a parent with very many children is summed before the shuffle,
and the join to it has one row on its other side, which adaptive skew handling splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.dates import strip
from palimpsest.plans.session import cut, cut_counted, discard, table


def latest_links(lifecycle: DataFrame) -> DataFrame:
    """(id, parent): one row per source_id; the record with the newest recorded_at holds.

    Ties on recorded_at take the larger link. A null source_id is dropped. Links ignore case and surrounding white
    space; blank links and links to ids that are not there are no links. Ids equal but for case or white space stay
    separate nodes; a link to them means the smallest.
    """
    held = lifecycle.where(F.col("source_id").isNotNull()).groupBy(F.col("source_id").alias("id")).agg(
        F.max(F.struct("recorded_at", "previous_source_id"))["previous_source_id"].alias("link")
    )
    norm = lambda c: F.lower(strip(c))
    named = held.groupBy(norm(F.col("id")).alias("name")).agg(F.min("id").alias("parent"))
    return held.withColumn("name", F.when(strip(F.col("link")) != "", norm(F.col("link")))).join(named, "name", "left").select("id", "parent")


def subtree_sizes(links: DataFrame, left: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Nodes at or below each node, and the nodes on cycles, by pointer doubling over ``links`` (id, parent).

    ``left`` is the number of links. Returns (sizes: id, below, without nodes that have nothing below them; ring: id,
    ptr, with ptr on a loop; tables to discard once both are used). In round k only nodes that have a 2^k-th ancestor
    (``ptr``) are left; each adds its size within distance 2^k to that ancestor. A closed node is never read again.
    """
    open_ = links.where("parent is not null").select("id", F.col("parent").alias("ptr"), F.lit(1).cast("long").alias("size"))
    rounds, steps, stuck = [open_], 1, left == 0
    while not stuck:
        ahead = open_.select(F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"))
        below = open_.groupBy(F.col("ptr").alias("id")).agg(F.sum("size").alias("more"))
        grown = open_.join(below, "id", "left").select("id", "ptr", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))
        open_, still = cut_counted(grown.join(ahead, "ptr").select("id", F.col("ptr2").alias("ptr"), "size"))
        steps *= 2
        # A node of finite depth closes as soon as its depth is passed, so a round that closes none leaves cycles only.
        stuck, left = still in (0, left), still
        rounds.append(open_)
    every = rounds[0].select("ptr", "size")
    for r in rounds[1:]:
        every = every.unionByName(r.select("ptr", "size"))
    sizes = every.groupBy(F.col("ptr").alias("id")).agg(F.sum("size").alias("below"))
    ring, kept = open_.select("id", "ptr"), rounds[1:]
    # Pointers of the cyclic rest go on until they are past any way into a loop.
    while steps < left:
        ring = cut(ring.join(ring.select(F.col("id").alias("ptr"), F.col("ptr").alias("ptr2")), "ptr").select("id", F.col("ptr2").alias("ptr")))
        kept.append(ring)
        steps *= 2
    return sizes, ring if left else ring.where("false"), kept


def _ranked(chained: DataFrame, left: int) -> DataFrame:
    """(id, parent, size, chain_id, chain_pos) of nodes (id, parent, size, along): ``along`` leads up the own chain, null at its top.

    ``left`` is the number of nodes with ``along``. A node at distance d below a closed one makes that one's size more
    than d, so of the closed rows only those of more than 2^k nodes go on to round k. 2^k is a column: as a literal each round
    would be new code to compile.
    """
    top = F.when(F.col("along").isNull(), F.col("id"))
    state = chained.select("id", "parent", "size", F.col("along").alias("ptr"), top.alias("top"), F.col("along").isNotNull().cast("long").alias("dist"), F.lit(True).alias("fresh"), F.lit(2).cast("long").alias("steps"))
    done = state.where("top is not null")
    while left:
        ahead = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("top").alias("top2"), F.col("dist").alias("dist2"))
        moved = state.where("top is null").join(ahead, "ptr").select(
            "id", "parent", "size", F.when(F.col("top2").isNull(), F.col("ptr2")).alias("ptr"), F.col("top2").alias("top"), (F.col("dist") + F.col("dist2")).alias("dist"), F.lit(True).alias("fresh"), (F.col("steps") * 2).alias("steps")
        )
        carried = state.where("top is not null and size > steps").withColumns({"fresh": F.lit(False), "steps": F.col("steps") * 2})
        state, left = cut_counted(moved.unionByName(carried), "top is null")
        done = done.unionByName(state.where("fresh and top is not null"))
    return done.select("id", "parent", "size", F.col("top").alias("chain_id"), F.col("dist").alias("chain_pos"))


def heavy_paths(links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Decompose the forest of ``links`` (id, parent).

    Returns
    - nodes (id, parent, size, chain_id, chain_pos): the chain is named by its top node, size counts the node itself;
    - chains (chain_id, segments: array of (chain, upto)): the segments above a chain, outermost first, each from
      position 0 to ``upto``;
    - cyclic (id, on_cycle): nodes on a loop (1) or leading up into one (0).

    A node that names itself is a loop. Repeated links of one node are not allowed. Empty links give empty results.
    """
    links, n_links = cut_counted(links.select("id", "parent"), "parent is not null")
    sizes, ring, used = subtree_sizes(links, n_links)
    on_loop = ring.select(F.col("ptr").alias("id")).distinct().withColumn("on_cycle", F.lit(1))
    cyclic = cut(ring.select("id").join(on_loop, "id", "left").select("id", F.coalesce("on_cycle", F.lit(0)).alias("on_cycle")))

    tree = links.join(sizes, "id", "left").join(cyclic.select("id"), "id", "left_anti").select("id", "parent", (F.coalesce("below", F.lit(0)) + 1).alias("size"))
    tree = cut(tree)
    discard(links, *used)
    heavy = tree.where("parent is not null").groupBy("parent").agg(F.max(F.struct("size", "id"))["id"].alias("id")).select("id", F.col("parent").alias("along"))
    chained, left = cut_counted(tree.join(heavy, "id", "left"), "along is not null")
    discard(tree)
    nodes = _ranked(chained, left)

    # The chain above a chain, and where on it this one leaves.
    at = nodes.select(F.col("id").alias("parent"), F.col("chain_id").alias("above"), F.col("chain_pos").alias("upto"))
    heads = chained.where("along is null").select(F.col("id").alias("chain_id"), "parent", "size").join(at, "parent", "left")
    none = F.array().cast("array<struct<chain:string,upto:bigint>>")
    state, left = cut_counted(
        heads.select(
            "chain_id", "size", F.col("above").alias("ptr"),
            F.when(F.col("above").isNull(), none).otherwise(F.array(F.struct(F.col("above").alias("chain"), F.col("upto").alias("upto")))).alias("segments"), F.lit(True).alias("fresh"), F.lit(3).alias("least"),
        ),
        "ptr is not null",
    )
    chains = state.where("ptr is null")
    while left:
        up = state.select(F.col("chain_id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("segments").alias("before"))
        moved = state.where("ptr is not null").join(up, "ptr").select("chain_id", "size", F.col("ptr2").alias("ptr"), F.concat("before", "segments").alias("segments"), F.lit(True).alias("fresh"), (2 * F.col("least") - 1).alias("least"))
        # Each chain hangs below a node more than twice its size, so a chain d chains above another has 2^(d+1) nodes or more.
        carried = state.where(F.col("ptr").isNull() & (F.log2(F.col("size") + 1) >= F.col("least"))).withColumns({"fresh": F.lit(False), "least": 2 * F.col("least") - 1})
        state, left = cut_counted(moved.unionByName(carried), "ptr is not null")
        chains = chains.unionByName(state.where("fresh and ptr is null"))
    return nodes, chains.select("chain_id", "segments"), cyclic


def path_nodes(asked: DataFrame, nodes: DataFrame, chains: DataFrame) -> DataFrame:
    """(id, depth, node): the full path of the ``asked`` nodes (id), root at depth 0, put together from chain segments.

    One row per asked node and node on its path; ask for nodes whose paths you can hold. Nodes that are not in the
    forest have none; repeated rows count once.
    """
    own = asked.select("id").distinct().join(nodes.select("id", "chain_id", "chain_pos"), "id").join(chains, "chain_id")
    whole = F.concat("segments", F.array(F.struct(F.col("chain_id").alias("chain"), F.col("chain_pos").alias("upto"))))
    part = own.select("id", F.posexplode(whole).alias("k", "s"), F.col("segments"))
    above = F.aggregate(F.slice("segments", F.lit(1), F.col("k")), F.lit(0).cast("long"), lambda acc, x: acc + x["upto"] + 1)
    part = part.select("id", above.alias("above"), F.col("s.chain").alias("chain_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("s.upto"))).alias("chain_pos"))
    member = nodes.select("chain_id", "chain_pos", F.col("id").alias("node"))
    return part.join(member, ["chain_id", "chain_pos"]).select("id", (F.col("above") + F.col("chain_pos")).alias("depth"), "node")


def descendant_nodes(asked: DataFrame, nodes: DataFrame, chains: DataFrame) -> DataFrame:
    """(id, node): all descendants of the ``asked`` nodes (id): the rest of the own chain, and every chain that hangs below it.

    One row per asked node and descendant. Nodes that are not in the forest have none; repeated rows count once.
    """
    own = asked.select("id").distinct().join(nodes.select("id", "chain_id", "chain_pos"), "id")
    rest = own.join(nodes.select("chain_id", F.col("chain_pos").alias("p"), F.col("id").alias("node")), "chain_id").where("p > chain_pos").select("id", "node")
    hung = chains.select(F.col("chain_id").alias("lower"), F.explode("segments").alias("s")).select("lower", F.col("s.chain").alias("chain_id"), "s.upto")
    lower = own.join(hung, "chain_id").where("upto >= chain_pos").select("id", F.col("lower").alias("chain_id"))
    return rest.unionByName(lower.join(nodes.select("chain_id", F.col("id").alias("node")), "chain_id").select("id", "node"))


def _above(segments: str = "segments"):
    return F.aggregate(segments, F.lit(0).cast("long"), lambda acc, x: acc + x["upto"] + 1)


def found(spark, base: str) -> DataFrame:
    """p3_found: root, depth and loop flag of every source, read off the chain labels."""
    nodes, chains, cyclic = heavy_paths(latest_links(table(spark, base, "source_lifecycle")))
    in_tree = nodes.join(chains, "chain_id").select(
        F.col("id").alias("source_id"),
        F.when(F.size("segments") > 0, F.get("segments", F.lit(0))["chain"]).otherwise(F.col("chain_id")).alias("root_id"),
        (F.col("chain_pos") + _above()).cast("int").alias("node_depth"), F.lit(0).alias("on_cycle"),
    )
    looped = cyclic.select(F.col("id").alias("source_id"), F.lit("").alias("root_id"), F.lit(-1).alias("node_depth"), F.col("on_cycle").cast("int").alias("on_cycle"))
    return in_tree.unionByName(looped)


def paths(spark, base: str) -> DataFrame:
    """p3_paths: per source its path as chain segments ``chain[0..upto] > ... > chain[0..pos]`` and its number of descendants.

    Sources on a loop or leading into one have an empty chain and path, position -1 and no number.
    """
    nodes, chains, cyclic = heavy_paths(latest_links(table(spark, base, "source_lifecycle")))
    part = lambda chain, upto: F.concat(chain, F.lit("[0.."), upto.cast("string"), F.lit("]"))
    in_tree = nodes.join(chains, "chain_id").select(
        F.col("id").alias("source_id"), "chain_id", F.col("chain_pos").cast("int").alias("chain_pos"),
        F.array_join(F.concat(F.transform("segments", lambda x: part(x["chain"], x["upto"])), F.array(part(F.col("chain_id"), F.col("chain_pos")))), " > ").alias("path"),
        (F.col("size") - 1).alias("descendants"),
    )
    looped = cyclic.select(F.col("id").alias("source_id"), F.lit("").alias("chain_id"), F.lit(-1).alias("chain_pos"), F.lit("").alias("path"), F.lit(None).cast("long").alias("descendants"))
    return in_tree.unionByName(looped)


def descendant_intervals(spark, base: str) -> DataFrame:
    """p3_descendants: of each chain, the chains it hangs below and at which position.

    The descendants of the node at (chain c, position p) are the positions after p of chain c, and all of every chain
    with a row (below_chain = c, leaves_at >= p).
    """
    nodes, chains, _ = heavy_paths(latest_links(table(spark, base, "source_lifecycle")))
    lengths = nodes.groupBy("chain_id").agg(F.count("*").alias("chain_length"))
    return chains.join(lengths, "chain_id").select("chain_id", "chain_length", F.explode_outer("segments").alias("x")).select(
        "chain_id", "chain_length", F.col("x.chain").alias("below_chain"), F.col("x.upto").alias("leaves_at")
    )


def _newest(spark, base: str) -> DataFrame:
    """(id) of the newest record of each source_key: the source that stands at the end of its lineage."""
    rows = table(spark, base, "source_lifecycle").where("source_id is not null and source_key is not null")
    return rows.groupBy("source_key").agg(F.max(F.struct("recorded_at", "source_id"))["source_id"].alias("id")).select("id")


def newest_lineage(spark, base: str) -> DataFrame:
    """p3_lineage: the full path of the newest source of each source_key, node by node."""
    nodes, chains, _ = heavy_paths(latest_links(table(spark, base, "source_lifecycle")))
    return path_nodes(_newest(spark, base), nodes, chains).select(F.col("id").alias("source_id"), F.col("depth").cast("int").alias("depth"), F.col("node").alias("ancestor_id"))


def key_successors(spark, base: str) -> DataFrame:
    """p3_successors: all descendants of the first root of each source_key, node by node."""
    nodes, chains, _ = heavy_paths(latest_links(table(spark, base, "source_lifecycle")))
    keyed = table(spark, base, "source_lifecycle").where("source_key is not null").select(F.col("source_id").alias("id"), "source_key")
    roots = nodes.where("parent is null").select("id").join(keyed, "id").groupBy("source_key").agg(F.min("id").alias("id"))
    return descendant_nodes(roots, nodes, chains).select(F.col("id").alias("source_id"), F.col("node").alias("descendant_id"))
