"""Problem 3 against brute force on random forests with cycles."""

import random

from palimpsest.operators.hierarchy import descendant_nodes, heavy_paths, latest_links, path_nodes


def brute(parent):
    out = {}
    for x in parent:
        path, seen = [x], {x}
        while parent[path[-1]] is not None and parent[path[-1]] not in seen:
            path.append(parent[path[-1]])
            seen.add(path[-1])
        back = parent[path[-1]]
        out[x] = (path[::-1], None) if back is None else (None, int(x in path[path.index(back):]))
    return out


def test_random_forest(spark):
    rng = random.Random(5)
    names = [f"n{i:03d}" for i in range(160)]
    parent = {n: None if i == 0 or rng.random() < 0.05 else names[max(0, i - rng.choice([1, 1, 1, 2, 5]))] for i, n in enumerate(names)}
    parent["n050"] = "n060"  # loops, and nodes leading into them
    parent["n010"] = "n010"
    want = brute(parent)
    nodes, chains, cyclic = heavy_paths(spark.createDataFrame(list(parent.items()), "id string, parent string"))
    at = {r.id: r for r in nodes.collect()}
    above = {r.chain_id: r.segments for r in chains.collect()}
    member = {(r.chain_id, r.chain_pos): r.id for r in at.values()}
    below = {x: 0 for x in parent}
    for x, (path, _) in want.items():
        for y in (path or [])[:-1]:
            below[y] += 1
    for x, (path, on) in want.items():
        if path is None:
            assert x not in at
            continue
        r = at[x]
        expanded = [member[s.chain, p] for s in above[r.chain_id] for p in range(s.upto + 1)] + [member[r.chain_id, p] for p in range(r.chain_pos + 1)]
        assert expanded == path
        assert r.size == below[x] + 1
        assert len(above[r.chain_id]) <= 8
    assert {r.id: r.on_cycle for r in cyclic.collect()} == {x: on for x, (p, on) in want.items() if p is None}
    asked = spark.createDataFrame([(x,) for x in [*parent, "nowhere", names[0]]], "id string")
    got = {}
    for r in path_nodes(asked, nodes, chains).collect():
        got.setdefault(r.id, {})[r.depth] = r.node
    assert got == {x: dict(enumerate(p)) for x, (p, _) in want.items() if p}
    found = [tuple(r) for r in descendant_nodes(asked, nodes, chains).collect()]
    assert len(found) == len(set(found)) and set(found) == {(y, x) for x, (p, _) in want.items() for y in (p or [])[:-1]}
    assert path_nodes(asked.where("false"), nodes, chains).count() == descendant_nodes(asked.where("false"), nodes, chains).count() == 0


def test_deep_chain_and_wide_parent(spark):
    parent = {f"c{i:04d}": None if i == 0 else f"c{i - 1:04d}" for i in range(300)} | {f"w{i:03d}": "c0150" for i in range(200)}
    nodes, chains, cyclic = heavy_paths(spark.createDataFrame(list(parent.items()), "id string, parent string"))
    at = {r.id: (r.chain_id, r.chain_pos, r.size) for r in nodes.collect()}
    assert at["c0299"] == ("c0000", 299, 1) and at["c0150"][2] == 350 and at["w007"] == ("w007", 0, 1)
    assert {r.chain_id: [tuple(s) for s in r.segments] for r in chains.collect()}["w007"] == [("c0000", 150)] and cyclic.count() == 0


def test_records_and_links(spark):
    rows = [("a", None, 1), ("b", " A\t", 1), ("b", "zz", 0), ("c", "", 3), ("d", "gone", 1), ("e", "E", 1), (None, "a", 1), ("f", "b", None), ("f", "b", None)]
    df = spark.createDataFrame(rows, "source_id string, previous_source_id string, recorded_at int")
    assert {r.id: r.parent for r in latest_links(df).collect()} == {"a": None, "b": "a", "c": None, "d": None, "e": "e", "f": "b"}
    nodes, chains, cyclic = heavy_paths(latest_links(df.where("false")))
    assert nodes.count() == chains.count() == cyclic.count() == 0
