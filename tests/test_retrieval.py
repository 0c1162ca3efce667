"""Terms, reranking, selection, relations and links on small fixtures: nulls, ties, empty tables."""

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import evaluation, fulltext, fusion, graph, relations, rerank


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).head().x


@pytest.mark.parametrize(
    ("function", "value", "want"),
    [
        (T.expanded_terms, "getFileName v1.2-beta policies", ["getfilename", "v1.2-beta", "policies", "get", "file", "name", "v1", "beta", "policy"]),
        (T.expanded_terms, "法律条文 a", ["法律", "律条", "条文", "法律条", "律条文", "法律条文"]), (T.expanded_terms, None, []), (T.expanded_terms, "HTTPServer", ["httpserver", "http", "server"]),
        (T.target_anchors, "may the Kiln Safety Office and NASA act", ["kiln safety office", "nasa"]), (T.target_anchors, "Court", []), (T.target_anchors, None, None),
        (T.identity_text, "Ａct-No. ３ 法，典", "actno3法典"), (T.canonical_json, '{"b": 1, "a": [1, {"d": null, "c": "x"}]}', '{"a":[1,{"c":"x","d":null}],"b":1}'), (T.canonical_json, '{"a": 1, "a": 2}', None), (T.canonical_json, "no", None),
        (T.as_of_moment, "2020-01-02", "2020-01-02T23:59:59Z"), (T.as_of_moment, "2020-01-02T03:00:00+01:00", "2020-01-02T02:00:00Z"), (T.as_of_moment, "x", None),
        (T.unsafe_reasons, "see /home/me/x and password: hunter2hunter2", ["local_path", "secret"]), (T.unsafe_reasons, "a​b", ["hidden"]), (T.unsafe_reasons, "plain /page/2", []), (T.unsafe_reasons, None, []),
        (lambda c: T.marker_places(c, F.lit("ab")), "abxabab", [1, 4, 6]), (lambda c: T.marker_places(c, F.lit("ab")), "a", []),
    ],
)
def test_scalars(spark, function, value, want):
    assert one(spark, function, value) == want


def test_cosine_of_arrays(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([2.0, 2.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r.c, 6) for r in df.select(T.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [0.707107, 0.0, 1.0]


def test_rerank(spark):
    items = spark.createDataFrame([("a", "court order on fees"), ("b", "fee order"), ("c", None), ("d", "court order on fees")], "item_id string, text string")
    asked = spark.createDataFrame([(1, "court fees"), (2, None)], "query_id int, text string")
    pairs = spark.createDataFrame([(1, "a", 0.0), (1, "b", 5.0), (1, "c", None), (1, "d", None), (2, "a", -9.0)], "query_id int, item_id string, utility double")
    got = {(r.query_id, r.item_id): r for r in rerank.rerank(asked, pairs, items).collect()}
    assert len(got) == 5 and got[1, "a"].coverage == 1.0 and got[1, "a"].score == got[1, "d"].score and got[1, "a"].rank < got[1, "d"].rank
    assert got[1, "c"].score == 0.0 and got[2, "a"].score == -0.1 and 0.1 <= got[1, "b"].score < 0.5
    assert rerank.rerank(asked, pairs.where("false"), items).count() == 0
    v = rerank.feature_vectors(spark.createDataFrame([(1, "court"), (2, "court"), (3, ""), (4, None)], "id int, text string"))
    rows = {(r.id, r.bucket): r.v for r in v.collect()}
    assert {b: x for (i, b), x in rows.items() if i == 1} == {b: x for (i, b), x in rows.items() if i == 2} and not any(i > 2 for i, _ in rows)
    q = rerank.quantized(v).where("id = 1").agg(F.sum(F.col("q") * F.col("q")).alias("n")).head().n
    assert abs(q - 127 * 127) < 127 * 4


def test_retrieve_by_day_and_budget(spark):
    channels = spark.createDataFrame([(1, i, "x", k) for k, i in enumerate("abcde", 1)] + [(1, "e", "y", 1), (2, "a", "x", 1)], "query_id int, item_id string, channel string, rank int")
    items = spark.createDataFrame([("a", "g", 0, 10, 50), ("b", "g", None, None, 50), ("c", "h", None, None, 900), ("d", None, None, None, None), ("e", "k", 20, None, 10)], "item_id string, group string, s int, e int, size int")
    days = spark.createDataFrame([(1, 10), (2, None)], "query_id int, day int")
    got = [tuple(r) for r in fusion.retrieve(channels, items, days, {"x": 1.0, "y": 1.0}, 5, 5, 100).select("query_id", "item_id", "place").orderBy("query_id", "place").collect()]
    assert got == [(1, "b", 1), (1, "d", 2), (2, "a", 1)]
    later = fusion.retrieve(channels, items, days.withColumn("day", F.lit(20)), {"x": 1.0, "y": 1.0}, 5, 1, 100).collect()
    assert [(r.query_id, r.item_id) for r in later] == [(1, "e")]
    assert fusion.retrieve(channels.where("false"), items, days, {"x": 1.0}, 5, 5, 100).count() == 0


def test_budget_and_greedy_choice(spark):
    ranked = spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0), (1, "c", 1.0), (1, "d", 0.0), (1, "e", None), (2, "a", 3.0)], "query_id int, item_id string, score double")
    assert {(r.query_id, r.item_id): r.tokens for r in fusion.partition_budget(ranked, 10).collect()} == {(1, "a"): 4, (1, "b"): 3, (1, "c"): 3, (2, "a"): 10}
    rows = [(1, "a", "g", 0.0300), (1, "b", "g", 0.0299), (1, "c", "h", 0.0290), (1, "d", None, 0.0100), (2, "z", None, 0.5)]
    picks = fusion.diverse_greedy(spark.createDataFrame(rows, "query_id int, item_id string, group string, score double"), 3).orderBy("query_id", "place").collect()
    assert [(r.query_id, r.item_id, r.place) for r in picks] == [(1, "a", 1), (1, "c", 2), (1, "b", 3), (2, "z", 1)]


def test_nearest_marker(spark):
    rows = [("The Act replaces Old Law.", "Old Law", "replaces"), ("It does not repeals Old Law but amends it", "Old Law", "amends"), ("不废止旧法典，修改", "旧法典", "amends"), ("旧法典", "旧法典", None), ("nothing", "Old Law", None), (None, "x", None), ("repeals" + " " * 200 + "Old Law", "Old Law", None)]
    markers = {"amends": ["修改", "amends"], "repeals": ["废止", "repeals"], "replaces": ["replaces"]}
    df = spark.createDataFrame(rows, "t string, n string, w string")
    assert [r.x for r in df.select(relations.nearest_marker(F.col("t"), F.col("n"), markers, "不|not ").alias("x")).collect()] == [w for *_, w in rows]


def test_relations_and_versions(spark):
    rel = spark.createDataFrame([("n", "replaces", "o"), ("n", "replaces", "o"), ("n", "cites", "o"), ("m", "replaces", None), ("v1", "cites", "x"), ("v1", "cites", "y"), ("v2", "cites", "x")], "subject string, predicate string, object string")
    owners = spark.createDataFrame([("n", "k2"), ("o", "k1"), ("m", None)], "document_id string, source_key string")
    assert [tuple(r) for r in relations.successors_across(rel, owners, ["replaces"]).collect()] == [("k1", "k2", 1)]
    nexts = spark.createDataFrame([("v1", "v2"), ("v2", None)], "document_id string, next_id string")
    assert {(r.object, r.state) for r in relations.carry_forward(rel, nexts).collect()} == {("x", "carried"), ("y", "pending")}


def test_links_and_paths(spark):
    links = spark.createDataFrame([("p", "a"), ("p", "a"), ("q", "a"), ("p", "b"), (None, "b"), ("q", None)], "page_id string, to_page string")
    assert [tuple(r) for r in graph.backlinks(links).collect()] == [("a", "p", 2), ("a", "q", 1), ("b", "p", 1)]
    assert [tuple(r) for r in graph.backlinks(links, ("a", "p"), 1).collect()] == [("a", "q", 1)]
    assert {tuple(r) for r in graph.link_degrees(links).collect()} == {("p", 2, 0), ("q", 1, 0), ("a", 0, 2), ("b", 0, 1)}
    edges = spark.createDataFrame([("s", "a", "2"), ("s", "a", "1"), ("a", "t", "5"), ("s", "b", "3"), ("b", "t", "4"), ("t", "s", "6"), ("x", None, "7")], "src string, dst string, edge_id string")
    seeds = spark.createDataFrame([("s",), ("s",)], "seed string")
    assert {tuple(r) for r in graph.relation_paths(seeds, edges, 3).collect()} == {("s", "a", 1, "1"), ("s", "b", 1, "3"), ("s", "t", 2, "1>5")}
    assert {tuple(r) for r in graph.reached(spark.createDataFrame([("a",), ("b",), (None,)], "node string"), edges, 2).collect()} == {("t", 1), ("s", 2)}


def test_communities_settle_and_bridge(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", 1.0) for i in range(30)], "src string, dst string, weight double")
    assert graph.communities(edges, rounds=1).where("not settled").count() > 0
    star = spark.createDataFrame([("a", f"z{i}", 1.0) for i in range(5)], "src string, dst string, weight double")
    done = graph.communities(star).collect()
    assert all(r.settled for r in done) and {r.label for r in done} == {"a"}
    names = spark.createDataFrame([(f"n{i}", "Harbour Fees Act" + " x" * i) for i in range(50)] + [("m", "ab"), (None, "Harbour Fees"), ("k", None), ("o", "Other Rules")], "node string, name string")
    bridges = graph.name_bridges(names).collect()
    assert len(bridges) == 49 and len({r.src for r in bridges}) == 49 and all(r.weight == 0.35 for r in bridges)


def test_weight_profile_and_index(spark):
    channels = spark.createDataFrame([(1, "a", "x", 1), (1, "b", "y", 1), (2, "c", "y", 1)], "query_id int, item_id string, channel string, rank int")
    expected = spark.createDataFrame([(1, "b"), (2, "c"), (3, "z")], "query_id int, item_id string")
    got = evaluation.weight_profile(channels, expected, {"x": {"x": 1.0, "y": 0.5}, "y": {"x": 0.5, "y": 1.0}}).collect()
    assert [(r.profile, r.queries, r.mrr, r.place) for r in sorted(got, key=lambda r: r.place)] == [("y", 3, round(2 / 3, 6), 1), ("x", 3, 0.5, 2)]
    items = spark.createDataFrame([("a", "order", "court"), ("b", None, None)], "id string, text string, heading string")
    asked = fulltext.asked_terms(spark.createDataFrame([(1, "court order")], "query_id int, text string"))
    index = fulltext.postings(asked, items, "id", ["text", "heading"])
    assert {(r.item_id, r.term, tuple(r.f), tuple(r.d)) for r in index.collect()} == {("a", "order", (1, 0), (1, 1)), ("a", "court", (0, 1), (1, 1)), ("a", "", (0, 0), (1, 1)), ("b", "", (0, 0), (0, 0))}
    assert [r.item_id for r in fulltext.score(asked, index, [0.0, 1.0], 5).collect()] == ["a"] and fulltext.score(asked, index, [0.0, 0.0], 5).count() == 0
