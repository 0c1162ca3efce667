"""Every core query against its SQL on the smallest tables, and the shape of the registry."""

import os
import subprocess
import sys

import pytest

from palimpsest.plans.registry import QUERIES, SQL
from tests.compare import connect, spark_rows, sql_rows

BASE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(BASE):
        pytest.skip("no test tables")
    return connect(BASE)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    assert spark_rows(QUERIES[name](spark, BASE)) == sql_rows(con, SQL[name])


def test_core_does_not_need_the_text_operators():
    code = "import sys; sys.modules['palimpsest.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(n.startswith(('p2', 'p8')) for n in e.queries())"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_every_core_query_has_sql():
    assert set(SQL) == set(QUERIES)


def test_errors_inside_the_text_operators_are_raised(tmp_path):
    """Only a missing subpackage is left out; a broken module in it is no reason to go on without its queries."""
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/palimpsest", tmp_path / "palimpsest", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()))"
    run = lambda: subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert run().returncode == 0
    (tmp_path / "palimpsest/llm").mkdir()
    (tmp_path / "palimpsest/llm/__init__.py").write_text("")
    (tmp_path / "palimpsest/llm/registry.py").write_text("import no_such_module\n")
    assert "no_such_module" in run().stderr


def test_weighted_confidence_takes_every_scale(spark, tmp_path):
    rows = [("mixed", 1, 0.5, "ab"), ("mixed", 1, 90.0, "ab"), ("percent", 1, 80.0, "a"), ("percent", 2, 100.0, "a"), ("edge", 1, 1.0, "a"), ("none", 1, None, "a"), ("none", 1, 101.0, "a"), ("none", 1, -0.5, "a"), ("none", 1, float("nan"), "a"), ("text", None, 0.9, "a")]
    spark.createDataFrame(rows, "document_id string, page int, confidence double, text string").write.parquet(f"{tmp_path}/document_blocks.parquet")
    got = {r.document_id: (r.blocks, r.confidence) for r in QUERIES["weighted_confidence"](spark, str(tmp_path)).collect()}
    assert got == {"mixed": (2, 0.7), "percent": (2, 0.9), "edge": (1, 1.0), "none": (4, None)}


def test_dense_group_diversity_looks_beyond_one_full_label(spark, tmp_path):
    near = [(i, [1.0, i / 1000], "full") for i in range(1, 100)]
    far = [(200 + i, [1.0, 2.0 + i // 2], None if i == 9 else f"label{i // 2}") for i in range(10)]
    spark.createDataFrame([(0, [1.0, 0.0], "full"), *near, *far], "vec_id long, embedding array<double>, label string").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [(r.rank, r.item_id, r.label) for r in QUERIES["dense_group_diversity"](spark, str(tmp_path)).where("query_id = 0").orderBy("rank").collect()]
    assert got == [(1, 1, "full"), (2, 200, "label0"), (3, 202, "label1"), (4, 204, "label2"), (5, 206, "label3")]


def test_document_representatives_look_beyond_one_full_document(spark, tmp_path):
    spark.createDataFrame([("q", "apple pear")], "item_id string, question string").write.parquet(f"{tmp_path}/eval_items.parquet")
    rows = [(f"full{i:02}", "full", "apple pear") for i in range(30)] + [("b", "other", "apple plum"), ("c", "third", "apple plum fig"), ("d", "fourth", "apple plum fig kiwi"), ("e", "fifth", "plum")]
    items = spark.createDataFrame([(*r, None, None) for r in rows], "segment_id string, document_id string, text string, heading string, article_label string")
    items.write.parquet(f"{tmp_path}/segments.parquet")
    got = [(r.rank, r.item_id, r.document_id) for r in QUERIES["document_representatives"](spark, str(tmp_path)).orderBy("rank").collect()]
    assert got == [(1, "full00", "full"), (2, "b", "other"), (3, "c", "third")]


def test_contradictions_have_no_least_length(spark, tmp_path):
    spark.createDataFrame([("不得超过。超过。不得。共同申请人不得延期；共同申请人延期",), ("may not. go",)], "text string").write.parquet(f"{tmp_path}/segments.parquet")
    got = {tuple(r) for r in QUERIES["contradictions"](spark, str(tmp_path)).select("bare", "negated", "plain").collect()}
    assert got == {("超过", 1, 1), ("共同申请人延期", 1, 1)}


def test_source_diff_sees_every_part(spark, tmp_path):
    docs = [("old", "k", "2000-01-01"), ("new", "k", "2001-01-01")]
    from datetime import datetime

    spark.createDataFrame([(*d, datetime(2020, 1, 1)) for d in docs], "document_id string, source_key string, effective_from string, recorded_at timestamp_ntz").write.parquet(f"{tmp_path}/source_documents.parquet")
    parts = {"same": ("ab", "baa"), "changed": ("ab", "ac"), "gained": ("a", "ab"), "lost": ("ab", "a"), "gone": ("a", ""), "fresh": ("", "a")}
    rows = [(d, label, h) for label, both in parts.items() for d, hashes in zip(("old", "new"), both, strict=True) for h in hashes]
    spark.createDataFrame(rows, "document_id string, article_label string, text_sha256 string").write.parquet(f"{tmp_path}/segments.parquet")
    got = {r.article_label: r.change for r in QUERIES["source_diff"](spark, str(tmp_path)).collect()}
    assert got == {"same": "unchanged", "changed": "changed", "gained": "changed", "lost": "changed", "gone": "removed", "fresh": "added"}
