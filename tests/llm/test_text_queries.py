"""The text queries against their SQL on the smallest tables."""

import os
import re

import pytest

from palimpsest.llm.registry import QUERIES, SQL
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


# SQL has no tokenizer, no heap and no such corrections; these queries are held to what must be true of their results.


def test_queries_without_sql_are_known():
    assert set(QUERIES) - set(SQL) == {"p2_pieces", "p5_found", "p5_paragraphs", "p7_mix", "p7_shares", "p7_even"}


def test_pieces_make_up_their_texts(spark, con):
    rows = QUERIES["p2_pieces"](spark, BASE).collect()
    texts = dict(con.execute("SELECT segment_id, text FROM segments WHERE length(text) > 4500").fetchall())
    by_id = {}
    for r in rows:
        assert len(r.text) <= 4500 and r.text == texts[r.segment_id][r.begin : r.end] and r.body - r.begin == (200 if r.begin else 0)
        by_id.setdefault(r.segment_id, []).append(r)
    assert set(by_id) == set(texts)
    for i, parts in by_id.items():
        parts.sort(key=lambda r: r.part_index)
        assert "".join(texts[i][r.body : r.end] for r in parts) == texts[i]
        assert [r.part_index for r in parts] == list(range(parts[0].part_index, parts[0].part_index + len(parts)))


def test_noise_of_scanned_blocks_only(spark, con):
    rows = {tuple(r) for r in QUERIES["p5_found"](spark, BASE).collect()}
    scanned = {r[0] for r in con.execute("SELECT block_id FROM document_blocks WHERE page IS NOT NULL AND text IS NOT NULL").fetchall()}
    kinds = {k: {b for b, n in rows if n == k} for k in ("running_line", "page_number", "broken_word", "misread", "spaced_out")}
    assert rows and {b for b, _ in rows} <= scanned and sum(map(len, kinds.values())) == len(rows)
    furniture = kinds["running_line"] | kinds["page_number"]
    assert len(furniture) == len(kinds["running_line"]) + len(kinds["page_number"]) and not furniture & (kinds["broken_word"] | kinds["misread"] | kinds["spaced_out"])


def test_paragraphs_hold_the_text_without_furniture(spark, con):
    noise = {(r.block_id, r.noise) for r in QUERIES["p5_found"](spark, BASE).collect()}
    out = {}
    for r in QUERIES["p5_paragraphs"](spark, BASE).collect():
        out.setdefault(r.document_id, []).append(r.text)
    plain = lambda t: re.sub(r"[\W_]+", "", t)
    clean = con.execute("SELECT DISTINCT document_id, block_id, text FROM document_blocks WHERE page IS NOT NULL AND text IS NOT NULL AND document_id IS NOT NULL").fetchall()
    for document, block, text in clean:
        if not any((block, k) in noise for k in ("running_line", "page_number", "broken_word", "misread", "spaced_out")):
            assert plain(text) in plain("".join(out[document])), block
    assert len(out) == len({d for d, _, _ in clean})


def test_mixes_add_up(spark, con):
    shares = {(r.mix_name, r.source): r for r in QUERIES["p7_shares"](spark, BASE).collect()}
    mixed = QUERIES["p7_mix"](spark, BASE).collect()
    targets = {(m, s): (t, k) for m, s, t, k in con.execute("SELECT * FROM mix_targets").fetchall()}
    assert set(shares) == set(targets) and len({(r.mix_name, r.doc_id) for r in mixed}) == len(mixed)
    largest = max(r.tokens for r in mixed)
    for key, (target, repeats) in targets.items():
        rows = [r for r in mixed if (r.mix_name, r.source) == key]
        s = shares[key]
        assert all(1 <= r.copies <= repeats for r in rows) and max([r.copies for r in rows], default=0) - min([r.copies for r in rows], default=0) <= 1
        assert s.mixed == sum(r.tokens * r.copies for r in rows) and s.target_share == target and s.missing == s.wanted - s.mixed
        # Short of its share by less than one record, or by what it doesn't have.
        assert 0 <= s.missing <= largest or s.mixed == repeats * s.available
    for mix in {m for m, _ in targets}:
        assert abs(sum(s.actual_share or 0 for (m, _), s in shares.items() if m == mix) - 1) < 1e-6


def test_even_mixes_hold_their_shares(spark, con):
    rows = QUERIES["p7_even"](spark, BASE).collect()
    for r in rows:
        assert r.mixed <= r.max_repeats * r.available and (not r.available or 0 <= r.missing <= 20_000)
