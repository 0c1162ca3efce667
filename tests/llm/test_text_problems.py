"""The text operators against brute force, round trips and their edge cases."""

import hashlib
import random
import re
import unicodedata

import numpy as np
import pyarrow as pa

from palimpsest.llm import codepoints, eval_leaks, lookalikes, mixture, pieces, scan_noise, shared_spans
from palimpsest.llm.codepoints import Rolling, sliding_min


def test_sliding_min_and_rolling():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 50, 200).astype(np.uint64)
    for w in (1, 2, 7, 64, 100, 200):
        assert (sliding_min(x, w) == [x[i : i + w].min() for i in range(len(x) - w + 1)]).all()
    h = Rolling(np.tile(x[:40], 3))
    assert (h.all(11)[:40] == h.all(11)[40:80]).all()
    assert len(set(h.all(11)[:30].tolist())) == 30


# --- problem 2


def test_pieces_round_trip():
    rng = random.Random(2)
    for _ in range(60):
        parts = ["".join(rng.choice("ab 条") for _ in range(rng.choice([3, 30, 80, 400]))) + rng.choice([". ", "。", "\n", "\n\n", "; ", ".", ""]) for _ in range(rng.randrange(1, 40))]
        text = "".join(parts)
        limit, overlap = 200, 20
        out, longest = pieces.split_text(text, limit, overlap)
        assert "".join(text[b:e] for _, b, e, _ in out) == text
        assert all(e - a <= limit for a, _, e, _ in out)
        assert all(b - a == overlap for a, b, _, _ in out[1:])
        natural = {m.end() for m in re.finditer(r"\n|[。；！？]|[.;!?](?=\s)", text)} - {len(text)}
        assert all((c == 0) == (e not in natural) for _, _, e, c in out[:-1]) and out[-1][3] == 5
        # The cuts that are left inside stretches tell of the oversized stretch.
        assert (longest > limit) == (longest > limit and any(c == 0 for *_, c in out))
        stretches = re.split(r"(?<=[\n。；！？])|(?<=[.;!?])(?=\s)", text)
        assert longest == max(map(len, stretches))
        if longest <= limit - overlap:
            ends = {0, len(text)} | {m.end() for m in re.finditer(r"\n|[。；！？]|[.;!?](?=\s)", text)}
            assert all(e in ends for _, _, e, _ in out)


def test_pieces_prefer_strong_boundaries():
    text = "one one. two two.\n\n" + "three three. four four."
    out, _ = pieces.split_text(text, 28, 4)
    assert [text[b:e] for _, b, e, _ in out] == ["one one. two two.\n\n", "three three. four four."]
    windows = text.replace("\n", "\r\n")
    assert [windows[b:e] for _, b, e, _ in pieces.split_text(windows, 30, 4)[0]] == ["one one. two two.\r\n\r\n", "three three. four four."]
    # A first stretch may fill the whole piece, a later one only what the overlap leaves.
    assert [c for *_, c in pieces.split_text("a" * 29 + "\n" + "b" * 29 + "\n", 30, 5)[0]] == [3, 0, 5]


def test_pieces_spark(spark):
    df = spark.createDataFrame([("a", "x" * 30, 1), ("b", None, 1), ("c", "", 1), ("d", "y" * 10, 1)], "id string, text string, part_index int")
    got = pieces.split_oversized(df, 12, 2).orderBy("part_index").collect()
    assert {r.id for r in got} == {"a"} and [r.part_index for r in got] == [1, 2, 3] and {r.longest for r in got} == {30} and [r.boundary for r in got] == [0, 0, 5]
    assert pieces.split_oversized(df.where("false"), 12, 2).count() == 0


def test_piece_numbers_run_over_parts_of_an_article(spark, tmp_path):
    long = "Sentence one. " * 700
    rows = [("a", "d", 1, None, "Article 1", 1, "short"), ("b", "d", 2, None, "Article  1", 7, long), ("c", "d", 3, None, "Article 1", 1, long), ("e", "d", 9, None, "Article 1", 1, long), ("f", "d", 10, None, None, 1, long), ("g", None, 1, "H", "Article 1", 1, long), ("g", None, 1, "H", "Article 1", 1, long)]
    schema = "segment_id string, document_id string, ordinal int, heading string, article_label string, part_index int, text string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/segments.parquet")
    got = {}
    for r in pieces.labelled_pieces(spark, str(tmp_path)).collect():
        got.setdefault(r.segment_id, []).append(r.part_index)
    assert {k: sorted(v) for k, v in got.items()} == {"b": [2, 3, 4], "c": [5, 6, 7], "e": [1, 2, 3], "f": [1, 2, 3], "g": [1, 1, 2, 2, 3, 3]}


# --- problem 4


def look(text):
    forms = lookalikes.mapping()
    return unicodedata.normalize("NFC", "".join(forms.get(c, c) for c in text))


def test_looks_against_brute_force(spark):
    rng = random.Random(4)
    alphabet = "ab céèü²Ａｂ　 ​﻿аеοﬁ⻅̧̖́ｶﾞ，、\n\t中見1"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 90))) for _ in range(200)]
    texts += ["ｆｕｌｌｗｉｄｔｈ" * 40, "e​́", "é​", "́", "", "plain", "a\x01ｂ", "\x01", "ａ\x01", "\x02ｃ\x01\x01ｃd"]
    rows = [("t", f"{i}", t) for i, t in enumerate(texts)] + [("t", None, "x"), ("t", "n", None)]
    df = spark.createDataFrame(rows, "field string, id string, text string")
    got = {r.id: r.form for r in lookalikes.looks(df.unionByName(df)).collect()}
    assert got == {str(i): look(t) for i, t in enumerate(texts)}


def test_alike_pairs(spark):
    rows = [("t", "1", "Act １"), ("t", "2", "Act 1"), ("t", "3", "Act 1"), ("t", "4", "act 1"), ("t", "5", "Act¹"), ("u", "6", "Act 1")]
    df = spark.createDataFrame(rows, "field string, id string, text string")
    assert {tuple(r) for r in lookalikes.alike_pairs(df).collect()} == {("t", "1", "2"), ("t", "1", "3")}
    assert {tuple(r) for r in lookalikes.alike_classes(df).collect()} == {("t", i, "1", 3, 2) for i in "123"}
    assert lookalikes.alike_classes(df.where("false")).count() == 0


def test_looks_against_truth_made_by_hand(spark):
    alike = [("Сourt", "Court"), ("Οrder", "Order"), ("ｆｅｅ", "fee"), ("cafe\u0301", "café"), ("a\u00a0b", "a b"), ("a\u3000b", "a b"), ("no\u200bte", "note"), ("ﬁle", "file"), ("⾦", "金"), ("Ⅳ", "IV"), ("\u212b", "Å"), ("ﾊﾟ", "パ"), ("օath", "oath"), ("ᎪᏟ", "AC"), ("ꓲꓳ", "IO"), ("Ａ１，", "A1,")]
    other = [("x²", "x2"), ("Act", "act"), ("cafe", "café"), ("H₂O", "H2O"), ("日", "曰"), ("a b", "ab"), ("a\nb", "a b")]
    rows = [("t", f"{i:02d}{x}", text + f" {i}") for i, pair in enumerate(alike + other) for x, text in zip("ab", pair, strict=True)]
    got = {(r.id_a, r.id_b) for r in lookalikes.alike_pairs(spark.createDataFrame(rows, "field string, id string, text string")).collect()}
    assert got == {(f"{i:02d}a", f"{i:02d}b") for i in range(len(alike))}


def test_long_runs_and_hot_looks(spark):
    texts = ["e" + "\u0301" * 40 + "\u0327" * 40, "ａ" * 100 + "\u0301", "\u200b" * 90 + "\u0301x", "\u0301" * 70]
    df = spark.createDataFrame([("t", str(i), x) for i, x in enumerate(texts)], "field string, id string, text string")
    assert {r.id: r.form for r in lookalikes.looks(df).collect()} == {str(i): look(t) for i, t in enumerate(texts)}
    hot = [("t", f"h{i:03d}", "same") for i in range(300)] + [("t", "v", "ｓame")]
    got = lookalikes.alike_pairs(spark.createDataFrame(hot, "field string, id string, text string"))
    assert got.count() == 300 and got.where("id_b <> 'v'").count() == 0


def test_alike_empty(spark):
    df = spark.createDataFrame([], "field string, id string, text string")
    assert lookalikes.alike_pairs(df.where("false")).count() == 0


# --- problem 5


def scan(spark, blocks):
    rows = [(f"b{i}", "d", i, kind, page, None if y is None else f"[72.0,{y},500.0,{y}]", text) for i, (kind, page, y, text) in enumerate(blocks)]
    return spark.createDataFrame(rows, "block_id string, document_id string, ordinal int, kind string, page int, bbox_json string, text string")


def test_scan_noise(spark):
    body = "The panel shall record every decision and the third-party notice of inspection in the ledger of the court."
    native = [("paragraph", None, None, body)] * 12 + [("paragraph", None, None, "证人应当保管检验证书，不得更正。")] * 12
    scanned = [
        ("paragraph", 1, 34.0, "Compendium of decisions    12"),
        ("paragraph", 1, 90.0, "The panel shall record every decision and the third-"),
        ("paragraph", 1, None, "party notice of inspec-"),
        ("paragraph", 1, 150.0, "tion in the ledger. The pancl shall record every"),
        ("table_row", 1, None, "48"),
        ("paragraph", 1, None, "d e c i s i o n and the notice of inspection in the le¬"),
        ("paragraph", 1, None, "- 12 -"),
        ("paragraph", 2, None, "13    Compendium"),
        ("paragraph", 2, 90.0, "dger of the court; the panel shall record every decision"),
        ("paragraph", 2, 120.0, "证入应当保管检验证书，不得更正。"),
        ("paragraph", 2, 800.0, "13"),
        ("paragraph", 2, None, None),
    ]
    df = scan(spark, native + scanned)
    got = {tuple(r) for r in scan_noise.noise(df.unionByName(df)).collect()}
    n = len(native)
    want = {(0, "running_line"), (2, "broken_word"), (3, "misread"), (5, "spaced_out"), (5, "broken_word"), (6, "page_number"), (7, "running_line"), (9, "misread"), (10, "page_number")}
    assert got == {(f"b{n + i}", k) for i, k in want}
    text = " ".join(r.text for r in scan_noise.paragraphs(df).orderBy("page", "paragraph").collect())
    assert "third-party notice of inspection in the ledger. The panel shall record every" in text
    assert "decision and the notice of inspection in the ledger of the court" in text and "证人应当" in text
    assert scan_noise.noise(df.where("false")).count() == 0
    assert scan_noise.paragraphs(df.where("false")).count() == 0


# --- problem 6


def test_leaks_against_brute_force(spark):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(30)] + ["Ünïcode", "№5", "x_y"]
    passages = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([5, 12, 20]))), "en") for i in range(20)]
    passages += [(100 + i, "".join(rng.choice("甲乙丙丁，。 a1") for _ in range(60)), "ZH ") for i in range(10)] + [(200, None, "en"), (201, "x " * 30, None), passages[0]]
    docs = []
    for i in range(60):
        p = rng.choice(passages)[1] or ""
        a = rng.randrange(0, max(1, len(p)))
        docs.append((i, rng.choice(["", "lead, ", "前言"]) + rng.choice([p, p.upper(), p[a:], p[:a], p.replace(" ", " -\n")]) + rng.choice(["", " tail", "。"])))
    docs += [(90, None), (91, "")]
    words = lambda t: re.findall(r"[^\W_]+", t.lower())

    def grams(text, lang):
        w = words(text or "")
        if lang == "en":
            return {" ".join(w[i : i + 12]) for i in range(len(w) - 11)}
        c = "".join(w)
        return {c[i : i + 24] for i in range(len(c) - 23)}

    want = {(d, i) for d, t in docs for i, p, lang in passages if lang and grams(t, lang.strip().lower()) & grams(p, lang.strip().lower())}
    texts = spark.createDataFrame(docs, "id long, text string")
    items = spark.createDataFrame(passages, "item_id long, passage string, lang string")
    for most in (4_000_000, 100):
        assert {(r.id, r.item_id) for r in eval_leaks.leaked_grams(texts, items, most).collect()} == want
    assert eval_leaks.leaked_grams(texts.where("false"), items).count() == 0
    assert eval_leaks.leaked_grams(texts, items.where("false")).count() == 0


# --- problem 7


def test_mixture(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice([" Big-Source", "big source", "BIG_SOURCE"]), "word " * rng.randrange(0, 40)) for i in range(900)]
    rows += [(2000 + i, "small", "tiny text here") for i in range(10)] + [(3000, None, "x"), (3001, "other", "x"), (3002, "small", None)]
    records = spark.createDataFrame(rows, "id long, source string, text string")
    targets = spark.createDataFrame([("m", "big_source", 0.4, 1), ("m", "small", 0.4, 3), ("m", "absent", 0.2, 2)], "mix_name string, source string, target_share double, max_repeats int")
    taken, shares = mixture.mix_records(records, targets)
    s = {r.source: r for r in shares.collect()}
    assert s["absent"].available == s["absent"].mixed == 0 and s["absent"].missing == s["absent"].wanted
    assert s["small"].mixed == 3 * s["small"].available
    assert 0 <= s["big_source"].missing <= 60 and s["big_source"].mixed < s["big_source"].available
    assert abs(sum(r.actual_share for r in s.values()) - 1) < 1e-6
    t = taken.collect()
    assert {r.copies for r in t if r.source == "small"} == {3} and all(r.copies == 1 for r in t if r.source == "big_source")
    assert len({r.id for r in t}) == len(t)
    # A larger budget contains the smaller one's records.
    ids = lambda total: {r.id for r in mixture.mix_records(records, targets, total)[0].collect() if r.source == "big_source"}
    assert ids(4000) <= ids(9000)
    # At the even total no share drifts: sources with records differ from their targets by their last record only.
    even = {r.source: r for r in mixture.mix_records(records, targets, mixture.EVEN)[1].collect()}
    assert even["small"].mixed == even["small"].wanted == 3 * even["small"].available and 0 <= even["big_source"].missing <= 45 and even["absent"].mixed == 0
    assert mixture.mix_records(records.where("false"), targets)[0].count() == 0


# --- problem 8


def test_shared_spans_against_brute_force(spark):
    rng = random.Random(8)
    span = 40
    base = ["".join(rng.choice("abcd条 ") for _ in range(rng.randrange(100, 400))) for _ in range(6)]
    texts = []
    for i in range(40):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            b = rng.choice(base)
            a = rng.randrange(0, len(b))
            parts.append(b[a : a + rng.randrange(20, 160)] if rng.random() < 0.6 else "".join(rng.choice("xyz😀") for _ in range(60)))
        texts.append((i, "".join(parts)))
    texts += [(100, "-" * 500), (101, "-" * 300), (102, "q" * 500), (103, None), (104, ""), (105, base[0] * 2), (106, base[0])]
    where = {}
    for i, t in texts:
        for p in range(len(t or "") - span + 1):
            where.setdefault(t[p : p + span], set()).add(i)
    want = {}
    for i, t in texts:
        covered = {q for p in range(len(t or "") - span + 1) if len(where[t[p : p + span]]) > 1 for q in range(p, p + span)}
        if covered:
            want[i] = len(covered)
    df = spark.createDataFrame([(0, "x", i, 1, t) for i, t in texts], "lo int, r string, id long, h int, text string")
    got = {r.id: r.shared_chars for r in shared_spans.shared_chars(df, span).collect()}
    assert got == want
    assert shared_spans.shared_chars(df.where("false"), span).count() == 0
    spans, by_id = {}, dict(texts)
    for r in shared_spans.shared_spans(df, span).collect():
        spans.setdefault(r.id, set()).update(range(r.begin, r.end))
        assert r.end - r.begin >= span and r.span_class == hashlib.sha256(by_id[r.id][r.begin : r.end].encode()).hexdigest() and r.records >= 1
    assert {i: len(x) for i, x in spans.items()} == want
    assert shared_spans.shared_spans(df.where("false"), span).count() == 0


def test_texts_longer_than_the_position_bits(spark, monkeypatch):
    rng = random.Random(18)
    a = "".join(rng.choice("abc") for _ in range(900))
    texts = [(1, a), (2, "z" * 50 + a[200:800]), (3, "-" * 700), (4, "+" + "-" * 300)]
    df = spark.createDataFrame(texts, "id long, text string")
    run = shared_spans._anchor_batches(40)
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in texts]), pa.array([t for _, t in texts])], names=["id", "text"])
    whole = {(r["id"], p) for b in run([batch]) for r in b.to_pylist() for p in range(r["lo"], r["hi"] + 1)}
    monkeypatch.setattr(shared_spans, "CHUNK_CHARS", 128)
    monkeypatch.setattr(shared_spans, "slices", lambda ids, t: codepoints.slices(ids, t, 1))
    cut = {(r["id"], p) for b in run([batch]) for r in b.to_pylist() for p in range(r["lo"], r["hi"] + 1)}
    assert whole == cut == {(i, p) for i, t in texts for p in range(len(t) - 39)}
    assert df.count() == 4


def test_invisible_characters_of_the_last_plane_go(spark):
    texts = ["法典", "法\U000e0100典\U000e01ef", "\U000e0001法典\U000e0041\U000e007f"]
    df = spark.createDataFrame([("t", str(i), x) for i, x in enumerate(texts)], "field string, id string, text string")
    assert {tuple(r) for r in lookalikes.alike_pairs(df).collect()} >= {("t", "0", "1"), ("t", "0", "2")}


# --- problem 5, continued


def test_scan_goes_on_over_pages_without_text(spark):
    blocks = [
        ("paragraph", 1, 90.0, "The panel shall record every decision and notice of inspec-"), ("paragraph", 1, 800.0, "1"),
        ("paragraph", 2, 800.0, "2"),
        ("paragraph", 5, 90.0, "tion in the ledger of the court and the panel shall go on"), ("paragraph", 5, 800.0, "5"),
    ]
    blocks += [("paragraph", None, None, "the inspection of the ledger")] * 3
    df = scan(spark, blocks)
    assert {tuple(r) for r in scan_noise.noise(df).collect()} == {("b0", "broken_word"), ("b1", "page_number"), ("b2", "page_number"), ("b4", "page_number")}
    text = scan_noise.paragraphs(df).collect()
    assert [(r.page, r.paragraph) for r in text if "ledger" in r.text] == [(5, 0)] and "".join(r.text for r in sorted(text, key=lambda r: r.page)).count("inspection") == 1


def test_long_paragraphs_come_in_parts(spark):
    pages = [("heading", 1, 90.0, "Heading of a long text without end")] + [("paragraph", p, 120.0, f"line of page {p} of the text that goes on and on") for p in range(1, 200, 2)]
    rows = scan_noise.paragraphs(scan(spark, pages)).orderBy("part").collect()
    assert {(r.page, r.paragraph) for r in rows} == {(1, 1)} and [r.part for r in rows] == [0, 1, 2, 3]
    assert " ".join(r.text for r in rows).count("line of page") == 100


def test_repeated_edge_lines_and_large_pages(spark):
    body = "The panel shall record every decision and the notice of the court"
    blocks = []
    for p in range(1, 5):
        blocks += [("paragraph", p, None, "A RATHER LONG HEADING THAT IS NOT SHORTER THAN TEXT 9"), ("paragraph", p, 200.0, body), ("paragraph", p, 300.0, "repeated in the middle of pages, never at an edge"), ("paragraph", p, 400.0, body)]
    got = {tuple(r) for r in scan_noise.noise(scan(spark, blocks)).collect()}
    assert got == {(f"b{i}", "running_line") for i in range(0, 16, 4)}
    # On a page twice as high the margins are twice as wide.
    rows = [("b0", "d", 0, "paragraph", 1, "[72.0,90.0,500.0,110.0]", body), ("b1", "d", 1, "paragraph", 1, "[72.0,200.0,500.0,1684.0]", body), ("b2", "d", 2, "paragraph", 1, "[72.0,1500.0,500.0,1520.0]", body)]
    df = spark.createDataFrame(rows, "block_id string, document_id string, ordinal int, kind string, page int, bbox_json string, text string")
    assert {tuple(r) for r in scan_noise.noise(df).collect()} == {("b0", "running_line")}


def test_confusions_are_learned(spark):
    """Pairs that are on no list are learned from what the corpus shows, and found in words held out from learning."""
    rng = random.Random(15)
    stems = ["harvest", "granary", "vessel", "advance", "cavern", "lavish", "novice", "savour", "travel", "velvet", "vacant", "vendor"]
    words = [(w, 40) for w in stems] + [(w.replace("v", "y", 1), 1) for w in stems[:8]] + [("".join(rng.choice("bdmpt") for _ in range(6)), 2) for _ in range(30)]
    df = spark.createDataFrame(words + [("ad", 90), ("ed", 1)], "word string, n long")
    assert {tuple(r) for r in scan_noise.learned_confusions(df, places=False).collect()} == {("v", "y")}
    han = [("甲应当", 50), ("应当保", 50), ("人应当", 50), ("各应由", 50), ("由应该", 50), ("该由应", 50), ("不由应", 50), ("甲盔当", 1), ("盔当保", 1), ("人盔当", 1), ("盔当然", 1), ("应当然", 9), ("该由盔", 1), ("不由盔", 1), ("会说明", 5), ("会查明", 60)]
    assert {tuple(r) for r in scan_noise.learned_confusions(spark.createDataFrame(han, "word string, n long"), places=True).collect()} == {("应", "盔")}
    body = "We harvest the granary and the vessel, advance to the cavern, lavish for a novice, savour the travel, in velvet, vacant for a vendor."
    noisy = [body.replace(w, w.replace("v", "y", 1)) for w in stems[:8] if "v" in w]
    blocks = [("paragraph", None, None, body)] * 30 + [("paragraph", p, 200.0, t) for p, t in enumerate(noisy, 1)] + [("paragraph", 50, 200.0, body.replace("vendor", "yendor")), ("paragraph", 51, 200.0, body)]
    got = {tuple(r) for r in scan_noise.noise(scan(spark, blocks)).collect()}
    assert got == {(f"b{30 + i}", "misread") for i in range(len(noisy) + 1)}


def test_badly_recognised_blocks_are_believed_at_weaker_evidence(spark):
    rows = [(f"n{i}", "d", i, "paragraph", None, None, "the market inspector", None, None) for i in range(3)]
    rows += [("low", "d", 10, "paragraph", 1, "[72.0,200.0,500.0,210.0]", "the markct inspector", 62.0, None), ("flag", "d", 11, "paragraph", 2, "[72.0,200.0,500.0,210.0]", "the market inspcctor", None, '["ocr_low_confidence"]')]
    rows += [("fine", "d", 12, "paragraph", 3, "[72.0,200.0,500.0,210.0]", "the market inspecfor", 0.95, "[]")]
    df = spark.createDataFrame(rows, "block_id string, document_id string, ordinal int, kind string, page int, bbox_json string, text string, confidence double, risk_flags_json string")
    assert {tuple(r) for r in scan_noise.noise(df).collect()} == {("low", "misread"), ("flag", "misread")}


def test_blocks_delivered_twice_count_once(spark):
    df = spark.createDataFrame([("a", "one two"), ("a", "one two"), ("a", "one two"), ("b", "one"), (None, "two"), (None, "two"), ("c", None)], "block_id string, text string")
    assert {r.word: r.n for r in scan_noise.vocabulary(scan_noise.weighted(df)).collect()} == {"one": 2, "two": 3}
    han = spark.createDataFrame([("a", "甲乙丙"), ("a", "甲乙丙"), ("b", "甲乙丙丁")], "block_id string, text string")
    assert {r.word: r.n for r in scan_noise.han_windows(scan_noise.weighted(han)).collect()} == {"甲乙丙": 2, "乙丙丁": 1}


def test_slices_without_han_script_count_as_the_others(spark):
    """Batches and slices in which no window is left have the same schema as those with windows."""
    texts = ["甲乙丙", "no such script", "甲乙丙", "", "甲\n乙", "丙"]
    batches = [pa.RecordBatch.from_arrays([pa.array([t]), pa.array([1.0])], names=["text", "weight"]) for t in texts]
    out = list(scan_noise._count_windows(iter(batches)))
    assert {b.schema for b in out} == {pa.schema([("word", pa.string()), ("n", pa.float64())])}
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        for order in (texts, texts[1:] + texts[:1], texts[1:2]):
            df = spark.createDataFrame([(t, 1.0) for t in order], "text string, weight double").coalesce(1)
            assert {r.word: r.n for r in scan_noise.han_windows(df).collect()} == ({"甲乙丙": order.count("甲乙丙")} if "甲乙丙" in order else {})
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
