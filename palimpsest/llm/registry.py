"""Registered queries of the text operators and their SQL."""

from __future__ import annotations

import unicodedata

from palimpsest.llm import eval_leaks, lookalikes, mixture, pieces, scan_noise, shared_spans

QUERIES = {
    "p2_found": pieces.found,
    "p2_pieces": pieces.labelled_pieces,
    "p4_found": lookalikes.found,
    "p4_classes": lookalikes.classes,
    "p4_forms": lookalikes.forms,
    "p5_found": scan_noise.found,
    "p5_paragraphs": scan_noise.repaired,
    "p6_found": eval_leaks.found,
    "p6_items": eval_leaks.leaked_items,
    "p6_clean": eval_leaks.clean_documents,
    "p7_mix": mixture.mix,
    "p7_shares": mixture.shares,
    "p7_even": mixture.even_shares,
    "p8_found": shared_spans.found,
    "p8_spans": shared_spans.spans,
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _look_sql(column: str) -> str:
    """The consistent form: one character for one by translate, several by replace, then composed."""
    forms = lookalikes.mapping()
    single = {a: b for a, b in forms.items() if len(b) == 1}
    dropped = [a for a, b in forms.items() if not b]
    several = {a: b for a, b in forms.items() if len(b) > 1 and unicodedata.normalize("NFC", b) != unicodedata.normalize("NFC", a)}
    out = f"translate({column}, {_quoted(''.join(single) + ''.join(dropped))}, {_quoted(''.join(single.values()))})"
    for a, b in several.items():
        out = f"replace({out}, {_quoted(a)}, {_quoted(b)})"
    return f"nfc_normalize({out})"


_VALUES = " UNION ALL ".join(f"SELECT '{f}' AS field_name, document_id AS id, {f} AS text FROM source_documents WHERE {f} IS NOT NULL" for f in ("title", "normalized_title", "normalized_names"))
_GRAMS = """
  g_words AS (SELECT id, lang, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM t),
  grams AS (SELECT DISTINCT id, lang, 'en' AS kind, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS gram FROM g_words
    UNION SELECT DISTINCT id, lang, 'zh', unnest(list_transform(range(1, length(array_to_string(w, '')) - 22), lambda i: substr(array_to_string(w, ''), i, 24))) FROM g_words)"""

_LOOKS = f"v AS MATERIALIZED (SELECT DISTINCT field_name, id, text, {_look_sql('text')} AS look FROM ({_VALUES} UNION ALL SELECT 'segment_text', segment_id, text FROM segments WHERE text IS NOT NULL))"
_LEAKS = f"""docs AS MATERIALIZED (WITH t AS (SELECT doc_id AS id, '' AS lang, text FROM documents WHERE text IS NOT NULL), {_GRAMS} SELECT * FROM grams),
      items AS MATERIALIZED (WITH t AS (SELECT item_id AS id, lower(trim(lang)) AS lang, passage AS text FROM eval_items), {_GRAMS} SELECT * FROM grams WHERE lang = kind),
      hits AS (SELECT docs.id AS doc_id, items.id AS item_id, items.gram FROM docs JOIN items ON docs.kind = items.kind AND docs.gram = items.gram)"""
_SHARED = """w AS (SELECT doc_id, i, md5_number(substr(text, i, 300)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM documents WHERE length(text) >= 300)),
      s AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)),
      k AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM w WHERE h IN (SELECT h FROM s))"""

SQL: dict[str, str] = {
    "p2_found": r"""WITH s AS (SELECT segment_id, string_split(regexp_replace(regexp_replace(text, '([\n。；！？])', '\1' || chr(1), 'g'), '([.;!?])(\s|\p{Z})', '\1' || chr(1) || '\2', 'g'), chr(1)) AS parts FROM segments WHERE length(text) > 4500)
      SELECT segment_id, CAST(max(CASE WHEN list_max(list_transform(parts, lambda p: length(p))) > 4500 THEN 1 ELSE 0 END) AS INT) AS hard_cut FROM s GROUP BY segment_id""",
    "p4_found": f"""WITH {_LOOKS} SELECT DISTINCT a.field_name, a.id AS id_a, b.id AS id_b FROM v a JOIN v b ON a.field_name = b.field_name AND a.look = b.look AND a.id < b.id AND a.text <> b.text""",
    "p4_classes": f"""WITH {_LOOKS}, c AS (SELECT field_name, look, min(id) AS class_id, count(DISTINCT id) AS records, count(DISTINCT text) AS spellings FROM v GROUP BY ALL HAVING count(DISTINCT text) > 1)
      SELECT DISTINCT field_name, id, class_id, records, spellings FROM v JOIN c USING (field_name, look)""",
    "p4_forms": f"WITH {_LOOKS} SELECT DISTINCT field_name, id, look AS form FROM v WHERE id IS NOT NULL",
    "p6_found": f"WITH {_LEAKS} SELECT DISTINCT doc_id, item_id FROM hits",
    "p6_items": f"""WITH {_LEAKS}, n AS (SELECT id, count(DISTINCT gram) AS grams FROM items GROUP BY id)
      SELECT item_id, count(DISTINCT doc_id) AS documents, round(count(DISTINCT gram) / max(grams), 6) AS share_found FROM hits JOIN n ON n.id = item_id GROUP BY item_id""",
    "p6_clean": f"WITH {_LEAKS} SELECT doc_id, CAST(length(text) AS INT) AS n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hits)",
    "p8_found": f"""WITH {_SHARED}
      SELECT doc_id, CAST(sum(CASE WHEN before IS NULL THEN 300 ELSE least(300, i - before) END) AS INT) AS shared_chars FROM k GROUP BY doc_id""",
    "p8_spans": f"""WITH {_SHARED}, n AS (SELECT *, sum(CASE WHEN before IS NULL OR i > before + 300 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM k),
      r AS (SELECT doc_id, CAST(min(i) - 1 AS INT) AS "begin", CAST(max(i) + 299 AS INT) AS "end" FROM n GROUP BY doc_id, run),
      c AS (SELECT r.*, sha256(substr(text, "begin" + 1, "end" - "begin")) AS span_class FROM r JOIN documents USING (doc_id))
      SELECT c.*, records FROM c JOIN (SELECT span_class, count(DISTINCT doc_id) AS records FROM c GROUP BY span_class) USING (span_class)""",
}
