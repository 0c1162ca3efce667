"""Core queries of retrieval, reranking, relations, links and listings, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.functions import text as T
from palimpsest.functions.dates import end_day, parse_date, start_day
from palimpsest.operators import evaluation, fulltext, fusion, graph, relations, rerank, segment, temporal
from palimpsest.plans import queries as base_queries
from palimpsest.plans.queries import (
    _ALIASES, _HELD, _QUESTIONS, _SEGMENT_WEIGHTS, MOMENT, _alias_rows, _bm25_sql, _candidates, _date_sql, _edges, _end_sql, _questions, _segment_index, _start_sql, _terms_sql, _titles, _unique_segments,
)
from palimpsest.plans.session import cut, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
_H = base_queries._HAN


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


# --- terms and reranking --------------------------------------------------------------------------------------------


def _grams_sql(low: str, letters: str, n: int) -> str:
    runs = f"list_filter(regexp_extract_all({low}, '[{letters}]+'), lambda r: length(r) >= {n})"
    return f"flatten(list_transform({runs}, lambda r: list_transform(range(1, length(r) - {n - 2}), lambda i: substr(r, i, {n}))))"


def _expanded_sql(c: str) -> str:
    """Terms of functions.text.expanded_terms."""
    text, low = f"coalesce({c}, '')", f"lower(coalesce({c}, ''))"
    tokens = f"regexp_extract_all({text}, '[A-Za-z0-9]+(?:[-_.][A-Za-z0-9]+)*')"
    camel = r"regexp_replace(regexp_replace(regexp_replace(t, '[-_.]+', ' ', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')"
    parts = f"flatten(list_transform({tokens}, lambda t: string_split(lower({camel}), ' ')))"
    stem = "CASE WHEN regexp_matches(p, '^.{2,}ies$') THEN regexp_replace(p, 'ies$', 'y') WHEN regexp_matches(p, '^.{3,}ing$') THEN regexp_replace(p, 'ing$', '') WHEN regexp_matches(p, '^.{3,}(ed|es)$') THEN regexp_replace(p, '(ed|es)$', '') WHEN regexp_matches(p, '^.{3,}[^s]s$') THEN regexp_replace(p, 's$', '') ELSE p END"
    every = [f"list_transform({tokens}, lambda t: lower(t))", parts, f"list_transform({parts}, lambda p: {stem})", _grams_sql(low, _H, 2), _grams_sql(low, _H, 3), f"list_filter(regexp_extract_all({low}, '[{_H}]+'), lambda r: length(r) <= 12)"]
    return f"list_distinct(list_filter({' || '.join(every)}, lambda x: length(x) >= 2))"


@query(f"WITH {_bm25_sql(_QUESTIONS, 'segments', 'segment_id', _SEGMENT_WEIGHTS, 5, _expanded_sql)} SELECT query_id, item_id, score, CAST(rank AS INT) AS rank FROM ranked")
def expanded_topk(spark, base):
    """The 5 best segments of each question by expanded terms: parts of compound words, stems, triples and runs of Han characters."""
    asked = fulltext.asked_terms(_questions(spark, base), make=T.expanded_terms)
    index = fulltext.postings(asked, _unique_segments(spark, base), "segment_id", list(_SEGMENT_WEIGHTS), make=T.expanded_terms)
    return fulltext.score(asked, index, list(_SEGMENT_WEIGHTS.values()), 5)


@query(f"WITH {_HELD} SELECT DISTINCT document_id, unnest(list_transform(regexp_extract_all(title, '[A-Z][A-Za-z0-9]*(?: [A-Z][A-Za-z0-9]*)+|[A-Z]{{2,}}[A-Z0-9]*'), lambda x: lower(x))) AS anchor FROM held")
def target_anchors(spark, base):
    """Names in the titles of documents, by their capitals."""
    return _titles(spark, base).select("document_id", F.explode(T.target_anchors(F.col("title"))).alias("anchor"))


def _vectors_sql(name: str, source: str) -> str:
    """Hashed feature vectors of operators.rerank as tables name_v (id, bucket, v) and name_n (id, norm)."""
    words, triples, pairs = "regexp_extract_all(lower(text), '[a-z0-9]+')", _grams_sql("lower(text)", "a-z0-9", 3), _grams_sql("lower(text)", _H, 2)
    rows = " UNION ALL ".join(f"SELECT id, '{p}:' || unnest({x}) AS f, {c} AS c FROM {name}_t" for p, c, x in (("w", 3, words), ("c", 1, triples), ("z", 2, pairs)))
    number = lambda at, n: f"CAST('0x' || substr(md5(f), {at}, {n}) AS BIGINT)"
    return f"""{name}_t AS (SELECT * FROM ({source}) WHERE text IS NOT NULL), {name}_f AS (SELECT id, f, sum(c) AS c FROM ({rows}) GROUP BY ALL),
      {name}_v AS MATERIALIZED (SELECT id, CAST({number(1, 6)} % 512 AS INT) AS bucket, round(sum(CASE WHEN {number(7, 1)} % 2 = 1 THEN 1.0 ELSE -1.0 END * (1 + ln(1 + c))), 9) AS v FROM {name}_f GROUP BY ALL HAVING v <> 0),
      {name}_n AS (SELECT id, sqrt(sum(v * v)) AS norm FROM {name}_v GROUP BY id)"""


@query(
    f"""WITH {base_queries._CANDIDATES}, {_vectors_sql('a', 'SELECT query_id AS id, text FROM q')}, {_vectors_sql('b', 'SELECT segment_id AS id, text FROM segments WHERE segment_id IN (SELECT item_id FROM cand)')},
      near AS (SELECT c.query_id, c.item_id, sum(a_v.v * b_v.v) / max(a_n.norm) / max(b_n.norm) AS cosine FROM cand c JOIN a_v ON a_v.id = c.query_id JOIN b_v ON b_v.id = c.item_id AND b_v.bucket = a_v.bucket JOIN a_n ON a_n.id = c.query_id JOIN b_n ON b_n.id = c.item_id GROUP BY ALL),
      cover AS (SELECT c.query_id, c.item_id, len(list_intersect(list_distinct({_terms_sql('q.text')}), c.t)) / greatest(1, len(list_distinct({_terms_sql('q.text')}))) AS coverage FROM cand c JOIN q USING (query_id)),
      r AS (SELECT query_id, item_id, round(coverage, 6) AS coverage, round(coalesce(cosine, 0), 6) AS cosine, round(0.55 * coverage + 0.35 * coalesce(cosine, 0), 6) AS score FROM cover LEFT JOIN near USING (query_id, item_id)),
      s AS (SELECT query_id, item_id, coverage, CASE WHEN cosine = 0 THEN CAST(0 AS DOUBLE) ELSE cosine END AS cosine, CASE WHEN score = 0 THEN CAST(0 AS DOUBLE) ELSE score END AS score FROM r)
      SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INT) AS rank FROM s"""
)
def reranked_candidates(spark, base):
    """The 20 best segments of each question ranked anew by the share of its terms they have and the cosine of feature vectors."""
    asked = _questions(spark, base)
    found = cut(fulltext.bm25(asked, _unique_segments(spark, base), "segment_id", _SEGMENT_WEIGHTS, 20)).withColumn("utility", F.lit(None).cast("double"))
    return rerank.rerank(asked, found, table(spark, base, "segments").select(F.col("segment_id").alias("item_id"), "text"))


@query(
    f"""WITH {_vectors_sql('a', 'SELECT segment_id AS id, text FROM segments')}, q AS (SELECT id, CAST(round(round(v / norm * 127, 6)) AS INT) AS q FROM a_v JOIN a_n USING (id))
      SELECT id AS segment_id, count(*) AS buckets, CAST(sum(abs(q)) AS BIGINT) AS weight, max(q) AS greatest, min(q) AS least FROM q WHERE q <> 0 GROUP BY id"""
)
def feature_index(spark, base):
    """The index of hashed feature vectors of all segments in small whole numbers, summed up by segment."""
    index = rerank.quantized(rerank.feature_vectors(table(spark, base, "segments").select(F.col("segment_id").alias("id"), "text")))
    return index.groupBy(F.col("id").alias("segment_id")).agg(F.count("*").alias("buckets"), F.sum(F.abs("q").cast("long")).alias("weight"), F.max("q").alias("greatest"), F.min("q").alias("least"))


# --- composed retrieval ---------------------------------------------------------------------------------------------

_BOTH = f"""{_bm25_sql(_QUESTIONS, 'segments', 'segment_id', _SEGMENT_WEIGHTS, 20)},
      ranked_titles AS (WITH {_bm25_sql(_QUESTIONS, '(SELECT segment_id, heading, article_label FROM segments)', 'segment_id', {'heading': 1.0, 'article_label': 1.0}, 20)} SELECT * FROM ranked),
      both_ AS (SELECT query_id, item_id, 'body' AS channel, 1.5 AS w, rank FROM ranked UNION ALL SELECT query_id, item_id, 'label', 1.0, rank FROM ranked_titles)"""
_ROOM = "len(w.ids) < 5 AND w.used + b.size <= 3000"


def _both(spark, base):
    asked, index = _segment_index(spark, base)
    body = fulltext.score(asked, index, list(_SEGMENT_WEIGHTS.values()), 20).withColumn("channel", F.lit("body"))
    return cut(body.unionByName(fulltext.score(asked, index, [1.0, 1.0, 0.0], 20).withColumn("channel", F.lit("label"))))


@query(
    f"""WITH RECURSIVE {_HELD}, {_BOTH},
      it AS (SELECT segment_id AS item_id, s.document_id AS grp, {_start_sql('h.effective_from')} AS s, {_end_sql('h.effective_to')} AS e, coalesce(length(text), 0) AS size FROM segments s LEFT JOIN held h ON h.document_id = s.document_id),
      day AS (SELECT item_id AS query_id, {_date_sql('as_of')} AS day FROM eval_items),
      fused AS (SELECT query_id, item_id, any_value(grp) AS grp, any_value(size) AS size, round(sum(w / (60 + rank)), 9) AS score FROM both_ JOIN it USING (item_id) JOIN day USING (query_id) WHERE day IS NULL OR ((s IS NULL OR s <= day) AND (e IS NULL OR e > day)) GROUP BY query_id, item_id),
      one AS (SELECT * FROM fused QUALIFY row_number() OVER (PARTITION BY query_id, grp ORDER BY score DESC, item_id) = 1),
      best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS place FROM one QUALIFY place <= 8),
      w AS (SELECT DISTINCT query_id, 0 AS step, CAST([] AS VARCHAR[]) AS ids, CAST(0 AS BIGINT) AS used FROM best
        UNION ALL SELECT w.query_id, b.place, CASE WHEN {_ROOM} THEN list_append(w.ids, b.item_id) ELSE w.ids END, CASE WHEN {_ROOM} THEN w.used + b.size ELSE w.used END FROM w JOIN best b ON b.query_id = w.query_id AND b.place = w.step + 1),
      chosen AS (SELECT query_id, unnest(ids) AS item_id, generate_subscripts(ids, 1) AS place FROM (SELECT query_id, arg_max(ids, step) AS ids FROM w GROUP BY query_id))
      SELECT c.query_id, c.item_id, b.grp AS document_id, b.score, CAST(c.place AS INT) AS place FROM chosen c JOIN best b ON b.query_id = c.query_id AND b.item_id = c.item_id"""
)
def composed_retrieval(spark, base):
    """Answers to each question as of its day: two channels, valid versions only, fused, one segment a document, within 5 items and 3,000 characters."""
    held = temporal.latest_per_key(table(spark, base, "source_documents").select("document_id", "recorded_at", "effective_from", "effective_to"), ["document_id"], ["recorded_at"])
    valid = held.select("document_id", start_day(F.col("effective_from")).alias("s"), end_day(F.col("effective_to")).alias("e"))
    items = table(spark, base, "segments").select(F.col("segment_id").alias("item_id"), "document_id", F.length("text").alias("size")).join(valid, "document_id", "left").withColumnRenamed("document_id", "group")
    days = table(spark, base, "eval_items").select(F.col("item_id").alias("query_id"), F.unix_date(parse_date(F.col("as_of"))).alias("day"))
    return fusion.retrieve(_both(spark, base), items, days, {"body": 1.5, "label": 1.0}, 8, 5, 3000).withColumnRenamed("group", "document_id")


def _greedy_sql(steps: int) -> str:
    """Greedy choice, each step spelled out: score with a bonus for new documents and a penalty for repeated ones."""
    again = "len(list_filter(p.groups, lambda g: g = c.grp))"
    goal = f"round(c.score + CASE WHEN c.grp IS NULL THEN 0 WHEN {again} = 0 THEN 0.002 ELSE -least(0.004, 0.001 * {again}) END, 9)"
    parts = ["s0 AS (SELECT DISTINCT query_id, CAST([] AS VARCHAR[]) AS ids, CAST([] AS VARCHAR[]) AS groups FROM c)"]
    for i in range(1, steps + 1):
        pick = f"SELECT p.query_id, p.ids, p.groups, c.item_id, c.grp FROM s{i - 1} p JOIN c ON c.query_id = p.query_id WHERE NOT list_contains(p.ids, c.item_id) QUALIFY row_number() OVER (PARTITION BY p.query_id ORDER BY {goal} DESC, c.item_id) = 1"
        parts.append(f"s{i} AS MATERIALIZED (SELECT query_id, list_append(ids, item_id) AS ids, list_append(groups, grp) AS groups, item_id, CAST({i} AS INT) AS place FROM ({pick}))")
    return f"""WITH {_BOTH}, c AS (SELECT query_id, b.item_id, any_value(s.document_id) AS grp, round(sum(w / (60 + rank)), 9) AS score FROM both_ b JOIN segments s ON s.segment_id = b.item_id GROUP BY query_id, b.item_id), {', '.join(parts)}
      {' UNION ALL '.join(f'SELECT query_id, item_id, place FROM s{i}' for i in range(1, steps + 1))}"""


@query(_greedy_sql(5))
def diverse_pick(spark, base):
    """5 segments for each question from both channels, documents that were not taken yet before others of nearly the same score."""
    fused = fusion.reciprocal_rank(_both(spark, base), {"body": 1.5, "label": 1.0})
    groups = table(spark, base, "segments").select(F.col("segment_id").alias("item_id"), F.col("document_id").alias("group"))
    return fusion.diverse_greedy(fused.join(groups, "item_id").select("query_id", "item_id", "group", "score"), 5)


@query(
    f"""WITH {_bm25_sql(_QUESTIONS, 'segments', 'segment_id', _SEGMENT_WEIGHTS, 6)}, x AS (SELECT query_id, item_id, round(score / sum(score) OVER (PARTITION BY query_id) * 2000, 6) AS exact FROM ranked WHERE score > 0),
      f AS (SELECT *, CAST(floor(exact) AS BIGINT) AS whole FROM x), r AS (SELECT *, 2000 - sum(whole) OVER (PARTITION BY query_id) AS room, row_number() OVER (PARTITION BY query_id ORDER BY round(exact - whole, 6) DESC, item_id) AS place FROM f)
      SELECT query_id, item_id, CAST(whole + CASE WHEN place <= room THEN 1 ELSE 0 END AS BIGINT) AS tokens FROM r"""
)
def budget_partition(spark, base):
    """How 2,000 tokens are split over the 6 best segments of each question, in proportion to their scores."""
    return fusion.partition_budget(fulltext.bm25(_questions(spark, base), _unique_segments(spark, base), "segment_id", _SEGMENT_WEIGHTS, 6), 2000)


_GRID = {"title": {"title": 1.0, "names": 0.0}, "even": {"title": 1.0, "names": 1.0}, "title_first": {"title": 2.0, "names": 1.0}, "names_first": {"title": 1.0, "names": 2.0}}
_GRID_SQL = ", ".join(f"('{p}', '{c}', {w})" for p, ws in _GRID.items() for c, w in ws.items())
_ASKED = "SELECT DISTINCT alias AS query_id, alias AS text FROM aliases"


@query(
    f"""WITH {_HELD}, aliases AS ({_ALIASES}), {_bm25_sql(_ASKED, 'held', 'document_id', {'title': 1.0}, 10)},
      ranked_names AS (WITH {_bm25_sql(_ASKED, 'held', 'document_id', {'normalized_names': 1.0}, 10)} SELECT * FROM ranked),
      ch AS (SELECT query_id, item_id, 'title' AS channel, rank FROM ranked UNION ALL SELECT query_id, item_id, 'names', rank FROM ranked_names), grid(profile, channel, w) AS (VALUES {_GRID_SQL}),
      fused AS (SELECT profile, query_id, item_id, round(sum(w / (60 + rank)), 9) AS score FROM ch JOIN grid USING (channel) GROUP BY ALL),
      placed AS (SELECT *, row_number() OVER (PARTITION BY profile, query_id ORDER BY score DESC, item_id) AS rank FROM fused),
      expected AS (SELECT DISTINCT alias AS query_id, document_id AS item_id FROM aliases),
      first AS (SELECT profile, query_id, min(rank) AS first FROM placed JOIN expected USING (query_id, item_id) GROUP BY ALL),
      out AS (SELECT p.profile, count(*) AS queries, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr FROM (SELECT DISTINCT profile FROM grid) p CROSS JOIN (SELECT DISTINCT query_id FROM expected) e LEFT JOIN first f ON f.profile = p.profile AND f.query_id = e.query_id GROUP BY p.profile)
      SELECT *, CAST(row_number() OVER (ORDER BY mrr DESC, profile) AS INT) AS place FROM out"""
)
def weight_profile(spark, base):
    """Which weights of the title and the names channel find the documents of the aliases best."""
    aliases = cut(_alias_rows(spark, base))
    asked = fulltext.asked_terms(aliases.select(F.col("alias").alias("query_id"), F.col("alias").alias("text")).distinct())
    index = fulltext.postings(asked, _titles(spark, base).select("document_id", "title", "normalized_names"), "document_id", ["title", "normalized_names"])
    channels = fulltext.score(asked, index, [1.0, 0.0], 10).withColumn("channel", F.lit("title")).unionByName(fulltext.score(asked, index, [0.0, 1.0], 10).withColumn("channel", F.lit("names")))
    return evaluation.weight_profile(channels, aliases.select(F.col("alias").alias("query_id"), F.col("document_id").alias("item_id")), _GRID)


# --- relations ------------------------------------------------------------------------------------------------------

# Words that tell a relation, and what negates them.
_MARKERS = {"amends": ["修改", "修正", "amends"], "exception_to": ["除外", "不适用", "except"], "repeals": ["废止", "停止执行", "repeals"], "replaces": ["代替", "替代", "replaces", "supersedes"]}
_NEGATIONS = "不|未|尚未|不得|not |never "


def _marker_sql() -> str:
    each = " || ".join(
        f"list_transform(list_filter(range(1, greatest(1, length(around) - {len(word) - 2})), lambda i: substr(around, i, {len(word)}) = '{word}' AND NOT regexp_matches(substr(around, 1, i - 1), '(?:{_NEGATIONS})$')), lambda i: {{'d': CAST(abs(i + {len(word) // 2} - middle) AS INT), 'label': '{label}'}})"
        for label, words in _MARKERS.items() for word in words
    )
    return f"list_min({each}).label"


@query(
    f"""WITH {_HELD}, names AS (SELECT document_id AS name_id, title AS name FROM held WHERE length(title) > 0),
      m AS (SELECT s.document_id AS subject_document_id, n.name_id AS object_document_id, s.segment_id, s.text, n.name, instr(s.text, n.name) AS pos FROM segments s JOIN names n ON contains(s.text, n.name) AND s.document_id <> n.name_id AND regexp_matches(' ' || s.text || ' ', CASE WHEN regexp_matches(n.name, '[A-Za-z0-9]$') THEN '[^A-Za-z0-9]' || regexp_escape(n.name) || '[^A-Za-z0-9]' ELSE regexp_escape(n.name) END)),
      b AS (SELECT *, greatest(1, pos - 80) AS begin_ FROM m), a AS (SELECT *, substr(text, begin_, pos - begin_ + length(name) + 80) AS around, pos - begin_ + 1 + length(name) // 2 AS middle FROM b)
      SELECT DISTINCT subject_document_id, object_document_id, segment_id, coalesce({_marker_sql()}, 'cites') AS predicate FROM a"""
)
def relation_predicates(spark, base):
    """Citations with what they say: the nearest word of repeal, replacement, amendment or exception that is not negated, else cites."""
    segs = table(spark, base, "segments").select(F.col("segment_id").alias("item_id"), "document_id", "text")
    names = _titles(spark, base).select(F.col("document_id").alias("name_id"), F.col("title").alias("name"))
    hits = fulltext.mentions(names, segs).join(segs, "item_id").join(names, "name_id").where(F.col("document_id") != F.col("name_id"))
    kind = relations.nearest_marker(F.col("text"), F.col("name"), _MARKERS, _NEGATIONS)
    return hits.select(F.col("document_id").alias("subject_document_id"), F.col("name_id").alias("object_document_id"), F.col("item_id").alias("segment_id"), F.coalesce(kind, F.lit("cites")).alias("predicate")).distinct()


def _held_relations(spark, base):
    cols = ["relation_id", "recorded_at", "observed_at", "subject_document_id", "predicate", "object_document_id", "review_status"]
    held = temporal.latest_per_key(table(spark, base, "evidence_relations").select(*cols), ["relation_id"], ["recorded_at", "observed_at"])
    return held.withColumn("predicate", F.lower(F.trim("predicate")))


_HELD_REL = "rel AS (SELECT relation_id, subject_document_id, lower(trim(predicate, ' ')) AS predicate, object_document_id, review_status FROM evidence_relations QUALIFY row_number() OVER (PARTITION BY relation_id ORDER BY recorded_at DESC, observed_at DESC) = 1)"


@query(f"WITH {_HELD}, {_HELD_REL} SELECT o.source_key AS old_key, n.source_key AS new_key, count(*) AS relations FROM (SELECT DISTINCT subject_document_id AS s, object_document_id AS o FROM rel WHERE predicate IN ('replaces', 'amends')) r JOIN held n ON n.document_id = r.s JOIN held o ON o.document_id = r.o WHERE n.source_key <> o.source_key GROUP BY ALL")
def cross_key_successors(spark, base):
    """Sources that documents of another source replace or amend."""
    rel = _held_relations(spark, base).select(F.col("subject_document_id").alias("subject"), "predicate", F.col("object_document_id").alias("object"))
    return relations.successors_across(rel, _titles(spark, base).select("document_id", "source_key"), ["replaces", "amends"])


@query(
    f"""WITH {_HELD}, {_HELD_REL}, live AS (SELECT document_id FROM held WHERE status IN ('verified_current', 'unverified_current'))
      SELECT relation_id, subject_document_id, predicate, object_document_id FROM rel WHERE subject_document_id IN (SELECT document_id FROM live) AND (object_document_id IN (SELECT document_id FROM live) OR object_document_id IN (SELECT document_id FROM core_documents))"""
)
def active_relations(spark, base):
    """Relations whose both ends are current: documents by their latest record, or general codes."""
    held = temporal.latest_per_key(table(spark, base, "source_documents").select("document_id", "recorded_at", "status"), ["document_id"], ["recorded_at"])
    live = held.where(F.col("status").isin("verified_current", "unverified_current")).select("document_id")
    ends = live.union(table(spark, base, "core_documents").select("document_id")).distinct()
    rel = _held_relations(spark, base).join(live.withColumnRenamed("document_id", "subject_document_id"), "subject_document_id", "left_semi")
    return rel.join(ends.withColumnRenamed("document_id", "object_document_id"), "object_document_id", "left_semi").select("relation_id", "subject_document_id", "predicate", "object_document_id")


@query(
    f"""WITH {_HELD}, {_HELD_REL}, v AS (SELECT document_id, lead(document_id) OVER (PARTITION BY source_key ORDER BY {_date_sql('effective_from')} NULLS FIRST, document_id) AS next_id FROM held WHERE source_key IS NOT NULL),
      r AS (SELECT DISTINCT subject_document_id AS s, predicate, object_document_id AS o FROM rel WHERE subject_document_id IS NOT NULL AND object_document_id IS NOT NULL)
      SELECT r.s AS old_subject, v.next_id AS new_subject, r.predicate, r.o AS object, CASE WHEN n.s IS NULL THEN 'pending' ELSE 'carried' END AS state
      FROM r JOIN v ON v.document_id = r.s AND v.next_id IS NOT NULL LEFT JOIN r n ON n.s = v.next_id AND n.predicate = r.predicate AND n.o = r.o"""
)
def relation_carry_forward(spark, base):
    """Relations of each version that the next version has too, or still lacks."""
    held = temporal.latest_per_key(table(spark, base, "source_documents").select("document_id", "recorded_at", "source_key", "effective_from"), ["document_id"], ["recorded_at"]).where("source_key is not null")
    nexts = temporal.following(held.select("document_id", "source_key", parse_date(F.col("effective_from")).alias("at")), "source_key", "at", "document_id", "next_id").select("document_id", "next_id")
    rel = _held_relations(spark, base).select(F.col("subject_document_id").alias("subject"), "predicate", F.col("object_document_id").alias("object"))
    return relations.carry_forward(rel, nexts)


@query(
    f"""WITH {_HELD}, e AS (SELECT subject_document_id AS src, object_document_id AS dst, min(relation_id) AS id FROM evidence_relations WHERE subject_document_id IS NOT NULL AND object_document_id IS NOT NULL GROUP BY ALL),
      seeds AS (SELECT document_id AS seed FROM held WHERE status = 'repealed'),
      one AS (SELECT seed, dst AS node, 1 AS hop, min(id) AS via FROM seeds JOIN e ON src = seed WHERE dst <> seed GROUP BY seed, dst),
      two AS (SELECT seed, e.dst AS node, 2 AS hop, min(via || '>' || e.id) AS via FROM one JOIN e ON e.src = one.node WHERE e.dst <> seed AND NOT EXISTS (SELECT 1 FROM one o WHERE o.seed = one.seed AND o.node = e.dst) GROUP BY seed, e.dst)
      SELECT * FROM one UNION ALL SELECT * FROM two"""
)
def relation_path_list(spark, base):
    """The relations that lead from each repealed document to what it refers to, over at most one other document."""
    seeds = temporal.latest_per_key(table(spark, base, "source_documents").select("document_id", "recorded_at", "status"), ["document_id"], ["recorded_at"]).where("status = 'repealed'")
    edges = table(spark, base, "evidence_relations").select(F.col("subject_document_id").alias("src"), F.col("object_document_id").alias("dst"), F.col("relation_id").alias("edge_id"))
    return graph.relation_paths(seeds.select(F.col("document_id").alias("seed")), edges, 2)


@query(
    f"""WITH RECURSIVE {_HELD}, e AS (SELECT DISTINCT subject_document_id AS src, object_document_id AS dst FROM evidence_relations WHERE subject_document_id IS NOT NULL AND object_document_id IS NOT NULL),
      r AS (SELECT document_id AS node, 0 AS hop FROM held WHERE recorded_at > TIMESTAMP '{MOMENT}' UNION SELECT e.src, r.hop + 1 FROM r JOIN e ON e.dst = r.node WHERE r.hop < 3)
      SELECT node, CAST(min(hop) AS INT) AS hop FROM r GROUP BY node HAVING min(hop) > 0"""
)
def affected_documents(spark, base):
    """Documents that refer, over at most three steps, to documents recorded anew since the moment."""
    held = temporal.latest_per_key(table(spark, base, "source_documents").select("document_id", "recorded_at"), ["document_id"], ["recorded_at"])
    changed = held.where(F.col("recorded_at") > F.lit(MOMENT).cast("timestamp_ntz")).select(F.col("document_id").alias("node"))
    return graph.reached(changed, _edges(spark, base).select(F.col("dst").alias("src"), F.col("src").alias("dst")), 3)


# --- structure, links, pages ----------------------------------------------------------------------------------------

_SECTIONS = "n AS (SELECT document_id, ordinal, segment_id, heading, kind, length(text) AS n, CAST(sum(CASE WHEN kind = 'section' THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY ordinal RANGE UNBOUNDED PRECEDING) AS BIGINT) AS section_no FROM segments WHERE document_id IS NOT NULL)"


def _sections(spark, base):
    segs = table(spark, base, "segments").where("document_id is not null").select("document_id", "ordinal", "segment_id", "heading", "kind", F.length("text").cast("long").alias("n"))
    return segment.running_count(segs, "document_id", "ordinal", F.col("kind") == "section", "section_no")


@query(f"WITH {_SECTIONS} SELECT document_id, section_no, max(CASE WHEN kind = 'section' THEN heading END) AS heading, count(*) AS segments, CAST(sum(n) AS BIGINT) AS n_chars, min(ordinal) AS first_ordinal FROM n GROUP BY document_id, section_no")
def structure_list(spark, base):
    """The sections of every document in order, with their segments and size; what stands before the first is section 0."""
    return _sections(spark, base).groupBy("document_id", "section_no").agg(
        F.max(F.when(F.col("kind") == "section", F.col("heading"))).alias("heading"), F.count("*").alias("segments"), F.sum("n").alias("n_chars"), F.min("ordinal").alias("first_ordinal")
    )


@query(
    f"""WITH {_SECTIONS}, h AS (SELECT document_id, section_no, max(CASE WHEN kind = 'section' THEN heading END) AS section FROM n GROUP BY ALL),
      r AS (WITH {_bm25_sql(_QUESTIONS, '(SELECT segment_id, heading, article_label FROM segments)', 'segment_id', {'heading': 2.0, 'article_label': 1.0}, 5)} SELECT * FROM ranked)
      SELECT query_id, item_id, score, CAST(rank AS INT) AS rank, n.document_id, n.section_no, h.section FROM r LEFT JOIN n ON n.segment_id = r.item_id LEFT JOIN h ON h.document_id = n.document_id AND h.section_no = n.section_no"""
)
def structure_search(spark, base):
    """The 5 segments of each question with the best headings and labels, and the section they stand in."""
    items = table(spark, base, "segments").select("segment_id", "heading", "article_label")
    best = cut(fulltext.bm25(_questions(spark, base), items, "segment_id", {"heading": 2.0, "article_label": 1.0}, 5))
    numbered = _sections(spark, base)
    named = numbered.groupBy("document_id", "section_no").agg(F.max(F.when(F.col("kind") == "section", F.col("heading"))).alias("section"))
    place = numbered.select(F.col("segment_id").alias("item_id"), "document_id", "section_no").join(best.select("item_id").distinct(), "item_id", "left_semi")
    return best.join(place, "item_id", "left").join(named, ["document_id", "section_no"], "left").select("query_id", "item_id", "score", "rank", "document_id", "section_no", "section")


_LINKS_SQL = r"""l AS (SELECT CAST(doc_id AS VARCHAR) AS page_id, unnest(regexp_extract_all(regexp_replace(text, '`[^`\n]*`', '', 'g'), '\[\[([^\[\]\n]+)\]\]', 1)) AS target FROM documents),
      resolved AS (SELECT page_id, lower(trim(regexp_extract(target, '^([^|#]+)', 1))) AS to_page FROM l)"""


def _links(spark, base):
    """Links of the corpus' texts to the pages that they name."""
    pages = table(spark, base, "documents").where(F.contains("text", F.lit("[["))).select(F.col("doc_id").cast("string").alias("page_id"), F.col("text").alias("body"))
    return graph.wiki_links(pages).select("page_id", F.lower(F.trim(F.regexp_extract("target", r"^([^|#]+)", 1))).alias("to_page"))


@query(f"WITH {_LINKS_SQL} SELECT to_page, page_id AS from_page, count(*) AS links FROM resolved WHERE to_page > 'the l' GROUP BY ALL ORDER BY to_page, from_page LIMIT 100")
def backlink_page(spark, base):
    """A page of 100 backlinks after a cursor: pages and the texts that link to them."""
    return graph.backlinks(_links(spark, base), ("the l", ""))


@query(f"WITH {_LINKS_SQL}, p AS (SELECT DISTINCT page_id, to_page FROM resolved) SELECT page_id, sum(o) AS outlinks, sum(b) AS backlinks FROM (SELECT page_id, 1 AS o, 0 AS b FROM p UNION ALL SELECT to_page, 0, 1 FROM p) GROUP BY page_id")
def link_degrees(spark, base):
    """How many pages each text links to, and how many texts link to each page."""
    return graph.link_degrees(_links(spark, base))


@query(
    f"""WITH {_HELD}, r AS (SELECT source_key, document_id, title, status, recorded_at, row_number() OVER (PARTITION BY source_key ORDER BY recorded_at DESC, document_id) AS k, count(*) OVER (PARTITION BY source_key) AS versions FROM held WHERE source_key IS NOT NULL)
      SELECT source_key, max(versions) AS versions, '# ' || source_key || chr(10) || string_agg('- ' || document_id || ' ' || coalesce(title, '') || ' (' || coalesce(status, '') || ')', chr(10) ORDER BY k) AS page FROM r WHERE k <= 20 GROUP BY source_key"""
)
def source_pages(spark, base):
    """A Markdown page for each source with its 20 newest versions."""
    held = temporal.latest_per_key(table(spark, base, "source_documents").select("document_id", "source_key", "title", "status", "recorded_at"), ["document_id"], ["recorded_at"]).where("source_key is not null")
    newest = held.withColumn("k", F.row_number().over(Window.partitionBy("source_key").orderBy(F.desc("recorded_at"), "document_id"))).where("k <= 20")
    line = F.concat(F.lit("- "), "document_id", F.lit(" "), F.coalesce("title", F.lit("")), F.lit(" ("), F.coalesce("status", F.lit("")), F.lit(")"))
    # At most 20 lines per page.
    pages = newest.groupBy("source_key").agg(F.array_sort(F.collect_list(F.struct("k", line.alias("line")))).alias("x"))
    counted = held.groupBy("source_key").agg(F.count("*").alias("versions"))
    return pages.join(counted, "source_key").select("source_key", "versions", F.concat(F.lit("# "), "source_key", F.lit("\n"), F.array_join("x.line", "\n")).alias("page"))


@query(
    f"""WITH {_HELD}, names AS (SELECT DISTINCT lower(trim(unnest(string_split(normalized_names, ' ')))) AS name, document_id FROM held WHERE normalized_names IS NOT NULL),
      c AS (SELECT name, document_id, row_number() OVER (PARTITION BY name ORDER BY document_id) AS place, count(*) OVER (PARTITION BY name) AS candidates FROM names WHERE name <> '')
      SELECT name, document_id, CAST(place AS INT) AS place FROM c WHERE candidates > 1 AND place <= 5"""
)
def name_candidates(spark, base):
    """The first 5 documents of each name that stands for several."""
    names = _titles(spark, base).where("normalized_names is not null").select(F.explode(F.split("normalized_names", " ")).alias("name"), "document_id").select(F.lower(F.trim("name")).alias("name"), "document_id").where("name <> ''").distinct()
    several = names.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
    return names.join(several, "name", "left_semi").withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy("document_id"))).where("place <= 5")


@query(
    " UNION ALL ".join(f"SELECT '{name}' AS reason, count_if(regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}')) AS texts FROM documents" for name, p in T.UNSAFE.items())
)
def content_risks(spark, base):
    """Texts of the corpus that hold paths of a machine, secrets or hidden characters, by kind; a kind without any has 0."""
    docs = table(spark, base, "documents")
    counts = docs.agg(*[F.count_if(F.col("text").rlike(p)).alias(name) for name, p in T.UNSAFE.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("reason"), F.col(n).alias("texts")) for n in T.UNSAFE])).alias("x")).select("x.*")
