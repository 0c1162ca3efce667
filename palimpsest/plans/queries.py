"""Core queries over the given tables, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.functions import text as T
from palimpsest.functions.dates import end_day, parse_date, start_day
from palimpsest.operators import audit, dense, diff, evaluation, fulltext, fusion, graph, segment, temporal
from palimpsest.operators.intervals import merge_intervals
from palimpsest.plans.session import table
from palimpsest.sources import files

QUERIES: dict = {}
SQL: dict[str, str] = {}

# Parameters of the queries: the day and moment of the as-of views.
DAY, MOMENT = "2012-06-30", "2018-01-01 00:00:00"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# --- SQL pieces -----------------------------------------------------------------------------------------------------

# Dates in all their spellings, as in functions.dates.
def _date_sql(c: str) -> str:
    v = f"trim({c}, ' \t\n\r')"
    parts = rf"regexp_extract({v}, '^(\d{{4}})(?:-|/|年)?(\d{{1,2}})(?:-|/|月)?(\d{{1,2}})(?:日|T.*)?$', ['y','m','d'])"
    return f"try_cast(({parts}).y || '-' || lpad(({parts}).m, 2, '0') || '-' || lpad(({parts}).d, 2, '0') AS DATE)"


def _start_sql(c: str) -> str:
    return f"CASE WHEN trim(coalesce({c}, ''), ' \t\n\r') = '' THEN DATE '0001-01-01' ELSE {_date_sql(c)} END"


def _end_sql(c: str) -> str:
    return f"CASE WHEN trim(coalesce({c}, ''), ' \t\n\r') = '' THEN DATE '9999-12-31' ELSE {_date_sql(c)} END"


_HAN = "㐀-䶿一-鿿"


def _terms_sql(c: str) -> str:
    """Terms of functions.text.terms: words, then pairs of Han characters."""
    low = f"lower(coalesce({c}, ''))"
    runs = f"regexp_extract_all({low}, '[{_HAN}]{{2,}}')"
    return f"(regexp_extract_all({low}, '[a-z0-9]+') || flatten(list_transform({runs}, lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2)))))"


def _bm25_sql(queries: str, items: str, item: str, weights: dict[str, float], k: int, make=_terms_sql) -> str:
    parts = " UNION ALL ".join(f"SELECT {item} AS item_id, unnest({make(c)}) AS term, {w} AS w FROM {items}" for c, w in weights.items())
    sizes = " + ".join(f"len({make(c)})" for c in weights)
    return f"""
      q AS ({queries}),
      asked AS (SELECT DISTINCT query_id, unnest({make('text')}) AS term FROM q),
      post AS (SELECT item_id, term, sum(w) AS f FROM ({parts}) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
      size AS (SELECT {item} AS item_id, CAST({sizes} AS DOUBLE) AS d FROM {items}),
      whole AS (SELECT count(*) AS n_items, avg(d) AS mean FROM size),
      df AS (SELECT term, count(*) AS n FROM post GROUP BY term),
      scored AS (SELECT query_id, item_id, round(sum(greatest(ln((n_items - n + 0.5) / (n + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / mean))), 6) AS score
                 FROM post JOIN df USING (term) JOIN size USING (item_id) CROSS JOIN whole JOIN asked USING (term) GROUP BY ALL),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM scored QUALIFY rank <= {k})"""


# --- full text ------------------------------------------------------------------------------------------------------

_SEGMENT_WEIGHTS = {"heading": 8.0, "article_label": 2.0, "text": 5.0}


def _questions(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "eval_items").select(F.col("item_id").alias("query_id"), F.col("question").alias("text"))


def _unique_segments(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "segments").select("segment_id", *_SEGMENT_WEIGHTS)


def _segment_index(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """Terms of the questions and their postings in the segments, tokenized once for all weightings."""
    asked = fulltext.asked_terms(_questions(spark, base))
    return asked, fulltext.postings(asked, _unique_segments(spark, base), "segment_id", list(_SEGMENT_WEIGHTS))


_QUESTIONS = "SELECT item_id AS query_id, question AS text FROM eval_items"


@query(f"WITH {_bm25_sql(_QUESTIONS, 'segments', 'segment_id', _SEGMENT_WEIGHTS, 5)} SELECT query_id, item_id, score, CAST(rank AS INT) AS rank FROM ranked")
def bm25_topk(spark, base):
    """The 5 best segments of each evaluation question, headings and labels weighted."""
    return fulltext.bm25(_questions(spark, base), _unique_segments(spark, base), "segment_id", _SEGMENT_WEIGHTS, 5)


def _titles(spark, base):
    """Title and names of each document, from its latest record."""
    held = temporal.latest_per_key(table(spark, base, "source_documents"), ["document_id"], ["recorded_at"])
    return held.select("document_id", "source_key", "title", "normalized_names", "aliases_json")


_HELD = "held AS (SELECT * FROM source_documents QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY recorded_at DESC) = 1)"
_ALIASES = "SELECT DISTINCT document_id, source_key, unnest(from_json(aliases_json, '[\"VARCHAR\"]')) AS alias FROM held WHERE source_key IS NOT NULL AND aliases_json IS NOT NULL"


def _alias_rows(spark, base):
    names = F.explode(F.from_json("aliases_json", "array<string>")).alias("alias")
    return _titles(spark, base).where("source_key is not null").select("document_id", "source_key", names).distinct()


@query(
    f"""WITH {_HELD}, aliases AS ({_ALIASES}), {_bm25_sql('SELECT DISTINCT alias AS query_id, alias AS text FROM aliases', 'held', 'document_id', {'title': 8.0}, 10)},
      expected AS (SELECT DISTINCT alias AS query_id, document_id AS item_id, CASE WHEN regexp_matches(alias, '[{_HAN}]') THEN 'zh' ELSE 'en' END AS lang FROM aliases),
      per AS (SELECT e.query_id, lang, min(rank) AS first, count(rank) AS found, count(*) AS wanted FROM expected e LEFT JOIN ranked r ON e.query_id = r.query_id AND e.item_id = r.item_id GROUP BY ALL)
      SELECT lang, count(*) AS queries, round(avg(CASE WHEN first = 1 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_1, round(avg(coalesce(1.0 / first, 0.0)), 6) AS mrr, round(avg(found / wanted), 6) AS recall FROM per GROUP BY lang"""
)
def eval_metrics(spark, base):
    """How well titles are found by the documents' aliases: hit at 1, mean reciprocal rank and recall by language."""
    aliases = _alias_rows(spark, base)
    asked = aliases.select(F.col("alias").alias("query_id"), F.col("alias").alias("text")).distinct()
    results = fulltext.bm25(asked, _titles(spark, base), "document_id", {"title": 8.0}, 10)
    lang = F.when(F.col("alias").rlike(f"[{T.HAN}]"), "zh").otherwise("en").alias("lang")
    return evaluation.ranking_metrics(results, aliases.select(F.col("alias").alias("query_id"), F.col("document_id").alias("item_id"), lang), "lang")


@query(
    f"""WITH {_HELD}, {_bm25_sql(_QUESTIONS, 'segments', 'segment_id', _SEGMENT_WEIGHTS, 20)},
      ranked_titles AS (WITH {_bm25_sql(_QUESTIONS, '(SELECT segment_id, heading, article_label FROM segments)', 'segment_id', {'heading': 1.0, 'article_label': 1.0}, 20)} SELECT * FROM ranked),
      both_ AS (SELECT query_id, item_id, 'body' AS channel, 1.5 AS w, rank FROM ranked UNION ALL SELECT query_id, item_id, 'label', 1.0, rank FROM ranked_titles)
      SELECT query_id, item_id, round(sum(w / (60 + rank)), 9) AS score, string_agg(channel, ',' ORDER BY channel) AS channels,
             CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(sum(w / (60 + rank)), 9) DESC, item_id) AS INT) AS rank FROM both_ GROUP BY query_id, item_id"""
)
def rrf_fusion(spark, base):
    """Reciprocal-rank fusion of a body channel and a label channel over segments."""
    asked, index = _segment_index(spark, base)
    body = fulltext.score(asked, index, list(_SEGMENT_WEIGHTS.values()), 20).withColumn("channel", F.lit("body"))
    label = fulltext.score(asked, index, [1.0, 1.0, 0.0], 20).withColumn("channel", F.lit("label"))
    return fusion.reciprocal_rank(body.unionByName(label), {"body": 1.5, "label": 1.0})


@query(
    """WITH asked AS (SELECT DISTINCT trim(lower(document_number)) AS number FROM source_documents WHERE document_number IS NOT NULL)
      SELECT DISTINCT number, d.document_id FROM asked JOIN source_documents d ON trim(lower(d.document_number)) = number"""
)
def exact_lookup(spark, base):
    """Documents by their exact number, blanks and case aside."""
    number = F.trim(F.lower("document_number"))
    docs = table(spark, base, "source_documents").where("document_number is not null").select(number.alias("number"), "document_id")
    return docs.select("number").distinct().join(docs, "number").distinct()


@query(
    """WITH n AS (SELECT DISTINCT regexp_replace(issuer, '^the ', '') AS name FROM core_documents WHERE issuer IS NOT NULL)
      SELECT DISTINCT n.name, s.segment_id FROM n JOIN segments s ON contains(s.text, n.name) AND regexp_matches(' ' || s.text || ' ', CASE WHEN regexp_matches(n.name, '^[A-Za-z0-9].*[A-Za-z0-9]$') THEN '[^A-Za-z0-9]' || regexp_escape(n.name) || '[^A-Za-z0-9]' ELSE regexp_escape(n.name) END)"""
)
def phrase_match(spark, base):
    """Segments that contain the name of an issuer of general codes as a phrase."""
    names = table(spark, base, "core_documents").where("issuer is not null").select(F.regexp_replace("issuer", "^the ", "").alias("name")).distinct().withColumn("name_id", F.col("name"))
    hits = fulltext.mentions(names, table(spark, base, "segments").select(F.col("segment_id").alias("item_id"), "text"))
    return hits.select(F.col("name_id").alias("name"), F.col("item_id").alias("segment_id"))


@query(
    f"""WITH {_HELD}, names AS (SELECT document_id AS name_id, title AS name FROM held WHERE length(title) > 0)
      SELECT DISTINCT s.document_id AS subject_document_id, n.name_id AS object_document_id, s.segment_id FROM segments s JOIN names n ON contains(s.text, n.name) AND s.document_id <> n.name_id AND regexp_matches(' ' || s.text || ' ', CASE WHEN regexp_matches(n.name, '[A-Za-z0-9]$') THEN '[^A-Za-z0-9]' || regexp_escape(n.name) || '[^A-Za-z0-9]' ELSE regexp_escape(n.name) END)"""
)
def derive_relations(spark, base):
    """Citations: segments of a document that contain another document's title."""
    segs = table(spark, base, "segments")
    names = _titles(spark, base).select(F.col("document_id").alias("name_id"), F.col("title").alias("name"))
    hits = fulltext.mentions(names, segs.select(F.col("segment_id").alias("item_id"), "text"))
    owner = segs.select(F.col("segment_id").alias("item_id"), F.col("document_id").alias("subject_document_id")).distinct()
    return hits.join(owner, "item_id").where("subject_document_id <> name_id").select("subject_document_id", F.col("name_id").alias("object_document_id"), F.col("item_id").alias("segment_id")).distinct()


@query(
    r"""WITH words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(title), '[a-z]{4,}')) AS word FROM source_documents),
      vocabulary AS (SELECT DISTINCT unnest(regexp_extract_all(lower(title), '[a-z]{4,}')) AS candidate FROM core_documents UNION SELECT DISTINCT unnest(regexp_extract_all(lower(issuer), '[a-z]{4,}')) FROM core_documents)
      SELECT word, candidate FROM words JOIN vocabulary ON left(word, 3) = left(candidate, 3) AND damerau_levenshtein(word, candidate) = 1"""
)
def typo_match(spark, base):
    """Words of titles one typing error away from a word of the general codes."""
    words = lambda df, c: df.select(F.explode(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{4,}"), F.lit(0))).alias("word"))
    core = table(spark, base, "core_documents")
    return fulltext.typo_matches(words(table(spark, base, "source_documents"), "title").distinct(), words(core, "title").union(words(core, "issuer")).distinct(), prefix=3)


# --- dense ----------------------------------------------------------------------------------------------------------


def _vectors(spark, base):
    return table(spark, base, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


@query(
    """WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score
      FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
      SELECT query_id, item_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INT) AS rank FROM s QUALIFY rank <= 10"""
)
def dense_topk_cosine(spark, base):
    """The 10 nearest vectors of every hundredth one."""
    v = _vectors(spark, base)
    return dense.cosine_top(v.where("id % 100 = 0"), v, 10)


@query(
    """WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, b.label, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score
      FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
      one AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, item_id) = 1)
      SELECT query_id, item_id, label, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INT) AS rank FROM one QUALIFY rank <= 5"""
)
def dense_group_diversity(spark, base):
    """The nearest vector of each label, the best 5 of them, for every hundredth vector."""
    v = _vectors(spark, base)
    return dense.cosine_top(v.where("id % 100 = 0"), v, 5, group="label").select("query_id", "item_id", "label", "score", "rank")


# --- versions and intervals -----------------------------------------------------------------------------------------


@query(f"WITH {_HELD} SELECT document_id, source_key, title, status, recorded_at FROM held")
def latest_per_key(spark, base):
    """The latest record of each document."""
    docs = table(spark, base, "source_documents").select("document_id", "source_key", "title", "status", "recorded_at")
    return temporal.latest_per_key(docs, ["document_id"], ["recorded_at"])


@query(
    f"""SELECT relation_id, subject_document_id, object_document_id, review_status, recorded_at FROM evidence_relations WHERE recorded_at <= TIMESTAMP '{MOMENT}'
      QUALIFY row_number() OVER (PARTITION BY relation_id ORDER BY recorded_at DESC) = 1"""
)
def as_of_latest(spark, base):
    """The relation records that held at a past moment."""
    rel = table(spark, base, "evidence_relations").select("relation_id", "subject_document_id", "object_document_id", "review_status", "recorded_at")
    return temporal.as_of(rel, ["relation_id"], ["recorded_at"], "recorded_at", F.lit(MOMENT).cast("timestamp_ntz"))


def _bitemporal(spark, base, mode):
    rel = table(spark, base, "evidence_relations").select(
        "relation_id", "subject_document_id", "object_document_id", F.lower(F.trim("predicate")).alias("predicate"), "observed_at", "recorded_at",
        F.date_from_unix_date(start_day(F.col("valid_from"))).alias("s"), F.date_from_unix_date(end_day(F.col("valid_to"))).alias("e"),
    )
    view = temporal.relation_view(rel, mode, F.lit(DAY).cast("date"), F.lit(MOMENT).cast("timestamp_ntz"))
    ends = table(spark, base, "source_documents").select(F.col("document_id").alias("subject_document_id")).distinct()
    return view.join(ends, "subject_document_id", "left_semi").select("relation_id", "subject_document_id", "predicate", "object_document_id")


def _bitemporal_sql(mode):
    held = "recorded_at <= TIMESTAMP '" + MOMENT + "'" if mode == "as_of" else "true"
    bounds = f"SELECT *, {_start_sql('valid_from')} AS s, {_end_sql('valid_to')} AS e FROM evidence_relations WHERE {held} QUALIFY row_number() OVER (PARTITION BY relation_id ORDER BY recorded_at DESC) = 1"
    when = f"e <= DATE '{DAY}'" if mode == "past" else f"s <= DATE '{DAY}' AND e > DATE '{DAY}'"
    return f"SELECT relation_id, subject_document_id, lower(trim(predicate, ' ')) AS predicate, object_document_id FROM ({bounds}) WHERE {when} AND subject_document_id IN (SELECT document_id FROM source_documents)"


@query(_bitemporal_sql("current"))
def bitemporal_current(spark, base):
    """Relations whose latest record is valid on the day."""
    return _bitemporal(spark, base, "current")


@query(_bitemporal_sql("past"))
def bitemporal_past(spark, base):
    """Relations whose latest record had ended by the day."""
    return _bitemporal(spark, base, "past")


@query(_bitemporal_sql("as_of"))
def bitemporal_as_of(spark, base):
    """Relations whose record at the moment was valid on the day."""
    return _bitemporal(spark, base, "as_of")


@query(f"SELECT relation_id, recorded_at FROM evidence_relations WHERE {_start_sql('valid_from')} <= DATE '{DAY}' AND {_end_sql('valid_to')} > DATE '{DAY}'")
def interval_admission(spark, base):
    """Relation records whose half-open interval holds the day."""
    day = F.unix_date(F.lit(DAY).cast("date"))
    return table(spark, base, "evidence_relations").where(temporal.interval_allows(start_day(F.col("valid_from")), end_day(F.col("valid_to")), day)).select("relation_id", "recorded_at")


@query(
    f"""WITH x AS (SELECT status, {_date_sql('effective_from')} AS s, {_date_sql('effective_to')} AS e FROM source_documents)
      SELECT CASE WHEN NOT coalesce((s IS NULL OR s <= DATE '{DAY}') AND (e IS NULL OR e > DATE '{DAY}'), false) THEN 'outside_effective_interval'
                  WHEN status IS NULL OR starts_with(status, 'unverified') OR s IS NULL THEN 'unverified_metadata' ELSE 'verified_in_scope' END AS class, count(*) AS n FROM x GROUP BY class"""
)
def temporal_classification(spark, base):
    """Where document versions stand on the day."""
    docs = table(spark, base, "source_documents")
    kind = temporal.classify(F.col("status"), parse_date(F.col("effective_from")), parse_date(F.col("effective_to")), F.lit(DAY).cast("date"))
    return docs.groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


_ADMIT = {
    "no_source_key": "source_key IS NULL",
    "not_current": "status NOT IN ('verified_current', 'unverified_current')",
    "review_required": "extraction_review_required",
    "low_authority": "authority_rank < 50",
    "no_start": "effective_from IS NULL OR trim(effective_from) = ''",
}


@query(
    "SELECT document_id, recorded_at, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _ADMIT.items())
    + "], lambda r: r IS NOT NULL), ',') AS reasons FROM source_documents"
)
def admission_reasons(spark, base):
    """Why a document record would not be admitted; empty if it is."""
    found = temporal.reasons(**{name: F.expr(c) for name, c in _ADMIT.items()})
    return table(spark, base, "source_documents").select("document_id", "recorded_at", F.array_join(found, ",").alias("reasons"))


# --- joins, sets and pages ------------------------------------------------------------------------------------------


@query("SELECT DISTINCT document_id, source_key FROM source_documents d WHERE NOT EXISTS (SELECT 1 FROM documents c WHERE c.document_id = d.document_id)")
def uncompiled_anti_join(spark, base):
    """Source documents that no corpus text comes from."""
    docs = table(spark, base, "source_documents").select("document_id", "source_key").distinct()
    return docs.join(table(spark, base, "documents").select("document_id"), "document_id", "left_anti")


@query(f"WITH {_HELD} SELECT doc_id, source_key, CAST(n_chars AS BIGINT) AS n_chars FROM documents WHERE document_id IN (SELECT document_id FROM held WHERE status IN ('repealed', 'historical'))")
def stale_semi_join(spark, base):
    """Corpus texts whose source is repealed or historical by its latest record."""
    held = temporal.latest_per_key(table(spark, base, "source_documents").select("document_id", "recorded_at", "status"), ["document_id"], ["recorded_at"])
    return table(spark, base, "documents").select("doc_id", "document_id", "source_key", "n_chars").join(held.where("status in ('repealed', 'historical')"), "document_id", "left_semi").drop("document_id")


@query("SELECT DISTINCT source_id, source_key, status FROM source_lifecycle WHERE source_id > 'src_8' ORDER BY source_id, status, source_key LIMIT 101")
def keyset_page(spark, base):
    """A page of 100 sources after a cursor, and one more row that tells if there are others."""
    rows = table(spark, base, "source_lifecycle").where("source_id > 'src_8'").select("source_id", "source_key", "status").distinct()
    return rows.orderBy("source_id", "status", "source_key").limit(101)


@query(
    """SELECT side, count(*) AS n FROM (
      SELECT 'blocks only' AS side FROM (SELECT document_id FROM document_blocks EXCEPT SELECT document_id FROM source_documents)
      UNION ALL SELECT 'source only' FROM (SELECT document_id FROM source_documents EXCEPT SELECT document_id FROM document_blocks)
      UNION ALL SELECT 'both' FROM (SELECT document_id FROM document_blocks INTERSECT SELECT document_id FROM source_documents)) GROUP BY side"""
)
def orphan_check(spark, base):
    """Documents with blocks but no record, with a record but no blocks, and with both."""
    a, b = table(spark, base, "document_blocks").select("document_id"), table(spark, base, "source_documents").select("document_id")
    sides = diff.orphans(a, b, "document_id").select(F.when(F.col("side") == "left", "blocks only").otherwise("source only").alias("side"))
    return sides.unionByName(a.intersect(b).select(F.lit("both").alias("side"))).groupBy("side").agg(F.count("*").alias("n"))


@query(
    """SELECT status, coalesce(review_required, false) AS review, count(*) AS n, count_if(removed) AS removed FROM
      (SELECT status, activated_at IS NULL AS review_required, removed_at IS NOT NULL AS removed FROM source_lifecycle) GROUP BY ALL"""
)
def status_counts(spark, base):
    """Lifecycle records by status and whether they were ever active, with conditional counts."""
    life = table(spark, base, "source_lifecycle")
    return life.groupBy("status", F.col("activated_at").isNull().alias("review")).agg(F.count("*").alias("n"), F.count_if(F.col("removed_at").isNotNull()).alias("removed"))


@query(
    """SELECT d.jurisdiction, count(DISTINCT d.source_key) AS sources, count(DISTINCT c.source_key) AS compiled FROM source_documents d
      LEFT JOIN (SELECT DISTINCT source_key FROM documents) c ON c.source_key = d.source_key GROUP BY d.jurisdiction"""
)
def coverage_distinct_counts(spark, base):
    """Sources and compiled sources by jurisdiction."""
    docs = table(spark, base, "source_documents").select("jurisdiction", "source_key").distinct()
    compiled = table(spark, base, "documents").select("source_key").distinct().withColumn("c", F.col("source_key"))
    return docs.join(compiled, "source_key", "left").groupBy("jurisdiction").agg(F.count_distinct("source_key").alias("sources"), F.count_distinct("c").alias("compiled"))


@query(
    """WITH b AS (SELECT document_id, length(text) AS n, CASE WHEN confidence BETWEEN 0 AND 1 THEN confidence WHEN confidence > 1 AND confidence <= 100 THEN confidence / 100 END AS c FROM document_blocks WHERE page IS NOT NULL)
      SELECT document_id, count(*) AS blocks, round(sum(c * n) / nullif(sum(CASE WHEN c IS NOT NULL THEN n END), 0), 6) AS confidence FROM b GROUP BY document_id"""
)
def weighted_confidence(spark, base):
    """Mean confidence of scanned documents weighted by characters; null where none is known.

    Values above 1 and up to 100 are percent; those below 0 or above 100 are impossible and count as unknown.
    """
    c = F.col("confidence")
    unit = F.when(c.between(0, 1), c).when((c > 1) & (c <= 100), c / 100)
    n = F.when(unit.isNotNull(), F.length("text"))
    return table(spark, base, "document_blocks").where("page is not null").groupBy("document_id").agg(
        F.count("*").alias("blocks"), F.round(F.try_divide(F.sum(unit * n), F.sum(n)), 6).alias("confidence")
    )


@query(
    """SELECT source_key, count(*) AS versions, min(document_id) AS first_id, max(document_id) AS last_id, count(DISTINCT status) AS states, max(recorded_at) AS last_recorded
      FROM (SELECT source_key, document_id, max(status) AS status, max(recorded_at) AS recorded_at FROM source_documents WHERE source_key IS NOT NULL GROUP BY ALL) GROUP BY source_key"""
)
def lineage_summary(spark, base):
    """The versions of each source key: how many, first and last id, states, last record. Summed up, never listed in one row."""
    docs = table(spark, base, "source_documents").where("source_key is not null").groupBy("source_key", "document_id").agg(F.max("status").alias("status"), F.max("recorded_at").alias("recorded_at"))
    return docs.groupBy("source_key").agg(
        F.count("*").alias("versions"), F.min("document_id").alias("first_id"), F.max("document_id").alias("last_id"), F.count_distinct("status").alias("states"), F.max("recorded_at").alias("last_recorded")
    )


@query("SELECT d.doc_id, c.class_id, c.copies FROM documents d JOIN (SELECT text, min(doc_id) AS class_id, count(*) AS copies FROM documents WHERE length(text) > 0 GROUP BY text HAVING count(*) > 1) c ON d.text = c.text")
def duplicate_clusters(spark, base):
    """One row per text that has exact copies: its class and the class's size."""
    docs = table(spark, base, "documents").where(F.length("text") > 0).select("doc_id", F.sha2("text", 256).alias("h"))
    classes = docs.groupBy("h").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies")).where("copies > 1")
    return docs.join(classes, "h").drop("h")


@query(f"WITH {_HELD}, aliases AS ({_ALIASES}) SELECT alias, count(DISTINCT source_key) AS sources, min(source_key) AS first_source, max(source_key) AS last_source FROM aliases GROUP BY alias HAVING count(DISTINCT source_key) > 1")
def alias_collisions(spark, base):
    """Aliases that stand for more than one source."""
    return _alias_rows(spark, base).groupBy("alias").agg(
        F.count_distinct("source_key").alias("sources"), F.min("source_key").alias("first_source"), F.max("source_key").alias("last_source")
    ).where("sources > 1")


_FEEDBACK = {"purchase": 1, "click": 1, "error": -1}


@query(
    """WITH f AS (SELECT user_id, sum(CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) AS net FROM events GROUP BY user_id)
      SELECT user_id, CAST(net AS BIGINT) AS net, CAST(row_number() OVER (ORDER BY net DESC, user_id) AS INT) AS rank FROM f WHERE net > 0 QUALIFY rank <= 100"""
)
def net_feedback_rank(spark, base):
    """The 100 users with the highest net of positive and negative events."""
    sign = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in _FEEDBACK.items() for x in kv]), F.col("event_type")), F.lit(0))
    best = table(spark, base, "events").groupBy("user_id").agg(F.sum(sign.cast("long")).alias("net")).where("net > 0").orderBy(F.desc("net"), "user_id").limit(100)
    # 100 rows at most: ranking them in one task is bounded.
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("net"), "user_id")))


@query(
    """SELECT event_type, count(*) AS n, count(k) AS with_k, sum(k) AS sum_k, min(k) AS min_k, max(k) AS max_k FROM
      (SELECT event_type, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type"""
)
def json_property_stats(spark, base):
    """A number inside the events' JSON, by type."""
    k = F.get_json_object("props", "$.k").try_cast("long").alias("k")
    return table(spark, base, "events").select("event_type", k).groupBy("event_type").agg(
        F.count("*").alias("n"), F.count("k").alias("with_k"), F.sum("k").alias("sum_k"), F.min("k").alias("min_k"), F.max("k").alias("max_k")
    )


# --- differences ----------------------------------------------------------------------------------------------------


def _states(spark, base):
    docs = table(spark, base, "source_documents")
    before = temporal.as_of(docs, ["document_id"], ["recorded_at"], "recorded_at", F.lit(MOMENT).cast("timestamp_ntz"))
    return before, temporal.latest_per_key(docs, ["document_id"], ["recorded_at"])


_STATES = f"{_HELD}, before AS (SELECT * FROM source_documents WHERE recorded_at <= TIMESTAMP '{MOMENT}' QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY recorded_at DESC) = 1)"


@query(
    f"""WITH {_STATES} SELECT coalesce(a.document_id, b.document_id) AS document_id,
      CASE WHEN a.document_id IS NULL THEN 'created' WHEN b.document_id IS NULL THEN 'deleted' WHEN a.source_sha256 IS NOT DISTINCT FROM b.source_sha256 AND a.byte_size IS NOT DISTINCT FROM b.byte_size AND a.status IS NOT DISTINCT FROM b.status AND a.title IS NOT DISTINCT FROM b.title THEN 'unchanged' ELSE 'updated' END AS change
      FROM before a FULL JOIN held b ON a.document_id = b.document_id"""
)
def snapshot_change_set(spark, base):
    """What changed between the state at a moment and now."""
    return diff.change_set(*_states(spark, base), ["document_id"], ["source_sha256", "byte_size", "status", "title"])


@query(
    """WITH a AS (SELECT relative_path AS path, min(source_sha256) AS da FROM source_documents WHERE document_type <> 'law' GROUP BY 1), b AS (SELECT regexp_replace(relative_path, '\\.[A-Za-z]+$', '.txt') AS path, min(source_sha256) AS db FROM source_documents GROUP BY 1),
      added AS (SELECT * FROM b WHERE path NOT IN (SELECT path FROM a)), removed AS (SELECT * FROM a WHERE path NOT IN (SELECT path FROM b)),
      single AS (SELECT db, min(path) AS moved_to FROM added GROUP BY db HAVING count(*) = 1),
      r AS (SELECT path, da AS digest, CASE WHEN moved_to IS NULL THEN 'removed' ELSE 'move' END AS change, moved_to FROM removed LEFT JOIN single ON da = db)
      SELECT * FROM r UNION ALL SELECT path, db, 'added', NULL FROM added WHERE path NOT IN (SELECT moved_to FROM r WHERE change = 'move')
      UNION ALL SELECT a.path, db, CASE WHEN da IS NOT DISTINCT FROM db THEN 'same' ELSE 'changed' END, NULL FROM a JOIN b USING (path)"""
)
def move_detection(spark, base):
    """Paths of a text-only delivery against those of the catalogue: moved, added, removed, changed."""
    docs = table(spark, base, "source_documents")
    before = docs.where("document_type <> 'law'").groupBy(F.col("relative_path").alias("path")).agg(F.min("source_sha256").alias("digest"))
    after = docs.groupBy(F.regexp_replace("relative_path", r"\.[A-Za-z]+$", ".txt").alias("path")).agg(F.min("source_sha256").alias("digest"))
    return diff.moves(before, after, "path", "digest")


@query(
    f"""WITH {_HELD}, v AS (SELECT document_id, source_key, lead(document_id) OVER (PARTITION BY source_key ORDER BY {_date_sql('effective_from')} NULLS FIRST, document_id) AS next_id FROM held WHERE source_key IS NOT NULL),
      s AS (SELECT document_id, article_label, coalesce(string_agg(DISTINCT text_sha256, ' ' ORDER BY text_sha256), '') AS h FROM segments WHERE article_label IS NOT NULL GROUP BY ALL),
      o AS (SELECT v.document_id, v.next_id, s.article_label, s.h FROM v JOIN s USING (document_id) WHERE next_id IS NOT NULL), n AS (SELECT v.document_id, v.next_id, s.article_label, s.h FROM v JOIN s ON s.document_id = v.next_id)
      SELECT coalesce(o.document_id, n.document_id) AS old_id, coalesce(o.next_id, n.next_id) AS new_id, coalesce(o.article_label, n.article_label) AS article_label,
        CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' WHEN o.h = n.h THEN 'unchanged' ELSE 'changed' END AS change
      FROM o FULL JOIN n ON o.document_id = n.document_id AND o.next_id = n.next_id AND o.article_label = n.article_label"""
)
def source_diff(spark, base):
    """Articles of each version against the next version of the same source, by the distinct texts of all their parts."""
    held = temporal.latest_per_key(table(spark, base, "source_documents"), ["document_id"], ["recorded_at"]).where("source_key is not null")
    v = temporal.following(held.select("document_id", "source_key", parse_date(F.col("effective_from")).alias("at")), "source_key", "at", "document_id", "next_id").where("next_id is not null").select("document_id", "next_id")
    parts = table(spark, base, "segments").where("article_label is not null").select("document_id", "article_label", "text_sha256").distinct()
    digest = [F.bit_xor(F.xxhash64("text_sha256", F.lit(i))).alias(f"x{i}") for i in range(2)]
    s = parts.groupBy("document_id", "article_label").agg(F.count("text_sha256").alias("n"), *digest).select("document_id", "article_label", F.struct("n", "x0", "x1").alias("h"))
    old = v.join(s, "document_id").select(F.col("document_id").alias("old_id"), F.col("next_id").alias("new_id"), "article_label", F.col("h").alias("a"))
    new = v.join(s.withColumnRenamed("document_id", "next_id"), "next_id").select(F.col("document_id").alias("old_id"), F.col("next_id").alias("new_id"), "article_label", F.col("h").alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") == F.col("b"), "unchanged").otherwise("changed")
    return old.join(new, ["old_id", "new_id", "article_label"], "full_outer").select("old_id", "new_id", "article_label", change.alias("change"))


@query(
    """WITH x AS (SELECT upper(trim(jurisdiction, ' ')) AS j, document_type AS t FROM source_documents),
      grid AS (SELECT j, t FROM (SELECT DISTINCT j FROM x WHERE j IS NOT NULL) CROSS JOIN (SELECT DISTINCT t FROM x WHERE t IS NOT NULL))
      SELECT g.j AS jurisdiction, g.t AS document_type, count(x.j) AS documents, CASE WHEN count(x.j) = 0 THEN 'missing' ELSE 'available' END AS state FROM grid g LEFT JOIN x ON x.j = g.j AND x.t = g.t GROUP BY ALL"""
)
def coverage_gaps(spark, base):
    """Every pair of jurisdiction and document type with its documents; pairs without any are gaps.

    The grid comes from the two columns' code lists, a few dozen values, not from rows.
    """
    x = table(spark, base, "source_documents").select(F.upper(F.trim("jurisdiction")).alias("jurisdiction"), "document_type")
    have = x.groupBy("jurisdiction", "document_type").agg(F.count("*").alias("documents")).where("jurisdiction is not null and document_type is not null")
    kinds = x.agg(F.collect_set("document_type").alias("k"))
    grid = x.where("jurisdiction is not null").select("jurisdiction").distinct().join(F.broadcast(kinds)).select("jurisdiction", F.explode("k").alias("document_type"))
    full = grid.join(have, ["jurisdiction", "document_type"], "left").fillna(0, ["documents"])
    return full.withColumn("state", F.when(F.col("documents") == 0, "missing").otherwise("available"))


# --- graph ----------------------------------------------------------------------------------------------------------


def _edges(spark, base):
    return table(spark, base, "evidence_relations").where("object_document_id is not null").select(F.col("subject_document_id").alias("src"), F.col("object_document_id").alias("dst")).distinct()


@query(
    f"""WITH {_HELD}, e AS (SELECT DISTINCT subject_document_id AS src, object_document_id AS dst FROM evidence_relations WHERE object_document_id IS NOT NULL AND subject_document_id IS NOT NULL),
      seeds AS (SELECT document_id AS seed FROM held WHERE status = 'repealed'),
      one AS (SELECT DISTINCT seed, dst AS node, 1 AS hop FROM seeds JOIN e ON src = seed WHERE dst <> seed),
      two AS (SELECT DISTINCT seed, e.dst AS node, 2 AS hop FROM one JOIN e ON e.src = one.node WHERE e.dst <> seed)
      SELECT seed, node, min(hop) AS hop FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY ALL"""
)
def two_hop_neighbors(spark, base):
    """What repealed documents refer to, directly and over one other document."""
    seeds = temporal.latest_per_key(table(spark, base, "source_documents").select("document_id", "recorded_at", "status"), ["document_id"], ["recorded_at"]).where("status = 'repealed'")
    return graph.k_hop(seeds.select(F.col("document_id").alias("seed")), _edges(spark, base), 2)


@query(
    f"""WITH RECURSIVE {_HELD}, e AS (SELECT DISTINCT subject_document_id AS src, object_document_id AS dst FROM evidence_relations WHERE object_document_id IS NOT NULL AND subject_document_id IS NOT NULL),
      s AS (SELECT document_id AS node, CASE status WHEN 'repealed' THEN 3 WHEN 'historical' THEN 2 WHEN 'unverified_current' THEN 1 ELSE 0 END AS state FROM held),
      r AS (SELECT node, state FROM s WHERE state > 0 UNION SELECT e.src, r.state FROM r JOIN e ON e.dst = r.node),
      n AS (SELECT src AS node FROM e UNION SELECT dst FROM e UNION SELECT node FROM s)
      SELECT n.node, CAST(coalesce(max(r.state), 0) AS INT) AS state FROM n LEFT JOIN r ON r.node = n.node GROUP BY n.node"""
)
def freshness_fixpoint(spark, base):
    """The worst status among a document and all it depends on through relations."""
    rank = F.when(F.col("status") == "repealed", 3).when(F.col("status") == "historical", 2).when(F.col("status") == "unverified_current", 1).otherwise(0)
    held = temporal.latest_per_key(table(spark, base, "source_documents").select("document_id", "recorded_at", "status"), ["document_id"], ["recorded_at"])
    return graph.worst_reached(held.select(F.col("document_id").alias("node"), rank.alias("state")), _edges(spark, base))


@query(
    f"""WITH {_HELD}, l AS (SELECT document_id AS node, upper(trim(jurisdiction, ' ')) AS label FROM held WHERE jurisdiction IS NOT NULL),
      e AS (SELECT subject_document_id AS src, object_document_id AS dst FROM evidence_relations UNION SELECT object_document_id, subject_document_id FROM evidence_relations)
      SELECT a.node, a.label, count(DISTINCT b.label) AS outside FROM e JOIN l a ON e.src = a.node JOIN l b ON e.dst = b.node WHERE a.label <> b.label GROUP BY ALL"""
)
def bridge_nodes(spark, base):
    """Documents related to documents of other jurisdictions."""
    held = temporal.latest_per_key(table(spark, base, "source_documents").select("document_id", "recorded_at", "jurisdiction"), ["document_id"], ["recorded_at"])
    labels = held.where("jurisdiction is not null").select(F.col("document_id").alias("node"), F.upper(F.trim("jurisdiction")).alias("label"))
    return graph.bridges(_edges(spark, base), labels)


def _communities_sql(rounds: int) -> str:
    """Label propagation with every round spelled out; at a fixed point further rounds change nothing."""
    parts = [
        "e AS (SELECT subject_document_id AS src, object_document_id AS dst, CASE WHEN lower(trim(predicate)) IN ('replaces', 'amends') THEN 2.0 ELSE 1.0 END AS weight FROM evidence_relations WHERE subject_document_id IS NOT NULL AND object_document_id IS NOT NULL AND subject_document_id <> object_document_id)",
        "links AS MATERIALIZED (SELECT src, dst, sum(weight) AS weight FROM (SELECT * FROM e UNION ALL SELECT dst, src, weight FROM e) GROUP BY ALL)",
        "n0 AS (SELECT DISTINCT src AS node, src AS label, false AS settled FROM links)",
    ]
    for i in range(rounds):
        label = "least(won, n.label)" if i % 2 else "won"
        votes = f"SELECT src, label, round(sum(weight), 9) AS w FROM links JOIN n{i} ON n{i}.node = links.dst GROUP BY ALL"
        parts.append(f"n{i + 1} AS MATERIALIZED (SELECT n.node, {label} AS label, won = n.label AS settled FROM n{i} n JOIN (SELECT src, arg_min(label, (-w, label)) AS won FROM ({votes}) GROUP BY src) v ON v.src = n.node)")
    return f"WITH {', '.join(parts)} SELECT node, label, settled FROM n{rounds}"


@query(_communities_sql(25))
def relation_communities(spark, base):
    """Communities of documents by weighted label propagation over relations."""
    rel = table(spark, base, "evidence_relations")
    weight = F.when(F.lower(F.trim("predicate")).isin("replaces", "amends"), 2.0).otherwise(1.0)
    return graph.communities(rel.select(F.col("subject_document_id").alias("src"), F.col("object_document_id").alias("dst"), weight.alias("weight")))


# --- text -----------------------------------------------------------------------------------------------------------


@query(
    r"""SELECT doc_id, CAST(line_no AS INT) AS line_no, line FROM (SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_no, trim(regexp_replace(unnest(l), '[\s\p{Z}]+', ' ', 'g'), ' ') AS line
      FROM (SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS l FROM documents)) WHERE line <> ''"""
)
def line_blocks(spark, base):
    """The non-empty lines of every text."""
    return segment.lines(table(spark, base, "documents"), ["doc_id"], "text")


_BREAK = "(#+ |第[零〇一二三四五六七八九十百千万\\d]+条|Article \\d+)"


@query(
    f"""WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '\\n{_BREAK}', chr(1) || '\\1', 'g'), chr(1)) AS parts FROM documents WHERE text IS NOT NULL),
      s AS (SELECT doc_id, generate_subscripts(parts, 1) - 1 AS section_no, unnest(parts) AS body FROM p)
      SELECT doc_id, CAST(section_no AS INT) AS section_no, CASE WHEN regexp_matches(body, '^{_BREAK}') THEN left(trim(regexp_replace(string_split(body, chr(10))[1], '^#+ ', ''), ' '), 500) ELSE '' END AS title, CAST(length(body) AS INT) AS n_chars FROM s"""
)
def heading_sections(spark, base):
    """The sections of every text."""
    return segment.sections(table(spark, base, "documents"), ["doc_id"], "text")


def _packed_sql() -> str:
    fits = f"w.used + 1 + r.n <= {segment.SEGMENT_CHARS}"
    return f"""WITH RECURSIVE b AS (SELECT coalesce(document_id, '?' || block_id, '?') AS doc, document_id, coalesce(ordinal, 0) AS ordinal, block_id, max(coalesce(text, '')) AS text FROM document_blocks GROUP BY ALL),
      g AS (SELECT *, CAST(sum(CASE WHEN regexp_matches(text, '{segment.LABEL}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY ordinal RANGE UNBOUNDED PRECEDING) AS BIGINT) AS grp FROM b),
      p AS (SELECT doc, document_id, grp, ordinal // 1000 AS stretch, ordinal, block_id, i, least({segment.SEGMENT_CHARS}, length(text) - i * {segment.SEGMENT_CHARS}) AS n FROM (SELECT *, unnest(range(0, greatest(1, (length(text) + {segment.SEGMENT_CHARS} - 1) // {segment.SEGMENT_CHARS}))) AS i FROM g)),
      r AS (SELECT *, row_number() OVER (PARTITION BY doc, grp, stretch ORDER BY ordinal, block_id, i) AS rn FROM p),
      w AS (SELECT doc, document_id, grp, stretch, ordinal, n, rn, 1 AS k, n AS used FROM r WHERE rn = 1
        UNION ALL SELECT r.doc, r.document_id, r.grp, r.stretch, r.ordinal, r.n, r.rn, CASE WHEN {fits} THEN w.k ELSE w.k + 1 END, CASE WHEN {fits} THEN w.used + 1 + r.n ELSE r.n END FROM w JOIN r ON r.doc = w.doc AND r.grp = w.grp AND r.stretch = w.stretch AND r.rn = w.rn + 1),
      s AS (SELECT doc, document_id, grp, stretch, k, count(*) AS n_blocks, CAST(sum(n) + count(*) - 1 AS BIGINT) AS n_chars, min(ordinal) AS first_ordinal, max(ordinal) AS last_ordinal FROM w GROUP BY ALL),
      o AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc, grp ORDER BY stretch, k) AS INT) AS part FROM s)
      SELECT document_id, grp, part, n_blocks, n_chars, first_ordinal, last_ordinal, 'seg_' || substr(sha256(doc || chr(0) || grp || chr(0) || part), 1, 24) AS segment_id FROM o"""


@query(_packed_sql())
def packed_segments(spark, base):
    """Blocks packed to segments of at most 4,500 characters, a new group at each article or heading."""
    return segment.segments(table(spark, base, "document_blocks").select("document_id", "ordinal", "block_id", "text"))


_RISKS_SQL = " || ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN ',{n}' ELSE '' END" for n, p in T.INSTRUCTION_RISKS.items())


@query(f"SELECT segment_id, substr({_RISKS_SQL}, 2) AS risks FROM segments WHERE {' OR '.join(f"regexp_matches(text, '{p}')" for p in T.INSTRUCTION_RISKS.values())}")
def instruction_risk_scan(spark, base):
    """Segments with text that addresses tools, or with hidden characters."""
    return table(spark, base, "segments").select("segment_id", F.array_join(T.risk_flags(F.col("text")), ",").alias("risks")).where("risks <> ''")


@query(
    f"""WITH x AS (SELECT coalesce(lower(lang), 'none') AS lang, length(coalesce(text, '')) AS n, length(regexp_replace(coalesce(text, ''), '[^{_HAN}]', '', 'g')) AS han FROM documents)
      SELECT lang, count(*) AS documents, CAST(sum(han + ceil((n - han) / 4)) AS BIGINT) AS tokens, CAST(max(han + ceil((n - han) / 4)) AS BIGINT) AS longest FROM x GROUP BY lang"""
)
def token_estimate(spark, base):
    """Estimated tokens of the corpus by language."""
    tokens = T.estimate_tokens(F.col("text"))
    return table(spark, base, "documents").groupBy(F.coalesce(F.lower("lang"), F.lit("none")).alias("lang")).agg(F.count("*").alias("documents"), F.sum(tokens).alias("tokens"), F.max(tokens).alias("longest"))


# --- selection ------------------------------------------------------------------------------------------------------


_CANDIDATES = f"""{_bm25_sql(_QUESTIONS, 'segments', 'segment_id', _SEGMENT_WEIGHTS, 20)},
      cand AS (SELECT r.query_id, r.item_id, r.rank, coalesce(length(s.text), 0) AS size, list_distinct({_terms_sql('s.text')}) AS t FROM ranked r JOIN segments s ON s.segment_id = r.item_id)"""
_FITS = "len(w.ids) < 5 AND w.used + c.size <= 1500"


def _cover_sql(steps: int, most: int) -> str:
    """Greedy cover, each step spelled out: of the items that fit the one adding most uncovered terms."""
    one = "SELECT {state}, c.item_id, c.size, list_filter(d.duties, lambda x: NOT list_contains({covered}, x)) AS news FROM {before} p JOIN cand c ON c.query_id = p.query_id JOIN duties d ON d.query_id = c.query_id AND d.item_id = c.item_id WHERE c.size <= p.room AND len(news) > 0 QUALIFY row_number() OVER (PARTITION BY p.query_id ORDER BY len(news) DESC, c.rank, c.item_id) = 1"
    parts = [f"s0 AS (SELECT DISTINCT query_id, CAST([] AS VARCHAR[]) AS covered, {most} AS room FROM cand)"]
    for i in range(1, steps + 1):
        pick = one.format(state="p.query_id, p.covered, p.room", covered="p.covered", before=f"s{i - 1}")
        parts.append(f"s{i} AS MATERIALIZED (SELECT query_id, covered || news AS covered, room - size AS room, item_id, CAST({i} AS INT) AS place, CAST(len(news) AS INT) AS adds FROM ({pick}))")
    return f"""WITH {_CANDIDATES}, asked_terms AS (SELECT query_id, list_distinct({_terms_sql('text')}) AS q FROM q),
      duties AS (SELECT c.query_id, item_id, list_filter(a.q, lambda x: list_contains(c.t, x)) AS duties FROM cand c JOIN asked_terms a ON a.query_id = c.query_id), {', '.join(parts)}
      {' UNION ALL '.join(f'SELECT query_id, item_id, place, adds FROM s{i}' for i in range(1, steps + 1))}"""


def _candidates(spark, base):
    items = table(spark, base, "segments").select(F.col("segment_id").alias("item_id"), F.length("text").alias("size"), F.array_distinct(T.terms(F.col("text"))).alias("t"))
    return fulltext.bm25(_questions(spark, base), _unique_segments(spark, base), "segment_id", _SEGMENT_WEIGHTS, 20).join(items, "item_id")


@query(
    f"""WITH RECURSIVE {_CANDIDATES},
      w AS (SELECT DISTINCT query_id, 0 AS rank, CAST([] AS VARCHAR[]) AS ids, CAST(0 AS BIGINT) AS used FROM cand
        UNION ALL SELECT w.query_id, c.rank, CASE WHEN {_FITS} THEN list_append(w.ids, c.item_id) ELSE w.ids END, CASE WHEN {_FITS} THEN w.used + c.size ELSE w.used END FROM w JOIN cand c ON c.query_id = w.query_id AND c.rank = w.rank + 1)
      SELECT query_id, array_to_string(arg_max(ids, rank), ',') AS ids, arg_max(used, rank) AS used FROM w GROUP BY query_id"""
)
def budget_first_fit(spark, base):
    """Segments for each question within 1,500 characters and 5 items, skipping what doesn't fit."""
    chosen = fusion.first_fit(_candidates(spark, base), "size", 5, 1500)
    return chosen.select("query_id", F.array_join("ids", ",").alias("ids"), "used")


@query(_cover_sql(5, 3000))
def evidence_cover(spark, base):
    """Segments for each question that together hold most of its terms, within 3,000 characters and 5 items."""
    asked = _questions(spark, base).select("query_id", F.array_distinct(T.terms(F.col("text"))).alias("q"))
    cands = _candidates(spark, base).join(asked, "query_id").withColumn("duties", F.array_intersect("q", "t"))
    return fusion.greedy_cover(cands.select("query_id", "item_id", "rank", "size", "duties"), 5, 3000)


# --- ledger and percentiles -----------------------------------------------------------------------------------------


@query(
    """WITH x AS (SELECT event_id, sha256(concat_ws('|', CAST(event_id AS VARCHAR), CAST(user_id AS VARCHAR), coalesce(event_type, ''), coalesce(props, ''))) AS h FROM events)
      SELECT CAST(event_id // 1000 AS BIGINT) AS block_no, count(*) AS n_events, max(event_id) - min(event_id) + 1 - count(DISTINCT event_id) AS missing, sha256(string_agg(h, '' ORDER BY event_id, h)) AS digest FROM x GROUP BY 1"""
)
def audit_block_digests(spark, base):
    """Digests of the event ledger by blocks of a thousand sequence numbers."""
    return audit.block_digests(table(spark, base, "events"), "event_id", audit.content_hash(F.col("event_id"), F.col("user_id"), F.col("event_type"), F.col("props")))


@query(
    """WITH r AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
      SELECT l_returnflag, max(n) AS n, max(CASE WHEN i = n // 2 THEN v END) AS p50, max(CASE WHEN i = greatest(0, CAST(floor(n * 0.95) AS BIGINT) - 1) THEN v END) AS p95 FROM r GROUP BY l_returnflag"""
)
def exact_percentiles(spark, base):
    """Index percentiles of prices by return flag."""
    return evaluation.index_percentiles(table(spark, base, "lineitem"), "l_returnflag", "l_extendedprice")


@query(
    """SELECT n_name, count(DISTINCT o_orderkey) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
      JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY n_name"""
)
def star_join(spark, base):
    """Revenue of one region's nations: a five-way join with filters that reach the scans."""
    t = lambda name: table(spark, base, name)
    orders = t("orders").where((F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz")))
    asia = t("nation").join(t("region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = t("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(asia, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count_distinct("o_orderkey").alias("orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


# --- listings, resolution, integrity --------------------------------------------------------------------------------


@query(
    """WITH f AS (SELECT DISTINCT block_id, document_id, unnest(from_json(CASE WHEN risk_flags_json IS NULL OR trim(risk_flags_json) = '' THEN '[]' ELSE risk_flags_json END, '["VARCHAR"]')) AS flag FROM document_blocks)
      SELECT flag, count(*) AS blocks, count(DISTINCT document_id) AS documents FROM f GROUP BY flag"""
)
def risk_flag_counts(spark, base):
    """Blocks and documents by flag inside the JSON arrays of risk flags."""
    flags = F.explode(F.from_json("risk_flags_json", "array<string>")).alias("flag")
    once = table(spark, base, "document_blocks").select("block_id", "document_id", flags).distinct()
    return once.groupBy("flag").agg(F.count("*").alias("blocks"), F.count_distinct("document_id").alias("documents"))


@query(
    f"""WITH {_HELD}, names AS (SELECT lower(trim(unnest(string_split(normalized_names, ' ')))) AS name, document_id, source_key FROM held WHERE normalized_names IS NOT NULL)
      SELECT name, count(DISTINCT document_id) AS candidates, min(document_id) AS first_candidate, CASE WHEN count(DISTINCT document_id) = 1 THEN 'resolved' WHEN count(DISTINCT source_key) = 1 THEN 'versions' ELSE 'ambiguous' END AS status
      FROM names WHERE name <> '' GROUP BY name"""
)
def resolve_names(spark, base):
    """What each name of the catalogue stands for: one document, versions of one source, or several."""
    names = _titles(spark, base).where("normalized_names is not null").select(F.explode(F.split("normalized_names", " ")).alias("name"), "document_id", "source_key")
    names = names.withColumn("name", F.lower(F.trim("name"))).where("name <> ''")
    status = F.when(F.col("candidates") == 1, "resolved").when(F.col("sources") == 1, "versions").otherwise("ambiguous")
    found = names.groupBy("name").agg(F.count_distinct("document_id").alias("candidates"), F.min("document_id").alias("first_candidate"), F.count_distinct("source_key").alias("sources"))
    return found.select("name", "candidates", "first_candidate", status.alias("status"))


@query(
    """WITH r AS (SELECT DISTINCT source_id, source_key, status, recorded_at FROM source_lifecycle ORDER BY recorded_at DESC, source_id, status LIMIT 500)
      SELECT *, CAST((row_number() OVER (ORDER BY recorded_at DESC, source_id, status) - 1) // 100 AS INT) AS shard FROM r"""
)
def recent_changes(spark, base):
    """The newest 500 lifecycle records in shards of 100."""
    newest = table(spark, base, "source_lifecycle").select("source_id", "source_key", "status", "recorded_at").distinct().orderBy(F.desc("recorded_at"), "source_id", "status").limit(500)
    # 500 rows at most: numbering them in one task is bounded.
    place = F.row_number().over(Window.orderBy(F.desc("recorded_at"), "source_id", "status"))
    return newest.withColumn("shard", F.floor((place - 1) / 100).cast("int"))


@query(
    f"""WITH {_bm25_sql(_QUESTIONS, 'segments', 'segment_id', _SEGMENT_WEIGHTS, 20)},
      d AS (SELECT r.query_id, s.document_id, r.item_id, r.score FROM scored r JOIN segments s ON s.segment_id = r.item_id QUALIFY row_number() OVER (PARTITION BY r.query_id, s.document_id ORDER BY r.score DESC, r.item_id) = 1)
      SELECT query_id, document_id, item_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INT) AS rank FROM d QUALIFY rank <= 3"""
)
def document_representatives(spark, base):
    """The best segment of each document, the best 3 of them, for each question."""
    items = table(spark, base, "segments").select("segment_id", "document_id", *_SEGMENT_WEIGHTS)
    best = fulltext.bm25(_questions(spark, base), items, "segment_id", _SEGMENT_WEIGHTS, 3, group="document_id")
    return best.select("query_id", "document_id", "item_id", "score", "rank")


@query(
    f"""WITH {_bm25_sql(_QUESTIONS, 'segments', 'segment_id', _SEGMENT_WEIGHTS, 10)},
      other AS (WITH {_bm25_sql(_QUESTIONS, 'segments', 'segment_id', {'text': 1.0}, 10)} SELECT * FROM ranked)
      SELECT coalesce(a.query_id, b.query_id) AS query_id, count(a.item_id) AS weighted, count(b.item_id) AS plain, count(CASE WHEN a.item_id IS NOT NULL AND b.item_id IS NOT NULL THEN 1 END) AS shared
      FROM ranked a FULL JOIN other b ON a.query_id = b.query_id AND a.item_id = b.item_id GROUP BY 1"""
)
def channel_agreement(spark, base):
    """How many of the 10 best segments of two ways of ranking are the same."""
    asked, index = _segment_index(spark, base)
    a = fulltext.score(asked, index, list(_SEGMENT_WEIGHTS.values()), 10).select("query_id", "item_id", F.lit(1).alias("a"))
    b = fulltext.score(asked, index, [0.0, 0.0, 1.0], 10).select("query_id", "item_id", F.lit(1).alias("b"))
    return a.join(b, ["query_id", "item_id"], "full_outer").groupBy("query_id").agg(F.count("a").alias("weighted"), F.count("b").alias("plain"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"))


@query(
    f"""WITH {_HELD}, v AS (SELECT document_id, lead(document_id) OVER (PARTITION BY source_key ORDER BY {_date_sql('effective_from')} NULLS FIRST, document_id) AS next_id FROM held WHERE source_key IS NOT NULL),
      s AS (SELECT document_id, text_sha256 AS h, min(ordinal) AS ordinal, count(*) AS n FROM segments GROUP BY ALL)
      SELECT v.document_id AS old_id, v.next_id AS new_id, count(*) AS segments, count(CASE WHEN b.ordinal = a.ordinal THEN 1 END) AS unchanged, count(CASE WHEN b.ordinal <> a.ordinal THEN 1 END) AS moved, count(CASE WHEN b.ordinal IS NULL THEN 1 END) AS missing
      FROM v JOIN s a ON a.document_id = v.document_id LEFT JOIN s b ON b.document_id = v.next_id AND b.h = a.h WHERE v.next_id IS NOT NULL GROUP BY ALL"""
)
def fragment_moves(spark, base):
    """How many distinct segments of a version stand unchanged, moved or not at all in the next version."""
    held = temporal.latest_per_key(table(spark, base, "source_documents"), ["document_id"], ["recorded_at"]).where("source_key is not null")
    v = temporal.following(held.select("document_id", "source_key", parse_date(F.col("effective_from")).alias("at")), "source_key", "at", "document_id", "new_id").where("new_id is not null").select(F.col("document_id").alias("old_id"), "new_id")
    s = table(spark, base, "segments").groupBy("document_id", F.col("text_sha256").alias("h")).agg(F.min("ordinal").alias("ordinal"))
    old = v.join(s.withColumnRenamed("document_id", "old_id").withColumnRenamed("ordinal", "a"), "old_id")
    both = old.join(s.withColumnRenamed("document_id", "new_id").withColumnRenamed("ordinal", "b"), ["new_id", "h"], "left")
    return both.groupBy("old_id", "new_id").agg(
        F.count("*").alias("segments"), F.count_if(F.col("a") == F.col("b")).alias("unchanged"), F.count_if(F.col("a") != F.col("b")).alias("moved"), F.count_if(F.col("b").isNull()).alias("missing")
    )


_NOT = r"(?i)\b(shall|may|must|does|is) not\b|不得|不应|未"


@query(
    rf"""WITH s AS (SELECT DISTINCT trim(regexp_replace(unnest(regexp_split_to_array(regexp_replace(text, '\d+', '#', 'g'), '[。；，\n]|[.,] ')), '\s+', ' ', 'g')) AS clause FROM segments),
      k AS (SELECT trim(regexp_replace(regexp_replace(clause, '{_NOT}', '', 'g'), '\s+', ' ', 'g')) AS bare, regexp_matches(clause, '{_NOT}') AS negated FROM s)
      SELECT bare, count_if(negated) AS negated, count_if(NOT negated) AS plain FROM k WHERE bare <> '' GROUP BY bare HAVING count_if(negated) > 0 AND count_if(NOT negated) > 0"""
)
def contradictions(spark, base):
    """Clauses that stand both with and without a negation, numbers aside; one row per clause, not per pair."""
    parts = F.explode(F.split(F.regexp_replace("text", r"\d+", "#"), r"[。；，\n]|[.,] ")).alias("clause")
    clauses = table(spark, base, "segments").select(parts).select(F.trim(F.regexp_replace("clause", r"\s+", " ")).alias("clause")).distinct()
    bare = F.trim(F.regexp_replace(F.regexp_replace("clause", _NOT, ""), r"\s+", " "))
    keyed = clauses.select(bare.alias("bare"), F.col("clause").rlike(_NOT).alias("negated"))
    return keyed.where("bare <> ''").groupBy("bare").agg(F.count_if("negated").alias("negated"), F.count_if(~F.col("negated")).alias("plain")).where("negated > 0 and plain > 0")


@query(
    """WITH r AS (SELECT * FROM evidence_relations QUALIFY row_number() OVER (PARTITION BY relation_id ORDER BY recorded_at DESC) = 1),
      s AS (SELECT segment_id, document_id, text_sha256, sha256(text) AS real FROM segments)
      SELECT r.provenance_segment_id IS NOT NULL AS has_segment, s.segment_id IS NOT NULL AS segment_found, coalesce(s.document_id = r.subject_document_id, false) AS same_document,
        coalesce(s.text_sha256 = r.evidence_sha256, false) AS same_hash, coalesce(s.real = s.text_sha256, false) AS hash_holds, count(*) AS relations
      FROM r LEFT JOIN s ON s.segment_id = r.provenance_segment_id GROUP BY ALL"""
)
def citation_audit(spark, base):
    """Relations by the checks that their evidence passes: segment there, of the subject, hashes equal and true."""
    held = temporal.latest_per_key(table(spark, base, "evidence_relations").select("relation_id", "recorded_at", "subject_document_id", "provenance_segment_id", "evidence_sha256"), ["relation_id"], ["recorded_at"])
    segs = table(spark, base, "segments").select(F.col("segment_id").alias("provenance_segment_id"), "document_id", "text_sha256", F.sha2("text", 256).alias("real"), F.lit(True).alias("there"))
    no = F.lit(False)
    return held.join(segs, "provenance_segment_id", "left").groupBy(
        F.col("provenance_segment_id").isNotNull().alias("has_segment"), F.col("there").isNotNull().alias("segment_found"), F.coalesce(F.col("document_id") == F.col("subject_document_id"), no).alias("same_document"),
        F.coalesce(F.col("text_sha256") == F.col("evidence_sha256"), no).alias("same_hash"), F.coalesce(F.col("real") == F.col("text_sha256"), no).alias("hash_holds"),
    ).agg(F.count("*").alias("relations"))


@query(
    """SELECT doc_id, CAST(i AS INT) AS window_no, sha256(substr(text, i * 2000 + 1, 2000)) AS digest, CAST(length(substr(text, i * 2000 + 1, 2000)) AS INT) AS n_chars
      FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 2000) AS BIGINT))) AS i FROM documents WHERE length(text) > 0)"""
)
def text_windows(spark, base):
    """Texts in windows of 2,000 characters with their digests, row by row."""
    docs = table(spark, base, "documents").where(F.length("text") > 0)
    parts = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?s).{1,2000}"), F.lit(0))).alias("window_no", "part"))
    return parts.select("doc_id", "window_no", F.sha2("part", 256).alias("digest"), F.length("part").alias("n_chars"))


@query(
    """SELECT 'relation subject' AS reference, count(*) AS dangling FROM evidence_relations WHERE subject_document_id IS NOT NULL AND subject_document_id NOT IN (SELECT document_id FROM source_documents)
      UNION ALL SELECT 'relation object', count(*) FROM evidence_relations WHERE object_document_id IS NOT NULL AND object_document_id NOT IN (SELECT document_id FROM source_documents UNION SELECT document_id FROM core_documents)
      UNION ALL SELECT 'relation segment', count(*) FROM evidence_relations WHERE provenance_segment_id IS NOT NULL AND provenance_segment_id NOT IN (SELECT segment_id FROM segments)
      UNION ALL SELECT 'text document', count(*) FROM documents WHERE document_id IS NOT NULL AND document_id NOT IN (SELECT document_id FROM source_documents)"""
)
def integrity_checks(spark, base):
    """References that lead nowhere, by kind; a kind without any has 0."""
    ids = lambda name, column: table(spark, base, name).select(F.col(column).alias("k"))
    checks = [
        ("relation subject", ids("evidence_relations", "subject_document_id"), ids("source_documents", "document_id")),
        ("relation object", ids("evidence_relations", "object_document_id"), ids("source_documents", "document_id").union(ids("core_documents", "document_id"))),
        ("relation segment", ids("evidence_relations", "provenance_segment_id"), ids("segments", "segment_id")),
        ("text document", ids("documents", "document_id"), ids("source_documents", "document_id")),
    ]
    out = None
    for name, a, b in checks:
        n = a.where("k is not null").join(b.distinct(), "k", "left_anti").agg(F.count("*").alias("dangling")).select(F.lit(name).alias("reference"), "dangling")
        out = n if out is None else out.unionByName(n)
    return out


@query(
    """WITH e AS (SELECT DISTINCT user_id, ts FROM events), g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM e),
      s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
      SELECT user_id, min(ts) AS started, max(ts) AS last_event FROM s GROUP BY user_id, session"""
)
def event_sessions(spark, base):
    """Sessions of each user's events, apart by more than half an hour: merged intervals, in shards of a day for busy users."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    half_hour, day = 30 * 60 * 1_000_000, 24 * 3600 * 1_000_000
    spans = table(spark, base, "events").select("user_id", at.alias("a"), (at + half_hour).alias("b"))
    found = merge_intervals(spans, ["user_id"], "a", "b", day)
    moment = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return found.select("user_id", moment(F.col("s")).alias("started"), moment(F.col("e") - half_hour).alias("last_event"))


@query(
    """SELECT jurisdiction, count(*) AS documents, bit_xor(CAST('0x' || substr(sha256(document_id), 1, 12) AS BIGINT)) AS digest FROM (SELECT DISTINCT jurisdiction, document_id FROM source_documents) GROUP BY jurisdiction"""
)
def membership_digests(spark, base):
    """A digest of the set of documents of each jurisdiction code, the same in any order, so that it adds up in parts."""
    ids = table(spark, base, "source_documents").select("jurisdiction", "document_id").distinct()
    return ids.groupBy("jurisdiction").agg(F.count("*").alias("documents"), F.bit_xor(F.conv(F.substring(F.sha2("document_id", 256), 1, 12), 16, 10).cast("long")).alias("digest"))


@query(
    r"""WITH l AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '`[^`\n]*`', '', 'g'), '\[\[([^\[\]\n]+)\]\]', 1)) AS target FROM documents),
      n AS (SELECT DISTINCT lower(trim(alias)) AS name, source_key FROM (SELECT unnest(from_json(aliases_json, '["VARCHAR"]')) AS alias, source_key FROM source_documents WHERE aliases_json IS NOT NULL AND source_key IS NOT NULL
        UNION SELECT title, source_key FROM source_documents WHERE source_key IS NOT NULL AND title IS NOT NULL)),
      c AS (SELECT name, count(*) AS k FROM n GROUP BY name)
      SELECT target, count(*) AS links, count(DISTINCT doc_id) AS pages, CASE WHEN max(k) IS NULL THEN 'missing' WHEN max(k) = 1 THEN 'resolved' ELSE 'ambiguous' END AS status
      FROM l LEFT JOIN c ON c.name = lower(trim(regexp_extract(target, '^([^|#]+)', 1))) GROUP BY target"""
)
def wiki_link_index(spark, base):
    """Targets of [[links]] in the corpus, how often they stand, and whether a title or alias answers to them."""
    docs = table(spark, base, "source_documents").where("source_key is not null")
    aliases = docs.where("aliases_json is not null").select(F.explode(F.from_json("aliases_json", "array<string>")).alias("name"), "source_key")
    names = aliases.unionByName(docs.where("title is not null").select(F.col("title").alias("name"), "source_key")).withColumn("name", F.trim("name"))
    pages = table(spark, base, "documents").where(F.contains("text", F.lit("[["))).select(F.col("doc_id").alias("page_id"), F.col("text").alias("body"))
    links = graph.resolve_links(graph.wiki_links(pages), names.withColumnRenamed("source_key", "page_id"))
    return links.groupBy("target").agg(F.count("*").alias("links"), F.count_distinct("page_id").alias("pages"), F.max("status").alias("status"))


@query(
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents WHERE text IS NOT NULL),
      f AS (SELECT *, regexp_matches(line, '^\s*(```|~~~)') AS fence, first_value(line) OVER (PARTITION BY doc_id ORDER BY n) AS head FROM l),
      c AS (SELECT *, coalesce(sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside, min(CASE WHEN n > 0 AND line = '---' THEN n END) OVER (PARTITION BY doc_id) AS closing FROM f),
      k AS (SELECT doc_id, line, CASE WHEN head = '---' AND n > 0 AND n < closing AND regexp_matches(line, '^[\w-]+:') THEN 'property' WHEN fence THEN NULL WHEN inside THEN 'code' WHEN regexp_matches(line, '^#{1,6} ') THEN 'heading'
          WHEN regexp_matches(line, '^\s*([-*+]|\d+[.)]) ') THEN 'list_item' WHEN length(line) - length(replace(line, '|', '')) >= 2 THEN 'table' END AS kind FROM c)
      SELECT kind, CASE WHEN kind = 'heading' THEN CAST(length(regexp_extract(line, '^#+')) AS INT) END AS level, count(*) AS lines, count(DISTINCT doc_id) AS texts FROM k WHERE kind IS NOT NULL GROUP BY ALL"""
)
def markdown_nodes(spark, base):
    """Headings, list items, table and code lines of the corpus by kind and source."""
    docs = table(spark, base, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    return files.markdown_nodes(docs).groupBy("kind", "level").agg(F.count("*").alias("lines"), F.count_distinct("path").alias("texts"))


@query(
    """WITH b AS (SELECT DISTINCT document_id, ordinal, block_id, text FROM document_blocks WHERE text IS NOT NULL)
      SELECT document_id, ordinal, 'block_' || substr(sha256(document_id || chr(0) || CAST(ordinal AS VARCHAR) || chr(0) || sha256(text)), 1, 24) AS content_id, CAST(length(text) AS INT) AS n_chars FROM b"""
)
def block_content_ids(spark, base):
    """Blocks once each, with an id made of document, place and content."""
    once = table(spark, base, "document_blocks").where("text is not null").select("document_id", "ordinal", "block_id", "text").distinct()
    return once.select("document_id", "ordinal", T.stable_id("block", F.col("document_id"), F.col("ordinal"), F.sha2("text", 256)).alias("content_id"), F.length("text").alias("n_chars"))


@query(
    f"""WITH RECURSIVE {_CANDIDATES}, best AS (SELECT *, count(*) OVER (PARTITION BY query_id) - rank AS after FROM cand WHERE rank <= 6),
      w AS (SELECT DISTINCT query_id, CAST(NULL AS VARCHAR) AS item_id, 0 AS rank, CAST(0 AS BIGINT) AS share, CAST(2000 AS BIGINT) AS room FROM best
        UNION ALL SELECT w.query_id, b.item_id, b.rank, greatest(0, least(b.size, w.room - b.after * 150)), w.room - greatest(0, least(b.size, w.room - b.after * 150)) FROM w JOIN best b ON b.query_id = w.query_id AND b.rank = w.rank + 1)
      SELECT query_id, item_id, CAST(rank AS INT) AS rank, share FROM w WHERE rank > 0"""
)
def context_shares(spark, base):
    """How 2,000 characters are shared among the 6 best segments of each question, 150 kept for each one still to come."""
    best = _candidates(spark, base).where("rank <= 6")
    return fusion.fair_share(best, "size", 2000, 150).select("query_id", "item_id", "rank", "share")
