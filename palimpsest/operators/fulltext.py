"""Full-text retrieval over batches of queries: BM25, exact, phrase, typo and name-mention channels.

Every channel returns (query_id, item_id, score or evidence). The corpus is scanned once for all queries: terms that no
query asks for are dropped inside the row, so only hits are shuffled, never the postings of the whole corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.functions.text import terms
from palimpsest.operators.fusion import diverse
from palimpsest.plans.session import cut, small

K1, B = 1.2, 0.75


def asked_terms(queries: DataFrame, make=terms) -> DataFrame:
    """(query_id, term): the distinct terms of queries (query_id, text), as a table. ``make`` takes a text to its terms."""
    return cut(queries.select("query_id", F.explode(F.array_distinct(make(F.col("text")))).alias("term")))


def postings(asked: DataFrame, items: DataFrame, item: str, columns: list[str], *more: str, make=terms) -> DataFrame:
    """(item_id, term, more, f, d) of the asked terms, as a table: counts of the term and lengths of the item, by column.

    One pass over the texts, each tokenized once; it serves every weighting of the columns. Each item has one more row
    with the empty term, so that the corpus' size and mean length come from this table too. Null columns are empty.
    """

    def terms_of(i: int) -> Column:
        return F.transform(make(F.col(columns[i])), lambda t: F.struct(t.alias("term"), F.lit(i).alias("c")))

    n = range(len(columns))
    listed = items.select(F.col(item).alias("item_id"), *more, *[terms_of(i).alias(f"x{i}") for i in n])
    empty = F.array(F.struct(F.lit("").alias("term"), F.lit(-1).alias("c")))
    each = listed.select("item_id", *more, F.array(*[F.size(f"x{i}") for i in n]).alias("d"), F.explode(F.concat(empty, *[F.col(f"x{i}") for i in n])).alias("x"))
    wanted = asked.select("term").distinct()
    wanted = wanted.unionByName(wanted.sparkSession.createDataFrame([("",)], "term string"))
    kept = each.select("item_id", *more, "d", "x.term", "x.c").join(small(wanted), "term", "left_semi")
    return cut(kept.groupBy("item_id", "term", *more).agg(F.array(*[F.count_if(F.col("c") == i) for i in n]).alias("f"), F.max("d").alias("d")))


def score(asked: DataFrame, index: DataFrame, weights: list[float], k: int, group: str | None = None) -> DataFrame:
    """Best ``k`` items of each query by BM25 over ``postings``, whose columns have the ``weights``; as ``bm25``.

    A column of weight 0 takes no part, neither in counts nor in lengths.
    """
    used = [i for i, w in enumerate(weights) if w]
    f = sum((F.col("f")[i] * float(weights[i]) for i in used), F.lit(0.0))
    d = sum((F.col("d")[i] for i in used), F.lit(0)).cast("double")
    weighted = index.select("item_id", "term", *[group] * bool(group), f.alias("f"), d.alias("d"))
    hits = weighted.where("term <> '' and f > 0")
    whole = F.broadcast(weighted.where("term = ''").agg(F.count("*").alias("n_items"), F.avg("d").alias("mean")))  # one row
    df = hits.groupBy("term").agg(F.count("*").alias("n"))
    idf = F.greatest(F.ln((F.col("n_items") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(1e-6))
    per_term = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("d") / F.col("mean")))
    total = F.round(F.sum(per_term), 6).alias("score")
    idfs = small(asked.join(df, "term").join(whole))
    if not group:
        return top(hits.join(idfs, "term").groupBy("query_id", "item_id").agg(total), k)
    # An item's postings lie in one bucket, where it is scored; of a bucket the best k groups of each query go on, as a
    # group's best item is the best of its bucket too and at most k - 1 groups there are better.
    buckets = 4 * int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = hits.withColumn("_bucket", F.pmod(F.xxhash64("item_id"), F.lit(buckets)).cast("int")).repartitionById(buckets, "_bucket")
    scored = spread.join(idfs, "term").groupBy("_bucket", "query_id", group, "item_id").agg(total)
    return diverse(diverse(scored, group, k, "_bucket"), group, k).drop("_bucket")


def bm25(queries: DataFrame, items: DataFrame, item: str, weights: dict[str, float], k: int, group: str | None = None) -> DataFrame:
    """Best ``k`` items of each query (query_id, text) by BM25: query_id, item_id, score (6 decimals), rank.

    With ``group``, a column of ``items``, the best item of each of the best ``k`` groups of all items found, and that
    column too; null groups are one group.
    ``weights`` multiply the counts in the columns. Terms count once per query. Equal scores rank by item_id. Queries and
    items without terms find nothing. Item ids are unique. The inverse document frequency has a floor of 1e-6.
    """
    asked = asked_terms(queries)
    return score(asked, postings(asked, items, item, list(weights), *[group] * bool(group)), list(weights.values()), k, group)


def top(scores: DataFrame, k: int) -> DataFrame:
    """Best ``k`` per query by score, then item_id, with their rank. Spark keeps k per task before the shuffle (window group limit)."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id"))
    return scores.withColumn("rank", place).where(F.col("rank") <= k)


def osa_is_one(a: Column, b: Column) -> Column:
    """Optimal string alignment distance of exactly one: an edit, or a swap of neighbours."""
    swap = (F.length(a) == F.length(b)) & F.exists(
        F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))),
        lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))) == b,
    )
    return (a != b) & ((F.levenshtein(a, b, 1) == 1) | swap)


def typo_matches(words: DataFrame, vocabulary: DataFrame, prefix: int = 0) -> DataFrame:
    """(word, candidate): vocabulary entries at distance one, whose first ``prefix`` letters are the same.

    Both inputs have distinct ``word``. The words meet on their forms with one letter deleted, an equi-join, and are then
    checked; words under four letters have no candidates.
    """

    def forms(df: DataFrame, name: str) -> DataFrame:
        w = F.col("word")
        less = F.transform(F.sequence(F.lit(prefix + 1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
        return df.where(F.length("word") >= 4).withColumn("form", F.explode(F.array_distinct(F.concat(F.array(w), less)))).withColumnRenamed("word", name)

    return forms(words, "word").join(forms(vocabulary, "candidate"), "form").where(osa_is_one(F.col("word"), F.col("candidate"))).where(F.substring("word", 1, prefix) == F.substring("candidate", 1, prefix)).select("word", "candidate").distinct()


def mentions(names: DataFrame, texts: DataFrame) -> DataFrame:
    """(name_id, item_id): texts that contain a name, not as a part of a longer word or number of the letters a-z.

    ``names`` has name_id, name; ``texts`` has item_id, text. Each name is looked up by its term that the fewest names
    have, then checked by containment, so no name is compared with every text. Names without terms and null texts find
    nothing; repeated rows give one row.
    """
    texts = texts.select("item_id", "text")
    keyed = names.where(F.length("name") > 0).select("name_id", "name", F.explode(F.array_distinct(terms(F.col("name")))).alias("term"))
    common = keyed.groupBy("term").agg(F.count("*").alias("names"))
    keys = cut(keyed.join(common, "term").groupBy("name_id", "name").agg(F.min(F.struct("names", "term"))["term"].alias("term")))
    found = texts.where("text is not null").select("item_id", F.array_distinct(terms(F.col("text"))).alias("t"))
    hits = found.select("item_id", F.explode("t").alias("term")).join(small(keys), "term").select("item_id", "name_id", "name")
    edge = "(?:(?<![A-Za-z0-9])|(?![A-Za-z0-9]))"
    phrase = F.concat(F.lit(edge + r"\Q"), "name", F.lit(r"\E(?:(?![A-Za-z0-9])|(?<![A-Za-z0-9]))"))
    return hits.join(texts, "item_id").where(F.col("text").contains(F.col("name"))).where(F.rlike("text", phrase)).select("name_id", "item_id").distinct()
