"""Problem 6: evaluation texts leaking into training text.

A broadcast set of normalised test n-grams, and one pass over the corpus: every window of 12 words, or of 24 letters,
digits and Han characters, of every text is hashed in numpy and looked up in the set; hits are verified against the
items' own n-grams. The corpus is never shuffled; only the hits are.

The set is bounded: it holds at most ``MAX_GRAMS`` n-grams at a time. A larger test set is taken in blocks of items of
that size, each scanned against all rows, so nothing is dropped and nothing larger is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.codepoints import Rolling, Slice, slices, tables
from palimpsest.plans.session import cut, in_arrow, table

WORDS, CHARS = 12, 24
MAX_GRAMS = 4_000_000
_BITS = 22


def _words(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(folded code points, begin and end of each word, text of each word)."""
    lower, alnum = tables()
    inside = alnum[s.cp]
    folded = lower[s.cp]
    edge = np.zeros(len(inside) + 1, dtype=bool)
    edge[s.begin] = edge[s.end] = True
    before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~edge[1:]
    begin, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return folded, begin, end, np.searchsorted(s.end, begin, side="right")


def _word_grams(s: Slice) -> tuple[np.ndarray, np.ndarray, callable]:
    """(hash, text) of each window of successive words, and a function giving the window's words as one string."""
    folded, begin, end, text = _words(s)
    if len(begin) < WORDS:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), None
    h = Rolling(Rolling(folded).at(begin, end)).all(WORDS)
    ok = text[: len(h)] == text[WORDS - 1 :]
    h = np.where(ok, h, np.uint64(0))

    def spell(i: int) -> str:
        return " ".join("".join(map(chr, folded[begin[j] : end[j]])) for j in range(i, i + WORDS))

    return h, text[: len(h)], spell


def _char_grams(s: Slice) -> tuple[np.ndarray, np.ndarray, callable]:
    """The same for windows of successive letters, digits and Han characters, whatever stands between them."""
    lower, alnum = tables()
    at = np.flatnonzero(alnum[s.cp])
    if len(at) < CHARS:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), None
    c = lower[s.cp[at]]
    text = np.searchsorted(s.end, at, side="right")
    h = Rolling(c).all(CHARS)
    h = np.where(text[: len(h)] == text[CHARS - 1 :], h, np.uint64(0))

    def spell(i: int) -> str:
        return "".join(map(chr, c[i : i + CHARS]))

    return h, text[: len(h)], spell


_GRAMS = {"en": _word_grams, "zh": _char_grams}


def item_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-grams of each item (item_id, passage, lang): item_id, lang, hash, gram."""
    for batch in batches:
        langs = batch.column(2).to_pylist()
        for s in slices(batch.column(0), batch.column(1)):
            for lang, grams in _GRAMS.items():
                h, text, spell = grams(s)
                keep = [i for i in np.flatnonzero(h) if langs[s.rows[text[i]]] == lang]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.ids[text[keep]], pa.int64()), pa.array([lang] * len(keep), pa.string()), pa.array(h[keep].view(np.int64)), pa.array([spell(i) for i in keep], pa.string())],
                    names=["item_id", "lang", "h", "gram"],
                )


class _Lookup:
    """Is a hash in the set: first a bitmap over its low bits, then a binary search for what passes."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        self.bitmap = np.zeros(1 << _BITS, dtype=bool)
        self.bitmap[self.sorted & np.uint64((1 << _BITS) - 1)] = True

    def hits(self, h: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.bitmap[h & np.uint64((1 << _BITS) - 1)])
        if not len(maybe) or not len(self.sorted):
            return maybe[:0]
        at = np.minimum(np.searchsorted(self.sorted, h[maybe]), len(self.sorted) - 1)
        return maybe[self.sorted[at] == h[maybe]]


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = {lang: _Lookup(h) for lang, h in shared.value.items()}
        for batch in batches:
            for s in slices(batch.column(0), batch.column(1)):
                ids, langs, hashes, grams = [], [], [], []
                for lang, make in _GRAMS.items():
                    h, text, spell = make(s)
                    for i in sets[lang].hits(h) if lang in sets and len(h) else ():
                        if h[i]:
                            ids.append(int(s.ids[text[i]]))
                            langs.append(lang)
                            hashes.append(int(h[i].view(np.int64)))
                            grams.append(spell(i))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(hashes, pa.int64()), pa.array(grams, pa.string())], names=["id", "lang", "h", "gram"])

    return run


def leaked_grams(texts: DataFrame, items: DataFrame, max_grams: int = MAX_GRAMS) -> DataFrame:
    """(id, item_id, gram): test n-grams that stand in the texts.

    ``texts`` has a bigint ``id`` and ``text``; ``items`` has item_id, passage, lang. Items in other languages than en
    and zh, null and short passages have no n-grams. Case is ignored, and everything that is not a letter or digit;
    repeated rows give one result row. An empty side gives an empty result.
    """
    spark = texts.sparkSession
    grams = cut(gram_table(items))
    total = grams.count()
    blocks = max(1, -(-total // max_grams))
    result = None
    for block in range(blocks):
        part = grams if blocks == 1 else grams.where(F.pmod(F.xxhash64("h"), F.lit(blocks)) == block)
        hashes = {lang: part.where(F.col("lang") == lang).select("h").distinct().toArrow().column("h").combine_chunks().to_numpy().view(np.uint64) for lang in _GRAMS}
        shared = spark.sparkContext.broadcast(hashes)
        hits = in_arrow(texts.select("id", "text"), _scan(shared), "id bigint, lang string, h bigint, gram string")
        found = hits.distinct().join(part, ["lang", "h", "gram"]).select("id", "item_id", "gram")
        # With many blocks each one's hits become a table, so that the plan does not grow with them.
        found = found if blocks == 1 else cut(found)
        result = found if result is None else result.unionByName(found)
    return result.distinct()


def gram_table(items: DataFrame) -> DataFrame:
    """(item_id, lang, h, gram): the distinct n-grams of items (item_id, passage, lang)."""
    plain = items.select(F.col("item_id").cast("long"), "passage", F.lower(F.trim("lang")).alias("lang"))
    return in_arrow(plain, item_grams, "item_id bigint, lang string, h bigint, gram string").distinct()


def _inputs(spark, base: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, base, "documents").select(F.col("doc_id").alias("id"), "text"), table(spark, base, "eval_items")


def found(spark, base: str) -> DataFrame:
    """p6_found: the corpus documents that hold a run of an item's passage, and the items."""
    return leaked_grams(*_inputs(spark, base)).select(F.col("id").alias("doc_id"), "item_id").distinct()


def leaked_items(spark, base: str) -> DataFrame:
    """p6_items: each leaked item with the number of documents that hold a part of it and the share of its n-grams found."""
    texts, items = _inputs(spark, base)
    hits = leaked_grams(texts, items)
    size = gram_table(items).groupBy("item_id").agg(F.countDistinct("gram").alias("grams"))
    return hits.groupBy("item_id").agg(F.countDistinct("id").alias("documents"), F.countDistinct("gram").alias("n")).join(size, "item_id").select(
        "item_id", "documents", F.round(F.col("n") / F.col("grams"), 6).alias("share_found")
    )


def clean_documents(spark, base: str) -> DataFrame:
    """p6_clean: doc_id and text length of the documents that remain after leaked ones are removed."""
    docs = table(spark, base, "documents").select("doc_id", F.length("text").alias("n_chars"))
    return docs.join(found(spark, base).select("doc_id").distinct(), "doc_id", "left_anti")
