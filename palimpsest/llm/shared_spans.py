"""Problem 8: long exact spans shared between records, by level-wise doubling of repeated windows.

Anchors. Of the ``span - quarter + 1`` windows of length ``quarter`` (75) inside each window of ``span`` (300)
characters, the one with the least hash (the leftmost of equals) is its anchor. The choice depends on those 300
characters alone, so two records that share 300 characters share the anchor. Each 300-window has one anchor, and the
windows of one anchor start at neighbouring positions [lo, hi]; there is about one anchor per 113 characters.

Levels. Anchors whose 75 characters occur in one record only are dropped; the others are doubled to 150 characters,
to the right and to the left (one of the two lies in any shared 300-window around the anchor), and dropped if neither
occurs elsewhere; then come the anchor's whole hull [lo, hi + 300). A hull that occurs in another record settles all
its windows with one row. What is left are anchors at the edges of shared spans: only their windows are hashed one by
one at length 300.

Every level is an aggregation to the least and greatest record of a hash (combined before the shuffle, so a window
held by a third of all rows costs one row per task) and a join of its rows with the repeated hashes, one row each,
which adaptive execution splits when a hash is hot. Hashes at the last two levels have 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.codepoints import Rolling, Slice, slices, sliding_min
from palimpsest.plans.session import cut, discard, in_arrow, small, table

SPAN = 300
BROADCAST_HASHES = 500_000  # of 8 bytes
_POS_BITS = np.uint64(24)
CHUNK_CHARS = 1 << 23


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _chunks(parts: Iterator[Slice], span: int) -> Iterator[tuple[Slice, int]]:
    """The slices, and where each begins in its text: a text too long for the position bits comes in overlapping chunks.

    Every window of ``span`` characters lies in a chunk, and what is said of it depends on its own characters only.
    """
    for s in parts:
        if len(s.cp) <= CHUNK_CHARS:
            yield s, 0
            continue
        # A slice that long is one text.
        for at in range(0, len(s.cp), CHUNK_CHARS):
            cp = s.cp[at : at + CHUNK_CHARS + span - 1]
            yield Slice(s.ids, s.rows, cp, np.array([0, len(cp)])), at


def _anchor_batches(span: int):
    quarter = span // 4
    windows = span - quarter + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, moved in _chunks(slices(batch.column(0), batch.column(1)), span):
                if len(s.cp) < span:
                    continue
                one, two = Rolling(s.cp, 1), Rolling(s.cp, 2)
                small = one.all(quarter)
                place = np.arange(len(small), dtype=np.uint64)
                key = ((small >> _POS_BITS) << _POS_BITS) | (place & np.uint64(0xFFFFFF))
                least = sliding_min(key, windows)
                owner = s.owner()
                whole = np.flatnonzero(owner[: len(least)] == owner[span - 1 :])
                if not len(whole):
                    continue
                # Back from the low bits to the position: it lies within the window.
                low = (least[whole] & np.uint64(0xFFFFFF)).astype(np.int64)
                anchor = whole + ((low - whole) & 0xFFFFFF)
                first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[whole[1:]] != owner[whole[:-1]])]))
                last = np.concatenate([first[1:] - 1, [len(whole) - 1]])
                lo, hi, at = whole[first], whole[last], anchor[first]
                doc = owner[at]
                begin, end = s.begin[doc], s.end[doc]
                right = np.where(at + 2 * quarter <= end, one.at(at, np.minimum(at + 2 * quarter, end)), np.uint64(0))
                left = np.where(at - quarter >= begin, one.at(np.maximum(at - quarter, begin), at + quarter), np.uint64(0))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(s.ids[doc]), pa.array(_signed(small[at])), pa.array(_signed(right)), pa.array(_signed(left)),
                        pa.array(_signed(one.at(lo, hi + span))), pa.array(_signed(two.at(lo, hi + span))),
                        pa.array((lo - begin + moved).astype(np.int32)), pa.array((hi - begin + moved).astype(np.int32)),
                    ],
                    names=["id", "h", "right", "left", "hull", "hull2", "lo", "hi"],
                )

    return run


def _window_batches(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            los, his = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for s in slices(batch.column(0), batch.column(1)):
                one, two = Rolling(s.cp, 1), Rolling(s.cp, 2)
                starts, who = [], []
                for k, row in enumerate(s.rows):
                    for lo, hi in zip(los[row], his[row], strict=True):
                        starts.append(np.arange(lo, hi + 1) + s.begin[k])
                        who.append(np.full(hi - lo + 1, k))
                if not starts:
                    continue
                t, k = np.concatenate(starts), np.concatenate(who)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.ids[k]), pa.array(_signed(one.at(t, t + span))), pa.array(_signed(two.at(t, t + span))), pa.array((t - s.begin[k]).astype(np.int32))],
                    names=["id", "h", "h2", "lo"],
                )

    return run


def _texts_of(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """The texts of the ids in ``rows``; few enough ids are broadcast, so that no other text is shuffled."""
    return texts.join(small(rows.select("id").distinct(), BROADCAST_HASHES), "id", "left_semi")


def _repeated(df: DataFrame, *keys: str) -> DataFrame:
    """The keys that occur in more than one record."""
    return df.groupBy(*keys).agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select(*keys)


def anchors(texts: DataFrame, span: int = SPAN) -> DataFrame:
    """Anchors of all texts (id, text): id, h, right, left, hull, hull2, lo, hi."""
    long_enough = texts.select(F.col("id").cast("long"), "text").where(F.length("text") >= span)
    return in_arrow(long_enough, _anchor_batches(span), "id bigint, h bigint, right bigint, left bigint, hull bigint, hull2 bigint, lo int, hi int")


def shared_windows(texts: DataFrame, span: int = SPAN) -> DataFrame:
    """(id, lo, hi): the windows of ``span`` characters starting from lo to hi that other records hold too.

    ``texts`` has a unique bigint ``id`` and a ``text``; other columns are ignored. Null, empty and short texts have none. Repetition inside one
    record alone does not count. ``span`` should be a multiple of 4.
    """
    texts = texts.select(F.col("id").cast("long"), "text")
    # Kept, so that the texts are hashed once; of the anchors only hash and record are shuffled to find the repeated ones.
    found = cut(anchors(texts, span))
    repeated = cut(_repeated(found, "h"))
    level1 = cut(found.join(small(repeated, BROADCAST_HASHES), "h"))
    discard(found, repeated)
    sides = level1.select("id", "h", "hull", "hull2", "lo", "hi", F.explode(F.array("right", "left")).alias("w")).where("w <> 0")
    # Both sides of an anchor may survive; one row goes on.
    level2 = sides.join(_repeated(sides, "w"), "w").groupBy("id", "h", "lo", "hi", "hull", "hull2").agg(F.lit(1).alias("n")).drop("n")
    holders = level2.groupBy("hull", "hull2").agg(F.min(F.struct("id", "lo", "hi")).alias("a"), F.max(F.struct("id", "lo", "hi")).alias("b")).where("a.id < b.id")
    level3 = cut(level2.join(holders, ["hull", "hull2"], "left"))
    # A window at an edge may also lie in a settled hull of other records: two of those stand for all of them.
    edges = level3.where("a is null").select("id", "h", "lo", "hi")
    stand_in = level3.where("a is not null and id = a.id").select("h", F.explode(F.array("a", "b")).alias("x")).select("h", "x.id", "x.lo", "x.hi")
    stand_in = stand_in.join(edges.select("h").distinct(), "h", "left_semi").select("id", "lo", "hi").distinct()
    edge = edges.select("id", "lo", "hi").unionByName(stand_in).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("r"))
    edge = cut(edge)
    edge = _texts_of(edge, texts).join(edge, "id").select("id", "text", F.col("r.lo").alias("los"), F.col("r.hi").alias("his"))
    windows = in_arrow(edge, _window_batches(span), "id bigint, h bigint, h2 bigint, lo int")
    inside = level3.where("a is not null").select("id", "lo", "hi")
    return inside.unionByName(windows.join(_repeated(windows, "h", "h2"), ["h", "h2"]).select("id", "lo", F.col("lo").alias("hi")))


def _ranges(texts: DataFrame, span: int) -> DataFrame:
    """(id, r): each record's shared windows as a list of (lo, hi) in order."""
    return shared_windows(texts, span).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("r"))


def shared_chars(texts: DataFrame, span: int = SPAN) -> DataFrame:
    """(id, shared_chars): the characters of each record that lie in shared windows; records without any are left out."""
    count = F.aggregate(
        "r", F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(x["hi"] + span - F.greatest(x["lo"], acc["upto"]), F.lit(0))).alias("n"), F.greatest(acc["upto"], x["hi"] + span).alias("upto")
        ),
    )["n"]
    return _ranges(texts, span).select("id", count.alias("shared_chars"))


def shared_spans(texts: DataFrame, span: int = SPAN) -> DataFrame:
    """(id, begin, end, span_class, records): the shared spans of each record, as long as they go, and who holds the same.

    A span is a stretch of overlapping or touching shared windows, from character ``begin`` (from 0) up to ``end``.
    ``span_class`` is the SHA-256 of its text, and ``records`` how many records have a span of exactly that text: 1
    where the others hold it as a part of a longer span or in pieces. Counted by class, never listed as pairs.
    """
    both = lambda b, e: F.struct(b.alias("begin"), e.alias("end"))
    start = F.struct(F.array().cast("array<struct<begin:int,end:int>>").alias("done"), both(F.lit(-1), F.lit(-1)).alias("open"))

    def step(acc, x):
        goes_on = acc["open"]["end"] >= x["lo"]
        return F.struct(
            F.when(goes_on | (acc["open"]["end"] < 0), acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])).alias("done"),
            F.when(goes_on, both(acc["open"]["begin"], F.greatest(acc["open"]["end"], x["hi"] + span))).otherwise(both(x["lo"], x["hi"] + span)).alias("open"),
        )

    merged = cut(_ranges(texts, span).select("id", F.aggregate("r", start, step, lambda acc: F.array_append(acc["done"], acc["open"])).alias("s")))
    texts = texts.select(F.col("id").cast("long"), "text")
    each = _texts_of(merged, texts).join(merged, "id").select("id", "text", F.explode("s").alias("s"))
    named = cut(each.select("id", "s.begin", "s.end", F.sha2(F.substring("text", F.col("s.begin") + 1, F.col("s.end") - F.col("s.begin")), 256).alias("span_class")))
    held = named.groupBy("span_class").agg(F.count_distinct("id").alias("records"))
    return named.join(held, "span_class").select("id", "begin", "end", "span_class", "records")


def _texts(spark, base: str) -> DataFrame:
    return table(spark, base, "documents").select(F.col("doc_id").alias("id"), "text")


def found(spark, base: str) -> DataFrame:
    """p8_found: each record with a shared run of 300 characters, and how many of its characters are shared."""
    return shared_chars(_texts(spark, base)).select(F.col("id").alias("doc_id"), F.col("shared_chars").cast("int").alias("shared_chars"))


def spans(spark, base: str) -> DataFrame:
    """p8_spans: the shared spans themselves, with their class and the number of records that hold just this span."""
    return shared_spans(_texts(spark, base)).withColumnRenamed("id", "doc_id")
