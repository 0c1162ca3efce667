"""Problem 2: splitting oversized texts at natural boundaries, by agglomerative merging.

The atoms of a text are the stretches between its natural boundaries. Adjacent pieces wait in a heap, ordered by how
weak the boundary between them is, then by their combined size; the weakest boundary goes first, as long as the
combined size and the overlap fit the limit. What is left are the strongest boundaries. Each text is a row of its own:
Spark filters the oversized ones before any Python runs, and no shuffle is needed.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.plans.session import in_arrow, table

MAX_CHARS, OVERLAP = 4500, 200

# After a line feed; after a full-width sentence mark; after . ; ! ? before white space.
_BOUNDARY = re.compile(r"\n|[。；！？]|[.;!?](?=\s)")
# A blank line after or before a line end, whatever marks the line ends.
_BLANK_AFTER, _BLANK_BEFORE = re.compile(r"\r?\n"), re.compile(r"\n\r?\n$")
# Strength of a boundary by the mark that it follows: a cut inside a stretch, clause, sentence, line, blank line.
_INSIDE, _CLAUSE, _SENTENCE, _LINE, _PARAGRAPH, _END = range(6)


def atoms(text: str, limit: int, overlap: int) -> tuple[list[int], list[int], int]:
    """(cut positions, strength of each, longest stretch).

    Stretches that no piece can hold are cut evenly, at white space if any is near: those longer than ``limit`` less
    ``overlap``, and at the beginning of the text, where there is no overlap, those longer than ``limit``.
    """
    cuts, strength, longest, start = [], [], 0, 0

    def cut_inside(upto: int) -> None:
        nonlocal start
        while upto - start > (room := limit - overlap if start else limit):
            parts = -(-(upto - start) // room)
            at = start + -(-(upto - start) // parts)
            space = max(text.rfind(" ", start + (at - start) // 2, at), text.rfind("\t", start + (at - start) // 2, at))
            start = space + 1 if space >= 0 else at
            cuts.append(start)
            strength.append(_INSIDE)

    for m in _BOUNDARY.finditer(text):
        end = m.end()
        longest = max(longest, end - start)
        cut_inside(end)
        if end < len(text):
            mark = m.group()
            cuts.append(end)
            blank = mark == "\n" and (_BLANK_AFTER.match(text, end) or _BLANK_BEFORE.search(text[max(0, end - 4) : end]))
            strength.append(_PARAGRAPH if blank else _LINE if mark == "\n" else _CLAUSE if mark in ";；" else _SENTENCE)
        start = end
    longest = max(longest, len(text) - start)
    cut_inside(len(text))
    return cuts, strength, longest


def split_text(text: str, limit: int = MAX_CHARS, overlap: int = OVERLAP) -> tuple[list[tuple[int, int, int, int]], int]:
    """Pieces (begin, body, end, cut) of ``text``, and its longest stretch without a boundary.

    ``cut`` is the strength of the boundary that the piece ends at: 0 inside a stretch, 1 clause, 2 sentence, 3 line,
    4 blank line; 5 at the end of the text. A piece is ``text[begin:end]`` of at most ``limit`` characters; ``body - begin`` is the overlap with the piece
    before (0 for the first, ``overlap`` otherwise), so the parts from ``body`` to ``end`` make up the text.
    """
    # The first piece has no overlap, so a first stretch of up to ``limit`` characters stays whole.
    cuts, strength, longest = atoms(text, limit, overlap)
    edge = [0, *cuts, len(text)]
    strength.append(_END)
    n = len(edge) - 1
    ahead, behind, alive, size = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n, [edge[i + 1] - edge[i] for i in range(n)]
    room = lambda i: limit - overlap if i else limit
    heap = [(strength[i], size[i] + size[i + 1], i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        s, both, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j] and ahead[i] == j and both == size[i] + size[j]) or both > room(i):
            continue
        alive[j], size[i], ahead[i] = False, both, ahead[j]
        if ahead[i] < n:
            behind[ahead[i]] = i
            heapq.heappush(heap, (strength[ahead[i] - 1], both + size[ahead[i]], i, ahead[i]))
        if behind[i] >= 0:
            heapq.heappush(heap, (strength[i - 1], size[behind[i]] + both, behind[i], i))
    pieces, i = [], 0
    while i < n:
        pieces.append((max(0, edge[i] - overlap) if i else 0, edge[i], edge[i] + size[i], strength[ahead[i] - 1]))
        i = ahead[i]
    return pieces, longest


_SCHEMA = "id string, part_index int, begin int, body int, end int, boundary int, longest int, text string"
_NAMES = ["id", "part_index", "begin", "body", "end", "boundary", "longest", "text"]
_BATCH_PIECES = 1024


def _run(limit: int, overlap: int):
    kinds = [pa.string(), *[pa.int32()] * 6, pa.string()]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pieces, longest = split_text(text, limit, overlap)
                rows += [(i, k, begin, body, end, cut, longest, text[begin:end]) for k, (begin, body, end, cut) in enumerate(pieces, 1)]
                if len(rows) >= _BATCH_PIECES:
                    yield out(rows)
                    rows = []
        if rows:
            yield out(rows)

    return run


def split_oversized(items: DataFrame, limit: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the texts (string id, text) above ``limit`` code points.

    Output: id, part_index (from 1), begin, body, end (code points), boundary (what the piece ends at: 0 a cut inside a
    stretch without natural boundary, 1 clause, 2 sentence, 3 line, 4 blank line, 5 end of the text), longest (characters
    of the text's longest stretch), text. Null, empty and fitting texts are not oversized and give no rows. Rows that
    repeat an id with other text give pieces of each. Needs 0 <= overlap < limit / 2.
    """
    if not 0 <= overlap < limit / 2:
        raise ValueError("overlap must be below half the limit")
    big = items.select(F.col("id").cast("string"), "text").where(F.length("text") > limit)
    return in_arrow(big, _run(limit, overlap), _SCHEMA)


def found(spark, base: str) -> DataFrame:
    """p2_found: each oversized segment, and whether it had to be cut inside a stretch.

    Of the cuts that are left after merging, those inside a stretch count if the stretch is longer than a whole piece; a
    stretch that fits a piece but not beside its overlap (4,301 to 4,500 characters) is cut too, and not counted.
    """
    pieces = split_oversized(table(spark, base, "segments").select(F.col("segment_id").alias("id"), "text"))
    hard = (F.col("boundary") == _INSIDE) & (F.col("longest") > MAX_CHARS)
    return pieces.groupBy(F.col("id").alias("segment_id")).agg(F.max(hard.cast("int")).alias("hard_cut"))


def labelled_pieces(spark, base: str) -> DataFrame:
    """p2_pieces: all pieces of oversized segments with heading, article_label, boundary and running part_index.

    An article may be cut already: segments of one document with successive ordinals and the same heading and label,
    white space aside, are its parts, and the pieces are numbered on over them in the order of the ordinals, whatever the
    segments' own part_index says (it is wrong in places); a segment that fits counts as one piece. A segment without any
    label, or without a document, stands alone.
    """
    segments = table(spark, base, "segments")
    pieces = split_oversized(segments.select(F.col("segment_id").alias("id"), "text")).withColumnRenamed("id", "segment_id")
    one = segments.groupBy("segment_id").agg(*[F.max(c).alias(c) for c in ("document_id", "ordinal", "heading", "article_label")])
    counted = one.withColumn("ordinal", F.coalesce("ordinal", F.lit(0))).join(pieces.groupBy("segment_id").agg(F.max("part_index").alias("parts")), "segment_id", "left")
    plain = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\p{Z}]+", "")
    alone = F.col("document_id").isNull() | (F.col("heading").isNull() & F.col("article_label").isNull())
    name = F.when(alone, F.col("segment_id")).otherwise(F.concat_ws("\x1f", "document_id", plain("heading"), plain("article_label")))
    keyed = counted.withColumn("name", name)
    keyed = keyed.join(keyed.where("parts is not null").select("name").distinct(), "name", "left_semi")
    # Successive ordinals keep their distance from their rank.
    rank = F.dense_rank().over(Window.partitionBy("name").orderBy("ordinal"))
    keyed = keyed.withColumn("group", F.concat_ws("\x1f", "name", F.col("ordinal") - rank))
    before = _running_before(keyed.select("group", "segment_id", "ordinal", F.coalesce("parts", F.lit(1)).alias("parts")))
    labels = keyed.where("parts is not null").select("segment_id", "heading", "article_label")
    whole = pieces.join(labels.join(before, "segment_id"), "segment_id")
    return whole.select("segment_id", "heading", "article_label", (F.col("part_index") + F.col("before")).cast("int").alias("part_index"), "begin", "body", "end", "boundary", "text")


def _running_before(keyed: DataFrame, stretch: int = 1000) -> DataFrame:
    """(segment_id, before): the parts of the group's segments that come before, by ordinal, then segment_id; summed in stretches of ordinals first."""
    put = keyed.withColumn("stretch", F.floor(F.col("ordinal") / stretch))
    inner = Window.partitionBy("group", "stretch").orderBy("ordinal", "segment_id").rowsBetween(Window.unboundedPreceding, -1)
    sums = put.groupBy("group", "stretch").agg(F.sum("parts").alias("n"))
    outer = Window.partitionBy("group").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("group", "stretch", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("outer"))
    near = put.withColumn("inner", F.coalesce(F.sum("parts").over(inner), F.lit(0)))
    return near.join(sums, ["group", "stretch"]).select("segment_id", (F.col("inner") + F.col("outer")).alias("before"))
