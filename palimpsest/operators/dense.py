"""Dense retrieval: a stated set of query vectors against all vectors, in blocks.

Bounded blocks of queries are sent to every task; each task multiplies its Arrow batches with the blocks and keeps its
best k per query, so what is shuffled is k rows per query and batch, not the scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.fulltext import top
from palimpsest.operators.fusion import diverse
from palimpsest.plans.session import cut, in_arrow

BLOCK = 2048  # queries of one multiplication
SCAN_BYTES = 128 << 20  # query vectors of one scan of the items


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(-1, width)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _best_of_groups(s: np.ndarray, ids: np.ndarray, group: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Query and item places of a batch: of each query's best ``k`` groups, and those equal to the k-th, the best item each.

    A group's best item of all batches is the best of its own batch, and at most ``k - 1`` groups there are better, so
    nothing that belongs to the whole table's best ``k`` groups is lost.
    """
    codes = group.dictionary_encode(null_encoding="encode").indices.to_numpy()
    order = np.lexsort((ids, codes))
    starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
    ends = np.append(starts[1:], len(order))
    s = s[:, order]
    best = np.maximum.reduceat(s, starts, axis=1)
    need = min(k, best.shape[1])
    least = np.partition(best, best.shape[1] - need, axis=1)[:, best.shape[1] - need, None]
    kept = (best >= least) & (best > -2.0)
    r, c = [], []
    for g in np.flatnonzero(kept.any(axis=0)):
        rows = np.flatnonzero(kept[:, g])
        r.append(rows)
        c.append(order[starts[g] + s[rows, starts[g] : ends[g]].argmax(axis=1)])
    return (np.concatenate(r), np.concatenate(c)) if r else (np.zeros(0, int), np.zeros(0, int))


def _scorer(shared, k: int, with_self: bool, group: str | None):
    """A function of batches (id, vector, group) that gives the best ``k`` of each batch for every query vector of ``shared``."""
    names = ["query_id", "item_id", "score"] + [group] * bool(group)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for width, blocks in shared.value.items():
                rows = np.flatnonzero(widths == width)
                if not len(rows):
                    continue
                part = batch if len(rows) == batch.num_rows else batch.take(pa.array(rows))
                i_ids, items = part.column(0).to_numpy(), _matrix(part.column(1), width)
                for q_ids, q in blocks:
                    s = np.round(q @ items.T, 6) + 0.0
                    if not with_self:
                        s[q_ids[:, None] == i_ids[None, :]] = -2.0
                    s[np.isnan(s)] = -2.0
                    if group:
                        r, c = _best_of_groups(s, i_ids, part.column(2), k)
                    else:
                        # Ties at the k-th place all go on; the ranking decides by id.
                        need = min(k, s.shape[1])
                        least = np.partition(s, s.shape[1] - need, axis=1)[:, s.shape[1] - need, None]
                        r, c = np.nonzero((s >= least) & (s > -2.0))
                    more = [part.column(2).take(pa.array(c))] if group else []
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[r]), pa.array(i_ids[c]), pa.array(s[r, c]), *more], names=names)

    return score


def cosine_top(queries: DataFrame, items: DataFrame, k: int, with_self: bool = False, group: str | None = None, at_once: int = SCAN_BYTES) -> DataFrame:
    """Best ``k`` items of each query by cosine: query_id, item_id, score (6 decimals), rank.

    With ``group``, a column of ``items``, the best item of each of the best ``k`` groups of all items, and that column
    too; null groups are one group.

    Both have a bigint id and an array ``vector``. A query meets the items of its own width, whatever widths there are;
    null and empty vectors find nothing, a vector without length has cosine 0. Equal scores rank by item_id. The item
    with the query's own id is left out unless ``with_self``.

    Query vectors go out in broadcasts of at most ``at_once`` bytes, many blocks in one scan of the items; where more
    scans are needed the best of each are kept as a table, so the plan does not grow with the queries.
    """
    spark = queries.sparkSession
    usable = queries.where("id is not null and size(vector) > 0").select("id", "vector")
    kind = "query_id bigint, item_id bigint, score double" + (f", `{group}` {dict(items.dtypes)[group]}" if group else "")
    best = (lambda df: diverse(df, group, k)) if group else (lambda df: top(df, k))
    size = usable.agg(F.sum(F.size("vector").cast("long") * 8 + 8).alias("b")).head()["b"]
    if not size:
        return best(spark.createDataFrame([], kind))
    scans = -(-size // at_once)
    corpus = items.where("id is not null and size(vector) > 0").select("id", "vector", *[group] * bool(group))
    parts = []
    for scan in range(scans):
        chosen = usable if scans == 1 else usable.where(F.pmod(F.xxhash64("id"), F.lit(scans)) == scan)
        got = chosen.toArrow()
        ids, vectors = got.column("id").to_numpy(), got.column("vector").combine_chunks()
        widths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
        shared = {}
        for width in np.unique(widths):
            rows = np.flatnonzero(widths == width)
            blocks = [rows[i : i + BLOCK] for i in range(0, len(rows), BLOCK)]
            shared[int(width)] = [(ids[b], _matrix(vectors.take(pa.array(b)), int(width))) for b in blocks]
        found = best(in_arrow(corpus, _scorer(spark.sparkContext.broadcast(shared), k, with_self, group), kind))
        parts.append(found if scans == 1 else cut(found))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
