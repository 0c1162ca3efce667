"""Hash ledgers: chains checked by equi-joins, digests built by blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 1000


def content_hash(*parts: Column) -> Column:
    """SHA-256 of the parts joined by ``|``; null parts read as empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def block_digests(events: DataFrame, sequence: str, digest: Column, rows: int = BLOCK_ROWS) -> DataFrame:
    """(block_no, n_events, missing, digest): SHA-256 over the hashes of each block of ``rows`` sequence numbers in order.

    A ledger's integrity is that of its blocks, which are hashed side by side; repeated sequence numbers count twice, so a
    replayed event changes the digest. Null sequence numbers are left out.
    """
    put = events.where(F.col(sequence).isNotNull()).select(F.floor(F.col(sequence) / rows).cast("long").alias("block_no"), F.struct(F.col(sequence).alias("s"), digest.alias("h")).alias("x"))
    return put.groupBy("block_no").agg(
        F.count("*").alias("n_events"), (F.max("x.s") - F.min("x.s") + 1 - F.count_distinct("x.s")).alias("missing"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda e: e["h"]), ""), 256).alias("digest"),
    )


def broken_links(ledger: DataFrame) -> DataFrame:
    """(sequence, fault) of a chained ledger (sequence, previous_hash, event_hash, payload): gap, previous, content.

    Each event meets its predecessor by an equi-join on the sequence; no order over the whole ledger is needed. The
    first event must have an empty or null previous_hash.
    """
    ledger = ledger.select("sequence", "previous_hash", "event_hash", "payload")
    before = ledger.select((F.col("sequence") + 1).alias("sequence"), F.col("event_hash").alias("expected"))
    first = ledger.agg(F.min("sequence").alias("first"))
    both = ledger.join(before, "sequence", "left").join(F.broadcast(first))
    fault = F.array_compact(
        F.array(
            F.when((F.col("sequence") > F.col("first")) & F.col("expected").isNull(), "gap"),
            F.when(F.coalesce("previous_hash", F.lit("")) != F.coalesce("expected", F.lit("")), "previous"),
            F.when(F.sha2(F.concat_ws("|", F.coalesce("previous_hash", F.lit("")), F.col("payload")), 256) != F.col("event_hash"), "content"),
        )
    )
    return both.select("sequence", F.explode(fault).alias("fault"))
