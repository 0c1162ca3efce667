"""Relations between documents: their predicate in the text, and what becomes of them when versions change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import marker_places

WINDOW = 80


def nearest_marker(text: Column, name: Column, markers: dict[str, list[str]], negations: str, window: int = WINDOW) -> Column:
    """Of the markers around the first place of ``name`` the label of the nearest one that is not negated; null without any.

    ``markers`` has the words of each label. A window of ``window`` characters on both sides is looked at; a word counts
    as negated if ``negations`` (a regular expression) ends just before it. Ties go to the least label.
    """
    at = F.instr(text, name)
    begin = F.greatest(F.lit(1), at - window)
    around = F.substring(text, begin, at - begin + F.length(name) + window)
    middle = at - begin + 1 + F.floor(F.length(name) / 2)

    def places(label: str, word: str) -> Column:
        real = F.filter(marker_places(around, F.lit(word)), lambda i: ~F.rlike(F.substring(around, F.lit(1), i - 1), F.lit(f"(?:{negations})$")))
        return F.transform(real, lambda i: F.struct(F.abs(i + len(word) // 2 - middle).cast("int").alias("d"), F.lit(label).alias("label")))

    every = F.concat(*[places(label, word) for label, words in markers.items() for word in words])
    return F.when(at > 0, F.array_min(every)["label"])


def successors_across(relations: DataFrame, owners: DataFrame, predicates: list[str]) -> DataFrame:
    """(old_key, new_key, relations): keys replaced by documents of another key.

    ``relations``: subject, predicate, object; ``owners``: document_id, source_key, unique documents. Counted by pair of
    keys; relations with an unknown or keyless end are left out.
    """
    kept = relations.where(F.col("predicate").isin(predicates)).select("subject", "object").distinct()
    new = owners.select(F.col("document_id").alias("subject"), F.col("source_key").alias("new_key"))
    old = owners.select(F.col("document_id").alias("object"), F.col("source_key").alias("old_key"))
    return kept.join(new, "subject").join(old, "object").where("new_key <> old_key").groupBy("old_key", "new_key").agg(F.count("*").alias("relations"))


def carry_forward(relations: DataFrame, nexts: DataFrame) -> DataFrame:
    """(old_subject, new_subject, predicate, object, state): relations of a version and what the next version has of them.

    ``relations``: subject, predicate, object; ``nexts``: document_id, next_id. ``carried`` if the next version has the
    relation too, ``pending`` if not. Repeated relations count once; an object that has a next version itself stays.
    """
    held = relations.where("subject is not null and object is not null").select("subject", "predicate", "object").distinct()
    old = held.join(nexts.where("next_id is not null").select(F.col("document_id").alias("subject"), F.col("next_id").alias("new_subject")), "subject")
    new = held.select(F.col("subject").alias("new_subject"), "predicate", "object", F.lit(True).alias("there"))
    both = old.join(new, ["new_subject", "predicate", "object"], "left")
    return both.select(F.col("subject").alias("old_subject"), "new_subject", "predicate", "object", F.when(F.col("there"), "carried").otherwise("pending").alias("state"))
