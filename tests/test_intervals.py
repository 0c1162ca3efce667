"""Problem 1 against brute force over days, and its edge cases."""

import random

from pyspark.sql import functions as F

from palimpsest.functions.dates import end_day, start_day
from palimpsest.operators.intervals import merge_intervals, periods_and_gaps


def brute(rows):
    out = []
    by = {}
    for k, s, e in rows:
        if k is not None and s is not None and e is not None and s < e:
            by.setdefault(k, set()).update(range(s, e))
    for k, days in by.items():
        runs, days = [], sorted(days)
        start = days[0]
        for a, b in zip(days, [*days[1:], None]):
            if b != a + 1:
                runs.append((start, a + 1))
                start = b
        out += [(k, "period", s, e) for s, e in runs]
        out += [(k, "gap", a[1], b[0]) for a, b in zip(runs, runs[1:])]
    return sorted(out)


def test_random_intervals_cross_shards(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(600):
        s, n = rng.randrange(-60, 300), rng.choice([-3, 0, 1, 2, 5, 9, 40, None])
        rows.append((rng.choice(["a", "a", "a", "b", "c", None]), s, None if n is None else s + n))
    df = spark.createDataFrame([(k, s, e, 1) for k, s, e in rows], "k string, a int, b int, shard int")
    for width in (7, 64, 4096):
        got = periods_and_gaps(merge_intervals(df, ["k"], "a", "b", width), ["k"]).select("k", "kind", "s", "e").collect()
        assert sorted(map(tuple, got)) == brute(rows)


def test_touching_repeated_and_empty(spark):
    df = spark.createDataFrame([("x", 1, 3), ("x", 3, 5), ("x", 3, 5), ("x", 9, 9)], "k string, a int, b int")
    assert [tuple(r) for r in merge_intervals(df, ["k"], "a", "b").collect()] == [("x", 1, 5)]
    assert merge_intervals(df.where("false"), ["k"], "a", "b").count() == 0


def test_date_spellings(spark):
    texts = ["2004-11-23", " 2004-11-23 ", "2004/11/23", "20041123", "2004年11月23日", "2004-11-23T00:00:00Z"]
    df = spark.createDataFrame([(t,) for t in [*texts, None, "  ", "soon", "2004-02-31"]], "t string")
    got = [tuple(r) for r in df.select(start_day(F.col("t")), end_day(F.col("t"))).collect()]
    assert got[:6] == [(12745, 12745)] * 6
    assert got[6:8] == [(-719162, 2932896)] * 2
    assert got[8:] == [(None, None)] * 2
