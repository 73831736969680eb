"""Segmented concatenation against the same texts joined in Python."""

import random

import pytest
from pyspark.sql import functions as F

from markspark.operators.concat import concat_segments
from markspark.operators.stats import concat_text

SCHEMA = "k string, a int, b string, t string, _pid int, segment int, start string, text string, key int"


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(*r, 1, 2, "x", "y", 3) for r in rows], SCHEMA).repartition(parts)


def brute(rows, chars, sep):
    whole = {}
    first = lambda r: tuple((x is not None, x if x is not None else 0) for x in r[1:3])
    for k, *_, t in sorted((r for r in rows if r[3] is not None), key=lambda r: (first(r), r[3])):
        whole.setdefault(k, []).append(t)
    found = {}
    for k, texts in whole.items():
        at = 0
        for t in texts:
            found.setdefault((k, at // chars), (at, []))[1].append(t)
            at += len(t) + len(sep)
    return {(k, n, at, sep.join(ts)) for (k, n), (at, ts) in found.items()}, {k: sep.join(ts) for k, ts in whole.items()}


@pytest.mark.parametrize(("chars", "sep"), [(1, " "), (97, " "), (97, ""), (500, "\\ 'é\n"), (1 << 20, " ")])
def test_segments_equal_brute_force(spark, chars, sep):
    rng = random.Random(chars)
    rows = [("hot" if i % 3 == 0 else rng.choice([*map(str, range(40)), None]), rng.choice([None, *range(60)]), rng.choice([None, "p", "q"]),
             rng.choice([None, "", "é" * rng.randint(1, 9), "x" * rng.randint(0, 150), "y z"])) for i in range(900)]
    rows += [rows[0]] * 3 + [("void", 1, "p", None), ("bare", 1, "p", "")]
    got = concat_segments(frame(spark, rows), "k", "t", ["a", "b"], chars, sep).collect()
    want, whole = brute(rows, chars, sep)
    assert len(got) == len(want) and {(r.k, r.segment, r.start, r.t) for r in got} == want
    longest = max(len(r[3] or "") for r in rows)
    assert all(len(r.t) < chars + longest for r in got)
    again = {}
    for r in sorted(got, key=lambda r: r.segment):
        again.setdefault(r.k, []).append(r.t)
    assert {k: sep.join(ts) for k, ts in again.items()} == whole


def test_segments_do_not_depend_on_partitions(spark):
    rows = [("hot" if i % 3 else str(i), i % 7, "p", f"text {i}") for i in range(300)]
    runs = [concat_segments(frame(spark, rows, n), "k", "t", "a", 64).collect() for n in (1, 9)]
    assert sorted(map(tuple, runs[0])) == sorted(map(tuple, runs[1]))


def test_one_segment_is_the_whole_text(spark):
    rows = [(str(i % 20), i, "p", f"t{i}") for i in range(200)]
    d = frame(spark, rows)
    got = {r.k: (r.segment, r.start, r.whole) for r in concat_segments(d, "k", "t", "a", out="whole").collect()}
    assert got == {r.k: (0, 0, r.t) for r in concat_text(d, "k", "t", "a").collect()}


def test_hot_key_is_spread(spark):
    """The rows of one key, a third of all, are no group of any task: the largest group has one segment's rows."""
    rows = [("hot" if i % 3 == 0 else str(i), i, "p", "word") for i in range(6_000)]
    got = concat_segments(frame(spark, rows), "k", "t", "a", 100).filter("k = 'hot'")
    sizes = [r.n for r in got.select((F.size(F.split("t", " "))).alias("n")).collect()]
    assert sum(sizes) == 2_000 and max(sizes) == 20


def test_nothing(spark):
    d = frame(spark, [("k", 1, "p", "t")])
    assert concat_segments(d.limit(0), "k", "t", "a").count() == 0
    with pytest.raises(ValueError):
        concat_segments(d, "k", "t", "a", 0)
