import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vectrail.config import Profile
from vectrail.functions import scoring

SCHEMA = "id int, qt timestamp, qg string, qe array<string>, ct timestamp, cg string, ce array<string>"


def context(spark, rows):
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], SCHEMA)
    side = lambda p: {"ts": F.col(f"{p}t"), "geo": F.col(f"{p}g"), "entities": F.col(f"{p}e")}
    got = df.select("id", scoring.context_score(side("q"), side("c")).alias("s"), scoring.context_score(side("c"), side("q")).alias("r")).orderBy("id").collect()
    assert all(x.s == pytest.approx(x.r) for x in got)
    return [x.s for x in got]


def test_context_score(spark):
    t = dt.datetime(2024, 1, 1)
    d = lambda n: t + dt.timedelta(days=n)
    got = context(spark, [
        (None, "a", [], None, "a", []), (None, "a", [], None, "b", []), (None, "a", [], None, None, []),
        (t, None, [], t, None, []), (t, None, [], d(30), None, []), (d(60), None, [], t, None, []),
        (None, None, ["a", "b"], None, None, ["b", "c"]), (None, None, ["a", "b"], None, None, ["b", "a"]), (None, None, ["a", "b"], None, None, ["c", "d"]), (None, None, ["a"], None, None, []),
        (t, "a", ["x"], d(30), "a", ["x"]), (None, "a", ["x"], None, "a", ["y"]), (None, None, None, None, None, None),
    ])
    assert got == pytest.approx([1, 0, 0, 1, 0.5, 0.25, 1 / 3, 1, 0, 0, 0.85, 0.4 / 0.7, 0])


def test_fuse_gate_and_band(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, 1.0), (0.5, 1.0), (0.0, 1.0), (1.0, 0.0), (0.0, 0.0), (nan, 1.0), (None, 1.0), (1.0, None)], "f double, c double")
    got = [r.x for r in df.select(scoring.fuse(F.col("f"), F.col("c"), 0.7, 0.3).alias("x")).collect()]
    assert got[:5] == pytest.approx([1, 0.65, 0.3, 0.7, 0]) and got[5:] == [None] * 3
    got = [r.x for r in df.limit(4).select(scoring.fuse(F.col("f") * 2 - 1, F.col("c"), 1.0, 1.0).alias("x")).collect()]
    assert got == [1, 1, 0, 1]
    q = spark.createDataFrame([(0.9,), (0.5,), (0.1,), (nan,), (None,), (0.6,), (0.3,)], "q double")
    assert [r.t for r in q.select(scoring.trust(F.col("q"), 0.6).alias("t")).collect()] == ["full", "low", "reject", "reject", "reject", "full", "low"]
    b = spark.createDataFrame([(0.65,), (0.7,), (0.75,), (0.649999,), (0.750001,), (nan,), (None,)], "s double")
    assert [r.b for r in b.select(scoring.in_band(F.col("s"), 0.65, 0.75).alias("b")).collect()] == [True, True, True, False, False, False, False]
    label = spark.createDataFrame([("blur", 1.5), ("clean", 0.0), ("x", 10.0)], "n string, s double").select(scoring.condition_label(F.col("n"), F.col("s")).alias("l"))
    assert [r.l for r in label.collect()] == ["blur 1.5", "clean 0", "x 10"]


def test_valid_vectors(spark):
    rows = [([1.0, 2.0],), ([0.0, 0.0],), ([],), (None,), ([1.0, None],), ([float("nan")],), ([float("inf")],)]
    got = spark.createDataFrame(rows, "v array<double>").select(scoring.valid_vector(F.col("v")).alias("ok")).collect()
    assert [r.ok for r in got] == [True] + [False] * 6


def test_profile():
    with pytest.raises(ValueError):
        Profile(alpha=0, beta=0)
    with pytest.raises(ValueError):
        Profile(ambiguous_low=0.8, ambiguous_high=0.7)
    with pytest.raises(ValueError):
        Profile(alpha=float("nan"))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 400)), st.one_of(st.none(), st.sampled_from("abc")), st.lists(st.sampled_from("xyz"), max_size=3)), min_size=2, max_size=6))
def test_context_score_is_symmetric_and_bounded(spark, sides):
    t = lambda n: None if n is None else dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    rows = [(t(a[0]), a[1], a[2], t(b[0]), b[1], b[2]) for a in sides for b in sides]
    assert all(0 <= s <= 1 for s in context(spark, rows))
