import pytest
from hypothesis import given, settings, strategies as st

from strandloom.functions import ranges as r
from strandloom.functions.predicates import to_sql
from strandloom.operators import intervals


@pytest.mark.parametrize("outer, inner", [("1-129_389-404, 247-388", "0-129_388-404, 246-388"), ("1-1_100-150, 151-200", "0-1_99-150, 150-200"), ("", "")])
def test_conventions_round_trip(outer, inner):
    assert r.annotation_to_clipping(outer) == inner
    assert r.clipping_to_annotation(inner) == outer


@pytest.mark.parametrize("text", ["0-50", "5-4", "1-two", "1-4,,8-12", "1-2_", "1-2_0-4"])
def test_bad_strings_raise(text):
    with pytest.raises(ValueError):
        r.annotation_to_clipping(text)


@pytest.mark.parametrize("pair", [(-1, 10), (3, 3), (1.5, 3), (True, 3)])
def test_bad_ranges_raise(pair):
    with pytest.raises(ValueError):
        r.checked_ranges([pair])


def test_lenient_swaps_and_skips():
    assert r.parse_lenient("9-4_x, 2-3") == [[(4, 9)], [(2, 3)]]


def test_ranges_frame(spark):
    assert [tuple(x) for x in r.ranges_frame(spark, "1-5_8-9, 6-7").collect()] == [(0, 0, 0, 5), (0, 1, 7, 9), (1, 0, 5, 7)]


def test_clip_covers_the_range(spark):
    seg = spark.createDataFrame([(1, 0, 0, 123)], "alignment_id int, q_start int, s_start int, length int")
    out = sorted((x.q_start, x.s_start, x.length) for x in intervals.clip(seg, [(22, 50), (59, 123)]).collect())
    assert out == [(22, 22, 28), (59, 59, 64)]
    assert intervals.clip(seg, []).count() == 0
    assert intervals.clip(seg, [(123, 130)]).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 50), st.integers(1, 40)), min_size=1, max_size=8), st.integers(1, 90))
def test_clip_is_idempotent_and_conserves_length(spark, rows, cut):
    seg = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "alignment_id int, q_start int, s_start int, length int")
    parts = intervals.clip(seg, [(0, cut), (cut, 200)])
    assert parts.agg({"length": "sum"}).first()[0] == sum(x[2] for x in rows)
    once = sorted(map(tuple, intervals.clip(seg, [(5, 30)]).collect()))
    assert sorted(map(tuple, intervals.clip(intervals.clip(seg, [(5, 30)]), [(5, 30)]).collect())) == once


def test_predicate_dialect():
    assert to_sql("a >= 1 & ~(b in ['x', \"y\"])") == "`a` >= 1 AND NOT ( `b` IN ( 'x' , 'y' ) )"
    for bad in ("", "a ; b", "a >= `x`"):
        with pytest.raises(ValueError):
            to_sql(bad)


def test_selections(spark):
    from pyspark.sql import functions as F
    from strandloom.operators import selection

    df = spark.createDataFrame([(c, float(i + 1), (i + 1) / 10) for i, c in enumerate("abcdef")], "id string, z double, cov double")
    pick = lambda y, angle: [x.id for x in df.where(selection.half_plane(F.col("z"), F.col("cov"), 3.5, y, angle)).orderBy("id").collect()]
    assert pick(0.35, -90) == ["d", "e", "f"]
    assert pick(0.6, 0) == []
    ranked = selection.first_appearance_rank(spark.createDataFrame([(1, "x", 5.0), (2, "y", 9.0), (3, None, 10.0), (4, "x", 9.0), (5, "Unassigned", 20.0)], "id int, l string, z double"), "l", "z", "id", "k", True)
    assert {x.id: x.k for x in ranked.collect()} == {1: 2, 2: 1, 3: 3, 4: 2, 5: 3}
    q = selection.benjamini_hochberg(spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, 0.5)], "id int, p double"), "p", "q")
    assert {x.id: round(x.q, 6) for x in q.collect()} == {1: 0.04, 2: 0.053333, 3: 0.053333, 4: 0.5}
