import pytest

from strandloom.functions.segment import Registry, Segment, resolved
from strandloom.operators import reports


def test_distribution_test_finds_the_high_group(spark):
    rows = [(f"f{i % 3}", "c1" if i % 3 == 0 else "c2", i % 3 + 1, 1 if i % 3 == 0 else 2, float(i % 3 == 0) * 10 + i * 0.01, 0.5) for i in range(120)]
    df = spark.createDataFrame(rows, "pfam string, clan string, pfam_rank int, clan_rank int, z_score double, query_coverage double")
    got = {(r.level, r.group, r.variable): r for r in reports.distribution_test(df, {"pfam": "pfam_rank", "clan": "clan_rank"}, ["z_score", "query_coverage"], min_effect={"z_score": 1.0}).collect()}
    assert got["pfam", "f0", "z_score"].significant and not got["pfam", "f1", "z_score"].significant
    assert got["pfam", "f1", "z_score"].n2 == 40 and not got["clan", "c1", "query_coverage"].significant


def test_sentences(spark):
    assert reports.logo_insight([0.1, 0.2]).startswith("no conserved") and "1" in reports.logo_insight([4.0] + [0.1] * 20)
    assert reports.modality([0.0] * 20 + [10.0] * 20 + [x / 10 for x in range(5)]) == "two peaks" and reports.modality([1.0]) == "too few values"
    df = spark.createDataFrame([(9.0, 0.9, 0.2), (5.0, 0.8, 0.3)], "z_score double, query_coverage double, target_coverage double")
    assert reports.overview(df) == "2 hits, median z 7.0: the query is a domain of larger targets"
    assert sorted(r.bin for r in reports.colour_bins(df, "z_score").collect()) == [0, 9]


def test_segments(spark):
    s = Segment.parse("3-7", "helix")
    assert len(s) == 5 and 7 in s and 8 not in s and s.overlap(Segment(6, 9)) == 2 and s.name == "helix_3_7"
    for bad in ("7-3", "x"):
        with pytest.raises(ValueError):
            Segment.parse(bad)
    r = Registry()
    r.add("a", s)
    r.add("b", Segment(10, 11))
    r.add("sheet", ["a", "b"])
    assert r.residues("sheet") == [3, 4, 5, 6, 7, 10, 11] and r.parents("a") == ["sheet"]
    bridge = spark.createDataFrame([("e", "a"), ("e", "b")], "entity string, segment string")
    parts = spark.createDataFrame([("a", 1, 3), ("b", 3, 4)], "segment string, start int, end int")
    assert resolved(bridge, parts).count() == 4
