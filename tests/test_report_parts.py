"""A report is read line by line: in many splits, in parts, its alignments numbered in order."""

import pytest

from strandloom.sources import reports


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def line(k):
    return f"t{k}\tPDB\t{k / 10}\t[{k}, {k + 1}]\t[1, 2]\t[3, 4]"


HEAD = "Target\tnamespace\tZ\tqstarts\tsstarts\tlengths"


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("parts", [1, 3])
def test_numbers_follow_the_lines(spark, tmp_path, small_splits, parts, end):
    for p in range(parts):
        body = [line(k) for k in range(p * 100, p * 100 + (100 if p != 1 else 7))]
        (tmp_path / f"part-{p:05}.csv").write_bytes(end.join(["# made by hand", "", HEAD, *body[:5], "", ".\t.\t.\t.\t.\t.", *body[5:], ""]).encode())
    summary, segments = reports.read_table(spark, str(tmp_path))
    ids = [k for p in range(parts) for k in range(p * 100, p * 100 + (100 if p != 1 else 7))]
    assert [(r.alignment_id, r.target_id, r.z_score) for r in summary.orderBy("alignment_id").collect()] == [(n + 1, f"t{k}", k / 10) for n, k in enumerate(ids)]
    assert sorted(map(tuple, segments.collect())) == sorted(x for n, k in enumerate(ids) for x in ((n + 1, k, 1, 3), (n + 1, k + 1, 2, 4)))
    assert reports.ordered_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 2


def test_no_task_holds_the_report(spark, tmp_path, small_splits):
    (tmp_path / "one.tsv").write_text("\n".join([HEAD, *map(line, range(1000))]))
    plan = reports.read_table(spark, str(tmp_path / "one.tsv"))[1]
    assert plan.count() == 2000 and plan.rdd.getNumPartitions() > 20
