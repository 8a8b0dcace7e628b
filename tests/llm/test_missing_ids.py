import pytest

import corpus_pipeline
from strandloom.llm import cap_filters, language_id, lm_score, packing, quality_rules, simhash_dedup, source_mixing, suffix_dedup, token_counts

PASSAGE = "the quick brown fox jumps over the lazy dog and runs away from all of it without looking back once " * 3


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None, PASSAGE + "alpha", "en", None, None), (None, "other text", None, "s", 1), (3, PASSAGE + "beta", "en", "s", 1), (3, PASSAGE + "beta", "en", "s", 1), (4, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2)


def test_every_operator_takes_rows_without_id(docs):
    assert quality_rules.judged(docs).count() == 5
    got = sorted(((r.doc_id, r.n_removed) for r in suffix_dedup.digests(docs).collect()), key=repr)
    n = len(PASSAGE)
    assert [x for x in got if x[0] is None] == [(None, 0), (None, n)] and [x for x in got if x[0] == 3] == [(3, n + 4)] * 2
    assert source_mixing.weighted(docs).count() == 5
    near = simhash_dedup.near_duplicates(docs).collect()
    assert {r.component_id for r in near if r.doc_id == 3} == {3} and len(near) == 5
    assert simhash_dedup.deduplicated(docs).count() >= 3
    assert packing.packed(docs).select("doc_id").distinct().count() == 3
    assert lm_score.scored(docs).count() == 5
    assert token_counts.token_counts(docs).count() == 5
    assert language_id.predicted(docs).count() == 5


def test_vectors_without_id(spark):
    v = [1.0] * 32
    frame = spark.createDataFrame([(None, v), (5, v), (None, [-1.0] * 32)], "vec_id long, embedding array<float>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in cap_filters.near_duplicates(frame).collect()), key=repr)
    assert got == [(5, 1, 5, True), (None, 0, None, True), (None, 1, 5, False)]


def test_pipeline_without_ids(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    corpus_pipeline.run(spark, str(tmp_path)).count()
