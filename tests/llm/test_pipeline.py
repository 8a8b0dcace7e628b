import corpus_pipeline

from strandloom.llm import packing, quality_rules, simhash_dedup, source_mixing, suffix_dedup


def test_stages_compose(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    kept = {r.doc_id for r in quality_rules.judged(docs).collect() if r.kept}
    one = stages["quality rules"](spark, docs, data)
    assert {r.doc_id for r in one.collect()} == kept
    firsts = {r.doc_id for r in simhash_dedup.near_duplicates(one).collect() if r.doc_id == r.component_id}
    two = stages["SimHash near-dedup"](spark, one, data)
    assert {r.doc_id for r in two.collect()} == firsts
    three = stages["suffix-array dedup"](spark, two, data).cache()
    removed = {r.doc_id: r.n_removed for r in suffix_dedup.digests(two).collect()}
    whole = {r.doc_id: r.text for r in two.collect()}
    assert all((r.text == whole[r.doc_id]) == (removed[r.doc_id] == 0) for r in three.collect()) and three.count() == len(firsts)
    drawn = {r.doc_id for r in source_mixing.weighted(three).collect() if r.selected}
    four = stages["mixing to target weights"](spark, three, data)
    assert {r.doc_id for r in four.collect()} == drawn and all(f.columns == columns for f in (one, two, three, four))
    five = stages["packing"](spark, four, data)
    assert {r.doc_id for r in five.collect()} == drawn and five.columns == packing.packed(four).columns


def test_run(spark, data):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "SimHash near-dedup", "suffix-array dedup", "mixing to target weights", "packing"]
    assert corpus_pipeline.run(spark, data).count() > 0
