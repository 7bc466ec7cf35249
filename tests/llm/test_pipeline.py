"""The pipeline over small tables, each stage held against what it must do."""

import corpus_pipeline
from gridsmith.llm import decontam, jaccard, quality

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = [{r.doc_id for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        seen.append({r.doc_id for r in docs.collect()})
        assert seen[-1] <= seen[-2]
        if name == "near duplicates":
            assert seen[-1] == {r.class_id for r in jaccard.classes(before).collect()}
        if name == "benchmark decontamination":
            assert decontam.matches(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    rules = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert seen[1] == {r.doc_id for r in quality.judge(spark.read.parquet(f"{SF}/documents.parquet"), rules).filter("kept").collect()}
    assert seen[4] == seen[3], "redaction drops nothing"
    coded = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in coded} == seen[-1] and all(len(r.ids) == r.n_tokens for r in coded)


def test_stages_of_odd_rows(spark, odd, nothing):
    """Nulls, repeated rows, a long text, clashing names and an empty table, in each stage."""
    ids = lambda df: sorted(-1 if r.doc_id is None else r.doc_id for r in df.select("doc_id").collect())
    want = {
        "near duplicates": [-1, -1, 1, 3, 4, 5, 6, 7],
        "benchmark decontamination": ids(odd),
        "personal data": ids(odd),
        "byte-level BPE": ids(odd),
    }
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, odd, SF), stage(spark, nothing, SF)
        assert none.count() == 0, name
        if name != "byte-level BPE":
            assert out.columns == odd.columns and none.columns == nothing.columns, name
        got = ids(out)
        if name in want:
            assert got == want[name], name
        else:
            assert set(got) <= {-1, 1, 2, 7}, "texts of under ten words go"
