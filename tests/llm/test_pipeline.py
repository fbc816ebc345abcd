import pandas as pd

import corpus_pipeline

from llm_corpora import make_docs, near_copies


def test_stages_return_documents(spark, odd_texts):
    texts = [*odd_texts, *near_copies(), "call +1 (988) 555-2485 " + " ".join(f"word{i}" for i in range(30))]
    docs = make_docs(spark, texts)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, "").cache()
        assert docs.columns == make_docs(spark, ["x"]).columns, name
        assert docs.count() <= before
    assert docs.where("text like '%555-2485%'").count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "").toPandas()
    assert set(pieces.doc_id) == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_stages_take_empty_tables(spark):
    docs = make_docs(spark, ["x"]).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_run_over_a_folder(spark, tmp_path):
    texts = near_copies()
    make_docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert len(got) and isinstance(got, pd.DataFrame)
    whole = got.groupby("doc_id").length.sum()
    assert (whole == got.groupby("doc_id").doc_tokens.first()).all()
