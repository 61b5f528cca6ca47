"""The pipeline's stages on the smallest tables: each keeps what its brute-force version keeps."""

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from sparkloom.llm import decontaminate, jaccard, quality, secrets  # noqa: E402


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = {r.doc_id for r in docs.collect()}
    want = {
        "quality_classifier": lambda d: {r.doc_id for r in quality.classify(d, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect() if r.predicted},
        "ngram_jaccard_join": lambda d: {r.component_id for r in jaccard.jaccard_components(d).collect()},
        "benchmark_decontamination": lambda d: {r.doc_id for r in d.collect()}
        - {r.doc_id for r in decontaminate.contamination(d, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()},
        "secret_scans": lambda d: {r.doc_id for r in d.collect()},
    }
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns
        after = {r.doc_id for r in out.collect()}
        assert after == want[name](docs) and after <= kept
        docs, kept = pipeline.settle(out, "test-stage"), after
    assert docs.filter("n_chars <> length(text)").count() == 0
    assert not {r.doc_id for r in secrets.scan(docs).filter("n_live > 0").collect()}
    last = pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in last.collect()} == kept
