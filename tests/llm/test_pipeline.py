"""The pipeline against the operators' own decisions, stage by stage."""

from __future__ import annotations

import hashlib

import corpus_pipeline
from weftlex.llm import jaccard_join, pii, quality, tiling


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "pii", "encoding"]
    labels, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    seen = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir).cache()
        got = {r.doc_id: r for r in out.collect()}
        if name == "quality":
            assert set(got) == {r.doc_id for r in quality.classify(docs, labels).collect() if r.kept}
        elif name == "near_duplicates":
            assert set(got) == {r.doc_id for r in jaccard_join.jaccard_components(docs).collect() if r.component_id == r.doc_id}
        elif name == "decontamination":
            assert set(got) == set(seen) - {r.doc_id for r in tiling.contaminated(docs, items).collect()} and len(got) < len(seen)
        elif name == "pii":
            assert set(got) == set(seen) and all(not pii.base_spans(r.text) for r in got.values())
            assert all(got[i].text == t for i, t in seen.items() if not pii.candidates(t) and not pii.base_spans(t))
        else:
            assert all(hashlib.sha256(t.encode()).hexdigest() == got[i].decoded_sha256 for i, t in seen.items())
            continue
        assert out.columns == columns
        docs, seen = out, {i: r.text for i, r in got.items()}


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 50
