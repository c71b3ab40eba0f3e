"""The pipeline's stages keep to their contract and their decisions take effect."""

import re

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for i, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF)
        if i + 1 == len(P.STAGES):
            assert {"doc_id", "sequence_id", "offset"} <= set(out.columns)
            assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()}
            break
        assert out.columns == docs.columns
        out = P.materialize(out)
        before, after = docs.collect(), out.collect()
        ids = {r["doc_id"] for r in after}
        if i == 0:
            assert all(d in ids for d, q in labels.items() if q == 1)
            assert len(ids) < len(before)
        elif i == 1:
            first = {}
            for r in sorted(before, key=lambda r: r["doc_id"]):
                first.setdefault(norm(r["text"]), r["doc_id"])
            assert ids == set(first.values()) and len(after) == len(ids)
        elif i == 2:
            assert len(after) == len(ids) <= len(before)
        else:
            assert ids <= {r["doc_id"] for r in before}
        docs = out


def test_run(spark):
    assert P.run(spark, SF).count() > 0
