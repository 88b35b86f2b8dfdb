"""The pipeline's stages, each on what the one before it kept."""

import corpus_pipeline
from rxspark.llm import base, queries

from .test_operators import _base_spans, _exact, _rule_stats


def test_stages(spark, sf_dir, texts):
    docs = base.table(spark, sf_dir, "documents")
    columns, rows = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = base.materialize(stage(spark, docs, sf_dir), name)
        if name == "packing":
            packed = docs.collect()
            assert {r.doc_id for r in packed} == set(rows)
            break
        assert docs.columns == columns
        found = {r.doc_id: r.text for r in docs.collect()}
        old = {r.doc_id: r.text for r in before.select("doc_id", "text").collect()}
        assert set(found) <= set(old)
        if name == "quality_rules":
            for i, text in old.items():
                n, *_, repeats = _rule_stats(text)
                assert (i in found) <= (n >= 10 and 100 * repeats <= 20 * n)
        if name == "near_dedup":
            assert set(found) == {i for i, root in _exact(old.items()).items() if i == root}
        if name == "pii":
            assert set(found) == set(old)
            assert all((found[i] != old[i]) == bool(_base_spans(old[i])) or "[" in found[i] for i in found)
        else:
            assert all(found[i] == old[i] for i in found)
        rows = found
    assert len(rows) > 0.6 * len(texts)
    again = corpus_pipeline.run(spark, sf_dir).collect()
    key = lambda r: (r.doc_id, r.piece, r.length, r.ids_crc32)
    assert sorted(map(key, again)) == sorted(map(key, packed))


def test_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 11)}
