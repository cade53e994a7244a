"""Each stage on what the one before kept."""

import corpus_pipeline
from edge_rows import CLASHES, documents, empty
from rankweave.llm.common import Scratch
from test_kernels import shingle_set
from test_near_dedup import brute
from test_packing import laws
from rankweave.llm.packing import PackingSettings


def test_stages(spark, folder):
    scratch, docs, kept = Scratch(spark, "test"), spark.read.parquet(f"{folder}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, scratch.store(stage(spark, docs, folder))
        kept.append((before, docs))
        assert name == "packing" or docs.columns == columns
    texts = {r.doc_id: r.text for r in kept[2][0].collect()}
    assert {r.doc_id for r in kept[2][1].collect()} == {i for i, top in brute(texts, 5).items() if i == top}
    assert all(shingle_set(t, 5) for t in texts.values())
    s = PackingSettings()
    used, bound = laws(kept[4][0], kept[4][1].collect(), s)
    assert used <= bound + 1
    clean = {r.doc_id for r in kept[3][1].collect()}
    assert clean < {r.doc_id for r in kept[3][0].collect()}
    assert corpus_pipeline.run(spark, folder).count() == kept[4][1].count()


def test_edges(spark, folder):
    for rows in (documents(spark, clashes=True), empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, folder)
            out.collect()
            assert name == "packing" or set(out.columns) == set(rows.columns) and (CLASHES[0] in rows.columns) == (CLASHES[0] in out.columns)
