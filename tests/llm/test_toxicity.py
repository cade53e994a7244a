"""The chain on held-out documents."""

import numpy as np
from edge_rows import ROWS, documents, empty
from rankweave.llm import toxicity


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.filter("doc_id % 3 = 0").collect()}
    scored = toxicity.score_toxicity(docs, labels.filter("doc_id % 3 <> 0")).collect()
    assert len(scored) == docs.count()
    said = {r.doc_id: r.toxic for r in scored if r.doc_id in truth}
    caught = [said[i] for i, t in truth.items() if t]
    alarms = [said[i] for i, t in truth.items() if not t]
    assert np.mean(caught) > 0.5 and np.mean(alarms) < 0.03


def test_later_models_use_earlier_probabilities():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (400, 5)).astype(float)
    y = x[:, 0]
    w = toxicity.fit_logistic(x, y, 1.0)
    assert w[0] > 3 and abs(w[1:5]).max() < 1
    assert toxicity._inputs([[1]], 3, np.array([[0.5]])).tolist() == [[0.0, 1.0, 0.0, 0.0]]


def test_edges(spark):
    docs = documents(spark, clashes=True)
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (5, 0), (99, 1)], "doc_id long, toxic int")
    assert toxicity.score_toxicity(docs, labels).count() == len(ROWS)
    none = toxicity.score_toxicity(docs, labels.limit(0)).collect()
    assert len(none) == len(ROWS) and len({r.p_toxic for r in none}) == 1
    assert toxicity.score_toxicity(empty(spark), labels).count() == 0
