"""The golden lists: duplicates, empty lists, empty truth, unknown items."""

import pytest
from planted import lists
from pyspark.sql import functions as F

from rankweave.operators import metrics

RECS = {0: [1, 2, 3, 4], 1: [5, 1], 2: [], 3: [2, 2, 6], 4: [7, 8]}
TRUTH = {0: [2, 4, 9], 1: [3], 2: [1], 3: [2], 4: []}
EXPECTED = {0: [2, 1], 1: [], 2: [1], 3: [6], 4: [7]}
GOLDEN = {
    ("precision", 2): 0.375, ("precision", 3): 0.208333,
    ("recall", 2): 0.333333, ("recall", 3): 0.333333,
    ("f1", 2): 0.352941, ("f1", 3): 0.25641,
    ("ndcg", 2): 0.504446, ("ndcg", 3): 0.481753,
    ("map", 2): 1.125, ("map", 3): 1.083333,
    ("mrr", 2): 0.3, ("mrr", 3): 0.3,
    ("serendipity", 2): 0.25, ("serendipity", 3): 0.125,
}


@pytest.fixture(scope="module")
def users(spark):
    return spark.range(5).withColumnRenamed("id", "user_id")


def values(df):
    return {(r.metric, r.k): r.value for r in df.collect()}


def test_golden_lists(spark, users):
    names = metrics.RANKING_METRICS + ("serendipity",)
    got = values(metrics.ranking_metrics(
        lists(spark, RECS), lists(spark, TRUTH), users, [2, 3], names, expected=lists(spark, EXPECTED)
    ))
    assert got == pytest.approx(GOLDEN, abs=1e-6)


def test_repeated_truth_counts_once(spark, users):
    doubled = {u: t + t for u, t in TRUTH.items()}
    got = values(metrics.ranking_metrics(lists(spark, RECS), lists(spark, doubled), users, [2, 3]))
    assert got == pytest.approx({k: v for k, v in GOLDEN.items() if k[0] != "serendipity"}, abs=1e-6)


def test_map_over_all_users(spark, users):
    got = values(metrics.ranking_metrics(lists(spark, RECS), lists(spark, TRUTH), users, [2], ("map",), all_users_map=True))
    assert got["map", 2] == pytest.approx(1.125 * 2 / 5)


def test_nobody_gives_zero(spark, users):
    nobody = users.filter("user_id < 0")
    got = values(metrics.ranking_metrics(lists(spark, RECS), lists(spark, TRUTH), nobody, [2]))
    assert set(got.values()) == {0.0}


def test_graded_ndcg(spark):
    import math

    recs = lists(spark, {0: [1, 2, 3]})
    gains = spark.createDataFrame([(0, 1, 1.0), (0, 3, 3.0), (0, 9, 2.0)], "user_id long, item_id long, gain double")
    one = spark.range(1).withColumnRenamed("id", "user_id")
    got = values(metrics.ranking_metrics(recs, gains, one, [3], ("graded_ndcg",), gains=gains))
    dcg = 1.0 + 3.0 / math.log2(4)
    ideal = 3.0 + 2.0 / math.log2(3) + 1.0 / math.log2(4)
    assert got["graded_ndcg", 3] == pytest.approx(dcg / ideal)


def test_beyond_accuracy(spark):
    recs = lists(spark, RECS)
    vectors = spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate([(1, 0), (1, 0), (0, 1), (1, 1), (-1, 0), (0, 2), (3, 4)])],
        "item_id long, factors array<double>",
    )
    shares = spark.createDataFrame(
        [(1, 0.5), (2, 0.25), (3, 0.125), (4, 0.0), (5, 1.0), (6, 0.25)], "item_id long, popularity double"
    )
    catalogue = spark.range(10).withColumnRenamed("id", "item_id")
    assert metrics.catalogue_coverage(recs, catalogue).first().coverage == pytest.approx(0.8)
    assert metrics.catalogue_coverage(recs, catalogue, 1).first().coverage == pytest.approx(0.4)
    assert metrics.list_diversity(recs, vectors).first().diversity == pytest.approx(0.727383, abs=1e-6)
    assert metrics.list_novelty(recs, shares).first().novelty == pytest.approx(4.101607, abs=1e-6)
    assert metrics.catalogue_coverage(recs, catalogue.limit(0)).first().coverage == 0.0


def test_rating_errors_and_intervals(spark):
    rows = spark.createDataFrame(
        [(4.0, 3.0, 2.0, 4.0), (2.0, 4.0, 3.0, 5.0)], "rating double, estimate double, lower double, upper double"
    )
    errors = metrics.rating_errors(rows).first()
    assert (errors.mse, errors.mae, errors.n_predictions) == (2.5, 1.5, 2)
    assert errors.rmse == pytest.approx(2.5 ** 0.5)
    report = metrics.interval_report(rows).first()
    assert (report.confidence_coverage, report.avg_interval_width) == (0.5, 2.0)  # the bound counts as inside
