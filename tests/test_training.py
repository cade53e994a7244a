"""Training on planted structure: better than the mean, better than popularity, repeatable."""

import hashlib
import time
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from planted import planted_ratings
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from rankweave.operators import als, alternating, metrics, pairwise, prep, rotation, sgd, stats, topk
from rankweave.operators.model import FactorModel
from rankweave.plans import evaluate, search
from rankweave.session import cut_lineage

CUT = 3.4


@pytest.fixture(scope="module")
def data(spark):
    rows = cut_lineage(planted_ratings(spark))
    train, test = prep.holdout_split(rows)
    return {
        "all": rows, "train": train, "test": test,
        "positives": cut_lineage(prep.to_implicit(train, CUT)), "truth": cut_lineage(prep.to_implicit(test, CUT)),
    }


def mean_rmse(data):
    mean = data["train"].agg(F.avg("rating")).first()[0]
    return metrics.rating_errors(data["test"].withColumn("estimate", F.lit(mean))).first().rmse


@pytest.mark.parametrize("params", [{}, {"biased": True}, {"algorithm": "nmf"}])
def test_explicit_models_beat_the_mean(data, params):
    model = als.fit_explicit(data["train"], n_factors=6, n_epochs=8, regularization=0.05, **params)
    errors = evaluate.evaluate_ratings(model, data["test"]).first()
    assert errors.n_predictions == data["test"].count()
    assert errors.rmse < 0.7 * mean_rmse(data)
    bu, bi = model.biases()
    assert (bu is None) == (not params.get("biased", False))
    if params.get("algorithm") == "nmf":
        assert model.users.select(F.min(F.array_min("factors"))).first()[0] >= 0


def test_cold_ids_fall_back_to_the_mean(spark, data):
    model = als.fit_explicit(data["train"], n_factors=4, n_epochs=2)
    pair = spark.createDataFrame([(10**6, 10**6)], "user_id long, item_id long")
    mean = data["train"].agg(F.avg("rating")).first()[0]
    assert model.predict(pair).first().estimate == pytest.approx(mean)


def test_wide_ids_go_through_a_dictionary(data):
    far = data["train"].withColumn("user_id", F.col("user_id") + F.lit(10**12))
    model = als.fit_explicit(far, n_factors=4, n_epochs=2)
    assert model.users.agg(F.min("user_id")).first()[0] >= 10**12


def precision(model, data):
    users = prep.evaluation_users(data["truth"])
    recs = model.recommend(users, 10, data["positives"])
    return metrics.ranking_metrics(recs, data["truth"], users, [10], ("precision",)).first().value


def popularity_precision(data):
    users = prep.evaluation_users(data["truth"])
    scores = stats.item_popularity(data["positives"], data["all"]).select("item_id", F.col("popularity").alias("score"))
    recs = topk.shared_ranking_topk(scores, users, data["positives"], 10)
    return metrics.ranking_metrics(recs, data["truth"], users, [10], ("precision",)).first().value


@pytest.mark.parametrize("loss", pairwise.LOSSES)
def test_pairwise_losses_beat_popularity(data, loss):
    settings = pairwise.PairwiseSettings(
        loss=loss, factors=8, rounds=4, passes=3, learning_rate=0.3, users_per_block=100, items_per_block=80
    )
    model = pairwise.fit_pairwise(data["positives"], data["all"], settings)
    losses = model.info["losses"]
    assert losses[-1] < losses[0]
    assert precision(model, data) > 1.5 * popularity_precision(data)


def test_warp_is_as_good_in_one_cell_as_in_64(data):
    """One block of users and items, and a rotation of eight by eight."""
    found = {}
    for blocks in (1, 8):
        settings = pairwise.PairwiseSettings(loss="warp", factors=8, rounds=4, passes=3, learning_rate=0.2, blocks=blocks)
        found[blocks] = precision(pairwise.fit_pairwise(data["positives"], data["all"], settings), data)
    assert found[8] > 0.8 * found[1] > 1.2 * popularity_precision(data)


def test_rotation_meets_every_sample_once_and_shares_nothing(data):
    run = pairwise.rotation(data["positives"], data["all"], pairwise.PairwiseSettings(factors=2, blocks=5))
    dealt = run.dealt()
    assert run.blocks == 5 and dealt.count() == run.samples.count() == dealt.select("a", "b").distinct().count()
    for turn in range(5):
        now = dealt.filter(F.col("turn") == turn)
        for side in ("a", "b"):
            assert now.groupBy(side).agg(F.countDistinct("cell").alias("n")).filter("n > 1").count() == 0
    run.round(dealt, 0)
    assert run.state.filter("kind < 2").groupBy("kind", "id").count().filter("count > 1").count() == 0


def test_draws_are_not_sent_and_rounds_not_written(data, monkeypatch):
    """An epoch writes its state once; writing it after every round, as before, gives the same."""
    found = []
    for chained in (8, 1):
        monkeypatch.setattr(rotation, "CHAINED", chained)
        run = pairwise.rotation(data["positives"], data["all"], pairwise.PairwiseSettings(factors=2, blocks=5))
        assert run.dealt().filter("vec IS NOT NULL").count() == 0
        run.run_epoch()
        assert run.written == (1 if chained == 8 else 5)
        found.append({r.feature_id: r.factors for r in run.features().collect()})
    assert found[0] == found[1]


def test_negatives_are_redrawn_and_no_positives(data):
    run = pairwise.rotation(data["positives"], data["all"], pairwise.PairwiseSettings(factors=2, blocks=3))
    drawn = run.negatives().cache()
    taken = data["positives"].select("user_id", F.col("item_id").alias("negative_id"))
    assert drawn.join(taken, ["user_id", "negative_id"]).count() == 0
    assert drawn.groupBy("user_id", "item_id").count().filter("count = 3").count() > 0.97 * run.samples.count()
    assert drawn.filter("draw > 2").count() > 0  # later tries stand in for positives


@pytest.mark.parametrize("biased", [False, True])
def test_gradient_descent_beats_the_mean(data, biased):
    model = sgd.fit_sgd(data["train"], 6, 40, 0.02, 0.02, biased, passes=10)
    errors = evaluate.evaluate_ratings(model, data["test"]).first()
    assert errors.rmse < (0.8 if biased else 0.9) * mean_rmse(data)
    assert model.info["losses"][-1] < model.info["losses"][0] and (model.biases()[0] is None) == (not biased)


def test_two_penalties_of_nonnegative_factors(data):
    """More penalty for users alone makes their factors smaller against the items', products stay close."""
    norm = lambda df: df.select(F.avg(F.aggregate("factors", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    share = []
    for pu, qi in ((0.4, 0.1), (0.1, 0.4)):
        model = als.fit_explicit(data["train"], 4, 8, algorithm="nmf", reg_pu=pu, reg_qi=qi)
        share.append(norm(model.users) / norm(model.items))
        worst = als.user_residuals(data["train"], "rating", model.users, model.items, pu).agg(F.max("worst_nonnegative")).first()[0]
        assert worst < 1e-2
    assert 2 * share[0] < share[1]


@pytest.mark.parametrize("alpha", [None, 2.0])
def test_residuals_equal_the_normal_equations(spark, alpha):
    rng = np.random.default_rng(4)
    p, q = rng.normal(size=(5, 3)), rng.normal(size=(7, 3)).astype(np.float32).astype(float)
    rows = [(u, i, float(u + i) / 3) for u in range(5) for i in range(7) if (u * i) % 3 != 1]
    table = lambda name, x: spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], f"{name} long, factors array<double>")
    ratings = spark.createDataFrame(rows, "user_id long, item_id long, v double")
    got = {r.user_id: r for r in als.user_residuals(ratings, "v", table("user_id", p), table("item_id", q), 0.1, alpha).collect()}
    for u in range(5):
        mine = [(q[i], v) for w, i, v in rows if w == u]
        weight = [(v - p[u] @ x) if alpha is None else 1 + alpha * v * (1 - p[u] @ x) for x, v in mine]
        right = sum(x * (v if alpha is None else 1 + alpha * v) for x, v in mine)
        off = sum(x * w for (x, _), w in zip(mine, weight)) - 0.1 * len(mine) * p[u]
        off = off if alpha is None else off - q.T @ q @ p[u]
        scale = np.abs(right).max() + 1e-12
        assert got[u].worst == pytest.approx(np.abs(off).max() / scale)
        sided = np.where(p[u] > 0, np.abs(off), np.maximum(off, 0))
        assert got[u].worst_nonnegative == pytest.approx(sided.max() / scale)


def test_blocks_do_not_follow_the_shuffle_partitions():
    assert als.block_count(12, 2_100_000, 50, 20) == 5  # factors of all would be sent to each block 40 times
    assert als.block_count(12, 12_600_000, 10, 5) == 12
    assert als.block_count(8, 10_000, 100, 15) == 10


def test_narrow_fits_have_few_blocks_on_large_tables():
    assert als.light_blocks(2_100_000, 16, 5) == 6 and als.light_blocks(12_600_000, 16, 5) == 4
    assert als.light_blocks(210_000, 16, 5) > 12  # small tables as before
    assert als.light_blocks(210_000, 100, 15) > 12


@pytest.mark.parametrize("params", [
    dict(rank=40, regParam=0.1), dict(rank=40, regParam=0.02, implicitPrefs=True, alpha=2.0), dict(rank=3, regParam=0.1),
])
def test_batched_solver_equals_sparks(spark, monkeypatch, params):
    """Rows of few and of many ratings, repeated pairs, ratings of zero and below; rank 3 has more ratings than factors."""
    rows = spark.range(1, 3000).selectExpr("id * id % 97 user_id", "-(id * 37 % 113) item_id", "cast(id % 7 - 1 as double) value")
    few = spark.createDataFrame([(1000, -5, 2.0), (1000, -6, 4.0), (1000, -6, 4.0), (1001, -500, 1.0)], "user_id long, item_id long, value double")
    found = []
    monkeypatch.setattr(als, "WIDE_RANK", 1)
    for heavy in (0, float("inf")):
        monkeypatch.setattr(als, "HEAVY_FIT", heavy)
        sides = als._fit(rows.unionByName(few), "value", maxIter=2, seed=5, **params)
        found.append([{r[0]: r.factors for r in side.collect()} for side in sides])
    for ours, sparks in zip(*found):
        assert ours.keys() == sparks.keys()
        assert all(ours[k] == pytest.approx(sparks[k], rel=1e-4, abs=1e-6) for k in ours)


def test_rows_of_few_ratings_need_no_system_as_wide_as_the_factors(monkeypatch):
    """In a batch of rows, as many unknowns as ratings; threads and rows added up in parts give the same."""
    rng = np.random.default_rng(0)
    own, other = np.repeat(np.arange(30, dtype=np.int32), 5), np.tile(np.arange(5, dtype=np.int32), 30)
    block = alternating.Block(alternating.Block.packed(own, other, rng.random(150).astype(np.float32) + 1, 0, 2))
    factors = rng.normal(size=(5, 40)).astype(np.float32)
    widths, solve = [], np.linalg.solve
    monkeypatch.setattr(np.linalg, "solve", lambda a, b: widths.append(a.shape[1]) or solve(a, b))
    for gram, alpha in ((None, None), (factors.astype(float).T @ factors + np.eye(40), 1.5)):
        results = [block.solve(factors, gram, alternating.Terms(40, 0.1, alpha, threads)) for threads in (1, 3)]
        assert set(widths) == {5}
        widths.clear()
        spectrum = None if gram is None else np.linalg.eigh(gram)
        monkeypatch.setattr(alternating, "BATCH_BYTES", 1)
        results.append(block._solved(np.arange(30), 5, factors, gram, spectrum, alternating.Terms(40, 0.1, alpha)))
        assert set(widths) == {40}
        widths.clear()
        monkeypatch.undo()
        monkeypatch.setattr(np.linalg, "solve", lambda a, b: widths.append(a.shape[1]) or solve(a, b))
        assert (results[0] == results[1]).all() and np.allclose(results[0], results[2], atol=1e-5)


def test_solved_factors_stay_floats(data):
    model = als.fit_implicit_als(data["positives"], data["all"], 4, 2)
    for side in (model.users, model.items):
        assert side.schema["factors"].dataType.simpleString() == "array<float>"


def test_large_tables_turn_in_few_rounds():
    settings = pairwise.PairwiseSettings(factors=16)
    assert rotation.count_blocks(900_000, 1_200_000, 20_000_000, settings) == 8
    assert rotation.count_blocks(900_000, 1_200_000, 20_000_000, replace(settings, factors=128)) == 19


def test_narrow_state_of_large_tables_is_moved_eight_times_an_epoch():
    assert rotation.count_blocks(5_400_000, 7_200_000, 126_000_000, pairwise.PairwiseSettings(factors=16)) == 8


def test_samples_are_dealt_without_a_shuffle(data):
    run = pairwise.rotation(data["positives"], data["all"], pairwise.PairwiseSettings(factors=2, blocks=5))
    plans, write = [], DataFrameWriter.parquet
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: plans.append(self._df._jdf.queryExecution().toString()) or write(self, *a, **k))
        dealt = run.dealt()
    assert len(plans) == 1 and "Repartition" not in plans[0] and dealt.count() == run.samples.count()


def test_search_cuts_slow_trials_at_the_budget(spark, tmp_path):
    """One trial that never ends in time, one that does, one not begun."""
    trials = spark.createDataFrame([(0, 1), (1, 10**9), (2, 1)], "trial int, size long")

    def objective(p, workspace):
        spark.range(3).write.parquet(workspace)
        n = spark.range(p["size"] * 1000, numPartitions=8).selectExpr("sum(hash(id, id + 1))").first()
        return 1.0, {"n": 0.0 if n is None else 1.0}

    start = time.time()
    rows = {r.trial: r for r in search._run(trials, objective, ["n"], 20, parallel=1).collect()}
    assert time.time() - start < 60
    assert [rows[k].state for k in range(3)] == ["COMPLETE", "TIMED_OUT", "TIMED_OUT"]
    assert rows[0].value == 1.0 and rows[1].value is None
    states = {r.trial: r.state for r in search.prune_trials(search._run(trials.filter("trial <> 1"), objective, ["n"], 60)).collect()}
    assert states == {0: "COMPLETE", 2: "COMPLETE"}


def _cell(settings, width=4, taken=(0,)):
    """A cell of three users who have taken some of ten items."""
    part = lambda kind, a, b, vec: pa.table({
        "kind": np.full(len(a), kind, np.int32), "a": np.array(a, np.int64), "b": np.array(b, np.int64), "value": np.ones(len(a)),
        "vec": pa.array([list(map(float, v)) for v in vec], pa.list_(pa.float64())), "bias": np.zeros(len(a)), "g2": np.zeros(len(a)),
    })
    rng, pairs = np.random.default_rng(2), [(u, i) for u in range(3) for i in taken]
    word = lambda u, i, t: int(hashlib.md5(f"42-5-{u}-{i}-{t}".encode()).hexdigest()[:8], 16)
    return rotation.Cell(pa.concat_tables([
        part(rotation.USER, range(3), [0] * 3, rng.normal(size=(3, width))),
        part(rotation.FEATURE, range(10), [0] * 10, rng.normal(size=(10, width))),
        part(rotation.SAMPLE, *zip(*pairs), [[word(u, i, t) for t in range(settings.first_tries)] for u, i in pairs]),
    ]), settings, 10, epoch=5), word


@pytest.mark.parametrize("loss, sent", [("bpr", 3), ("logistic", 3), ("warp", 2)])
def test_few_draws_are_sent_and_the_others_made_when_needed(loss, sent):
    settings = rotation.RotationSettings(loss=loss, factors=4)
    cell, word = _cell(settings, taken=range(7))
    assert cell.draws.shape[1] == settings.first_tries == sent < settings.tries
    if loss == "warp":
        found = cell._violations(np.arange(21), 0)
        assert found[0].size and not cell.is_positive(found[0], found[2]).any()
        return
    at, tries, others = cell.negatives(np.arange(21))
    want = []
    for k in range(21):
        u, i = divmod(k, 7)
        free = [(k, t, word(u, i, t) % 10) for t in range(settings.tries) if word(u, i, t) % 10 >= 7]
        want += free[: settings.negatives]
    assert [*zip(at.tolist(), tries.tolist(), others.tolist())] == want and max(tries) > 2


def test_warp_scores_a_try_only_after_the_one_before(monkeypatch):
    """Everything violates at first, so one draw of each positive is scored, not ten."""
    cell, _ = _cell(rotation.RotationSettings(loss="warp", factors=4))
    cell.state[rotation.USER][0][:] = 0.0
    asked = []
    scores = rotation.Cell.scores
    monkeypatch.setattr(rotation.Cell, "scores", lambda self, users, *more: asked.append(len(users)) or scores(self, users, *more))
    cell._violations(np.arange(3), 0)
    assert sum(asked) <= 3 + 2 * 3


def test_training_repeats_exactly(data):
    settings = pairwise.PairwiseSettings(factors=4, rounds=1, passes=1)
    first, second = (
        {r.item_id: r.factors for r in pairwise.fit_pairwise(data["positives"].repartition(n), data["all"], settings).items.collect()}
        for n in (2, 5)
    )
    assert first == second


def test_hybrid_learns_from_features(spark, data):
    """Items are described only by the bucket of their hidden dimensions' signs."""
    from rankweave.functions.hashing import uniform

    signs = F.array(*[
        F.concat(F.lit(f"d{d}="), (uniform(1, 2, "item_id", F.lit(d)) > 0.5).cast("string")) for d in range(4)
    ])
    items = data["all"].select("item_id").distinct()
    features = items.select("item_id", F.explode(signs).alias("feature"), F.lit(1.0).alias("value"))
    settings = pairwise.PairwiseSettings(loss="warp", factors=8, rounds=3, passes=3, learning_rate=0.1, user_reg=1e-6, item_reg=1e-6)
    model = pairwise.fit_hybrid(data["positives"], features, settings)
    assert model.info["loss"] == "warp"
    assert model.items.count() == items.count()
    assert precision(model, data) > 1.2 * popularity_precision(data)


@pytest.mark.parametrize("described", ["item_id % 5 <> 0", "item_id < 40"])
def test_hybrid_trains_items_without_features(data, described):
    """Neither scattered items without features nor the last ones are taken for other items."""
    items = data["all"].select("item_id").distinct()
    features = items.filter(described).select(
        "item_id", F.concat(F.lit("f="), (F.col("item_id") % 3).cast("string")).alias("feature"), F.lit(1.0).alias("value")
    )
    links = pairwise.feature_links(features, universe=items)
    assert links.select("item_id").distinct().count() == items.count()
    alone = links.join(features.select("item_id").distinct(), "item_id", "left_anti")
    assert alone.count() == alone.select("feature_id").distinct().count() == items.count() - features.count()
    settings = pairwise.PairwiseSettings(
        loss="warp", factors=4, rounds=2, passes=2, learning_rate=0.1, users_per_block=100, items_per_block=50
    )
    model = pairwise.fit_hybrid(data["positives"], features, settings, universe=items)
    assert model.items.count() == items.count()
    apart = model.items.join(features, "item_id", "left_anti").select("factors").distinct().count()
    assert apart == items.count() - features.count()


def test_no_rows_train_no_factors(data):
    model = als.fit_explicit(data["train"].limit(0), n_factors=4, n_epochs=2)
    assert model.users.count() == 0 and model.items.count() == 0


def test_unknown_loss_is_rejected(data):
    with pytest.raises(ValueError):
        pairwise.fit_pairwise(data["positives"], data["all"], pairwise.PairwiseSettings(loss="hinge"))


def test_implicit_als_lists(data):
    model = als.fit_implicit_als(data["positives"], data["all"], 8, 8, 0.05)
    users = prep.evaluation_users(data["truth"])
    recs = model.recommend(users, 10, data["positives"]).cache()
    assert recs.join(data["positives"], ["user_id", "item_id"]).count() == 0
    shape = recs.groupBy("user_id").agg(F.max("rank").alias("m"), F.count("*").alias("n")).filter("m != n").count()
    assert shape == 0
    assert precision(model, data) > 1.3 * popularity_precision(data)


def test_models_survive_storage(spark, data, tmp_path):
    model = als.fit_explicit(data["train"], n_factors=4, n_epochs=2, biased=True)
    model.save(str(tmp_path / "m"))
    again = FactorModel.load(spark, str(tmp_path / "m"))
    key = lambda r: (r.user_id, r.item_id)
    a = sorted(model.predict(data["test"]).collect(), key=key)
    b = sorted(again.predict(data["test"]).collect(), key=key)
    assert [r.estimate for r in a] == pytest.approx([r.estimate for r in b])


def test_cross_validation(data):
    folds = evaluate.cross_validate(data["train"], lambda part: als.fit_explicit(part, 4, 3, 0.1), folds=2)
    assert [r.fold for r in folds.collect()] == [0, 1]
    assert evaluate.fold_summary(folds).first().rmse_mean > 0


def test_pruning_counts_only_completed_trials(spark):
    values = [0.1, 0.2, 0.3, 0.4, 0.5, 0.1, 0.45, 0.9, 0.42]
    trials = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "trial int, value double")
    states = [r.state for r in search.prune_trials(trials).orderBy("trial").collect()]
    assert states == ["COMPLETE"] * 5 + ["PRUNED", "COMPLETE", "COMPLETE", "PRUNED"]
