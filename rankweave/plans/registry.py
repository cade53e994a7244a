"""Named queries over the star-schema tables, one per operator or pipeline."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.operators import als, biases, metrics, pairwise, prep, rotation, sampling, scoring, stats, topk
from rankweave.operators.model import FactorModel
from rankweave.plans import evaluate, search
from rankweave.session import cut_lineage, fresh_path, ship_package, write_and_read
from rankweave.sources import sinks, tables

KS = [5, 10, 20]
TOP_N = 20
REG_USER, REG_ITEM = 5.0, 5.0
REDRAWS = rotation.REDRAWS
# One epoch in four blocks, a step per cell: what SQL repeats.
_STEP = dict(factors=4, rounds=1, passes=1, learning_rate=0.1, user_reg=0.01, item_reg=0.02, batch=1 << 40, blocks=4)
ROUND = {loss: rotation.RotationSettings(loss=loss, **_STEP) for loss in rotation.LOSSES}
ROUND["squared"] = replace(ROUND["squared"], offset=3.0, learning_rate=0.02, user_bias_reg=0.03, item_bias_reg=0.04)
HYBRID_BPR = ROUND["bpr"]

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    @wraps(fn)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, folder)

    _QUERIES[fn.__name__] = run
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def r6(column, name: str):
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value.cast("double"), 6).alias(name)


class Split:
    """The standard hold-out of the ratings view and its positives.

    ``stored`` writes the split first, for queries that read it several times.
    """

    def __init__(self, spark: SparkSession, folder: str, stored: bool = True):
        self.ratings = tables.ratings(spark, folder)
        tagged = prep.store_split(self.ratings, fresh_path(spark, "split")) if stored else prep.holdout_tag(self.ratings)
        if stored:
            self.ratings = tagged.drop("is_test")
        self.train = tagged.filter(~F.col("is_test")).drop("is_test")
        self.test = tagged.filter("is_test").drop("is_test")
        self.positives = prep.to_implicit(self.train)
        self.truth = prep.to_implicit(self.test)

    def popularity(self) -> DataFrame:
        return stats.item_popularity(self.positives, self.ratings, unique=True)

    def popular_lists(self, users: DataFrame, n: int = TOP_N) -> DataFrame:
        scores = self.popularity().select("item_id", F.col("popularity").alias("score"))
        return topk.shared_ranking_topk(scores, users, self.positives, n)

    def judged_users(self) -> DataFrame:
        return cut_lineage(prep.evaluation_users(self.truth))

    def biases(self, iterations: int = 2) -> biases.BiasModel:
        return biases.fit_biases(self.train, [biases.BiasRun(REG_USER, REG_ITEM)], iterations)

    def bias_estimates(self) -> DataFrame:
        return biases.predict_biases(self.test.select("user_id", "item_id", "rating"), self.biases())


def stored_ratings(spark: SparkSession, folder: str) -> DataFrame:
    """The ratings view written once, for queries that pass over it several times."""
    return write_and_read(tables.ratings(spark, folder), fresh_path(spark, "ratings"))


class Vectors:
    """Fixed item vectors and each user's mean liked vector: a factor model without training."""

    def __init__(self, spark: SparkSession, folder: str, split: Split):
        self.items = tables.item_vectors(spark, folder)
        self.users = cut_lineage(scoring.liked_item_vectors(split.positives, self.items))

    def lists(self, split: Split, users: DataFrame | None = None, n: int = TOP_N) -> DataFrame:
        mine = self.users if users is None else self.users.join(users, "user_id", "left_semi")
        return topk.factor_topk(mine, self.items, split.positives, n)


# --- sources and preparation ---------------------------------------------------------------

@query
def ratings_view(spark, folder):
    rows = tables.ratings(spark, folder)
    return rows.select("user_id", "item_id", "rating", F.unix_micros("ts").alias("ts_micros"))


@query
def item_user_view(spark, folder):
    return prep.transpose(Split(spark, folder, stored=False).positives).select("item_id", "user_id", "weight")


@query
def item_features(spark, folder):
    return tables.item_features(spark, folder)


@query
def holdout_split(spark, folder):
    return _tagged(spark, folder, 0.2)


def _tagged(spark, folder, fraction: float) -> DataFrame:
    tagged = prep.holdout_tag(tables.ratings(spark, folder), fraction)
    return tagged.select("user_id", "item_id", "rating", F.col("is_test").cast("int").alias("is_test"))


@query
def holdout_split_5pct(spark, folder):
    return _tagged(spark, folder, 0.05)


@query
def holdout_split_25pct(spark, folder):
    return _tagged(spark, folder, 0.25)


@query
def holdout_split_exact(spark, folder):
    tagged = prep.exact_holdout_tag(stored_ratings(spark, folder))
    return tagged.select("user_id", "item_id", "rating", F.col("is_test").cast("int").alias("is_test"))


@query
def validation_split(spark, folder):
    fit, held = prep.validation_split(Split(spark, folder, stored=False).train)
    tag = lambda df, flag: df.select("user_id", "item_id", "rating", F.lit(flag).alias("is_validation"))
    return tag(fit, 0).unionByName(tag(held, 1))


@query
def temporal_split(spark, folder):
    tagged = prep.temporal_tag(tables.event_feedback(spark, folder), order=("ts", "event_id"))
    return tagged.select("event_id", "user_id", "item_id", F.col("is_test").cast("int").alias("is_test"))


@query
def stratified_split(spark, folder):
    tagged = prep.stratified_tag(stored_ratings(spark, folder))
    return tagged.select("user_id", "item_id", "rating", F.col("is_test").cast("int").alias("is_test"))


@query
def min_train_items(spark, folder):
    return prep.min_items_per_user(Split(spark, folder, stored=False).positives, 5).select("user_id", "item_id")


@query
def implicit_threshold(spark, folder):
    split = Split(spark, folder, stored=False)
    tag = lambda df, name: df.select("user_id", "item_id", "weight", F.lit(name).alias("part"))
    return tag(split.positives, "train").unionByName(tag(split.truth, "test"))


@query
def confidence_weights(spark, folder):
    return prep.confidence_weights(Split(spark, folder, stored=False).train)


@query
def id_encode(spark, folder):
    rows = stored_ratings(spark, folder)
    users = prep.encode_ids(rows, "user_id").select(F.lit("user").alias("kind"), F.col("user_id").alias("raw_id"), "idx")
    items = prep.encode_ids(rows, "item_id").select(F.lit("item").alias("kind"), F.col("item_id").alias("raw_id"), "idx")
    return users.unionByName(items)


@query
def user_item_lists(spark, folder):
    tiles = prep.item_list_tiles(Split(spark, folder, stored=False).positives)
    return tiles.select(
        "user_id", "tile", F.size("items").cast("long").alias("n_items"), F.concat_ws(",", "items").alias("items")
    )


@query
def eval_user_sample(spark, folder):
    return prep.evaluation_users(Split(spark, folder, stored=False).truth, cap=1000)


# --- statistics ----------------------------------------------------------------------------

@query
def rating_profile(spark, folder):
    return stats.rating_profile(Split(spark, folder, stored=False).train).withColumn("global_mean", F.round("global_mean", 6))


@query
def interaction_profile(spark, folder):
    split = Split(spark, folder)
    return stats.interaction_profile(split.positives, split.ratings, unique=True).withColumn("density", F.round("density", 9))


@query
def item_popularity(spark, folder):
    return Split(spark, folder).popularity().select("item_id", "n_positives", r6("popularity", "popularity"))


@query
def vector_model_size(spark, folder):
    split = Split(spark, folder)
    vectors = Vectors(spark, folder, split)
    return stats.model_size(vectors.users, vectors.items)


# --- bias model and rating errors ----------------------------------------------------------

@query
def bias_export(spark, folder):
    by_user, by_item = Split(spark, folder).biases().single()
    users = by_user.select(F.lit("user").alias("kind"), F.col("user_id").alias("id"), r6("bias", "bias"))
    items = by_item.select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), r6("bias", "bias"))
    return users.unionByName(items)


@query
def bias_predict(spark, folder):
    return Split(spark, folder).bias_estimates().select("user_id", "item_id", "rating", r6("estimate", "estimate"))


@query
def rating_errors(spark, folder):
    errors = metrics.rating_errors(Split(spark, folder).bias_estimates())
    return errors.select(r6("rmse", "rmse"), r6("mae", "mae"), r6("mse", "mse"), "n_predictions")


@query
def interval_coverage(spark, folder):
    rows = Split(spark, folder).bias_estimates()
    spread = rows.withColumn("lower", F.round("estimate", 6) - 1.0).withColumn("upper", F.round("estimate", 6) + 1.0)
    report = metrics.interval_report(spread)
    return report.select(r6("confidence_coverage", "confidence_coverage"), r6("avg_interval_width", "avg_interval_width"))


@query
def kfold_rmse(spark, folder):
    folds = evaluate.cross_validate_biases(stored_ratings(spark, folder))
    return folds.select("fold", r6("rmse", "rmse"), r6("mae", "mae"), "n_predictions")


@query
def kfold_summary(spark, folder):
    summary = evaluate.fold_summary(evaluate.cross_validate_biases(stored_ratings(spark, folder)))
    return summary.select(*[r6(c, c) for c in summary.columns])


@query
def time_window_rmse(spark, folder):
    events = tables.event_feedback(spark, folder).withColumn(
        "is_test", prep.hash32(42, "event_id") % 10 < 2
    )
    model = biases.fit_biases(events.filter(~F.col("is_test")), [biases.BiasRun(REG_USER, REG_ITEM)], 1)
    windows = evaluate.time_windows(events.filter("is_test"), 5, ("ts", "event_id"))
    summary = evaluate.window_summary(biases.predict_biases(windows, model))
    return summary.select(
        "window_no", r6("window_rmse", "window_rmse"), "window_size",
        F.round("mean_epoch_seconds", 3).alias("mean_epoch_seconds"),
    )


# --- scoring and top-N ---------------------------------------------------------------------

@query
def popularity_topk(spark, folder):
    split = Split(spark, folder)
    lists = split.popular_lists(split.ratings)
    return lists.select("user_id", "item_id", r6("score", "score"), "rank")


@query
def factor_predict(spark, folder):
    split = Split(spark, folder)
    vectors = Vectors(spark, folder, split)
    scored = scoring.score_pairs(split.test, vectors.users, vectors.items)
    return scored.select("user_id", "item_id", r6("score", "score"))


@query
def hybrid_predict(spark, folder):
    split = Split(spark, folder)
    vectors = Vectors(spark, folder, split)
    user_bias = split.train.groupBy("user_id").agg((F.avg("rating") - 3.0).alias("bias"))
    item_bias = split.popularity().select("item_id", F.col("popularity").alias("bias"))
    scored = scoring.score_pairs(
        split.test, vectors.users.join(user_bias, "user_id"), vectors.items.join(item_bias, "item_id"), use_bias=True
    )
    return scored.select("user_id", "item_id", r6("score", "score"))


@query
def factor_topk(spark, folder):
    split = Split(spark, folder)
    lists = Vectors(spark, folder, split).lists(split)
    return lists.select("user_id", "item_id", r6("score", "score"), "rank")


@query
def candidate_topk(spark, folder):
    split = Split(spark, folder)
    vectors = Vectors(spark, folder, split)
    features = tables.item_features(spark, folder)
    candidates = features.filter(F.col("feature") == "type=ECONOMY")
    lists = topk.factor_topk(vectors.users, vectors.items, split.positives, 10, candidates)
    return lists.select("user_id", "item_id", r6("score", "score"), "rank")


@query
def factor_topk_with_seen(spark, folder):
    split = Split(spark, folder)
    vectors = Vectors(spark, folder, split)
    lists = topk.factor_topk(vectors.users, vectors.items, None, 10)
    return lists.select("user_id", "item_id", r6("score", "score"), "rank")


@query
def pmf_topk(spark, folder):
    """Top lists by clipped rating estimate, from the bias model as a factor model of width one."""
    split = Split(spark, folder)
    fitted = split.biases()
    by_user, by_item = fitted.single()
    flat = F.array(F.lit(0.0)).alias("factors")
    model = FactorModel(
        cut_lineage(by_user.select("user_id", flat, "bias")), cut_lineage(by_item.select("item_id", flat, "bias")),
        "biases", explicit=True, biased=True, offset=fitted.means[0],
    )
    lists = model.recommend(split.judged_users(), 10, split.train)
    return lists.select("user_id", "item_id", r6("score", "score"), "rank")


@query
def hybrid_representation(spark, folder):
    """Item vectors and biases as sums over the item's features; features carry rating statistics."""
    split = Split(spark, folder)
    links = pairwise.feature_links(tables.item_features(spark, folder))
    rated = links.join(split.train.select("item_id", "rating"), "item_id")
    features = cut_lineage(rated.groupBy("feature_id").agg(
        F.array(F.avg("rating"), F.stddev_pop("rating")).alias("factors"), (F.avg("rating") - 3.0).alias("bias")
    ))
    items = pairwise.represent_items(links, features)
    return items.select(
        "item_id", r6(F.col("factors")[0], "mean_sum"), r6(F.col("factors")[1], "spread_sum"), r6("bias", "bias")
    )


@query
def nested_topk(spark, folder):
    split = Split(spark, folder)
    nested = scoring.nested_lists(Vectors(spark, folder, split).lists(split, n=10))
    joined = F.concat_ws(",", F.transform("items", lambda e: e.item_id.cast("string")))
    return nested.select("user_id", F.size("items").cast("long").alias("n_items"), joined.alias("items"))


@query
def factor_explain(spark, folder):
    split = Split(spark, folder)
    vectors = Vectors(spark, folder, split)
    explained = scoring.explain_scores(split.truth.select("user_id", "item_id"), vectors.users, vectors.items)
    rows = explained.select("user_id", "item_id", "total_score", F.posexplode("top_factors").alias("pos", "f"))
    return rows.select(
        "user_id", "item_id", r6("total_score", "total_score"), (F.col("pos") + 1).alias("place"),
        "f.factor_id", r6("f.contribution", "contribution"), r6("f.user_value", "user_value"), r6("f.item_value", "item_value"),
    )


@query
def truth_alignment(spark, folder):
    split = Split(spark, folder)
    users = split.judged_users()
    lists = metrics.user_lists(split.popular_lists(users), split.truth, users, TOP_N)
    return lists.select(
        "user_id", F.size("list").cast("long").alias("n_listed"), F.col("n_relevant").cast("long").alias("n_relevant"),
        F.size(F.filter("list", lambda e: e.hit == 1)).cast("long").alias("n_hits"),
    )


@query
def ensemble_topk(spark, folder):
    split = Split(spark, folder)
    users = split.judged_users()
    vectors = Vectors(spark, folder, split)
    flat, none = F.array(F.lit(0.0)).alias("factors"), F.lit(0.0).alias("bias")
    popular = users.select("user_id", flat, none), split.popularity().select("item_id", flat, F.col("popularity").alias("bias"))
    rated = vectors.items.join(split.ratings.select("item_id").distinct(), "item_id", "left_semi")
    nearest = vectors.users.select("user_id", "factors", none), rated.select("item_id", "factors", none)
    lists = topk.blended_topk(popular, nearest, users, split.positives, 10, (0.6, 0.4))
    return lists.select("user_id", "item_id", r6("score", "score"), "rank")


# --- ranking metrics -----------------------------------------------------------------------

def _metric(spark, folder, name: str, graded: bool = False):
    split = Split(spark, folder)
    users = split.judged_users()
    gains = split.test.filter(F.col("rating") >= 3.0).select("user_id", "item_id", F.col("rating").alias("gain"))
    rows = metrics.ranking_metrics(
        split.popular_lists(users), split.truth, users, KS, (name,), gains=gains if graded else None
    )
    return rows.select("k", r6("value", "value"))


@query
def precision_at_k(spark, folder):
    return _metric(spark, folder, "precision")


@query
def recall_at_k(spark, folder):
    return _metric(spark, folder, "recall")


@query
def f1_at_k(spark, folder):
    return _metric(spark, folder, "f1")


@query
def ndcg_binary(spark, folder):
    return _metric(spark, folder, "ndcg")


@query
def ndcg_graded(spark, folder):
    return _metric(spark, folder, "graded_ndcg", graded=True)


@query
def map_at_k(spark, folder):
    return _metric(spark, folder, "map")


@query
def mrr_at_k(spark, folder):
    return _metric(spark, folder, "mrr")


@query
def serendipity(spark, folder):
    split = Split(spark, folder)
    users = split.judged_users()
    lists = Vectors(spark, folder, split).lists(split, users)
    rows = metrics.ranking_metrics(
        lists, split.truth, users, KS, ("serendipity",), expected=split.popular_lists(users)
    )
    return rows.select("k", r6("value", "value"))


@query
def catalog_coverage(spark, folder):
    split = Split(spark, folder)
    report = metrics.catalogue_coverage(split.popular_lists(split.judged_users()), split.ratings)
    return report.select("n_recommended", "n_catalogue", r6("coverage", "coverage"))


@query
def list_diversity(spark, folder):
    split = Split(spark, folder)
    report = metrics.list_diversity(split.popular_lists(split.judged_users()), tables.item_vectors(spark, folder))
    return report.select(r6("diversity", "diversity"), "n_lists")


@query
def list_novelty(spark, folder):
    split = Split(spark, folder)
    report = metrics.list_novelty(split.popular_lists(split.judged_users()), split.popularity())
    return report.select(r6("novelty", "novelty"), "n_lists")


@query
def ranking_report(spark, folder):
    split = Split(spark, folder)
    vectors = Vectors(spark, folder, split)
    model = FactorModel(
        vectors.users.withColumn("bias", F.lit(0.0)), vectors.items.withColumn("bias", F.lit(0.0)), "vectors"
    )
    report = evaluate.evaluate_ranking(model, split.positives, split.truth, split.ratings, KS)
    return report.select("metric", "k", r6("value", "value"))


@query
def metric_report(spark, folder):
    split = Split(spark, folder)
    users = split.judged_users()
    names = ("precision", "recall", "ndcg")
    reports = {
        "popular": metrics.ranking_metrics(split.popular_lists(users), split.truth, users, KS, names),
        "vectors": metrics.ranking_metrics(Vectors(spark, folder, split).lists(split, users), split.truth, users, KS, names),
    }
    wide = evaluate.compare_models(reports)
    return wide.select("metric", "k", r6("popular", "popular"), r6("vectors", "vectors"))


@query
def merged_profile(spark, folder):
    """The profile from stored sketches per month beside the exact one; ``close`` within five standard errors."""
    ratings = stored_ratings(spark, folder)
    sketches = write_and_read(stats.profile_sketches(ratings, F.date_format("ts", "yyyy-MM")), fresh_path(spark, "sketches"))
    exact, merged = stats.rating_profile(ratings), stats.merge_profiles(sketches)
    error = 5 * 1.04 / 2 ** (stats.SKETCH_BITS / 2)
    names = ("n_users", "n_items", "n_ratings", "global_mean")
    told = merged.select(F.struct(*names)).scalar()
    near = lambda c: (F.abs(told[c] / F.col(c) - 1) <= error).cast("int").alias(f"{c}_close")
    return exact.select("n_users", "n_items", "n_ratings", r6("global_mean", "global_mean"), *[near(c) for c in names])


# --- sampling and search -------------------------------------------------------------------

@query
def bpr_triples(spark, folder):
    split = Split(spark, folder)
    return sampling.sample_triples(split.positives, prep.encode_ids(split.ratings, "item_id"), redraws=REDRAWS)


@query
def training_negatives(spark, folder):
    """The negatives that training draws, redrawn where they are positives, in the blocks of its first epoch."""
    split = Split(spark, folder)
    return pairwise.rotation(split.positives, split.ratings, ROUND["bpr"]).negatives()


def _trained(run: rotation.Rotation) -> DataFrame:
    """Every parameter after one epoch; factors from 1, the bias at 0."""
    run.run()
    rows = run.users().withColumn("kind", F.lit("user")).withColumnRenamed("user_id", "id").unionByName(
        run.features().withColumn("kind", F.lit("feature")).withColumnRenamed("feature_id", "id")
    )
    cells = F.posexplode(F.concat(F.array("bias"), "factors")).alias("factor_id", "v")
    return rows.select("kind", "id", cells).select("kind", "id", "factor_id", r6("v", "value"))


@query
def bpr_round(spark, folder):
    split = Split(spark, folder)
    return _trained(pairwise.rotation(split.positives, split.ratings, ROUND["bpr"]))


@query
def lmf_round(spark, folder):
    split = Split(spark, folder)
    return _trained(pairwise.rotation(split.positives, split.ratings, ROUND["logistic"]))


@query
def sgd_round(spark, folder):
    train = Split(spark, folder).train
    samples = train.select("user_id", "item_id", F.col("rating").alias("value"))
    return _trained(rotation.Rotation(samples, train, ROUND["squared"]))


def _hybrid_round(spark, folder, settings) -> DataFrame:
    split = Split(spark, folder)
    links = pairwise.feature_links(tables.item_features(spark, folder), universe=split.ratings)
    return _trained(pairwise.hybrid_rotation(split.positives, links, settings))


@query
def warp_round(spark, folder):
    """Rank-weighted steps over features that items of all blocks share."""
    return _hybrid_round(spark, folder, ROUND["warp"])


@query
def hybrid_bpr_round(spark, folder):
    return _hybrid_round(spark, folder, HYBRID_BPR)


@query
def warp_first_violation(spark, folder):
    split = Split(spark, folder)
    vectors = Vectors(spark, folder, split)
    dictionary = cut_lineage(prep.encode_ids(split.ratings, "item_id"))
    triples = sampling.sample_triples(split.positives, dictionary, n_negatives=10)
    rows = sampling.first_violations(triples, vectors.users, vectors.items, dictionary.count(), margin=0.01)
    return rows.select("user_id", "item_id", "negative_id", "tries", r6("weight", "weight"))


def _bias_trials(spark, folder) -> DataFrame:
    fit, held = prep.validation_split(Split(spark, folder).train)
    trials = search.sample_trials(spark, search.EXPLICIT_SPACE, 20, 42, search.EXPLICIT_DEFAULTS)
    return search.bias_trials(fit, held, trials)


@query
def trial_space_explicit(spark, folder):
    rows = _bias_trials(spark, folder)
    return rows.select(
        "trial", "n_factors", "n_epochs", r6("learning_rate", "learning_rate"), r6("regularization", "regularization"),
        F.col("use_biased").cast("int").alias("use_biased"), r6("reg_bu", "reg_bu"), r6("reg_bi", "reg_bi"),
        r6("value", "value"), r6("mae", "mae"), "n_predictions",
    )


@query
def trial_space_implicit(spark, folder):
    """The sampled trials with the model size each would have on the training positives."""
    split = Split(spark, folder)
    shape = stats.interaction_profile(split.positives, split.ratings, unique=True)
    rows = search.sample_trials(spark, search.IMPLICIT_SPACE, 20, 42)
    entities = shape.select(F.col("n_users") + F.col("n_items")).scalar()
    return rows.select(
        "trial", "factors", "iterations", r6("learning_rate", "learning_rate"),
        F.round("regularization", 7).alias("regularization"), "algorithm",
        F.col("verify_negative_samples").cast("int").alias("verify_negative_samples"),
        (entities * F.col("factors")).cast("long").alias("total_parameters"),
    )


@query
def trial_prune(spark, folder):
    rows = search.prune_trials(cut_lineage(_bias_trials(spark, folder)))
    return rows.select("trial", r6("value", "value"), "state")


@query
def best_trial(spark, folder):
    best = search.best_trial(_bias_trials(spark, folder))
    merged = search.merge_explicit_parameters(best)
    return merged.select(
        "n_factors", "n_epochs", r6("learning_rate", "learning_rate"), r6("regularization", "regularization"),
        F.col("biased").cast("int").alias("biased"), r6("reg_bu", "reg_bu"), r6("reg_bi", "reg_bi"),
    )


# --- training (rows only) ------------------------------------------------------------------

def _explicit(spark, folder, **params) -> DataFrame:
    split = Split(spark, folder)
    model = als.fit_explicit(split.train, n_factors=10, n_epochs=5, regularization=0.1, **params)
    return model.predict(split.test.select("user_id", "item_id", "rating"))


def _implicit(spark, folder, loss: str) -> DataFrame:
    split = Split(spark, folder)
    settings = pairwise.PairwiseSettings(loss=loss, factors=16, rounds=2)
    model = pairwise.fit_pairwise(split.positives, split.ratings, settings)
    return model.recommend(prep.evaluation_users(split.truth), 10, split.positives)


def _hybrid(spark, folder, loss: str) -> DataFrame:
    split = Split(spark, folder)
    settings = pairwise.PairwiseSettings(loss=loss, factors=16, rounds=2, user_reg=1e-6, item_reg=1e-6)
    model = pairwise.fit_hybrid(split.positives, tables.item_features(spark, folder), settings)
    return model.recommend(prep.evaluation_users(split.truth), 10, split.positives)


@query
def pmf_fit(spark, folder):
    return _explicit(spark, folder)


@query
def pmf_biased_fit(spark, folder):
    return _explicit(spark, folder, biased=True, reg_bu=REG_USER, reg_bi=REG_ITEM)


@query
def nmf_fit(spark, folder):
    return _explicit(spark, folder, algorithm="nmf")


def _solved(residuals: DataFrame, column: str = "worst", tolerance: float = 1e-3) -> DataFrame:
    return residuals.select("user_id", (F.col(column) <= tolerance).cast("int").alias("ok"))


@query
def pmf_normal_equations(spark, folder):
    train = Split(spark, folder).train
    model = als.fit_explicit(train, regularization=0.1)
    return _solved(als.user_residuals(train, "rating", model.users, model.items, 0.1))


@query
def pmf_biased_normal_equations(spark, folder):
    train = Split(spark, folder).train
    model = als.fit_explicit(train, regularization=0.1, biased=True, reg_bu=REG_USER, reg_bi=REG_ITEM)
    by_user, by_item = model.biases()
    rest = train.join(by_user.withColumnRenamed("bias", "bu"), "user_id").join(by_item.withColumnRenamed("bias", "bi"), "item_id")
    rest = rest.withColumn("residual", F.col("rating") - model.offset - F.col("bu") - F.col("bi"))
    return _solved(als.user_residuals(rest, "residual", model.users, model.items, 0.1))


@query
def nmf_conditions(spark, folder):
    train = Split(spark, folder).train
    model = als.fit_explicit(train, n_factors=10, n_epochs=5, regularization=0.1, algorithm="nmf")
    return _solved(als.user_residuals(train, "rating", model.users, model.items, 0.1), "worst_nonnegative", 1e-2)


@query
def nmf_two_penalties(spark, folder):
    """Users and items each meet the conditions of their own penalty. The solver ends with the users, so
    the items are judged in a fit with the sides exchanged."""
    train = Split(spark, folder).train
    turned = train.select(F.col("item_id").alias("user_id"), F.col("user_id").alias("item_id"), "rating")
    rows = None
    for side, ratings, own, other in (("user", train, 0.4, 0.025), ("item", turned, 0.025, 0.4)):
        model = als.fit_explicit(ratings, 10, 5, algorithm="nmf", reg_pu=own, reg_qi=other)
        ok = _solved(als.user_residuals(ratings, "rating", model.users, model.items, own), "worst_nonnegative", 1e-2)
        ok = ok.select(F.lit(side).alias("side"), F.col("user_id").alias("id"), "ok")
        rows = ok if rows is None else rows.unionByName(ok)
    return rows


@query
def implicit_als_normal_equations(spark, folder):
    split = Split(spark, folder)
    model = als.fit_implicit_als(split.positives, split.ratings)
    return _solved(als.user_residuals(split.positives, "weight", model.users, model.items, 0.01, alpha=1.0))


# --- sinks: written and read back ------------------------------------------------------------

@query
def sink_predictions(spark, folder):
    home = fresh_path(spark, "predictions")
    rows = Split(spark, folder).bias_estimates().select("user_id", "item_id", "estimate", F.lit("biases").alias("model"))
    sinks.write_predictions(rows, home)
    return spark.read.parquet(home).select("model", "user_id", "item_id", r6("estimate", "estimate"))


@query
def sink_trials(spark, folder):
    home = fresh_path(spark, "trials")
    trials = _bias_trials(spark, folder)
    sinks.write_trials(trials, home, "pmf")
    back = spark.read.schema(trials.schema).option("header", True).csv(f"{home}/pmf_trials")
    return back.select("trial", "n_factors", "n_epochs", r6("value", "value"), r6("mae", "mae"), "n_predictions")


@query
def sink_importance(spark, folder):
    home = fresh_path(spark, "importance")
    names = [entry[0] for entry in search.EXPLICIT_SPACE]
    sinks.write_importance(search.parameter_importance(cut_lineage(_bias_trials(spark, folder)), names), home, "pmf")
    back = spark.read.schema("parameter string, importance double").json(f"{home}/pmf_param_importance")
    total = back.agg(F.round(F.sum("importance"), 6)).scalar()
    return back.select("parameter", F.col("importance").between(0, 1).cast("int").alias("is_share"), total.alias("total"))


@query
def sink_best_parameters(spark, folder):
    home = fresh_path(spark, "best")
    best = search.best_trial(_bias_trials(spark, folder))
    sinks.write_best_parameters(best, home, "pmf")
    back = spark.read.schema(best.schema).json(f"{home}/pmf_best_params")
    return back.select("n_factors", "n_epochs", r6("learning_rate", "learning_rate"), r6("regularization", "regularization"))


@query
def sink_report(spark, folder):
    home = fresh_path(spark, "report")
    split = Split(spark, folder)
    users = split.judged_users()
    rows = metrics.ranking_metrics(split.popular_lists(users), split.truth, users, KS, ("precision", "recall", "ndcg"))
    label = F.concat_ws("@", "metric", F.col("k").cast("string"))
    report = rows.agg(F.map_from_entries(F.collect_list(F.struct(label, "value"))).alias("metrics"))
    sinks.write_report(report.select(F.lit("popular").alias("model"), "metrics"), home)
    back = spark.read.schema("model string, metrics map<string, double>").json(home)
    return back.select("model", F.explode("metrics").alias("name", "value")).select("model", "name", r6("value", "value"))


@query
def sink_model(spark, folder):
    home = fresh_path(spark, "model")
    fitted = Split(spark, folder).biases()
    by_user, by_item = fitted.single()
    flat = F.array(F.lit(0.0)).alias("factors")
    FactorModel(
        by_user.select("user_id", flat, "bias"), by_item.select("item_id", flat, "bias"), "biases",
        explicit=True, biased=True, offset=fitted.means[0],
    ).save(home)
    users, items = FactorModel.load(spark, home).biases()
    tag = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col(f"{kind}_id").alias("id"), r6("bias", "bias"))
    return tag(users, "user").unionByName(tag(items, "item"))


@query
def implicit_als_fit(spark, folder):
    split = Split(spark, folder)
    model = als.fit_implicit_als(split.positives, split.ratings, 16, 5)
    return model.recommend(prep.evaluation_users(split.truth), 10, split.positives)


@query
def implicit_als_confidence_fit(spark, folder):
    split = Split(spark, folder)
    weighted = prep.confidence_weights(split.train.filter(F.col("rating") >= 3.0))
    model = als.fit_implicit_als(weighted, split.ratings, 16, 5, weight="confidence")
    return model.recommend(prep.evaluation_users(split.truth), 10, split.positives)


@query
def bpr_fit(spark, folder):
    return _implicit(spark, folder, "bpr")


@query
def lmf_fit(spark, folder):
    return _implicit(spark, folder, "logistic")


@query
def warp_fit(spark, folder):
    return _hybrid(spark, folder, "warp")


@query
def hybrid_loss_fit(spark, folder):
    return _hybrid(spark, folder, "bpr")


@query
def als_kfold(spark, folder):
    train = Split(spark, folder).train
    return evaluate.cross_validate(train, lambda part: als.fit_explicit(part, 8, 3, 0.1), folds=2)


@query
def model_size(spark, folder):
    model = als.fit_implicit_als(cut_lineage(Split(spark, folder).positives), tables.ratings(spark, folder), 16, 2)
    return model.size()


SEARCH_SECONDS = 90.0  # budget of a registered search; the library's default is 900


@query
def tune_explicit(spark, folder):
    """Twenty trials of the whole space under a time budget; those it does not reach are TIMED_OUT."""
    fit, held = (cut_lineage(x) for x in prep.validation_split(Split(spark, folder).train))
    return search.tune_explicit(fit, held, seconds=SEARCH_SECONDS)


@query
def tune_implicit(spark, folder):
    split = Split(spark, folder)
    fit, held = (cut_lineage(prep.to_implicit(x)) for x in prep.validation_split(split.train))
    return search.tune_implicit(fit, held, split.ratings, seconds=SEARCH_SECONDS)


@query
def param_importance(spark, folder):
    """Importance of the explicit parameters for the error of models trained with them."""
    trials = cut_lineage(tune_explicit(spark, folder).filter("state = 'COMPLETE'"))
    return search.parameter_importance(trials, [entry[0] for entry in search.EXPLICIT_SPACE])
