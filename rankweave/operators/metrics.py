"""Rating-error, ranking and beyond-accuracy metrics as aggregations.

Ranking metrics take ``recs(user_id, item_id, rank)``, ``truth(user_id, item_id)`` and the
``users`` to average over. Truth is joined, never collected: only a list's first ``max(k)``
entries are ever held in one row, so a user with a huge truth set costs a count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.functions.vectors import cosine_distance, norm

RANKING_METRICS = ("precision", "recall", "f1", "ndcg", "map", "mrr")


def rating_errors(predictions: DataFrame, truth: str = "rating", estimate: str = "estimate") -> DataFrame:
    error = F.col(truth) - F.col(estimate)
    return predictions.agg(*error_columns(error))


def error_columns(error: Column) -> list[Column]:
    return [
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("mse"),
        F.count("*").alias("n_predictions"),
    ]


def interval_report(predictions: DataFrame, truth: str = "rating", lower: str = "lower", upper: str = "upper") -> DataFrame:
    """Share of true ratings inside the closed interval, and the mean width."""
    return predictions.agg(
        F.avg(F.col(truth).between(F.col(lower), F.col(upper)).cast("double")).alias("confidence_coverage"),
        F.avg(F.col(upper) - F.col(lower)).alias("avg_interval_width"),
    )


def _discounted(length: Column) -> Column:
    """Ideal gain of ``length`` hits in front: the sum of 1 / log2(j + 1)."""
    return F.when(length <= 0, F.lit(0.0)).otherwise(
        F.aggregate(F.sequence(F.lit(1), F.greatest(length, F.lit(1))), F.lit(0.0), lambda acc, j: acc + 1.0 / F.log2(j + 1.0))
    )


def user_lists(
    recs: DataFrame,
    truth: DataFrame,
    users: DataFrame,
    depth: int,
    gains: DataFrame | None = None,
    expected: DataFrame | None = None,
) -> DataFrame:
    """One row per user: the cut list with hit flags, the truth size, and graded ideals if given."""
    users = users.select("user_id").distinct()
    relevant = truth.select("user_id", "item_id").join(users, "user_id", "left_semi").distinct()
    entries = (
        recs.filter(F.col("rank") <= depth).select("user_id", "item_id", "rank")
        .join(relevant.withColumn("hit", F.lit(1)), ["user_id", "item_id"], "left")
    )
    fields = ["rank", "item_id", F.coalesce("hit", F.lit(0)).alias("hit")]
    if gains is not None:
        entries = entries.join(gains.select("user_id", "item_id", "gain"), ["user_id", "item_id"], "left")
        fields.append(F.coalesce("gain", F.lit(0.0)).alias("gain"))
    if expected is not None:
        first = expected.groupBy("user_id", "item_id").agg(F.min("rank").alias("expected_rank"))
        entries = entries.join(first, ["user_id", "item_id"], "left")
        fields.append("expected_rank")
    lists = entries.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("list"))
    sizes = relevant.groupBy("user_id").agg(F.count("*").alias("n_relevant"))
    rows = (
        users.join(lists, "user_id", "left")
        .join(sizes, "user_id", "left")
        .withColumn("n_relevant", F.coalesce("n_relevant", F.lit(0)).cast("int"))
        .withColumn("list", F.coalesce("list", F.array().cast(lists.schema["list"].dataType)))
    )
    if gains is not None:
        rows = rows.join(_best_gains(gains.join(users, "user_id", "left_semi"), depth), "user_id", "left")
    return rows


def _best_gains(gains: DataFrame, depth: int) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy(F.col("gain").desc(), "item_id")
    best = gains.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= depth)
    return best.groupBy("user_id").agg(
        F.sort_array(F.collect_list("gain"), asc=False).alias("best_gains")
    )


def _per_user(metric: str, k: int) -> Column:
    """The user's value, or null where the user does not take part in the average."""
    cut = F.slice("list", 1, k)
    distinct = F.array_distinct(F.transform(cut, lambda e: e.item_id))
    n_listed = F.size(distinct)
    hits = F.array_distinct(F.transform(F.filter(cut, lambda e: e.hit == 1), lambda e: e.item_id))
    n_relevant = F.col("n_relevant")
    if metric == "precision":
        return F.when(n_listed > 0, F.size(hits) / n_listed)
    if metric == "recall":
        return F.when(n_relevant > 0, F.size(hits) / n_relevant)
    if metric == "serendipity":
        surprising = F.filter(cut, lambda e: (e.hit == 1) & ~F.coalesce(e.expected_rank <= k, F.lit(False)))
        return F.when(n_listed > 0, F.size(F.array_distinct(F.transform(surprising, lambda e: e.item_id))) / n_listed)
    if metric == "ndcg":
        gained = F.aggregate(
            F.transform(cut, lambda e, j: e.hit / F.log2(j + 2.0)), F.lit(0.0), lambda acc, x: acc + x
        )
        return F.when(n_relevant > 0, gained / _discounted(F.least(n_relevant, F.lit(k))))
    if metric == "graded_ndcg":
        graded = F.aggregate(
            F.transform(cut, lambda e, j: e.gain / F.log2(j + 2.0)), F.lit(0.0), lambda acc, x: acc + x
        )
        best = F.slice(F.coalesce("best_gains", F.array().cast("array<double>")), 1, k)
        ideal = F.aggregate(F.transform(best, lambda g, j: g / F.log2(j + 2.0)), F.lit(0.0), lambda acc, x: acc + x)
        # Users without graded scores are judged by hits alone.
        return F.when(ideal > 0, graded / ideal).otherwise(_per_user("ndcg", k))
    if metric == "map":
        places = F.filter(F.transform(cut, lambda e, j: F.when(e.hit == 1, j + 1)), lambda p: p.isNotNull())
        total = F.aggregate(F.transform(places, lambda p, j: (j + 1.0) / p), F.lit(0.0), lambda acc, x: acc + x)
        return F.when(F.size(places) > 0, total / F.least(n_relevant, F.lit(k)))
    if metric == "mrr":
        place = F.array_position(F.transform(cut, lambda e: e.hit), 1)
        return F.when(place > 0, 1.0 / place).otherwise(F.lit(0.0))
    raise ValueError(f"unknown metric {metric}")


def ranking_wide(lists: DataFrame, ks: list[int], metrics=RANKING_METRICS, all_users_map: bool = False) -> DataFrame:
    """One row: ``n_users`` and ``metric@k`` columns; an average over nobody is 0.0."""
    averaged = []
    base = [m for m in metrics if m != "f1"]
    if "f1" in metrics:
        base += [m for m in ("precision", "recall") if m not in base]
    for k in ks:
        for metric in base:
            value = _per_user(metric, k)
            if metric == "map" and all_users_map:
                value = F.coalesce(value, F.lit(0.0))
            averaged.append(F.coalesce(F.avg(value), F.lit(0.0)).alias(f"{metric}@{k}"))
    wide = lists.agg(F.count("*").alias("n_users"), *averaged)
    for k in ks if "f1" in metrics else []:
        p, r = F.col(f"`precision@{k}`"), F.col(f"`recall@{k}`")
        wide = wide.withColumn(f"f1@{k}", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)))
    return wide


def wide_to_long(wide: DataFrame, columns: list[tuple[str, str, int | None]]) -> DataFrame:
    """Turn one wide row into ``(metric, k, value)`` rows; ``columns`` holds (column, metric, k)."""
    cells = F.array(*[
        F.struct(F.lit(metric).alias("metric"), F.lit(k).cast("int").alias("k"), F.col(f"`{column}`").cast("double").alias("value"))
        for column, metric, k in columns
    ])
    return wide.select(F.explode(cells).alias("cell")).select("cell.*")


def ranking_metrics(
    recs: DataFrame,
    truth: DataFrame,
    users: DataFrame,
    ks: list[int],
    metrics=RANKING_METRICS,
    gains: DataFrame | None = None,
    expected: DataFrame | None = None,
    all_users_map: bool = False,
) -> DataFrame:
    lists = user_lists(recs, truth, users, max(ks), gains, expected)
    wide = ranking_wide(lists, ks, metrics, all_users_map)
    return wide_to_long(wide, [(f"{m}@{k}", m, k) for m in metrics for k in ks])


def _cut(recs: DataFrame, k: int | None) -> DataFrame:
    return recs if k is None else recs.filter(F.col("rank") <= k)


def catalogue_coverage(recs: DataFrame, catalogue: DataFrame, k: int | None = None) -> DataFrame:
    """Distinct recommended items over catalogue size; not restricted to the catalogue."""
    size = catalogue.select("item_id").distinct().agg(F.count("*")).scalar()
    return _cut(recs, k).agg(F.countDistinct("item_id").alias("n_recommended")).select(
        "n_recommended",
        size.alias("n_catalogue"),
        F.when(size > 0, F.col("n_recommended") / size).otherwise(F.lit(0.0)).alias("coverage"),
    )


def list_diversity(recs: DataFrame, items: DataFrame, k: int | None = None) -> DataFrame:
    """Mean over users of the mean cosine distance between a list's items.

    Distances are folded inside the row of a cut top-N list, so no pair is ever a row. Items
    without a vector are left out, as are lists with fewer than two entries left.
    """
    placed = _cut(recs, k).join(items.select("item_id", "factors"), "item_id").withColumn("norm", norm(F.col("factors")))
    lists = placed.groupBy("user_id").agg(F.collect_list(F.struct("factors", "norm")).alias("v")).filter(F.size("v") > 1)
    n = F.size("v")
    later = lambda i: F.slice("v", i + 2, n)
    per_item = F.transform(
        "v",
        lambda a, i: F.aggregate(
            F.transform(later(i), lambda b: cosine_distance(a.factors, b.factors, a.norm, b.norm)), F.lit(0.0), lambda acc, x: acc + x
        ),
    )
    total = F.aggregate(per_item, F.lit(0.0), lambda acc, x: acc + x)
    per_user = lists.select((total / (n * (n - 1) / 2)).alias("d"))
    return per_user.agg(F.coalesce(F.avg("d"), F.lit(0.0)).alias("diversity"), F.count("*").alias("n_lists"))


def list_novelty(recs: DataFrame, popularity: DataFrame, k: int | None = None) -> DataFrame:
    """Mean over users of the mean ``-log2(popularity + 1e-10)`` of their listed known items."""
    known = _cut(recs, k).join(popularity.select("item_id", "popularity"), "item_id")
    per_user = known.groupBy("user_id").agg(F.avg(-F.log2(F.col("popularity") + F.lit(1e-10))).alias("v"))
    return per_user.agg(F.coalesce(F.avg("v"), F.lit(0.0)).alias("novelty"), F.count("*").alias("n_lists"))
