"""Splits, ordering, top-N and scoring against brute force, including heavy users and items."""

import numpy as np
import pyarrow as pa
import pytest
from planted import planted_ratings
from pyspark.sql import functions as F

from rankweave.operators import biases, ordering, prep, sampling, scoring, stats, topk
from rankweave.plans import evaluate


@pytest.fixture(scope="module")
def skewed(spark):
    """User 0 holds about a third of the rows; item 0 is held by nearly everyone."""
    heavy = spark.range(1, 600).select(F.lit(0).cast("long").alias("user_id"), F.col("id").alias("item_id"))
    popular = spark.range(1, 500).select(F.col("id").alias("user_id"), F.lit(0).cast("long").alias("item_id"))
    rest = spark.range(1000).select((1 + F.col("id") % 499).alias("user_id"), (1 + F.col("id") * 7 % 600).alias("item_id"))
    return heavy.unionByName(popular).unionByName(rest).distinct().cache()


def test_splits_are_disjoint_and_whole(spark):
    rows = planted_ratings(spark).cache()
    total = rows.count()
    train, test = prep.holdout_split(rows)
    assert train.count() + test.count() == total
    assert train.join(test, ["user_id", "item_id"]).count() == 0
    fit, held = prep.validation_split(train)
    assert fit.count() + held.count() == train.count()
    exact = prep.exact_holdout_tag(rows).filter("is_test").count()
    assert exact == -(-total // 5)
    assert prep.to_implicit(train).count() + prep.to_implicit(test).count() == prep.to_implicit(rows).count()


@pytest.mark.parametrize("fraction", [0.05, 0.15, 0.25])
def test_holdout_has_the_share_asked_for(spark, fraction):
    rows = planted_ratings(spark).cache()
    share = prep.holdout_split(rows, fraction)[1].count() / rows.count()
    assert abs(share - fraction) < 0.02


def test_temporal_split_keeps_the_latest(spark):
    tagged = prep.temporal_tag(planted_ratings(spark)).cache()
    last = tagged.filter(~F.col("is_test")).agg(F.max("ts")).first()[0]
    first = tagged.filter("is_test").agg(F.min("ts")).first()[0]
    assert last <= first


def test_numbering_is_the_same_whether_or_not_a_group_is_large(spark, skewed):
    hashed = skewed.withColumn("h", prep.hash32(42, "user_id", "item_id"))
    plain = ordering.hash_rank_within(hashed, "user_id", "h", ["item_id"])
    cut = ordering.hash_rank_within(hashed, "user_id", "h", ["item_id"], large=50)
    assert plain.exceptAll(cut).count() == 0 and cut.exceptAll(plain).count() == 0
    per_user = cut.groupBy("user_id").agg(F.max("hash_no").alias("top"), F.countDistinct("hash_no").alias("n"))
    assert per_user.filter("top != n").count() == 0


def test_sort_rank_is_dense_and_ordered(spark, skewed):
    rows = ordering.sort_rank(skewed, [F.col("user_id").desc(), F.col("item_id")]).orderBy("order_no").collect()
    assert [r.order_no for r in rows] == list(range(1, len(rows) + 1))
    keys = [(-r.user_id, r.item_id) for r in rows]
    assert keys == sorted(keys)


@pytest.mark.parametrize("head", [15, 100_000])
def test_shared_ranking_lists_match_brute_force(spark, skewed, head):
    scores = stats.item_popularity(skewed, skewed).select("item_id", F.col("popularity").alias("score"))
    got = topk.shared_ranking_topk(scores, skewed, skewed, 10, block=16, head=head).collect()
    seen = {}
    for r in skewed.collect():
        seen.setdefault(r.user_id, set()).add(r.item_id)
    order = [r.item_id for r in sorted(scores.collect(), key=lambda r: (-r.score, r.item_id))]
    want = {
        (u, i, p + 1) for u, mine in seen.items()
        for p, i in enumerate([i for i in order if i not in mine][:10])
    }
    assert {(r.user_id, r.item_id, r.rank) for r in got} == want
    assert sum(r.user_id == 0 for r in got) < 10  # the heavy user has too few unseen items left


@pytest.mark.parametrize("users_per_block, items_per_block", [(1000, 1000), (70, 90)])
def test_factor_lists_match_brute_force(spark, skewed, users_per_block, items_per_block):
    rng = np.random.default_rng(5)
    p = {u: rng.integers(-2, 3, 3).astype(float) for u in range(500)}  # small integers: many ties
    q = {i: rng.integers(-2, 3, 3).astype(float) for i in range(601)}
    users = spark.createDataFrame([(u, v.tolist()) for u, v in p.items()], "user_id long, factors array<double>")
    items = spark.createDataFrame([(i, v.tolist()) for i, v in q.items()], "item_id long, factors array<double>")
    got = topk.factor_topk(
        users, items, skewed, 7, users_per_block=users_per_block, items_per_block=items_per_block
    ).collect()
    seen = {(r.user_id, r.item_id) for r in skewed.collect()}
    want = set()
    for u in p:
        ranked = sorted((-(p[u] @ q[i]), i) for i in q if (u, i) not in seen)[:7]
        want |= {(u, i, -s, place + 1) for place, (s, i) in enumerate(ranked)}
    assert {(r.user_id, r.item_id, r.score, r.rank) for r in got} == want


@pytest.mark.parametrize("clip", [None, (-2.0, 2.0)])
def test_chunks_of_a_block_leave_nothing_out(monkeypatch, clip):
    """Many chunks, ties, clipping, biases and seen items: as sorting all scores."""
    monkeypatch.setattr(topk, "_ITEMS_AT_ONCE", 16)
    monkeypatch.setattr(topk, "_USERS_AT_ONCE", 7)
    rng = np.random.default_rng(3)
    p, q = rng.integers(-1, 2, (40, 3)).astype(float), rng.integers(-1, 2, (200, 3)).astype(float)
    bu, bi = rng.integers(-1, 2, 40).astype(float), rng.integers(-1, 2, 200).astype(float)
    q[120:] = 0.0
    seen = sorted({(int(u), int(i)) for u, i in zip(rng.integers(0, 40, 900), rng.integers(0, 200, 900))} | {(3, i) for i in range(197)})
    table = lambda name, f, b: pa.table({name: np.arange(len(f)), "factors": pa.array(list(f)), "bias": b})
    seen_rows = pa.table({"user_id": [u for u, _ in seen], "item_id": [i for _, i in seen]})
    got = pa.concat_tables(topk._score_block(table("user_id", p, bu), table("item_id", q, bi), seen_rows, 5, clip)).to_pylist()
    scores = p @ q.T + bu[:, None] + bi
    scores = np.clip(scores, *clip) if clip else scores
    taken = set(seen)
    want = {
        (u, i, scores[u, i]) for u in range(40)
        for i in sorted((i for i in range(200) if (u, i) not in taken), key=lambda i: (-scores[u, i], i))[:5]
    }
    assert {(r["user_id"], r["item_id"], r["score"]) for r in got} == want
    assert sum(r["user_id"] == 3 for r in got) == 3


@pytest.mark.parametrize("size, kind", [(1.0, np.float32), (1e20, np.float64)])
def test_rough_scores_lose_no_item(size, kind):
    """Scores that floats cannot tell apart are listed by their doubles; factors too large for floats are scored in doubles."""
    rng = np.random.default_rng(6)
    p = rng.normal(size=(50, 8)) * size
    q = rng.normal(size=8) + rng.normal(size=(6000, 8)) * 1e-8
    table = lambda name, f: pa.table({name: np.arange(len(f)), "factors": pa.array(list(f)), "bias": np.zeros(len(f))})
    none = pa.table({"user_id": pa.array([], pa.int64()), "item_id": pa.array([], pa.int64())})
    assert topk._Chunks(p, q).rough.dtype == kind
    got = pa.concat_tables(topk._score_block(table("user_id", p), table("item_id", q), none, 5, None)).to_pylist()
    near = np.round(p @ q.T, 9)
    for u in range(50):
        want = sorted(near[u], reverse=True)[:5]
        assert sorted((round(r["score"], 9) for r in got if r["user_id"] == u), reverse=True) == pytest.approx(want, rel=1e-12, abs=2e-9)


def test_large_tables_are_not_copied_for_every_thousand_users():
    """Rows sent to the block pairs of 900,000 users and 1.2 million items of 16 factors."""
    user_blocks, item_blocks = topk._grid(900_000, 1_200_000, 16, None, None)
    assert 900_000 * item_blocks + 1_200_000 * user_blocks < 20e6
    assert user_blocks * item_blocks >= topk.CELLS


@pytest.mark.parametrize("n_users, n_items, width", [(90_000, 120_000, 16), (77_000, 102_000, 64)])
def test_neither_side_is_copied_for_every_cell(n_users, n_items, width):
    user_blocks, item_blocks = topk._grid(n_users, n_items, width, None, None)
    assert n_users * item_blocks + n_items * user_blocks < 2e6
    assert user_blocks * item_blocks >= topk.CELLS


def test_block_pairs_of_large_tables_get_few_copies():
    """Bytes sent for lists of ten, 5.4 million users and 7.2 million items of 16 factors."""
    user_blocks, item_blocks = topk._grid(5_400_000, 7_200_000, 16, None, None, 10)
    assert 5_400_000 * (8 * 16 + 24 + 240) * item_blocks + 7_200_000 * (8 * 16 + 24) * user_blocks < 30e9
    assert user_blocks * item_blocks >= topk.CELLS


def test_items_of_one_model_meet_its_factors_alone(spark, monkeypatch):
    """Users travel to items that a model lacks without that model's factors; lists are those of all scores."""
    rng = np.random.default_rng(9)
    table = lambda name, ids, x: spark.createDataFrame(
        [(int(k), v.tolist(), float(k % 3)) for k, v in zip(ids, x)], f"{name} long, factors array<double>, bias double")
    p0, p1, q0, q1 = rng.normal(size=(6, 1)), rng.normal(size=(5, 12)), rng.normal(size=(20, 1)), rng.normal(size=(9, 12))
    own0, own1, it0, it1 = range(6), range(1, 6), range(20), range(14, 23)
    seen = spark.createDataFrame([(u, i) for u in range(6) for i in range(23) if (u + i) % 4 == 0], "user_id long, item_id long")
    sent, pairs = [], topk._every_block_pair
    monkeypatch.setattr(topk, "_every_block_pair", lambda users, items, *a, **k: sent.append(
        (items.count(), len(users.first().factors), len(items.first().factors))) or pairs(users, items, *a, **k))
    people = spark.range(6).withColumnRenamed("id", "user_id")
    got = topk.blended_topk(
        (table("user_id", own0, p0), table("item_id", it0, q0)), (table("user_id", own1, p1), table("item_id", it1, q1)), people, seen, 4, (0.6, 0.4)
    ).collect()
    assert sorted(sent) == sorted([(6, 17, 17), (14, 3, 3), (3, 14, 14)] * 2)
    want = set()
    for u in range(6):
        free = [i for i in range(23) if (u + i) % 4]
        a = np.array([p0[u] @ q0[i] + u % 3 + i % 3 if i < 20 else 0.0 for i in free])
        b = np.array([p1[u - 1] @ q1[i - 14] + u % 3 + i % 3 if u and i >= 14 else 0.0 for i in free])
        scaled = lambda x: (x - x.min()) / (x.max() - x.min()) if x.max() > x.min() else np.ones(len(x))
        best = sorted(zip(-np.round(0.6 * scaled(a) + 0.4 * scaled(b), 9), free))[:4]
        want |= {(u, i, rank) for rank, (_, i) in enumerate(best, 1)}
    assert {(r.user_id, r.item_id, r["rank"]) for r in got} == want


def test_lists_of_floats_are_those_of_doubles(spark, skewed):
    rng = np.random.default_rng(8)
    rows = lambda n: [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(n, 3)).astype(np.float32).astype(float))]
    users = spark.createDataFrame(rows(500), "user_id long, factors array<double>")
    items = spark.createDataFrame(rows(601), "item_id long, factors array<double>")
    floats = lambda df: df.withColumn("factors", F.col("factors").cast("array<float>"))
    got = [{tuple(r) for r in topk.factor_topk(a, b, skewed, 5).collect()} for a, b in ((users, items), (users, floats(items)), (floats(users), floats(items)))]
    assert got[0] == got[1] == got[2] and len(got[0]) > 2400


def test_stored_vectors_stay_floats_and_meet_pairs_first(spark, folder):
    """The join next to the pairs is with the items; the wider vectors of users never travel with a pair."""
    from rankweave.sources import tables

    items = tables.item_vectors(spark, folder)
    assert items.schema["factors"].dataType.simpleString() == "array<float>"
    users = spark.createDataFrame([(1, [1.0] * 64)], "user_id long, factors array<double>")
    pairs = spark.createDataFrame([(1, 5, 2.0), (1, -6, 2.0), (2, 5, 2.0)], "user_id long, item_id long, rating double")
    scored = scoring.score_pairs(pairs, users, items)
    last = next(x for x in scored._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftOuter" in x)
    assert "user_id" in last and "item_id" not in last
    known = sum(items.filter("item_id = 5").first().factors)
    assert {(r.user_id, r.item_id, r.rating): r.score for r in scored.collect()} == {
        (1, 5, 2.0): pytest.approx(known), (1, -6, 2.0): 0.0, (2, 5, 2.0): 0.0
    }


def test_unknown_ids_score_zero(spark):
    users = spark.createDataFrame([(1, [1.0, 2.0])], "user_id long, factors array<double>")
    items = spark.createDataFrame([(5, [3.0, 4.0])], "item_id long, factors array<double>")
    pairs = spark.createDataFrame([(1, 5), (1, 6), (2, 5)], "user_id long, item_id long")
    got = {(r.user_id, r.item_id): r.score for r in scoring.score_pairs(pairs, users, items).collect()}
    assert got == {(1, 5): 11.0, (1, 6): 0.0, (2, 5): 0.0}


def test_explanations_add_up(spark):
    users = spark.createDataFrame([(1, [1.0, -2.0, 0.5])], "user_id long, factors array<double>")
    items = spark.createDataFrame([(5, [3.0, 4.0, 1.0])], "item_id long, factors array<double>")
    pairs = spark.createDataFrame([(1, 5), (1, 6)], "user_id long, item_id long")
    rows = scoring.explain_scores(pairs, users, items, n_top=2).collect()
    assert len(rows) == 1 and rows[0].total_score == pytest.approx(-4.5)
    assert [(f.factor_id, f.contribution) for f in rows[0].top_factors] == [(1, -8.0), (0, 3.0)]


def test_time_windows_put_the_remainder_last(spark):
    rows = spark.range(13).select(
        F.timestamp_seconds("id").alias("ts"), F.col("id").alias("user_id"), F.col("id").alias("item_id")
    )
    sizes = {r.window_no: r["count"] for r in evaluate.time_windows(rows, 5).groupBy("window_no").count().collect()}
    assert sizes == {0: 2, 1: 2, 2: 2, 3: 2, 4: 5}
    few = {r.window_no for r in evaluate.time_windows(rows.limit(3), 5).collect()}
    assert few == {4}


def test_fold_sizes(spark):
    rows = planted_ratings(spark).limit(103).cache()
    sizes = sorted(r["count"] for r in evaluate.assign_folds(rows, 5).groupBy("fold").count().collect())
    assert sizes == [20, 20, 21, 21, 21]
    assert evaluate.assign_folds(rows, 5, exact=False).filter("fold between 0 and 4").count() == 103


def test_bias_runs_equal_separate_fits(spark):
    rows = planted_ratings(spark, 60, 40).withColumn("fold", (F.col("user_id") + F.col("item_id")) % 3).cache()
    together = biases.fit_biases(rows, [biases.BiasRun(2.0, 3.0, F.col("fold") != f) for f in range(3)])
    for f in range(3):
        alone = biases.fit_biases(rows.filter(F.col("fold") != f), [biases.BiasRun(2.0, 3.0)])
        assert together.means[f] == pytest.approx(alone.means[0])
        a = {r.user_id: r.biases[f] for r in together.users.collect()}
        b = {r.user_id: r.biases[0] for r in alone.users.collect()}
        assert {u: a[u] for u in b} == pytest.approx(b)


def test_negatives_are_never_positives(spark):
    rows = planted_ratings(spark).select("user_id", "item_id").cache()
    triples = sampling.sample_triples(rows, prep.encode_ids(rows, "item_id"), 3)
    clash = triples.join(rows.withColumnRenamed("item_id", "negative_id"), ["user_id", "negative_id"])
    assert triples.count() > 0 and clash.count() == 0


def test_redraws_are_the_next_good_tries(spark, monkeypatch):
    """As drawing all tries for everyone; tries beyond the first are made only for pairs that lost some."""
    asked, plain = [], sampling.draws
    monkeypatch.setattr(sampling, "draws", lambda seed, epoch, tries, first=0: asked.append((first, tries)) or plain(seed, epoch, tries, first))
    rows = spark.range(120).select((F.col("id") % 6).alias("user_id"), (F.col("id") * 7 % 25).alias("item_id")).distinct().cache()
    items = prep.encode_ids(rows, "item_id")
    got = {tuple(r) for r in sampling.sample_triples(rows, items, 3, redraws=4).collect()}
    assert asked == [(0, 3), (3, 7)]
    every = sampling.sample_triples(rows, items, 7).collect()
    by_pair = {}
    for r in sorted(every, key=lambda r: r.draw):
        by_pair.setdefault((r.user_id, r.item_id), []).append(tuple(r))
    assert got == {r for mine in by_pair.values() for r in mine[:3]} and any(r[2] > 2 for r in got)


def test_first_violations_skip_ids_without_vectors(spark):
    triples = spark.createDataFrame(
        [(1, 5, 0, 9), (1, 5, 1, 6), (1, 5, 2, 7), (1, 8, 0, 6), (2, 5, 0, 6)], "user_id long, item_id long, draw int, negative_id long"
    )
    users = spark.createDataFrame([(1, [1.0, 2.0])], "user_id long, factors array<double>")
    items = spark.createDataFrame([(5, [1.0, 0.0]), (6, [0.0, 0.0]), (7, [3.0, 0.0])], "item_id long, factors array<double>")
    got = [tuple(r) for r in sampling.first_violations(triples, users, items, 10, 0.5).collect()]
    assert got == [(1, 5, 7, 3, pytest.approx(np.log(3.0)))]


def test_tiles_hold_every_item_once(spark, skewed):
    tiles = prep.item_list_tiles(skewed, width=64)
    assert tiles.agg(F.max(F.size("items"))).first()[0] <= 64
    assert tiles.agg(F.sum(F.size("items"))).first()[0] == skewed.count()


def test_evaluation_sample_is_capped_and_stable(spark, skewed):
    first = {r.user_id for r in prep.evaluation_users(skewed, 50).collect()}
    assert len(first) == 50
    assert first == {r.user_id for r in prep.evaluation_users(skewed.repartition(3), 50).collect()}


def test_labels_by_cuts_match_sorting(spark):
    """Few and many ties, nulls, cuts at both ends: as numbering the sorted rows."""
    import random

    rng = random.Random(7)
    for spread in (3, 50, 10**12):
        rows = [(i, None if rng.random() < 0.05 else rng.randint(-spread, spread)) for i in range(300)]
        df = spark.createDataFrame(rows, "id long, x long")
        cuts = [1, 7, 150, 151, 299, 300]
        order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
        want = {r[0]: sum(k + 1 > c for c in cuts) for k, r in enumerate(order)}
        got = {r.id: r.behind for r in ordering.label_by_cuts(df, F.col("x"), ["id"], cuts, "behind").collect()}
        assert got == want
