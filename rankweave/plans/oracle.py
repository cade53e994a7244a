"""Plain SQL for the registered queries, over the raw tables, for comparison in another engine."""

from __future__ import annotations

from rankweave.functions.sql_hash import md5_draw as h
from rankweave.operators.prep import hash_cut
from rankweave.plans import registry, rotation_oracle
from rankweave.plans.search import EXPLICIT_DEFAULTS, EXPLICIT_SPACE, IMPLICIT_SPACE


RATINGS = f"""ratings AS (
  SELECT user_id, item_id, rating, ts, {h(42, 'user_id', 'item_id')} AS h FROM (
    SELECT o_custkey AS user_id, l_partkey AS item_id, ceil(l_quantity / 10)::DOUBLE AS rating, o_orderdate AS ts,
           row_number() OVER (PARTITION BY o_custkey, l_partkey
                              ORDER BY o_orderdate DESC, l_orderkey DESC, l_quantity DESC) AS rn
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey) WHERE rn = 1)"""
SPLIT = RATINGS + f""",
train AS (SELECT * FROM ratings WHERE h >= {hash_cut(0.2)}),
test AS (SELECT * FROM ratings WHERE h < {hash_cut(0.2)}),
pos AS (SELECT user_id, item_id FROM train WHERE rating >= 3),
truth AS (SELECT user_id, item_id, rating FROM test WHERE rating >= 3)"""
SAMPLE = f"""users AS (
  SELECT user_id FROM (SELECT DISTINCT user_id FROM truth) ORDER BY {h(42, 'user_id')}, user_id LIMIT 1000)"""
JUDGED = "users AS (SELECT DISTINCT user_id FROM truth)"
ALL_USERS = "users AS (SELECT DISTINCT user_id FROM ratings)"
POPULARITY = """pop AS (
  SELECT i.item_id, count(p.user_id) AS n_positives,
         count(p.user_id) / (SELECT count(DISTINCT user_id) FROM ratings) AS popularity
  FROM (SELECT DISTINCT item_id FROM ratings) i LEFT JOIN pos p USING (item_id) GROUP BY 1)"""


def popular(name: str = "recs", n: int = 20) -> str:
    return f"""{name} AS (
  SELECT * FROM (
    SELECT u.user_id, p.item_id, p.popularity AS score,
           row_number() OVER (PARTITION BY u.user_id ORDER BY p.popularity DESC, p.item_id)::INTEGER AS rank
    FROM users u CROSS JOIN pop p
    WHERE NOT EXISTS (SELECT 1 FROM pos s WHERE s.user_id = u.user_id AND s.item_id = p.item_id))
  WHERE rank <= {n})"""


VECTORS = """iv AS (SELECT vec_id AS item_id, embedding::DOUBLE[] AS factors FROM embeddings),
uv AS (
  SELECT user_id, list(m ORDER BY d) AS factors FROM (
    SELECT user_id, d, avg(v) AS m FROM (
      SELECT user_id, unnest(factors) AS v, generate_subscripts(factors, 1) AS d FROM pos JOIN iv USING (item_id))
    GROUP BY 1, 2) GROUP BY 1)"""


def nearest(name: str = "recs", n: int = 20, users: str = "", items: str = "", seen: bool = True) -> str:
    drop_seen = "WHERE NOT EXISTS (SELECT 1 FROM pos s WHERE s.user_id = u.user_id AND s.item_id = i.item_id)" if seen else ""
    return f"""{name} AS (
  SELECT * FROM (
    SELECT user_id, item_id, score,
           row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id)::INTEGER AS rank
    FROM (SELECT u.user_id, i.item_id, list_dot_product(u.factors, i.factors) AS score
          FROM (SELECT * FROM uv {users}) u CROSS JOIN (SELECT * FROM iv {items}) i {drop_seen}))
  WHERE rank <= {n})"""


LIST_COLUMNS = "SELECT user_id, item_id, round(score, 6) AS score, rank FROM recs"
IN_JUDGED = "WHERE user_id IN (SELECT user_id FROM users)"

# Per user and k: list length, hits, discounted gain, first hit, average-precision sum.
def per_user(recs: str = "recs", tag: str = "") -> str:
    return f"""ks{tag} AS (SELECT unnest([5, 10, 20]) AS k),
rel{tag} AS (SELECT user_id, count(*) AS n_rel FROM truth GROUP BY 1),
marked{tag} AS (
  SELECT r.user_id, r.item_id, r.rank, t.item_id IS NOT NULL AS hit, coalesce(t.rating, 0) AS gain,
         sum((t.item_id IS NOT NULL)::INTEGER) OVER (PARTITION BY r.user_id ORDER BY r.rank) AS running
  FROM {recs} r LEFT JOIN truth t ON t.user_id = r.user_id AND t.item_id = r.item_id),
per_user{tag} AS (
  SELECT u.user_id, k, count(m.item_id) AS n_listed, count(*) FILTER (m.hit) AS hits,
         coalesce(sum(1 / log2(m.rank + 1)) FILTER (m.hit), 0) AS dcg,
         coalesce(sum(m.gain / log2(m.rank + 1)), 0) AS graded,
         min(m.rank) FILTER (m.hit) AS first_hit,
         sum(m.running / m.rank) FILTER (m.hit) AS ap,
         any_value(n_rel) AS n_rel
  FROM users u CROSS JOIN ks{tag} LEFT JOIN marked{tag} m ON m.user_id = u.user_id AND m.rank <= k
       LEFT JOIN rel{tag} r ON r.user_id = u.user_id
  GROUP BY 1, 2),
ideal{tag} AS (SELECT n, sum(1 / log2(j + 1)) AS idcg
          FROM range(1, 21) a(n) JOIN range(1, 21) b(j) ON j <= n GROUP BY 1),
scored{tag} AS (SELECT p.*, idcg FROM per_user{tag} p LEFT JOIN ideal{tag} ON n = least(n_rel, k))"""


METRIC_SQL = {
    "precision": "avg(CASE WHEN n_listed > 0 THEN hits / n_listed END)",
    "recall": "avg(CASE WHEN n_rel > 0 THEN hits / n_rel END)",
    "ndcg": "avg(CASE WHEN n_rel > 0 THEN dcg / idcg END)",
    "map": "avg(CASE WHEN hits > 0 THEN ap / least(n_rel, k) END)",
    "mrr": "avg(CASE WHEN hits > 0 THEN 1 / first_hit ELSE 0 END)",
}
METRIC_SQL["f1"] = (
    f"CASE WHEN {METRIC_SQL['precision']} + {METRIC_SQL['recall']} > 0 THEN "
    f"2 * {METRIC_SQL['precision']} * {METRIC_SQL['recall']} / ({METRIC_SQL['precision']} + {METRIC_SQL['recall']}) ELSE 0 END"
)


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


POPULAR_JUDGED = (SPLIT, JUDGED, POPULARITY, popular())


def metric(name: str) -> str:
    return with_(*POPULAR_JUDGED, per_user()) + (
        f"SELECT k::INTEGER AS k, round(coalesce({METRIC_SQL[name]}, 0), 6) AS value FROM scored GROUP BY k"
    )


DIVERSITY = """pairs AS (
  SELECT a.user_id, avg(1 - list_dot_product(x.factors, y.factors)
         / (sqrt(list_dot_product(x.factors, x.factors)) * sqrt(list_dot_product(y.factors, y.factors)) + 1e-8)) AS d
  FROM recs a JOIN recs b ON a.user_id = b.user_id AND a.rank < b.rank
       JOIN iv x ON x.item_id = a.item_id JOIN iv y ON y.item_id = b.item_id GROUP BY 1)"""
NOVELTY = """nov AS (SELECT user_id, avg(-log2(popularity + 1e-10)) AS v FROM recs JOIN pop USING (item_id) GROUP BY 1)"""
IV = VECTORS.split(",\nuv AS")[0]


def biases(train: str, reg_user: float, reg_item: float, steps: int) -> str:
    """Alternating half-steps, one CTE each; the last ones are ``bi`` and ``bu``."""
    out = [f"m AS (SELECT avg(rating) AS mean FROM {train})"]
    out.append(f"bi1 AS (SELECT item_id, sum(rating - mean) / ({reg_item} + count(*)) AS b FROM {train}, m GROUP BY 1)")
    for s in range(1, steps + 1):
        out.append(f"bu{s} AS (SELECT t.user_id, sum(rating - mean - b) / ({reg_user} + count(*)) AS b "
                   f"FROM {train} t JOIN bi{s} USING (item_id), m GROUP BY 1)")
        if s < steps:
            out.append(f"bi{s + 1} AS (SELECT t.item_id, sum(rating - mean - b) / ({reg_item} + count(*)) AS b "
                       f"FROM {train} t JOIN bu{s} USING (user_id), m GROUP BY 1)")
    out.append(f"bi AS (SELECT * FROM bi{steps})")
    out.append(f"bu AS (SELECT * FROM bu{steps})")
    return ",\n".join(out)


def estimates(test: str, extra: str = "") -> str:
    return f"""est AS (
  SELECT t.user_id, t.item_id, t.rating{extra},
         greatest(1, least(5, mean + coalesce(bu.b, 0) + coalesce(bi.b, 0))) AS estimate
  FROM {test} t CROSS JOIN m LEFT JOIN bu ON bu.user_id = t.user_id LEFT JOIN bi ON bi.item_id = t.item_id)"""


BIASES = biases("train", 5.0, 5.0, 2)
ERRORS = "sqrt(avg((rating - estimate) ** 2)) AS rmse, avg(abs(rating - estimate)) AS mae"
EVENTS = f"""events_view AS (
  SELECT event_id, user_id, json_extract_string(props, '$.k')::BIGINT AS item_id,
         (1 + floor(value)::BIGINT % 5)::DOUBLE AS rating, ts, {h(42, 'event_id')} % 10 < 2 AS is_test FROM events)"""

FOLDS = """numbered AS (
  SELECT user_id, item_id, rating, ntile(5) OVER (ORDER BY h, user_id, item_id) - 1 AS fold FROM ratings),
train AS (SELECT f AS run, n.* FROM numbered n, range(5) r(f) WHERE fold <> f),
fm AS (SELECT run, avg(rating) AS mean FROM train GROUP BY 1),
fi AS (SELECT run, item_id, sum(rating - mean) / (5.0 + count(*)) AS b FROM train JOIN fm USING (run) GROUP BY 1, 2),
fu AS (SELECT run, t.user_id, sum(rating - mean - b) / (5.0 + count(*)) AS b
       FROM train t JOIN fm USING (run) JOIN fi USING (run, item_id) GROUP BY 1, 2),
est AS (
  SELECT n.fold, n.rating, greatest(1, least(5, mean + coalesce(fu.b, 0) + coalesce(fi.b, 0))) AS estimate
  FROM numbered n JOIN fm ON fm.run = n.fold
       LEFT JOIN fi ON fi.run = n.fold AND fi.item_id = n.item_id
       LEFT JOIN fu ON fu.run = n.fold AND fu.user_id = n.user_id),
folds AS (SELECT fold::INTEGER AS fold, sqrt(avg((rating - estimate) ** 2)) AS rmse,
                 avg(abs(rating - estimate)) AS mae, count(*) AS n_predictions FROM est GROUP BY 1)"""

LINKS = """SELECT p_partkey AS item_id, ('0x' || substr(md5(feature), 1, 15))::BIGINT AS feature_id, 1.0::DOUBLE AS value
  FROM (SELECT p_partkey, unnest(['brand=' || p_brand, 'type=' || p_type, 'size=' || p_size]) AS feature FROM part)"""
ENCODED_ITEMS = "dict AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM (SELECT DISTINCT item_id FROM ratings))"


def triples(n: int, redraws: int = 0) -> str:
    return f"""triples AS (
  SELECT user_id, item_id, draw::INTEGER AS draw, negative_id FROM (
    SELECT p.user_id, p.item_id, draw, d.item_id AS negative_id
    FROM (SELECT *, {h(42, "'0'", 'user_id', 'item_id', 'draw')} % (SELECT count(*) FROM dict) AS idx
          FROM pos, range({n + redraws}) r(draw)) p JOIN dict d USING (idx)) t
  WHERE NOT EXISTS (SELECT 1 FROM pos s WHERE s.user_id = t.user_id AND s.item_id = t.negative_id)
  QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY draw) <= {n})"""


def draw(entry) -> str:
    name, kind, *rest = entry
    u = f"({h(42, 'trial', repr(name))} / 4294967296.0)"
    if kind == "int":
        low, high, step = rest
        return f"({low} + floor({u} * {(high - low) // step + 1})::INTEGER * {step})::INTEGER"
    if kind == "log":
        low, high = rest
        return f"exp(ln({low}) + {u} * (ln({high}) - ln({low})))"
    options = ", ".join(f"'{o}'" if isinstance(o, str) else str(o).lower() for o in rest[0])
    return f"[{options}][floor({u} * {len(rest[0])})::INTEGER + 1]"


def trial_space(space, defaults=None) -> str:
    columns = []
    for entry in space:
        value = draw(entry)
        if defaults is not None:
            kept = defaults.get(entry[0])
            literal = "NULL" if kept is None else str(kept).lower() if isinstance(kept, bool) else str(kept)
            value = f"CASE WHEN trial = 0 THEN {literal} ELSE {value} END"
        columns.append(f"{value} AS {entry[0]}")
    return f"space AS (SELECT trial::INTEGER AS trial, {', '.join(columns)} FROM range(20) r(trial))"


EXPLICIT_TRIALS = trial_space(EXPLICIT_SPACE, EXPLICIT_DEFAULTS) + f""",
trials AS (SELECT * REPLACE (CASE WHEN use_biased THEN reg_bu END AS reg_bu, CASE WHEN use_biased THEN reg_bi END AS reg_bi) FROM space),
fit AS (SELECT * FROM train WHERE {h(43, 'user_id', 'item_id')} >= {hash_cut(0.1)}),
held AS (SELECT * FROM train WHERE {h(43, 'user_id', 'item_id')} < {hash_cut(0.1)}),
m AS (SELECT avg(rating) AS mean FROM fit),
ti AS (SELECT trial, item_id, sum(rating - mean) / (any_value(reg_bi) + count(*)) AS b
       FROM fit, m, trials WHERE use_biased GROUP BY 1, 2),
tu AS (SELECT trial, f.user_id, sum(rating - mean - b) / (any_value(reg_bu) + count(*)) AS b
       FROM fit f JOIN ti USING (item_id) JOIN trials USING (trial), m GROUP BY 1, 2),
est AS (SELECT t.trial, h.rating, greatest(1, least(5, mean + coalesce(tu.b, 0) + coalesce(ti.b, 0))) AS estimate
        FROM held h CROSS JOIN trials t CROSS JOIN m
             LEFT JOIN ti ON ti.trial = t.trial AND ti.item_id = h.item_id
             LEFT JOIN tu ON tu.trial = t.trial AND tu.user_id = h.user_id),
results AS (SELECT t.*, r.* EXCLUDE (trial) FROM trials t JOIN (
  SELECT trial, round(-sqrt(avg((rating - estimate) ** 2)), 9) AS value, avg(abs(rating - estimate)) AS mae,
         count(*) AS n_predictions FROM est GROUP BY 1) r USING (trial))"""

FLAGGED = "SELECT user_id, item_id, rating, ({}) ::INTEGER AS is_test FROM ratings"


def report_sql() -> str:
    parts = [
        f"SELECT '{name}' AS metric, k::INTEGER AS k, coalesce({sql}, 0) AS value FROM scored GROUP BY k"
        for name, sql in METRIC_SQL.items()
    ]
    parts += [
        "SELECT 'coverage', NULL, count(DISTINCT item_id) / (SELECT count(DISTINCT item_id) FROM ratings) FROM recs",
        "SELECT 'diversity', NULL, coalesce(avg(d), 0) FROM pairs",
        "SELECT 'novelty', NULL, coalesce(avg(v), 0) FROM nov",
        "SELECT 'n_users_evaluated', NULL, count(*)::DOUBLE FROM users",
    ]
    known = JUDGED.replace("users AS", "sampled AS") + ",\nusers AS (SELECT user_id FROM sampled WHERE user_id IN (SELECT user_id FROM uv))"
    return (
        with_(SPLIT, VECTORS, known, POPULARITY, nearest(users=IN_JUDGED), per_user(), DIVERSITY, NOVELTY)
        + "SELECT metric, k, round(value, 6) AS value FROM (" + "\nUNION ALL ".join(parts) + ")"
    )


def compare_sql() -> str:
    sides = []
    for side, recs in (("popular", popular("recs_p")), ("vectors", nearest("recs_v", users=IN_JUDGED))):
        body = per_user(recs.split(" AS")[0], f"_{side}")
        rows = " UNION ALL ".join(
            f"SELECT '{m}' AS metric, k::INTEGER AS k, coalesce({METRIC_SQL[m]}, 0) AS v FROM scored_{side} GROUP BY k"
            for m in ("precision", "recall", "ndcg")
        )
        sides += [recs, body, f"out_{side} AS ({rows})"]
    return with_(SPLIT, JUDGED, POPULARITY, VECTORS, *sides) + (
        "SELECT metric, k, round(p.v, 6) AS popular, round(q.v, 6) AS vectors "
        "FROM out_popular p JOIN out_vectors q USING (metric, k)"
    )


def sink_sql(sql: dict[str, str]) -> dict[str, str]:
    """What is read back equals what another query returns, or some columns of it."""
    names = "UNION ALL ".join(
        f"SELECT 'popular' AS model, '{m}@' || k AS name, round(coalesce({METRIC_SQL[m]}, 0), 6) AS value FROM scored GROUP BY k "
        for m in ("precision", "recall", "ndcg")
    )
    part = lambda name, columns: f"SELECT {columns} FROM ({sql[name]})"
    return {
        "sink_predictions": part("bias_predict", "'biases' AS model, user_id, item_id, estimate"),
        "sink_trials": part("trial_space_explicit", "trial, n_factors, n_epochs, value, mae, n_predictions"),
        "sink_best_parameters": part("best_trial", "n_factors, n_epochs, learning_rate, regularization"),
        "sink_report": with_(*POPULAR_JUDGED, per_user()) + names,
        "sink_model": sql["bias_export"],
    }


def oracle_sql() -> dict[str, str]:
    found = _query_sql()
    return found | sink_sql(found)


def _query_sql() -> dict[str, str]:
    solved = with_(SPLIT) + "SELECT DISTINCT user_id, 1::INTEGER AS ok FROM "
    val = h(43, "user_id", "item_id") + f" < {hash_cut(0.1)}"
    return {
        "ratings_view": with_(RATINGS) + "SELECT user_id, item_id, rating, epoch_us(ts) AS ts_micros FROM ratings",
        "item_user_view": with_(SPLIT) + "SELECT item_id, user_id, 1.0::DOUBLE AS weight FROM pos",
        "item_features": "SELECT p_partkey AS item_id, unnest(['brand=' || p_brand, 'type=' || p_type, 'size=' || p_size]) AS feature, 1.0::DOUBLE AS value FROM part",
        "holdout_split": with_(RATINGS) + FLAGGED.format(f"h < {hash_cut(0.2)}"),
        "holdout_split_5pct": with_(RATINGS) + FLAGGED.format(f"h < {hash_cut(0.05)}"),
        "holdout_split_25pct": with_(RATINGS) + FLAGGED.format(f"h < {hash_cut(0.25)}"),
        "holdout_split_exact": with_(RATINGS) + FLAGGED.format(
            "row_number() OVER (ORDER BY h, user_id, item_id) <= ceil(round(0.2 * (SELECT count(*) FROM ratings), 6))"),
        "validation_split": with_(SPLIT) + f"SELECT user_id, item_id, rating, ({val})::INTEGER AS is_validation FROM train",
        "temporal_split": with_(EVENTS) + (
            "SELECT event_id, user_id, item_id, (row_number() OVER (ORDER BY ts, event_id) > "
            "floor(0.8 * (SELECT count(*) FROM events_view)))::INTEGER AS is_test FROM events_view"),
        "stratified_split": with_(RATINGS) + FLAGGED.format(
            "row_number() OVER (PARTITION BY user_id ORDER BY h, item_id) <= ceil(round(0.2 * count(*) OVER (PARTITION BY user_id), 6))"),
        "min_train_items": with_(SPLIT) + "SELECT user_id, item_id FROM pos WHERE user_id IN (SELECT user_id FROM pos GROUP BY 1 HAVING count(*) >= 5)",
        "implicit_threshold": with_(SPLIT) + "SELECT user_id, item_id, 1.0::DOUBLE AS weight, 'train' AS part FROM pos UNION ALL SELECT user_id, item_id, 1.0, 'test' FROM truth",
        "confidence_weights": with_(SPLIT) + "SELECT user_id, item_id, 1 + 40 * rating AS confidence FROM train",
        "id_encode": with_(RATINGS) + (
            "SELECT 'user' AS kind, user_id AS raw_id, row_number() OVER (ORDER BY user_id) - 1 AS idx FROM (SELECT DISTINCT user_id FROM ratings) "
            "UNION ALL SELECT 'item', item_id, row_number() OVER (ORDER BY item_id) - 1 FROM (SELECT DISTINCT item_id FROM ratings)"),
        "user_item_lists": with_(SPLIT) + (
            "SELECT user_id, item_id // 1024 AS tile, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS items FROM pos GROUP BY 1, 2"),
        "eval_user_sample": with_(SPLIT, SAMPLE) + "SELECT user_id FROM users",
        "rating_profile": with_(SPLIT) + "SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items, count(*) AS n_ratings, round(avg(rating), 6) AS global_mean FROM train",
        "interaction_profile": with_(SPLIT) + (
            "SELECT n_users, n_items, n_interactions, round(n_interactions / (n_users * n_items), 9) AS density, 'bpr' AS algorithm FROM "
            "(SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items, (SELECT count(*) FROM pos) AS n_interactions FROM ratings)"),
        "item_popularity": with_(SPLIT, POPULARITY) + "SELECT item_id, n_positives, round(popularity, 6) AS popularity FROM pop",
        "vector_model_size": with_(SPLIT, VECTORS) + (
            "SELECT n_users, n_items, 64::BIGINT AS n_factors, (n_users + n_items) * 64 AS total_parameters FROM "
            "(SELECT (SELECT count(*) FROM uv) AS n_users, (SELECT count(*) FROM iv) AS n_items)"),
        "bias_export": with_(SPLIT, BIASES) + "SELECT 'user' AS kind, user_id AS id, round(b, 6) AS bias FROM bu UNION ALL SELECT 'item', item_id, round(b, 6) FROM bi",
        "bias_predict": with_(SPLIT, BIASES, estimates("test")) + "SELECT user_id, item_id, rating, round(estimate, 6) AS estimate FROM est",
        "rating_errors": with_(SPLIT, BIASES, estimates("test")) + (
            "SELECT round(sqrt(avg((rating - estimate) ** 2)), 6) AS rmse, round(avg(abs(rating - estimate)), 6) AS mae, "
            "round(avg((rating - estimate) ** 2), 6) AS mse, count(*) AS n_predictions FROM est"),
        "interval_coverage": with_(SPLIT, BIASES, estimates("test")) + (
            "SELECT round(avg((rating BETWEEN round(estimate, 6) - 1 AND round(estimate, 6) + 1)::INTEGER), 6) AS confidence_coverage, "
            "2.0::DOUBLE AS avg_interval_width FROM est"),
        "kfold_rmse": with_(RATINGS, FOLDS) + "SELECT fold, round(rmse, 6) AS rmse, round(mae, 6) AS mae, n_predictions FROM folds",
        "kfold_summary": with_(RATINGS, FOLDS) + (
            "SELECT round(avg(rmse), 6) AS rmse_mean, round(stddev_pop(rmse), 6) AS rmse_std, "
            "round(avg(mae), 6) AS mae_mean, round(stddev_pop(mae), 6) AS mae_std FROM folds"),
        "time_window_rmse": with_(
            EVENTS, "train AS (SELECT * FROM events_view WHERE NOT is_test)",
            "test AS (SELECT * FROM events_view WHERE is_test)", biases("train", 5.0, 5.0, 1), estimates("test", ", t.ts, t.event_id"),
            "placed AS (SELECT *, least((row_number() OVER (ORDER BY ts, event_id) - 1) // ((SELECT count(*) FROM test) // 5), 4)::INTEGER AS window_no FROM est)",
        ) + (
            "SELECT window_no, round(sqrt(avg((rating - estimate) ** 2)), 6) AS window_rmse, count(*) AS window_size, "
            "round(avg(epoch_us(ts) / 1e6), 3) AS mean_epoch_seconds FROM placed GROUP BY 1"),
        "popularity_topk": with_(SPLIT, ALL_USERS, POPULARITY, popular()) + LIST_COLUMNS,
        "factor_predict": with_(SPLIT, VECTORS) + (
            "SELECT t.user_id, t.item_id, round(coalesce(list_dot_product(uv.factors, iv.factors), 0), 6) AS score "
            "FROM test t LEFT JOIN uv ON uv.user_id = t.user_id LEFT JOIN iv ON iv.item_id = t.item_id"),
        "hybrid_predict": with_(SPLIT, VECTORS, POPULARITY, "ub AS (SELECT user_id, avg(rating) - 3 AS b FROM train GROUP BY 1)") + (
            "SELECT t.user_id, t.item_id, round(coalesce(list_dot_product(uv.factors, iv.factors) + ub.b + pop.popularity, 0), 6) AS score "
            "FROM test t LEFT JOIN uv ON uv.user_id = t.user_id LEFT JOIN iv ON iv.item_id = t.item_id "
            "LEFT JOIN ub ON ub.user_id = t.user_id LEFT JOIN pop ON pop.item_id = t.item_id"),
        "factor_topk": with_(SPLIT, VECTORS, nearest()) + LIST_COLUMNS,
        "candidate_topk": with_(SPLIT, VECTORS, nearest(n=10, items="WHERE item_id IN (SELECT p_partkey FROM part WHERE p_type = 'ECONOMY')")) + LIST_COLUMNS,
        "factor_topk_with_seen": with_(SPLIT, VECTORS, nearest(n=10, seen=False)) + LIST_COLUMNS,
        "pmf_topk": with_(SPLIT, JUDGED, BIASES) + (
            "SELECT user_id, item_id, round(score, 6) AS score, rank FROM (SELECT *, "
            "row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id)::INTEGER AS rank FROM ("
            "SELECT u.user_id, i.item_id, greatest(1, least(5, mean + u.b + i.b)) AS score "
            "FROM (SELECT * FROM bu WHERE user_id IN (SELECT user_id FROM users)) u CROSS JOIN bi i CROSS JOIN m "
            "WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.user_id = u.user_id AND t.item_id = i.item_id))) WHERE rank <= 10"),
        "hybrid_representation": with_(
            SPLIT, "links AS (SELECT p_partkey AS item_id, unnest(['brand=' || p_brand, 'type=' || p_type, 'size=' || p_size]) AS feature FROM part)",
            "stats AS (SELECT feature, avg(rating) AS a, stddev_pop(rating) AS s FROM links JOIN train USING (item_id) GROUP BY 1)",
        ) + "SELECT item_id, round(sum(a), 6) AS mean_sum, round(sum(s), 6) AS spread_sum, round(sum(a - 3), 6) AS bias FROM links JOIN stats USING (feature) GROUP BY 1",
        "nested_topk": with_(SPLIT, VECTORS, nearest(n=10)) + "SELECT user_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY rank) AS items FROM recs GROUP BY 1",
        "factor_explain": with_(SPLIT, VECTORS) + (
            "SELECT user_id, item_id, round(total, 6) AS total_score, place::INTEGER AS place, (d - 1)::BIGINT AS factor_id, round(u * v, 6) AS contribution, "
            "round(u, 6) AS user_value, round(v, 6) AS item_value FROM ("
            "SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY abs(u * v) DESC, d) AS place FROM ("
            "SELECT t.user_id, t.item_id, list_dot_product(uv.factors, iv.factors) AS total, unnest(uv.factors) AS u, "
            "unnest(iv.factors) AS v, generate_subscripts(iv.factors, 1) AS d "
            "FROM truth t JOIN uv USING (user_id) JOIN iv USING (item_id))) WHERE place <= 5"),
        "truth_alignment": with_(*POPULAR_JUDGED, per_user()) + "SELECT user_id, n_listed, n_rel AS n_relevant, hits AS n_hits FROM scored WHERE k = 20",
        "ensemble_topk": with_(
            SPLIT, JUDGED, POPULARITY, VECTORS,
            "sc AS (SELECT u.user_id, pop.item_id, pop.popularity AS a, coalesce(list_dot_product(uv.factors, iv.factors), 0) AS b "
            "FROM users u CROSS JOIN pop LEFT JOIN uv ON uv.user_id = u.user_id LEFT JOIN iv ON iv.item_id = pop.item_id "
            "WHERE NOT EXISTS (SELECT 1 FROM pos s WHERE s.user_id = u.user_id AND s.item_id = pop.item_id))",
            "blend AS (SELECT user_id, item_id, 0.6::DOUBLE * CASE WHEN ha > la THEN (a - la) / (ha - la) ELSE 1 END "
            "+ 0.4::DOUBLE * CASE WHEN hb > lb THEN (b - lb) / (hb - lb) ELSE 1 END AS score FROM (SELECT *, min(a) OVER w AS la, "
            "max(a) OVER w AS ha, min(b) OVER w AS lb, max(b) OVER w AS hb FROM sc WINDOW w AS (PARTITION BY user_id)))",
            "recs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id)::INTEGER AS rank FROM blend) WHERE rank <= 10)",
        ) + LIST_COLUMNS,
        "precision_at_k": metric("precision"),
        "recall_at_k": metric("recall"),
        "f1_at_k": metric("f1"),
        "ndcg_binary": metric("ndcg"),
        "ndcg_graded": with_(
            *POPULAR_JUDGED, per_user(),
            "best AS (SELECT user_id, k, sum(rating / log2(r + 1)) AS ideal_gain FROM "
            "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rating DESC, item_id) AS r FROM truth) JOIN ks ON r <= k GROUP BY 1, 2)",
        ) + "SELECT k::INTEGER AS k, round(avg(graded / ideal_gain), 6) AS value FROM scored JOIN best USING (user_id, k) GROUP BY 1",
        "map_at_k": metric("map"),
        "mrr_at_k": metric("mrr"),
        "serendipity": with_(SPLIT, JUDGED, POPULARITY, VECTORS, popular("expected"), nearest(users=IN_JUDGED), "ks AS (SELECT unnest([5, 10, 20]) AS k)") + (
            "SELECT k::INTEGER AS k, round(coalesce(avg(v), 0), 6) AS value FROM ("
            "SELECT r.user_id, k, sum((t.item_id IS NOT NULL AND e.item_id IS NULL)::INTEGER) / count(*) AS v "
            "FROM recs r JOIN ks ON r.rank <= k LEFT JOIN truth t ON t.user_id = r.user_id AND t.item_id = r.item_id "
            "LEFT JOIN expected e ON e.user_id = r.user_id AND e.item_id = r.item_id AND e.rank <= k GROUP BY 1, 2) GROUP BY 1"),
        "catalog_coverage": with_(*POPULAR_JUDGED) + (
            "SELECT n_recommended, n_catalogue, round(n_recommended / n_catalogue, 6) AS coverage FROM "
            "(SELECT count(DISTINCT item_id) AS n_recommended, (SELECT count(DISTINCT item_id) FROM ratings) AS n_catalogue FROM recs)"),
        "list_diversity": with_(*POPULAR_JUDGED, IV, DIVERSITY) + "SELECT round(avg(d), 6) AS diversity, count(*) AS n_lists FROM pairs",
        "list_novelty": with_(*POPULAR_JUDGED, NOVELTY) + "SELECT round(avg(v), 6) AS novelty, count(*) AS n_lists FROM nov",
        "ranking_report": report_sql(),
        "metric_report": compare_sql(),
        "sink_importance": "SELECT unnest([" + ", ".join(f"'{e[0]}'" for e in EXPLICIT_SPACE) + "]) AS parameter, 1 AS is_share, 1.0::DOUBLE AS total",
        "merged_profile": with_(RATINGS) + (
            "SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items, count(*) AS n_ratings, "
            "round(avg(rating), 6) AS global_mean, 1 AS n_users_close, 1 AS n_items_close, 1 AS n_ratings_close, "
            "1 AS global_mean_close FROM ratings"),
        "bpr_triples": with_(SPLIT, ENCODED_ITEMS, triples(3, registry.REDRAWS)) + "SELECT * FROM triples",
        "training_negatives": with_(
            SPLIT, rotation_oracle.dealt(registry.ROUND["bpr"], "pos", "ratings"), rotation_oracle.negatives(registry.ROUND["bpr"]),
        ) + "SELECT user_id, item_id, draw::INTEGER AS draw, other AS negative_id FROM chosen",
        "bpr_round": with_(SPLIT, rotation_oracle.epoch(registry.ROUND["bpr"], "pos", "ratings")) + "SELECT * FROM trained",
        "lmf_round": with_(SPLIT, rotation_oracle.epoch(registry.ROUND["logistic"], "pos", "ratings")) + "SELECT * FROM trained",
        "warp_round": with_(SPLIT, rotation_oracle.epoch(registry.ROUND["warp"], "pos", "ratings", LINKS)) + "SELECT * FROM trained",
        "hybrid_bpr_round": with_(SPLIT, rotation_oracle.epoch(registry.HYBRID_BPR, "pos", "ratings", LINKS)) + "SELECT * FROM trained",
        "sgd_round": with_(
            SPLIT, rotation_oracle.epoch(registry.ROUND["squared"], "(SELECT user_id, item_id, rating AS value FROM train)", "train"),
        ) + "SELECT * FROM trained",
        "warp_first_violation": with_(
            SPLIT, VECTORS, ENCODED_ITEMS, triples(10),
            "tried AS (SELECT t.*, row_number() OVER (PARTITION BY t.user_id, t.item_id ORDER BY draw) AS rn "
            "FROM triples t JOIN uv USING (user_id) JOIN iv i ON i.item_id = t.item_id JOIN iv j ON j.item_id = t.negative_id "
            "WHERE list_dot_product(uv.factors, j.factors) > list_dot_product(uv.factors, i.factors) - 0.01)",
        ) + "SELECT user_id, item_id, negative_id, draw + 1 AS tries, round(ln(greatest(1, ((SELECT count(*) FROM dict) - 1) // (draw + 1))), 6) AS weight FROM tried WHERE rn = 1",
        "pmf_normal_equations": solved + "train",
        "pmf_biased_normal_equations": solved + "train",
        "nmf_conditions": solved + "train",
        "nmf_two_penalties": with_(SPLIT) + (
            "SELECT 'user' AS side, user_id AS id, 1 AS ok FROM train GROUP BY 2 UNION ALL "
            "SELECT 'item', item_id, 1 FROM train GROUP BY 2"),
        "implicit_als_normal_equations": solved + "pos",
        "trial_space_explicit": with_(SPLIT, EXPLICIT_TRIALS) + (
            "SELECT trial, n_factors, n_epochs, round(learning_rate, 6) AS learning_rate, round(regularization, 6) AS regularization, "
            "use_biased::INTEGER AS use_biased, round(reg_bu, 6) AS reg_bu, round(reg_bi, 6) AS reg_bi, "
            "round(value, 6) AS value, round(mae, 6) AS mae, n_predictions FROM results"),
        "trial_space_implicit": with_(SPLIT, trial_space(IMPLICIT_SPACE)) + (
            "SELECT trial, factors, iterations, round(learning_rate, 6) AS learning_rate, round(regularization, 7) AS regularization, algorithm, "
            "CASE WHEN algorithm = 'bpr' THEN verify_negative_samples::INTEGER END AS verify_negative_samples, "
            "factors * (SELECT count(DISTINCT user_id) + count(DISTINCT item_id) FROM ratings) AS total_parameters FROM space"),
        "trial_prune": ("WITH RECURSIVE " + with_(SPLIT, EXPLICIT_TRIALS)[5:].rstrip() + """,
walk AS (
  SELECT 0 AS t, [value] AS done, 'COMPLETE' AS state, value FROM results WHERE trial = 0
  UNION ALL
  SELECT w.t + 1,
         CASE WHEN len(w.done) >= 5 AND r.value < list_aggregate(w.done, 'quantile_cont', 0.75) THEN w.done ELSE list_append(w.done, r.value) END,
         CASE WHEN len(w.done) >= 5 AND r.value < list_aggregate(w.done, 'quantile_cont', 0.75) THEN 'PRUNED' ELSE 'COMPLETE' END,
         r.value
  FROM walk w JOIN results r ON r.trial = w.t + 1)
SELECT t::INTEGER AS trial, round(value, 6) AS value, state FROM walk"""),
        "best_trial": with_(SPLIT, EXPLICIT_TRIALS) + (
            "SELECT n_factors, n_epochs, round(learning_rate, 6) AS learning_rate, round(regularization, 6) AS regularization, "
            "use_biased::INTEGER AS biased, round(reg_bu, 6) AS reg_bu, round(reg_bi, 6) AS reg_bi FROM results ORDER BY value DESC, trial LIMIT 1"),
    }
