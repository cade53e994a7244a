"""SQL of one training epoch: blocks in rotation, counter-based negatives, gradient sums and steps.

Parameters are rows (id, d, v), with d = 0 for the bias; each round of the rotation is a few grouped joins.
"""

from __future__ import annotations

from rankweave.functions.sql_hash import md5_draw as h
from rankweave.operators.rotation import FEATURE, USER, RotationSettings


def dealt(s: RotationSettings, samples: str, items: str) -> str:
    """Blocks of users and items, and every sample with its cell and turn, in epoch 0."""
    return f"""
bitem AS MATERIALIZED (
  SELECT item_id, ib, row_number() OVER (PARTITION BY ib ORDER BY item_id) - 1 AS place, count(*) OVER (PARTITION BY ib) AS size
  FROM (SELECT item_id, {h(s.seed, "'item'", "'0'", 'item_id')} % {s.blocks} AS ib FROM (SELECT DISTINCT item_id FROM {items}))),
samples AS MATERIALIZED (
  SELECT s.*, ib, (ib - cell + {s.blocks}) % {s.blocks} AS turn FROM (
    SELECT *, {h(s.seed, "'user'", 'user_id')} % {s.blocks} AS cell FROM {samples}) s JOIN bitem USING (item_id)),
drawn AS MATERIALIZED (
  SELECT s.user_id, s.item_id, s.cell, s.turn, s.draw, b.item_id AS other FROM (
    SELECT *, {h(s.seed, "'0'", 'user_id', 'item_id', 'draw')} % size AS k
    FROM samples JOIN bitem USING (item_id, ib), range({s.tries}) r(draw)) s
  JOIN bitem b ON b.ib = s.ib AND b.place = s.k),
good AS MATERIALIZED (
  SELECT * FROM drawn d WHERE NOT EXISTS (SELECT 1 FROM samples p WHERE p.user_id = d.user_id AND p.item_id = d.other))"""


def negatives(s: RotationSettings) -> str:
    return f"""chosen AS MATERIALIZED (
  SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY draw) <= {s.negatives})"""


def _start(s: RotationSettings, name: str, kind: int, ids: str) -> str:
    spread = s.spread if s.spread is not None else s.factors**-0.5
    return f"""{name}0 AS MATERIALIZED (
  SELECT id, d, CASE WHEN d = 0 THEN 0 ELSE ({h(s.seed, f"'{kind}'", 'id', 'd')} / 4294967296.0 - 0.5) * {spread!r} END AS v
  FROM ({ids}), range({s.factors + 1}) r(d)),
{name}g0 AS MATERIALIZED (SELECT DISTINCT id, 0.0::DOUBLE AS g2 FROM {name}0)"""


def _score(t: int, rows: str, item: str) -> str:
    """Dot product and biases of (user_id, ``item``) of ``rows``."""
    return f"""
  SELECT r.user_id, r.{item} AS item_id, sum(CASE WHEN u.d = 0 THEN u.v + q.v ELSE u.v * q.v END) AS score
  FROM (SELECT DISTINCT user_id, {item} FROM {rows}) r JOIN u{t} u ON u.id = r.user_id JOIN q{t} q ON q.id = r.{item} AND q.d = u.d
  GROUP BY 1, 2"""


def _round(s: RotationSettings, t: int) -> str:
    """Round ``t``: from u, f (parameters) and ug, fg (their scales) numbered t to those numbered t + 1."""
    user_bias = s.user_bias_reg if s.user_bias_reg is not None else s.user_reg
    item_bias = s.item_bias_reg if s.item_bias_reg is not None else s.item_reg
    parts = [f"q{t} AS MATERIALIZED (SELECT item_id AS id, d, sum(value * v) AS v FROM links JOIN f{t} f ON f.id = feature_id GROUP BY 1, 2)"]
    if s.loss == "squared":
        parts.append(f"""steps{t} AS MATERIALIZED (
  SELECT cell, user_id, item_id, NULL AS other, value - {s.offset!r} - score AS pull, 0.0 AS push
  FROM (SELECT * FROM samples WHERE turn = {t}) JOIN ({_score(t, f'(SELECT * FROM samples WHERE turn = {t})', 'item_id')}) USING (user_id, item_id))""")
    else:
        rows = f"(SELECT * FROM {'good' if s.loss == 'warp' else 'chosen'} WHERE turn = {t})"
        parts.append(f"""scored{t} AS MATERIALIZED (
  SELECT n.*, own.score AS own, rival.score AS rival FROM {rows} n
  JOIN ({_score(t, rows, 'item_id')}) own USING (user_id, item_id)
  JOIN ({_score(t, rows, 'other')}) rival ON rival.user_id = n.user_id AND rival.item_id = n.other)""")
        if s.loss == "warp":
            weight = "ln(greatest(1, ((SELECT count(*) FROM bitem) - 1) // (draw + 1)))"
            parts.append(f"""steps{t} AS MATERIALIZED (
  SELECT cell, user_id, item_id, other, {weight} AS pull, {weight} AS push FROM scored{t} WHERE rival > own - 1
  QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY draw) = 1)""")
        else:
            pull, push = ("1 / (1 + exp(own - rival))",) * 2 if s.loss == "bpr" else (
                f"(1 - 1 / (1 + exp(-own))) / {s.negatives}", "1 / (1 + exp(-rival))"
            )
            parts.append(f"steps{t} AS MATERIALIZED (SELECT cell, user_id, item_id, other, {pull} AS pull, {push} AS push FROM scored{t})")
    biased = "1" if s.biased else "0"
    parts.append(f"""usum{t} AS MATERIALIZED (
  SELECT x.user_id AS id, u.d, count(*) AS n,
         sum(CASE WHEN u.d = 0 THEN (pull - push) * {biased} ELSE pull * a.v - push * coalesce(b.v, 0) END)
           - count(*) * any_value(u.v) * CASE WHEN u.d = 0 THEN {user_bias!r} ELSE {s.user_reg!r} END AS g
  FROM steps{t} x JOIN u{t} u ON u.id = x.user_id JOIN q{t} a ON a.id = x.item_id AND a.d = u.d
       LEFT JOIN q{t} b ON b.id = x.other AND b.d = u.d GROUP BY 1, 2),
fsum{t} AS MATERIALIZED (
  SELECT cell, l.feature_id AS id, f.d, count(*) AS n,
         sum(x.w * l.value * CASE WHEN f.d = 0 THEN {biased} ELSE u.v END)
           - count(*) * any_value(f.v) * CASE WHEN f.d = 0 THEN {item_bias!r} ELSE {s.item_reg!r} END AS g
  FROM (SELECT cell, user_id, item_id, pull AS w FROM steps{t} UNION ALL
        SELECT cell, user_id, other, -push FROM steps{t} WHERE other IS NOT NULL) x
  JOIN links l ON l.item_id = x.item_id JOIN f{t} f ON f.id = l.feature_id JOIN u{t} u ON u.id = x.user_id AND u.d = f.d
  GROUP BY 1, 2, 3)""")
    for name, keys in (("u", "id"), ("f", "cell, id")):
        rate = f"{s.learning_rate!r}" if s.loss == "squared" else f"{s.learning_rate!r} / sqrt(g2 + dg + 1e-6)"
        both = "cell, " if name == "f" else ""
        scale = "0.0" if s.loss == "squared" else f"sum(g * g) / {s.factors}"
        parts.append(f"""{name}rate{t} AS MATERIALIZED (
  SELECT {both}id, n, dg, {rate} AS rate FROM (
    SELECT {both}id, any_value(n) AS n, {scale} AS dg FROM {name}sum{t} GROUP BY {keys}) JOIN {name}g{t} USING (id)),
{name}move{t} AS MATERIALIZED (
  SELECT id, d, sum(r.n * r.rate * x.g) / sum(r.n) AS dv FROM {name}sum{t} x JOIN {name}rate{t} r USING ({keys}) GROUP BY 1, 2),
{name}{t + 1} AS MATERIALIZED (SELECT id, d, v + coalesce(dv, 0) AS v FROM {name}{t} LEFT JOIN {name}move{t} USING (id, d)),
{name}g{t + 1} AS MATERIALIZED (
  SELECT id, g2 + coalesce(dg, 0) AS g2
  FROM {name}g{t} LEFT JOIN (SELECT id, sum(n * dg) / sum(n) AS dg FROM {name}rate{t} GROUP BY 1) USING (id))""")
    return ",\n".join(parts)


def epoch(s: RotationSettings, samples: str, items: str, links: str | None = None) -> str:
    """CTEs that end in ``trained(kind, id, factor_id, value)``: factors from 1, the bias at 0."""
    links = links or f"SELECT DISTINCT item_id, item_id AS feature_id, 1.0::DOUBLE AS value FROM {items}"
    ctes = [f"links AS MATERIALIZED ({links})", dealt(s, samples, "links"), negatives(s)]
    ctes.append(_start(s, "u", USER, "SELECT DISTINCT user_id AS id FROM samples"))
    ctes.append(_start(s, "f", FEATURE, "SELECT DISTINCT feature_id AS id FROM links"))
    ctes += [_round(s, t) for t in range(s.blocks)]
    last = s.blocks
    ctes.append(f"""trained AS (
  SELECT 'user' AS kind, id, d::INTEGER AS factor_id, round(v, 6) AS value FROM u{last} UNION ALL
  SELECT 'feature', id, d::INTEGER, round(v, 6) FROM f{last})""")
    return ",\n".join(ctes)
