"""Factor training in strata: blocks of users and items meet in rotation.

Users and items are hashed into B blocks. In round r of an epoch, user block b meets item block
(b + r) mod B, so B cells train at once and no two share a user or an item: a cell hands its
parameters back instead of changes to be averaged, and every parameter moves once per round whatever
B is. After B rounds each sample has been met once; then items are dealt into other blocks. Features
that items of several blocks share are the exception: cells return changes of them, and the mean by
use is taken.

B never falls below ``blocks`` and grows with users, items and samples, so a cell stays small and the
method is the same at every size. Negatives come from the cell's items through
``sampling.draws``, counter-based draws that SQL can repeat.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.functions.hashing import hash32, uniform
from rankweave.operators import sampling
from rankweave.session import cell_partitions, even_labels, fresh_path, write_and_read

LOSSES = ("bpr", "logistic", "warp", "squared")
USER, FEATURE, LINK, SAMPLE, LOSS = range(5)

_STATE = "kind int, id long, vec array<double>, bias double, g2 double, uses double, loss double"
_ROWS = ["cell", "kind", "a", "b", "value", "vec", "bias", "g2"]
_EPS = 1e-6
REDRAWS = 8


@dataclass(frozen=True)
class RotationSettings:
    """``rounds`` epochs of ``passes`` passes over each cell's samples, ``batch`` samples to a step.

    ``learning_rate`` is scaled by the gradients so far (Adagrad), or used as it is for ``squared``, whose
    estimate is ``offset`` plus biases (if ``biased``) plus the product. ``spread`` is the width of the
    uniform start values, 1 / sqrt(factors) unless given. ``tolerance`` ends training when an epoch
    lowers the mean loss by less than that share.
    """

    loss: str = "bpr"
    factors: int = 100
    rounds: int = 5
    passes: int = 2
    learning_rate: float = 0.05
    user_reg: float = 5e-4
    item_reg: float = 5e-4
    user_bias_reg: float | None = None
    item_bias_reg: float | None = None
    negatives: int = 3
    max_sampled: int = 10
    verify_negatives: bool = True
    batch: int = 512
    seed: int = 42
    blocks: int = 8
    users_per_block: int | None = None
    items_per_block: int | None = None
    samples_per_cell: int = 1 << 21
    tolerance: float = 0.0
    spread: float | None = None
    offset: float = 0.0
    biased: bool = True

    @property
    def tries(self) -> int:
        """Draws per sample and pass."""
        if self.loss == "squared":
            return 1
        if self.loss == "warp":
            return self.max_sampled
        return self.negatives + (REDRAWS if self.verify_negatives else 0)

    @property
    def first_tries(self) -> int:
        """Draws made for every sample; few samples need one of the others, which are made when they do."""
        return min(self.tries, 2 if self.loss == "warp" else max(1, self.negatives))


class Cell:
    """Parameters and samples of one cell as arrays."""

    def __init__(self, rows: pa.Table, settings: RotationSettings, n_items: int, epoch: int = 0):
        self.s, self.n_items, self.epoch = settings, n_items, epoch
        kind, a, b = (rows[c].to_numpy() for c in ("kind", "a", "b"))

        def sorted_rows(wanted: int) -> np.ndarray:
            at = np.flatnonzero(kind == wanted)
            return at[np.lexsort((b[at], a[at]))]

        users, features, links, samples = (sorted_rows(k) for k in (USER, FEATURE, LINK, SAMPLE))
        self.user_ids, self.feature_ids = a[users], a[features]
        self.state = {USER: self._load(rows, users), FEATURE: self._load(rows, features)}
        self.uses = {USER: np.zeros(len(users)), FEATURE: np.zeros(len(features))}
        self.one_link = not len(links)  # items are their own features
        self.start = {} if self.one_link else {FEATURE: tuple(x.copy() for x in self.state[FEATURE])}
        if self.one_link:
            self.item_ids = self.feature_ids
            self.link_feature, self.link_value = np.arange(len(features)), np.ones(len(features))
        else:
            self.item_ids, starts = np.unique(a[links], return_index=True)
            self.link_start = np.append(starts, len(links))
            self.link_feature = np.searchsorted(self.feature_ids, b[links])
            self.link_value = rows["value"].to_numpy()[links]
            sizes = np.diff(self.link_start)
            self.link_size = int(sizes[0]) if (sizes == sizes[0]).all() else 0  # of every item, where all have as many
        self.user, self.item = np.searchsorted(self.user_ids, a[samples]), np.searchsorted(self.item_ids, b[samples])
        self.target = rows["value"].to_numpy()[samples]
        flat = rows["vec"].take(pa.array(samples)).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        self.draws = flat.astype(np.int64).reshape(len(samples), -1)
        self.pair, self.later = (a[samples], b[samples]), {}
        self.keys = np.sort(self.user * max(1, len(self.item_ids)) + self.item)
        self.loss, self.count = 0.0, 0.0

    @staticmethod
    def _load(rows: pa.Table, at: np.ndarray):
        picked = rows.select(["vec", "bias", "g2"]).take(pa.array(at))
        flat = picked["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        width = len(flat) // len(at) if len(at) else 0
        return flat.reshape(len(at), width).copy(), picked["bias"].to_numpy().copy(), picked["g2"].to_numpy().copy()

    def _later_draws(self, at: np.ndarray) -> np.ndarray:
        """The tries that were not sent with the samples: ``sampling.draws`` for single rows."""
        for k in at.tolist():
            if k not in self.later:
                head = "-".join(str(int(x)) for x in (self.s.seed, self.epoch, self.pair[0][k], self.pair[1][k]) if x == x)
                self.later[k] = [
                    int(hashlib.md5(f"{head}-{t}".encode()).hexdigest()[:8], 16) for t in range(self.draws.shape[1], self.s.tries)
                ]
        return np.array([self.later[k] for k in at.tolist()], np.int64).reshape(len(at), -1)

    def drawn(self, at: np.ndarray, turn: int, later: bool = False) -> np.ndarray:
        """Items drawn for samples, a row each: by the tries sent with them, or by those after. Later passes derive theirs."""
        draws = self._later_draws(at) if later else self.draws[at]
        if turn:
            draws = (draws * 2654435761 + turn * 40503) % 2**32
        return draws % len(self.item_ids)

    def is_positive(self, users: np.ndarray, items: np.ndarray) -> np.ndarray:
        wanted = users * len(self.item_ids) + items
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return self.keys[at] == wanted

    def negatives(self, at: np.ndarray, turn: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sample, try, item): the first draws that are no positives of the user, ``negatives`` at most."""
        drawn = self.drawn(at, turn)
        if not self.s.verify_negatives:
            row, column = np.nonzero(np.ones(drawn.shape, bool))
            return at[row], column, drawn[row, column]
        fresh = lambda of, items: ~self.is_positive(np.repeat(self.user[of], items.shape[1]), items.ravel()).reshape(items.shape)
        good = fresh(at, drawn)
        short = np.flatnonzero(~good.all(axis=1))
        if len(short) and self.s.tries > drawn.shape[1]:
            more = self.drawn(at[short], turn, later=True)
            width = drawn.shape[1]
            drawn = np.hstack([drawn, np.zeros((len(at), more.shape[1]), drawn.dtype)])
            good = np.hstack([good, np.zeros((len(at), more.shape[1]), bool)])
            drawn[short, width:], good[short, width:] = more, fresh(at[short], more)
        good &= np.cumsum(good, axis=1) <= self.s.negatives
        row, column = np.nonzero(good)
        return at[row], column, drawn[row, column]

    def represent(self, items: np.ndarray):
        """Item vectors and biases: the weighted sums over the items' features."""
        vec, bias, _ = self.state[FEATURE]
        if self.one_link:
            return np.take(vec, items, axis=0), bias[items]
        _, first, feature, value = self._links(items)
        if self.link_size:
            shape = len(items), self.link_size
            parts, biases = np.take(vec, feature, axis=0) * value[:, None], (bias[feature] * value).reshape(shape)
            parts = parts.reshape(*shape, vec.shape[1])
            total, total_bias = parts[:, 0].copy(), biases[:, 0].copy()
            for k in range(1, self.link_size):
                total += parts[:, k]
                total_bias += biases[:, k]
            return total, total_bias
        return np.add.reduceat(vec[feature] * value[:, None], first, axis=0), np.add.reduceat(bias[feature] * value, first)

    def _links(self, items: np.ndarray):
        if self.link_size:
            n = self.link_size
            at = (self.link_start[items][:, None] + np.arange(n)).ravel()
            return np.repeat(np.arange(len(items)), n), np.arange(0, n * len(items), n), self.link_feature[at], self.link_value[at]
        sizes = self.link_start[items + 1] - self.link_start[items]
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(items)), sizes)
        at = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes) + np.repeat(self.link_start[items], sizes)
        return owner, ends - sizes, self.link_feature[at], self.link_value[at]

    def _once_each(self, items: np.ndarray):
        """Vectors and biases of items that follow each other in runs, each run's represented once."""
        if self.one_link:
            return self.represent(items)
        new = np.concatenate([[True], items[1:] != items[:-1]])
        vec, bias = self.represent(items[new])
        run = np.cumsum(new) - 1
        return np.take(vec, run, axis=0), bias[run]

    def _push(self, items: np.ndarray, grad: np.ndarray, bias_grad: np.ndarray):
        if self.one_link:
            return items, grad, bias_grad
        owner, _, feature, value = self._links(items)
        return feature, np.take(grad, owner, axis=0) * value[:, None], bias_grad[owner] * value

    def scores(self, users: np.ndarray, mine: np.ndarray, vec: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """Scores of users, whose vectors are ``mine``, and of as many items."""
        return np.einsum("ij,ij->i", mine, vec) + bias + self.state[USER][1][users]

    def step(self, kind: int, ids: np.ndarray, grad: np.ndarray, bias_grad: np.ndarray, reg: float, bias_reg: float):
        """One step along the batch's gradients, summed per row, each use less its penalty."""
        vec, bias, g2 = self.state[kind]
        order = np.argsort(ids.astype(np.uint16) if len(vec) <= 1 << 16 else ids, kind="stable")  # short keys sort by radix
        ordered = ids[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        rows, counts = ordered[first], np.diff(np.append(first, len(ids)))
        g = np.add.reduceat(np.take(grad, order, axis=0), first, axis=0) - reg * counts[:, None] * vec[rows]
        gb = np.add.reduceat(bias_grad[order], first) - bias_reg * counts * bias[rows]
        rate = np.full(len(rows), self.s.learning_rate)
        if self.s.loss != "squared":
            g2[rows] += ((g * g).sum(axis=1) + gb * gb) / vec.shape[1]
            rate /= np.sqrt(g2[rows] + _EPS)
        vec[rows] += rate[:, None] * g
        bias[rows] += rate * gb
        self.uses[kind][rows] += counts

    def train(self) -> None:
        if not len(self.user) or len(self.item_ids) < (1 if self.s.loss == "squared" else 2):
            return
        order = np.argsort(self.draws[:, 0], kind="stable")
        for turn in range(self.s.passes):
            self.loss, self.count = 0.0, float(len(order))
            for at in range(0, len(order), self.s.batch):
                self._batch(order[at : at + self.s.batch], turn)

    def _batch(self, at: np.ndarray, turn: int) -> None:
        """Pull each user towards an item by ``pull``, away from another by ``push``."""
        s = self.s
        if s.loss == "squared":
            users, items = self.user[at], self.item[at]
            vec, bias = self.represent(items)
            p, bu, _ = self.state[USER]
            error = self.target[at] - s.offset - bu[users] - bias - np.einsum("ij,ij->i", p[users], vec)
            self.loss += (error * error).sum()
            f, g, b = self._push(items, error[:, None] * p[users], error * s.biased)
            self.step(USER, users, error[:, None] * vec, error * s.biased, s.user_reg, self._bias_reg(USER))
            self.step(FEATURE, f, g, b, s.item_reg, self._bias_reg(FEATURE))
            return
        if s.loss == "warp":
            users, items, others, pull, push, p, vi, vj = self._violations(at, turn)
        else:
            chosen, _, others = self.negatives(at, turn)
            users, items = self.user[chosen], self.item[chosen]
            if not len(users):
                return
            p = np.take(self.state[USER][0], users, axis=0)
            (vi, bi), (vj, bj) = self._once_each(items), self.represent(others)
            own, rival = self.scores(users, p, vi, bi), self.scores(users, p, vj, bj)
            if s.loss == "bpr":
                pull = push = 1.0 / (1.0 + np.exp(np.clip(own - rival, -30, 30)))
                self.loss -= np.log(1.0 - pull + 1e-12).sum()
            else:
                yes, no = (1.0 / (1.0 + np.exp(-np.clip(x, -30, 30))) for x in (own, rival))
                # A positive is repeated once per negative, so its share is split.
                pull, push = (1.0 - yes) / s.negatives, no
                self.loss -= (np.log(yes + 1e-12) / s.negatives + np.log(1.0 - no + 1e-12)).sum()
        if not len(users):
            return
        f1, g1, b1 = self._push(items, pull[:, None] * p, pull)
        f2, g2, b2 = self._push(others, -push[:, None] * p, -push)
        self.step(USER, users, pull[:, None] * vi - push[:, None] * vj, pull - push, s.user_reg, self._bias_reg(USER))
        both = (np.concatenate(x) for x in ((f1, f2), (g1, g2), (b1, b2)))
        self.step(FEATURE, *both, s.item_reg, self._bias_reg(FEATURE))

    def _bias_reg(self, kind: int) -> float:
        own = self.s.user_bias_reg if kind == USER else self.s.item_bias_reg
        return own if own is not None else self.s.user_reg if kind == USER else self.s.item_reg

    def _violations(self, at: np.ndarray, turn: int):
        """Per positive, the first draw inside the margin, weighted by the rank its tries estimate.

        Tries are looked at in turn, each only for the positives that have found none so far.
        """
        users, items = self.user[at], self.item[at]
        p = self.state[USER][0][users]
        vi, bi = self.represent(items)
        own = self.scores(users, p, vi, bi)
        tries, others, rivals = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.zeros(len(at))
        vj, left = np.zeros_like(vi), np.arange(len(at))
        for t in range(self.s.tries):
            later = t - self.draws.shape[1]
            drawn = self.drawn(at[left], turn, later >= 0)[:, later if later >= 0 else t]
            vec, bias = self.represent(drawn)
            rival = self.scores(users[left], p[left], vec, bias)
            bad = (rival > own[left] - 1.0) & ~self.is_positive(users[left], drawn)
            found = left[bad]
            tries[found], others[found], rivals[found], vj[found] = t + 1, drawn[bad], rival[bad], vec[bad]
            left = left[~bad]
            if not len(left):
                break
        hit = tries > 0
        weight = np.log(np.maximum(1.0, (self.n_items - 1) // np.maximum(tries, 1)))[hit]
        self.loss += (weight * (1.0 - own + rivals)[hit]).sum()
        return users[hit], items[hit], others[hit], weight, weight, p[hit], vi[hit], vj[hit]

    def result(self) -> pa.Table:
        """The new parameters; shared features as changes, where they were used."""
        parts = [_state_rows(USER, self.user_ids, *self.state[USER], self.uses[USER])]
        if self.one_link:
            parts.append(_state_rows(FEATURE, self.feature_ids, *self.state[FEATURE], self.uses[FEATURE]))
        else:
            used = self.uses[FEATURE] > 0
            moved = [now[used] - old[used] for now, old in zip(self.state[FEATURE], self.start[FEATURE])]
            parts.append(_state_rows(FEATURE, self.feature_ids[used], *moved, self.uses[FEATURE][used]))
        return pa.concat_tables(parts)


def _state_rows(kind, ids, vec, bias, g2, uses, loss=0.0) -> pa.Table:
    n = len(ids)
    offsets = np.arange(n + 1, dtype=np.int32) * vec.shape[1]
    return pa.table({
        "kind": pa.array(np.full(n, kind, dtype=np.int32)), "id": pa.array(ids, pa.int64()),
        "vec": pa.ListArray.from_arrays(pa.array(offsets), pa.array(vec.ravel())),
        "bias": pa.array(bias), "g2": pa.array(g2), "uses": pa.array(uses),
        "loss": pa.array(np.full(n, loss, dtype=np.float64)),
    })


def initial_state(ids: DataFrame, kind: int, settings: RotationSettings) -> DataFrame:
    """Small start values by a hash of seed, kind, id and place: the same on any cluster and in SQL."""
    spread = settings.spread if settings.spread is not None else 1.0 / math.sqrt(settings.factors)
    vec = F.transform(
        F.sequence(F.lit(1), F.lit(settings.factors)),
        lambda d: (uniform(settings.seed, kind, "id", d) - 0.5) * spread,
    )
    zero = F.lit(0.0)
    return ids.select(
        F.lit(kind).alias("kind"), "id", vec.alias("vec"), zero.alias("bias"), zero.alias("g2"), zero.alias("uses"), zero.alias("loss")
    )


def block_of(settings: RotationSettings, epoch: int, kind: int, column: str, blocks: int) -> Column:
    """Users keep their block, items get another every epoch."""
    salt = ("user",) if kind == USER else ("item", epoch)
    return (hash32(settings.seed, *map(F.lit, salt), column) % F.lit(blocks)).cast("int")


def count_blocks(n_users: int, n_items: int, n_samples: int, s: RotationSettings) -> int:
    # Every round moves the whole state: 64 MB of factors a block, 128 MB of narrow ones, so that rounds are few.
    most = max(65536, (128 << 20) // (8 * 16) if s.factors <= 16 else min(1 << 18, (64 << 20) // (8 * s.factors)))
    return max(
        s.blocks, math.ceil(n_users / (s.users_per_block or most)), math.ceil(n_items / (s.items_per_block or most)),
        math.ceil(math.sqrt(n_samples / s.samples_per_cell)),
    )


def deal(samples: DataFrame, s: RotationSettings, epoch: int, blocks: int) -> DataFrame:
    """Samples with their cell and the round (turn) in which they are met; draws are made in the cells."""
    placed = samples.withColumn("cell", block_of(s, epoch, USER, "user_id", blocks)).withColumn(
        "turn", F.pmod(block_of(s, epoch, FEATURE, "item_id", blocks) - F.col("cell"), F.lit(blocks)).cast("int")
    )
    return placed.select(
        "cell", F.lit(SAMPLE).alias("kind"), F.col("user_id").alias("a"), F.col("item_id").alias("b"), F.col("value"),
        F.lit(None).cast("array<double>").alias("vec"), F.lit(0.0).alias("bias"), F.lit(0.0).alias("g2"), "turn",
    )


LABELLED = 1024  # cells up to this number get a task each
CHAINED = 8  # rounds up to this number run in one job, from shuffle to shuffle, before the state is written


def _cells(rows: DataFrame, s: RotationSettings, epoch: int, blocks: int, labels: list[int], work, schema: str) -> DataFrame:
    """Cells are few and costly: each gets a task of its own, or they are spread over more tasks than cells.

    Samples get their draws where they are used, so that draws are neither stored nor sent.
    """
    if len(labels) == blocks:
        named, spread = F.element_at(F.array(*map(F.lit, labels)), F.col("cell") + 1), blocks
    else:
        named, spread = F.col("cell"), cell_partitions(rows.sparkSession, blocks)
    draws = sampling.draws(s.seed, epoch, s.first_tries, pair=("a", "b")).cast("array<double>")
    met = rows.withColumn("label", named).repartition(spread, "label")
    met = met.withColumn("vec", F.when(F.col("kind") == SAMPLE, draws).otherwise(F.col("vec")))
    return met.groupBy("label").applyInArrow(work, schema)


def _state_in_cells(state: DataFrame, s: RotationSettings, epoch: int, turn: int, blocks: int) -> DataFrame:
    at_user = block_of(s, epoch, USER, "id", blocks)
    at_item = F.pmod(block_of(s, epoch, FEATURE, "id", blocks) - F.lit(turn), F.lit(blocks)).cast("int")
    cell = F.when(F.col("kind") == USER, at_user).when(F.col("kind") == FEATURE, at_item)
    return state.select(
        F.coalesce(cell, F.col("id").cast("int")).alias("cell"), "kind", F.col("id").alias("a"),
        F.lit(0).cast("long").alias("b"), F.col("loss").alias("value"), "vec", "bias",
        F.when(F.col("kind") == LOSS, F.col("uses")).otherwise(F.col("g2")).alias("g2"),
    )


class Rotation:
    """One training run: its samples, state and schedule.

    ``samples(user_id, item_id, value)``, distinct pairs; ``links(item_id, feature_id, value)`` or None where every
    item of ``items(item_id)`` is its own feature. State alternates between two folders below
    ``home``; up to ``CHAINED`` rounds follow each other from shuffle to shuffle between two written tables.
    """

    def __init__(
        self, samples: DataFrame, items: DataFrame, settings: RotationSettings, links: DataFrame | None = None, home: str | None = None
    ):
        if settings.loss not in LOSSES:
            raise ValueError(f"loss must be one of {LOSSES}")
        spark = samples.sparkSession
        self.s, self.home = settings, home or fresh_path(spark, f"rotation-{settings.loss}")
        self.samples = write_and_read(samples.select("user_id", "item_id", "value"), f"{self.home}/samples")
        self.links = None if links is None else write_and_read(links.select("item_id", "feature_id", "value"), f"{self.home}/links")
        features = (
            items.select(F.col("item_id").alias("id")) if self.links is None else self.links.select(F.col("feature_id").alias("id"))
        ).distinct()
        users = self.samples.select(F.col("user_id").alias("id")).distinct()
        start = initial_state(users, USER, settings).unionByName(initial_state(features, FEATURE, settings))
        self.state = write_and_read(start, f"{self.home}/state-0")
        sizes = dict(self.state.groupBy("kind").count().collect())
        self.n_items = sizes.get(FEATURE, 0) if self.links is None else self.links.select("item_id").distinct().count()
        self.blocks = count_blocks(sizes.get(USER, 0), self.n_items, self.samples.count(), settings)
        self.labels = even_labels(spark, self.blocks) if self.blocks <= LABELLED else []
        self.epoch = self.written = self.unwritten = 0
        self.placed: tuple[int, DataFrame, DataFrame] | None = None
        self.losses: list[float] = []

    def dealt(self) -> DataFrame:
        """The epoch's samples, stored by turn so that a round reads only its own."""
        folder = f"{self.home}/dealt-{self.epoch % 2}"
        rows = deal(self.samples, self.s, self.epoch, self.blocks)
        rows.write.mode("overwrite").partitionBy("turn").parquet(folder)
        return self.samples.sparkSession.read.schema(rows.schema).parquet(folder)

    def _store(self, df: DataFrame) -> DataFrame:
        self.written += 1
        return write_and_read(df, f"{self.home}/state-{self.written % 2}")

    def round(self, dealt: DataFrame, turn: int) -> None:
        """Train the cells (b, (b + turn) mod B); the next state is stored after some rounds, shared features after each."""
        s, n_items, epoch = self.s, self.n_items, self.epoch
        own = self.state if self.links is None else self.state.filter(F.col("kind") != FEATURE)
        rows = _state_in_cells(own, s, self.epoch, turn, self.blocks)
        rows = rows.unionByName(dealt.filter(F.col("turn") == turn).drop("turn").select(_ROWS))
        if self.links is not None:
            rows = rows.unionByName(self._linked(turn))

        def work(rows: pa.Table) -> pa.Table:
            cell = Cell(rows, s, n_items, epoch)
            cell.train()
            kept = np.flatnonzero(rows["kind"].to_numpy() == LOSS)
            loss = cell.loss + rows["value"].to_numpy()[kept].sum()
            count = cell.count + rows["g2"].to_numpy()[kept].sum()
            one, none = np.zeros(1), np.zeros((1, 0))
            block = np.array([rows["cell"][0].as_py()])
            return pa.concat_tables([cell.result(), _state_rows(LOSS, block, none, one, one, np.array([count]), loss)])

        trained = _cells(rows, s, self.epoch, self.blocks, self.labels, work, _STATE)
        if self.links is None:
            self.state, self.unwritten = trained, self.unwritten + 1
            if self.unwritten == CHAINED:
                self._settle()
            return
        changes = write_and_read(trained, f"{self.home}/changes-{self.written % 2}")
        share = F.col("uses")
        moved = (
            changes.filter(F.col("kind") == FEATURE).select("id", "uses", "bias", "g2", F.posexplode("vec").alias("d", "x"))
            .groupBy("id", "d").agg(*[(F.sum(F.col(c) * share) / F.sum(share)).alias(c) for c in ("x", "bias", "g2")])
            .groupBy("id").agg(
                F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda e: e["x"]).alias("dv"),
                F.max("bias").alias("db"), F.max("g2").alias("dg"),
            )
        )
        features = self.state.filter(F.col("kind") == FEATURE).join(moved, "id", "left").select(
            "kind", "id",
            F.when(F.col("dv").isNull(), F.col("vec")).otherwise(F.zip_with("vec", "dv", lambda x, y: x + y)).alias("vec"),
            (F.col("bias") + F.coalesce("db", F.lit(0.0))).alias("bias"),
            (F.col("g2") + F.coalesce("dg", F.lit(0.0))).alias("g2"), "uses", "loss",
        )
        self.state = self._store(changes.filter(F.col("kind") != FEATURE).unionByName(features))

    def _settle(self) -> None:
        """Store the state that the last rounds lead to."""
        if self.unwritten:
            self.state, self.unwritten = self._store(self.state), 0

    def _linked(self, turn: int) -> DataFrame:
        """The item blocks' links, and the features that they use, in their cells; their blocks are stored once an epoch."""
        zero, none = F.lit(0.0), F.array().cast("array<double>").alias("vec")
        if self.placed is None or self.placed[0] != self.epoch:
            folder = f"{self.home}/placed-{self.epoch % 2}"
            block = block_of(self.s, self.epoch, FEATURE, "item_id", self.blocks)
            links = write_and_read(self.links.withColumn("block", block), f"{folder}/links")
            needed = links.select("block", F.col("feature_id").alias("id")).distinct()
            self.placed = self.epoch, links, write_and_read(needed, f"{folder}/needed")
        _, links, needed = self.placed
        cell = F.pmod(F.col("block") - F.lit(turn), F.lit(self.blocks)).cast("int").alias("cell")
        features = self.state.filter(F.col("kind") == FEATURE).join(needed, "id").select(
            cell, "kind", F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), zero.alias("value"), "vec", "bias", "g2"
        )
        links = links.select(
            cell, F.lit(LINK).alias("kind"), F.col("item_id").alias("a"), F.col("feature_id").alias("b"), "value", none,
            zero.alias("bias"), zero.alias("g2"),
        )
        return features.select(_ROWS).unionByName(links.select(_ROWS))

    def run_epoch(self) -> float:
        """All B rounds; the mean loss of the epoch's samples."""
        dealt = self.dealt()
        for turn in range(self.blocks):
            self.round(dealt, turn)
        self._settle()
        total = self.state.filter(F.col("kind") == LOSS).agg(F.sum("loss"), F.sum("uses")).first()
        self.losses.append((total[0] or 0.0) / max(total[1] or 1.0, 1.0))
        self.state = self.state.filter(F.col("kind") != LOSS)
        self.epoch += 1
        return self.losses[-1]

    def run(self) -> None:
        for _ in range(self.s.rounds):
            self.run_epoch()
            before = self.losses[-2:-1]
            if before and self.s.tolerance and before[0] - self.losses[-1] < self.s.tolerance * abs(before[0]):
                break

    def negatives(self) -> DataFrame:
        """(user_id, item_id, draw, negative_id): what the next epoch's first pass trains with, for every sample."""
        s, n_items, blocks, epoch = self.s, self.n_items, self.blocks, self.epoch
        samples = deal(self.samples, s, self.epoch, blocks).withColumn("cell", F.col("cell") + F.col("turn") * blocks)
        # A cell needs its items' ids; its users are those of its samples.
        zero, none = F.lit(0.0), F.array().cast("array<double>").alias("vec")
        placed = self.state.filter(F.col("kind") == FEATURE).select(
            "kind", "id", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("turn"),
            block_of(s, self.epoch, FEATURE, "id", blocks).alias("block"),
        )
        cell = (F.pmod(F.col("block") - F.col("turn"), F.lit(blocks)) + F.col("turn") * blocks).cast("int").alias("cell")
        items = placed.select(
            cell, "kind", F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), zero.alias("value"), none,
            zero.alias("bias"), zero.alias("g2"),
        )
        rows = items.select(_ROWS).unionByName(samples.select(_ROWS))

        def work(rows: pa.Table) -> pa.Table:
            kind = rows["kind"].to_numpy()
            of_samples = np.flatnonzero(kind == SAMPLE)
            _, first = np.unique(rows["a"].to_numpy()[of_samples], return_index=True)
            users = rows.take(pa.array(of_samples[first]))
            users = users.set_column(users.schema.get_field_index("kind"), rows.schema.field("kind"), pa.array(np.full(len(first), USER, np.int32)))
            cell = Cell(pa.concat_tables([rows, users]), s, n_items, epoch)
            chosen, tries, others = cell.negatives(np.arange(len(cell.user))) if len(cell.item_ids) else (np.zeros(0, np.int64),) * 3
            return pa.table({
                "user_id": cell.user_ids[cell.user[chosen]], "item_id": cell.item_ids[cell.item[chosen]],
                "draw": pa.array(tries, pa.int32()), "negative_id": cell.item_ids[others],
            })

        return _cells(rows, s, self.epoch, self.blocks * self.blocks, [], work, "user_id long, item_id long, draw int, negative_id long")

    def users(self) -> DataFrame:
        return self._parameters(USER, "user_id")

    def features(self) -> DataFrame:
        return self._parameters(FEATURE, "feature_id")

    def _parameters(self, kind: int, name: str) -> DataFrame:
        return self.state.filter(F.col("kind") == kind).select(F.col("id").alias(name), F.col("vec").alias("factors"), "bias")
