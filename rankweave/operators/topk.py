"""Top-N lists over a whole catalogue without forming the user x item product as rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.operators.ordering import sort_rank
from rankweave.operators.scoring import rank_scores
from rankweave.session import cell_partitions, cut_lineage

# A block of users or items has at most so many rows and bytes of factors; blocks are cut finer, down to
# the least block, while there are fewer cells than CELLS. Each side is copied once per block of the other, so
# large blocks keep the shuffle small.
LEAST_BLOCK, LARGEST_BLOCK, BLOCK_BYTES, CELLS = 1024, 1 << 20, 128 << 20, 64
# Bytes of a row besides its factors, and of an entry of a block's list.
ROW_BYTES, ENTRY_BYTES = 24, 24
# Ranks up to this one are looked up in a broadcast head of the ranking, later ones by shuffle.
HEAD_RANKS = 100_000
_USERS_AT_ONCE, _ITEMS_AT_ONCE = 128, 2048
# Factors up to this size are scored in floats first; only what may enter a list is scored in doubles.
_FLOAT_SAFE = 1e15
_SCORE_SCHEMA = "user_id long, item_id long, score double"
_NO_SCORES = pa.table({
    "user_id": pa.array([], pa.int64()), "item_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64()),
})


def _grid(
    n_users: int, n_items: int, width: int, users_per_block: int | None, items_per_block: int | None, listed: int = 0,
    item_bytes: int = 8,
) -> tuple[int, int]:
    """Numbers of user and item blocks: those that send the least, of copies of both sides and of lists of ``listed`` entries."""
    largest = max(LEAST_BLOCK, min(LARGEST_BLOCK, BLOCK_BYTES // (8 * max(1, width))))
    blocks = lambda rows, size: max(1, math.ceil(rows / size))
    least = blocks(n_items, items_per_block or largest)
    most = least if items_per_block or users_per_block else max(least, min(CELLS, blocks(n_items, LEAST_BLOCK)))
    a_user, an_item = 8 * width + ROW_BYTES + ENTRY_BYTES * listed, item_bytes * width + ROW_BYTES

    def users(item_blocks: int) -> int:
        if users_per_block:
            return blocks(n_users, users_per_block)
        return max(blocks(n_users, largest), min(blocks(n_users, LEAST_BLOCK), math.ceil(CELLS / item_blocks)))

    grids = [(users(item_blocks), item_blocks) for item_blocks in range(least, most + 1)]
    # Few cells keep cores idle, whatever they send.
    enough = min(CELLS, max(u * i for u, i in grids))
    return min((g for g in grids if g[0] * g[1] >= enough), key=lambda g: n_users * a_user * g[1] + n_items * an_item * g[0])


def _block(column: str, blocks: int):
    return F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(len(column), -1).astype(np.float64)


def _by_id(rows: pa.Table, column: str) -> pa.Table:
    return rows.take(pc.sort_indices(rows, [(column, "ascending")], null_placement="at_start"))


def _places(ids: pa.ChunkedArray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each wanted id among sorted ids, and how often it stands there."""
    known = ids.drop_null().to_numpy()
    first = np.searchsorted(known, wanted, side="left")
    return first + ids.null_count, np.searchsorted(known, wanted, side="right") - first


def _seen_places(users: pa.Table, items: pa.Table, seen: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(user, item) places of the pairs seen, by user; ``users`` and ``items`` are sorted by id."""
    u, u_times = _places(users["user_id"], seen["user_id"].to_numpy())
    i, i_times = _places(items["item_id"], seen["item_id"].to_numpy())
    times = u_times * (i_times > 0)  # of an item's several rows the first is masked
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    u, i = np.repeat(u, times) + nth, np.repeat(i, times)
    order = np.argsort(u, kind="stable")
    return u[order], i[order]


class _Chunks:
    """A block's items in chunks of likeness: as many zeros, then by the mean user's score."""

    def __init__(self, p: np.ndarray, q: np.ndarray):
        self.order = np.lexsort((-(q @ p.mean(axis=0)), (q == 0).sum(axis=1)))
        self.q = q[self.order]
        self.starts = np.arange(0, len(q), _ITEMS_AT_ONCE)
        self.ends = np.append(self.starts[1:], len(q))
        self.least, self.most = np.minimum.reduceat(self.q, self.starts), np.maximum.reduceat(self.q, self.starts)
        self.longest = np.maximum.reduceat(np.sqrt((self.q * self.q).sum(axis=1)), self.starts)
        self.place = np.empty(len(q), np.int64)
        self.place[self.order] = np.arange(len(q))
        self.finite = bool(np.isfinite(p).all() and np.isfinite(q).all())
        small = self.finite and max(np.abs(p).max(initial=0.0), np.abs(q).max(initial=0.0)) < _FLOAT_SAFE
        self.rough = self.q.astype(np.float32) if small else self.q

    def doubt(self, length: np.ndarray, c: int) -> np.ndarray:
        """More than a rough score can be off: rounding of both sides, and of a sum of products."""
        if self.rough is self.q:
            return np.zeros(len(length))
        return (self.q.shape[1] + 8) * 2.0**-23 * length * self.longest[c]

    def bounds(self, p: np.ndarray, columns: slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score a user can have in a chunk, (users, chunks): by each factor's range."""
        up, down = np.maximum(p, 0)[:, columns], np.minimum(p, 0)[:, columns]
        least, most = self.least[:, columns].T, self.most[:, columns].T
        return up @ least + down @ most, up @ most + down @ least

    def seen(self, owner: np.ndarray, item: np.ndarray, start: int, stop: int):
        """Those of users ``start`` to ``stop``: by place, with each chunk's part."""
        part = slice(np.searchsorted(owner, start), np.searchsorted(owner, stop))
        place = self.place[item[part]]
        order = np.argsort(place, kind="stable")
        own, place = owner[part][order] - start, place[order]
        cuts = np.searchsorted(place, np.append(self.starts, len(self.order)))
        return [(own[a:b], place[a:b] - s) for a, b, s in zip(cuts, cuts[1:], self.starts)]


def _slack(x: np.ndarray) -> np.ndarray:
    """More than rounding to 9 places or the order of a sum can move a score."""
    return 2e-9 + 1e-12 * np.abs(np.where(np.isfinite(x), x, 0.0))


def _above(scores: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of the scores that reach their row's least, in order; few do, so eight are looked at at once."""
    if scores.dtype == np.float32:  # a bound between two floats must not be rounded up
        least = np.nextafter(least.astype(np.float32), np.float32(-np.inf))
    reach = (scores >= least[:, None]).ravel()
    whole = len(reach) // 8 * 8
    eights = np.flatnonzero(reach[:whole].view(np.uint64))
    flat = (eights[:, None] * 8 + np.arange(8)).ravel()
    flat = np.concatenate([flat[reach[flat]], whole + np.flatnonzero(reach[whole:])])
    return np.divmod(flat, scores.shape[1])


def _products(p: np.ndarray, q: np.ndarray, row: np.ndarray, column: np.ndarray, rough: np.ndarray, clip) -> np.ndarray:
    """The scores in doubles of the pairs picked; masked ones stay out."""
    out, step = np.empty(len(row)), 1 << 16
    for at in range(0, len(row), step):
        pick = slice(at, at + step)
        out[pick] = np.einsum("ij,ij->i", p[row[pick]], q[column[pick]])
    if clip is not None:
        np.clip(out, *clip, out=out)
    out[np.isneginf(rough)] = -np.inf
    return out


def _score_block(users: pa.Table, items: pa.Table, seen: pa.Table, n: int, clip) -> Iterator[pa.Table]:
    """Every user's best ``n`` unseen items of the block.

    Chunks whose bound is below a user's n-th score so far are left out for that user: nothing in them can enter the list.
    """
    users, items = _by_id(users, "user_id"), _by_id(items, "item_id")
    # Behind the factors: the user bias times 1, and 1 times the item bias.
    p = np.column_stack([_matrix(users["factors"]), users["bias"].to_numpy(), np.ones(len(users))])
    q = np.column_stack([_matrix(items["factors"]), np.ones(len(items)), items["bias"].to_numpy()])
    owner, item = _seen_places(users, items, seen)
    chunks = _Chunks(p, q)
    room = np.empty(_USERS_AT_ONCE * _ITEMS_AT_ONCE, chunks.rough.dtype)
    for start in range(0, len(users), _USERS_AT_ONCE):
        stop = min(len(users), start + _USERS_AT_ONCE)
        own = p[start:stop]
        own_rough, length = own.astype(room.dtype, copy=False), np.sqrt((own * own).sum(axis=1))
        masked = chunks.seen(owner, item, start, stop)
        top = chunks.bounds(own)[1]
        top = np.minimum(top, length[:, None] * chunks.longest)
        if clip is not None:
            top = np.clip(top, *clip)
        top += _slack(top)
        score, rounded = np.full((stop - start, n), -np.inf), np.full((stop - start, n), -np.inf)
        place = np.full((stop - start, n), len(items), np.int64)
        for c in np.argsort(-np.nan_to_num(top).mean(axis=0), kind="stable"):
            # Lists are ordered by the score at 9 places, then by item.
            floor, last = rounded[:, -1], place[:, -1]
            live = np.flatnonzero(~(top[:, c] < floor))
            if not len(live):
                continue
            a, b = chunks.starts[c], chunks.ends[c]
            scores = np.matmul(own_rough[live], chunks.rough[a:b].T, out=room[: len(live) * (b - a)].reshape(len(live), b - a))
            if clip is not None:
                np.clip(scores, *clip, out=scores)
            if not chunks.finite:
                scores[~np.isfinite(scores)] = -np.inf
            if len(masked[c][0]):
                line = np.full(stop - start, -1)
                line[live] = np.arange(len(live))
                hidden, column = line[masked[c][0]], masked[c][1]
                scores[hidden[hidden >= 0], column[hidden >= 0]] = -np.inf
            doubt = chunks.doubt(length[live], c)
            least = floor[live] - _slack(floor[live])
            new = np.isneginf(least)
            if new.any():
                at = b - a - min(n, b - a)
                cut = np.partition(scores[new], at, axis=1)[:, at].astype(np.float64) - doubt[new]
                least[new] = cut - _slack(cut)
            row, column = _above(scores, least - doubt)
            if not len(row):
                continue
            value = scores[row, column]
            if chunks.rough is not chunks.q:
                value = _products(own, chunks.q, live[row], a + column, value, clip)
            row, where, near = live[row], chunks.order[a + column], np.round(value, 9)
            good = np.isfinite(value) & ((near > floor[row]) | ((near == floor[row]) & (where < last[row])))
            if not good.any():
                continue
            row, where, near, value = row[good], where[good], near[good], value[good]
            touched = np.unique(row)
            row = np.concatenate([np.repeat(touched, n), row])
            where = np.concatenate([place[touched].ravel(), where])
            near = np.concatenate([rounded[touched].ravel(), near])
            value = np.concatenate([score[touched].ravel(), value])
            order = np.lexsort((where, -near, row))
            pick = order[np.searchsorted(row[order], touched)[:, None] + np.arange(n)]
            score[touched], rounded[touched], place[touched] = value[pick], near[pick], where[pick]
        row, column = np.nonzero(rounded > -np.inf)
        yield pa.table({
            "user_id": users["user_id"].take(pa.array(start + row)), "item_id": items["item_id"].take(pa.array(place[row, column])),
            "score": score[row, column],
        })


def factor_topk(
    users: DataFrame,
    items: DataFrame,
    seen: DataFrame | None,
    n: int,
    candidates: DataFrame | None = None,
    use_bias: bool = False,
    clip: tuple[float, float] | None = None,
    users_per_block: int | None = None,
    items_per_block: int | None = None,
) -> DataFrame:
    """``(user_id, item_id, score, rank)``: the exact best ``n`` unseen items of every user.

    Users and items are hashed into blocks of bounded size. Every block of users meets every
    block of items once, in matrix products that emit only the block's best ``n`` per user; a
    last row number merges them. Seen items travel to the one block pair that scores them and
    are masked there, so a user who has seen much still gets a full list.
    """
    local = _local_lists(users, items, seen, n, candidates, use_bias, clip, users_per_block, items_per_block)
    return rank_scores(local, n)


def _local_lists(users, items, seen, n, candidates=None, use_bias=False, clip=None, users_per_block=None, items_per_block=None) -> DataFrame:
    """``(user_id, item_id, score)``: the best ``n`` of every block pair."""
    if candidates is not None:
        items = items.join(candidates.select("item_id").distinct(), "item_id", "left_semi")
    bias = F.col("bias") if use_bias else F.lit(0.0).alias("bias")

    def score(user_rows: pa.Table, item_rows: pa.Table, seen_rows: pa.Table) -> pa.Table:
        if not len(user_rows) or not len(item_rows):
            return _NO_SCORES
        return pa.concat_tables(_score_block(user_rows, item_rows, seen_rows, n, clip))

    return _every_block_pair(
        users.select("user_id", "factors", bias), items.select("item_id", "factors", bias), seen, score, _SCORE_SCHEMA,
        users_per_block, items_per_block, n,
    )


def _every_block_pair(
    users: DataFrame, items: DataFrame, seen: DataFrame | None, work, schema: str,
    users_per_block: int | None = None, items_per_block: int | None = None, listed: int = 0,
) -> DataFrame:
    """``work(users, items, seen pairs)`` for every block of users and block of items; floats travel as floats."""
    widest = items.agg(F.count("*"), F.max(F.size("factors"))).first()
    user_type, item_type = ("array<float>" if df.schema["factors"].dataType.simpleString() == "array<float>" else "array<double>" for df in (users, items))
    user_blocks, item_blocks = _grid(
        users.count(), widest[0], widest[1] or 0, users_per_block, items_per_block, listed, 4 if item_type == "array<float>" else 8
    )
    none = F.array().cast(user_type).alias("factors")
    each = lambda column, blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias(column)
    own = users.select(
        _block("user_id", user_blocks).alias("ub"), each("ib", item_blocks), "user_id", F.lit(None).cast("long").alias("item_id"),
        F.col("factors").cast(user_type).alias("factors"), F.col("bias").cast("double").alias("bias"), F.lit(False).alias("is_seen"),
    )
    if seen is not None:
        own = own.unionByName(seen.filter("user_id IS NOT NULL AND item_id IS NOT NULL").select(
            _block("user_id", user_blocks).alias("ub"), _block("item_id", item_blocks).alias("ib"), "user_id", "item_id",
            none, F.lit(0.0).alias("bias"), F.lit(True).alias("is_seen"),
        ))
    others = items.select(
        each("ub", user_blocks), _block("item_id", item_blocks).alias("ib"), "item_id", F.col("factors").cast(item_type).alias("factors"),
        F.col("bias").cast("double").alias("bias"),
    )

    def pair(own_rows: pa.Table, item_rows: pa.Table) -> pa.Table:
        is_seen = own_rows["is_seen"]
        return work(own_rows.filter(pc.invert(is_seen)), item_rows, own_rows.filter(is_seen))

    spread = cell_partitions(users.sparkSession, user_blocks * item_blocks)
    cells = lambda df: df.repartition(spread, "ub", "ib").groupBy("ub", "ib")
    return cells(own).cogroup(cells(others)).applyInArrow(pair, schema)


def _extremes_of_blocks(users: DataFrame, items: DataFrame, seen: DataFrame | None, split: int, **blocks) -> DataFrame:
    """Least and largest unseen score of every user and block of items in two models, whose factors stand one behind the other."""

    sides = (("first", slice(None, split)), ("second", slice(split, None)))

    def work(user_rows: pa.Table, item_rows: pa.Table, seen_rows: pa.Table) -> pa.Table:
        if not len(user_rows) or not len(item_rows):
            return _EXTREMES.empty_table()
        user_rows, item_rows = _by_id(user_rows, "user_id"), _by_id(item_rows, "item_id")
        p, q = _matrix(user_rows["factors"]), _matrix(item_rows["factors"])
        owner, item = _seen_places(user_rows, item_rows, seen_rows)
        chunks = _Chunks(p, q)
        found = {f"{end}_{name}": np.full(len(p), out) for name, _ in sides for end, out in (("lo", np.inf), ("hi", -np.inf))}
        for start in range(0, len(p), _USERS_AT_ONCE):
            stop = min(len(p), start + _USERS_AT_ONCE)
            own, masked = p[start:stop], chunks.seen(owner, item, start, stop)
            for name, side in sides:
                low, high = chunks.bounds(own, side)
                lo, hi = found[f"lo_{name}"][start:stop], found[f"hi_{name}"][start:stop]
                # Largest first, then least: what lies between both ends cannot move them.
                for c in dict.fromkeys(np.column_stack([np.argsort(-high.mean(axis=0)), np.argsort(low.mean(axis=0))]).ravel().tolist()):
                    live = np.flatnonzero(~((low[:, c] >= lo) & (high[:, c] <= hi)))
                    if not len(live):
                        continue
                    a, b = chunks.starts[c], chunks.ends[c]
                    scores = own[live, side] @ chunks.q[a:b, side].T
                    line = np.full(stop - start, -1)
                    line[live] = np.arange(len(live))
                    hidden, column = line[masked[c][0]], masked[c][1]
                    cell = hidden[hidden >= 0], column[hidden >= 0]
                    for into, pick, end, out in ((lo, np.minimum, np.min, np.inf), (hi, np.maximum, np.max, -np.inf)):
                        scores[cell] = out
                        into[live] = pick(into[live], end(scores, axis=1))
        return pa.table({"user_id": user_rows["user_id"], **found})

    return _every_block_pair(users, items, seen, work, _EXTREME_SCHEMA, **blocks)


def _extremes(each: DataFrame) -> DataFrame:
    names = ("first", "second")
    return each.groupBy("user_id").agg(
        *[F.min(f"lo_{c}").alias(f"lo_{c}") for c in names], *[F.max(f"hi_{c}").alias(f"hi_{c}") for c in names]
    )


_EXTREME_SCHEMA = "user_id long, lo_first double, hi_first double, lo_second double, hi_second double"
_EXTREMES = pa.schema([("user_id", pa.int64()), *[(f"{e}_{n}", pa.float64()) for e, n in (("lo", "first"), ("hi", "first"), ("lo", "second"), ("hi", "second"))]])


def blended_topk(
    first: tuple[DataFrame, DataFrame], second: tuple[DataFrame, DataFrame], users: DataFrame, seen: DataFrame | None, n: int,
    weights: tuple[float, float] = (0.5, 0.5), **blocks,
) -> DataFrame:
    """Exact weighted ensemble of two factor models over every unseen item of either.

    ``first`` and ``second`` are (users, items) with ``factors`` and ``bias``. A model scores the product plus biases, and 0.0
    where it lacks the user or the item. Scores are scaled to 0..1 by each user's least and largest over all unseen items; equal
    ones count 1. One pass over the blocks finds these bounds. Scaling only stretches a user's factors and adds a constant, so
    the blend is one factor model with both models' factors side by side, ranked by a second pass. Items that one model lacks
    are zero there: they meet the users' factors of the other model alone, in block pairs of their own.
    """
    sides = []
    for own, items in (first, second):
        widest = items.select(F.size("factors").alias("n")).first()
        sides.append((own, items, widest.n if widest else 0))
    # Behind the factors: 1 and the user bias, times the item bias and 1. Unknown ids are zero throughout.
    zeros = lambda width: F.array_repeat(F.lit(0.0), width + 2)
    doubles = F.col("factors").cast("array<double>")
    ids = first[1].select("item_id").unionByName(second[1].select("item_id")).distinct()
    people = users.select("user_id").distinct()
    for k, (own, items, width) in enumerate(sides):
        p = own.select("user_id", F.concat(doubles, F.array(F.lit(1.0), F.col("bias"))).alias(f"p{k}"))
        q = items.select("item_id", F.concat(doubles, F.array(F.col("bias"), F.lit(1.0))).alias(f"q{k}"))
        people = people.join(p, "user_id", "left").withColumn(f"p{k}", F.coalesce(f"p{k}", zeros(width)))
        ids = ids.join(q, "item_id", "left").withColumn(f"q{k}", F.coalesce(f"q{k}", zeros(width)))
    none = F.lit(0.0).alias("bias")
    people = cut_lineage(people)
    ids = cut_lineage(ids)
    split = sides[0][2] + 2
    # (items, the models that their factors and those of the users who meet them are of)
    has = [F.exists(f"q{k}", lambda x: x.isNull() | (x != 0)) for k in (0, 1)]
    apart = [(ids.filter(has[0] & has[1]), (0, 1)), (ids.filter(~has[1]), (0,)), (ids.filter(~has[0] & has[1]), (1,))]
    apart = [(x.select("item_id", F.concat(*[f"q{k}" for k in of]).alias("factors"), none), of) for x, of in apart]
    apart = [(items, of) for items, of in apart if not items.isEmpty()]
    each = None
    for items, of in apart:
        own = people.select("user_id", F.concat(*[f"p{k}" for k in of]).alias("factors"), none)
        found = _extremes_of_blocks(own, items, seen, split if 0 in of else 0, **blocks)
        each = found if each is None else each.unionByName(found)
    if each is None:
        return rank_scores(people.sparkSession.createDataFrame([], _SCORE_SCHEMA), n)
    bounds = _extremes(each)
    parts, constant = [], F.lit(0.0)
    for k, (name, weight) in enumerate(zip(("first", "second"), weights)):
        low, width = F.col(f"lo_{name}"), F.col(f"hi_{name}") - F.col(f"lo_{name}")
        stretch = F.when(width > 0, F.lit(float(weight)) / width).otherwise(F.lit(0.0))
        constant = constant + F.when(width > 0, -low * stretch).otherwise(F.lit(float(weight)))
        parts.append(_stretched(f"p{k}", stretch).alias(f"p{k}"))
    blended = cut_lineage(
        people.join(bounds.filter(F.col("hi_first") > float("-inf")), "user_id").select("user_id", *parts, constant.alias("bias"))
    )
    lists = None
    for items, of in apart:
        own = blended.select("user_id", F.concat(*[f"p{k}" for k in of]).alias("factors"), "bias")
        found = _local_lists(own, items, seen, n, use_bias=True, **blocks)
        lists = found if lists is None else lists.unionByName(found)
    return rank_scores(lists, n)


def _stretched(column: str, by: Column) -> Column:
    return F.transform(column, lambda x: x * by)


def shared_ranking_topk(
    item_scores: DataFrame, users: DataFrame, seen: DataFrame, n: int, block: int = 1024, head: int = HEAD_RANKS
) -> DataFrame:
    """Best ``n`` unseen items when every user shares one item ranking (popularity, item bias).

    With shared scores no pair needs scoring. A user's p-th unseen item stands at rank ``p``
    plus the number of seen items ahead of it, so it is enough to count, per user, how many seen
    items come after exactly d unseen ones (d < n). Counting goes through blocks of ranks: a
    user who has seen most of the catalogue is never sorted in one piece.
    """
    ranking = sort_rank(item_scores.select("item_id", "score"), [F.col("score").desc(), F.col("item_id")], "position")
    n_items = ranking.count()  # counts the stored ranking
    last = F.floor((F.col("position") - 1) / block)
    users = users.select("user_id").distinct()
    seen_ranks = (
        seen.select("user_id", "item_id").join(users, "user_id", "left_semi").distinct()
        .join(ranking.select("item_id", "position"), "item_id")
        .select("user_id", "position", last.alias("blk"))
    )
    before = Window.partitionBy("user_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        seen_ranks.groupBy("user_id", "blk").agg(F.count("*").alias("c"))
        .withColumn("seen_before", F.coalesce(F.sum("c").over(before), F.lit(0)))
        .filter(F.col("blk") * block - F.col("seen_before") < n)
        .select("user_id", "blk", "seen_before")
    )
    inside = Window.partitionBy("user_id", "blk").orderBy("position")
    # The repartition keeps the window's tasks per (user, block) rather than per user.
    unseen_ahead = (
        seen_ranks.join(blocks, ["user_id", "blk"]).repartition("user_id", "blk")
        .withColumn("ahead", F.col("position") - F.col("seen_before") - F.row_number().over(inside))
        .filter(F.col("ahead") < n)
    )
    skips = (
        unseen_ahead.groupBy("user_id", "ahead").agg(F.count("*").alias("c"))
        .groupBy("user_id").agg(F.collect_list(F.struct("ahead", "c")).alias("skips"))  # at most n entries
    )
    skipped = F.aggregate(
        F.coalesce("skips", F.array().cast("array<struct<ahead:bigint,c:bigint>>")),
        F.lit(0).cast("long"),
        lambda acc, s: acc + F.when(s.ahead < F.col("rank"), s.c).otherwise(0),
    )
    wanted = (
        users.join(skips, "user_id", "left")
        .withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(n))))
        .select("user_id", "rank", (F.col("rank") + skipped).alias("position"))
        .filter(F.col("position") <= n_items)
    )
    # Nearly all users meet at the first few ranks, so those are broadcast (a bounded head).
    found = wanted.filter(F.col("position") <= head).join(
        F.broadcast(ranking.filter(F.col("position") <= head)), "position"
    )
    if n_items > head:
        found = found.unionByName(
            wanted.filter(F.col("position") > head).join(ranking.filter(F.col("position") > head), "position")
        )
    return found.select("user_id", "item_id", "score", "rank")
