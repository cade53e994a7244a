"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands.

Documents longer than a sequence are cut; full pieces are sequences of their own. The rest is dealt by hash
into blocks of bounded size and packed by best fit. A block with more bins than its bound is evolved on
several islands, the longer the wider the gap; between epochs each island sends its elite to the
next one through a shuffle. Poorly filled bins are dealt again, over fewer blocks, as long as that saves
bins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import Scratch, arrow_pass
from rankweave.llm.grouping_ga import GaSettings, bound, evolve, first_packing
from rankweave.llm.tokens import word_tokens


@dataclass(frozen=True)
class PackingSettings:
    """``block`` pieces are packed together; bins below ``closed`` of the capacity are packed again."""

    capacity: int = 4096
    end_id: int = 1
    vocabulary: str | None = None
    block: int = 2048
    islands: int = 2
    epochs: int = 2
    closed: float = 0.98
    worth: int = 1000
    ga: GaSettings = field(default_factory=GaSettings)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, s: PackingSettings) -> DataFrame:
    """One row per piece of ``docs(doc_id, text)``: ids of the text, then the end id, cut at the capacity."""
    capacity, end, path = s.capacity, np.asarray([s.end_id], "<u4").tobytes(), s.vocabulary

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
        rows, number, lengths, sums = [], [], [], []
        for row, ids in enumerate(map(word_tokens(path).encode, texts)):
            held = memoryview(ids + end)
            for k in range(0, len(held), 4 * capacity):
                part = held[k : k + 4 * capacity]
                rows.append(row)
                number.append(k // (4 * capacity))
                lengths.append(len(part) // 4)
                sums.append(zlib.crc32(part))
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").cast(pa.int64()).take(pa.array(rows, pa.int64())),
                pa.array(number, pa.int32()),
                pa.array(np.asarray(number, np.int64) * capacity, pa.int64()),
                pa.array(lengths, pa.int64()),
                pa.array(sums, pa.int64()),
            ],
            ["doc_id", "piece", "start", "length", "ids_crc32"],
        )

    return arrow_pass(docs.select("doc_id", "text"), step, PIECES, lambda: word_tokens(path).forget())


_STATE = "block long, island int, elite int, item long, length long, bin long, bins long, score double"


def _island(s: PackingSettings, epoch: int):
    """One epoch on one island: evolve its own and the arrived elite, send the best on."""

    def run(key: tuple[pa.Scalar, ...], groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(groups)).sort_by([("elite", "ascending"), ("item", "ascending")])
        block, island = (k.as_py() for k in key)
        elite = table.column("elite").to_numpy()
        first = elite == elite[0]  # all elites hold the same items
        items, lengths = table.column("item").to_numpy()[first], table.column("length").to_numpy()[first]
        given = []
        if epoch:
            held = table.column("bin").to_numpy()
            given = [np.unique(held[elite == e], return_inverse=True)[1] for e in np.unique(elite)]
        else:
            given = [table.column("bin").to_numpy()]
        rng = np.random.default_rng([abs(block), island, epoch])
        best = evolve(lengths, given, s.ga, rng)
        bins = int(best.max()) + 1
        score = -float(np.square(np.bincount(best, weights=lengths) / s.capacity).sum())
        last = epoch == s.epochs - 1
        for place in [island] if last else sorted({island, (island + 1) % s.islands}):
            n = len(items)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, block)), pa.array(np.full(n, place, np.int32)),
                    pa.array(np.full(n, island, np.int32)), pa.array(items), pa.array(lengths), pa.array(best),
                    pa.array(np.full(n, bins)), pa.array(np.full(n, score)),
                ],
                ["block", "island", "elite", "item", "length", "bin", "bins", "score"],
            )

    return run


def _offsets(s: PackingSettings):
    """Of a block's islands the best one, with each item's place in its sequence."""

    def run(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(groups))
        names = ("bins", "score", "island", "bin", "item")
        best = np.lexsort([table.column(c).to_numpy() for c in reversed(names)])
        table = table.take(best)
        table = table.filter(pc.equal(table.column("island"), table.column("island")[0]))
        bins, items = table.column("bin").to_numpy(), table.column("item").to_numpy()
        lengths = table.column("length").to_numpy()
        before = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        first = np.searchsorted(bins, bins)
        fill = np.bincount(bins, weights=lengths).astype(np.int64)[bins]
        yield pa.RecordBatch.from_arrays(
            [pa.array(items), pa.array(lengths), pa.array(items[first]), pa.array(before - before[first]), pa.array(fill)],
            ["item", "length", "sequence_id", "offset", "fill"],
        )

    return run


def _packed(s: PackingSettings):
    """A block by best fit; ``met``: no packing of it has fewer bins."""

    def run(key: tuple[pa.Scalar, ...], groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(groups)).sort_by("item")
        items, lengths = table.column("item").to_numpy(), table.column("length").to_numpy()
        bins = first_packing(lengths, s.capacity)
        count = int(bins.max()) + 1
        met = count == bound(lengths, s.capacity)
        n, score = len(items), -float(np.square(np.bincount(bins, weights=lengths) / s.capacity).sum())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, key[0].as_py())), pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, np.int32)), pa.array(items),
                pa.array(lengths), pa.array(bins.astype(np.int64)), pa.array(np.full(n, count)), pa.array(np.full(n, score)), pa.array([met] * n),
            ],
            ["block", "island", "elite", "item", "length", "bin", "bins", "score", "met"],
        )

    return run


def _dealt(scratch: Scratch, pool: DataFrame, blocks: int, s: PackingSettings) -> DataFrame:
    """(item, length, sequence_id, offset, fill) of ``pool(item, length)`` packed in ``blocks`` blocks."""
    block = F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block")
    packed = scratch.store(pool.select(block, "item", "length").groupBy("block").applyInArrow(_packed(s), _STATE + ", met boolean"))
    done = packed.filter("met").drop("met")
    states = packed.filter("NOT met").drop("met")
    if not states.isEmpty():
        states = states.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(s.islands - 1))))
        for epoch in range(s.epochs):
            states = scratch.store(states.groupBy("block", "island").applyInArrow(_island(s, epoch), _STATE))
        done = done.unionByName(states)
    return scratch.store(
        done.groupBy("block").applyInArrow(_offsets(s), "item long, length long, sequence_id long, offset long, fill long")
    )


def pack_items(scratch: Scratch, items: DataFrame, s: PackingSettings) -> DataFrame:
    """(item, sequence_id, offset) for ``items(item, length)`` with unique items of 1 to capacity tokens.

    Dealing poor bins again ends when it saves less than one in ``worth`` of them, or in one block.
    """
    count = items.count()
    if not count:
        return items.select("item", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    poor = F.col("fill") < int(s.closed * s.capacity)
    placed, blocks = _dealt(scratch, items, -(-count // s.block), s), -(-count // s.block)
    done = placed.filter(~poor)
    left = placed.filter(poor)
    while blocks > 1:
        held, bins = left.agg(F.count("*"), F.countDistinct("sequence_id")).first()
        if not held:
            break
        blocks = -(-held // s.block)
        again = _dealt(scratch, left.select("item", "length"), blocks, s)
        now = again.agg(F.countDistinct("sequence_id")).first()[0]
        if now >= bins:
            break
        done = done.unionByName(again.filter(~poor))
        left = again.filter(poor)
        if s.worth * (bins - now) < bins:
            break
    return done.unionByName(left).select("item", "sequence_id", "offset")


def pack(docs: DataFrame, s: PackingSettings = PackingSettings()) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Rows that share a doc_id are packed each on its own;
    null doc_ids stay null; an empty table gives no rows. A text of any length is encoded whole.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    cut = scratch.store(pieces(docs, s).withColumn("item", F.monotonically_increasing_id()))
    placed = pack_items(scratch, cut.filter(F.col("length") < s.capacity).select("item", "length"), s)
    whole = cut.filter(F.col("length") == s.capacity).select(
        "*", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return cut.join(placed, "item").select(*names).unionByName(whole.select(*names))
