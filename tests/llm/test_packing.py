"""Ids against the tokenizer itself, the packing laws, and the genetic operators."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
from edge_rows import ROWS, documents, empty
from rankweave.llm import grouping_ga, packing
from rankweave.llm.common import Scratch, prepare
from rankweave.llm.tokens import word_tokens
from tokenizers import Tokenizer

PLAIN = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, 1]


def test_ids_of_odd_texts():
    rng = random.Random(3)
    signs = ["a", "É", "1", "'", "'s", " ", "\n", "\xa0", "ẞ", "½", "中", "́", "!", "<|endoftext|>", "\x1c", "\x85", "İ", "don't", "Σ"]
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 12)))
        assert word_tokens().encode(text) == np.asarray(ids(text)[:-1], "<u4").tobytes(), text


def laws(docs, rows, s):
    want = collections.Counter()
    for r in docs.collect():
        all_ids = ids(r.text)
        for k in range(0, len(all_ids), s.capacity):
            part = all_ids[k : k + s.capacity]
            want[r.doc_id, k // s.capacity, k, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= s.capacity
    return len(sequences), -(-sum(r.length for r in rows) // s.capacity)


def test_tables_pack_to_the_bound(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    s = packing.PackingSettings()
    used, bound = laws(docs, packing.pack(docs, s).collect(), s)
    assert used <= bound + 1


def test_many_blocks_pack_as_few(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    s = packing.PackingSettings(capacity=700, block=32, ga=grouping_ga.GaSettings(capacity=700))
    used, bound = laws(docs, packing.pack(docs, s).collect(), s)
    assert used <= 1.03 * bound + 1


def test_edges(spark):
    docs = documents(spark, clashes=True)
    s = packing.PackingSettings()
    rows = packing.pack(docs, s).collect()
    laws(docs, rows, s)
    assert len({r.piece for r in rows if r.doc_id == 5}) > 1 and len(rows) >= len(ROWS)
    assert packing.pack(empty(spark)).count() == 0


def test_crossover_keeps_every_item_and_the_capacity():
    rng = np.random.default_rng(1)
    s = grouping_ga.GaSettings(capacity=100)
    lengths = rng.integers(1, 101, 300)
    order = np.arange(300)
    nothing = np.full(300, -1)
    one = grouping_ga.best_fit(nothing, order, lengths, 100)
    two = grouping_ga.best_fit(nothing, order[::-1], lengths, 100)
    for _ in range(20):
        child = grouping_ga.crossover(one, two, lengths, s, rng)
        fill = np.bincount(child, weights=lengths)
        assert child.min() == 0 and len(child) == 300 and fill.max() <= 100 and fill.min() > 0
        one, two = two, child
    best = grouping_ga.evolve(lengths, [], s, rng)
    assert best.max() <= grouping_ga.best_fit(nothing, np.argsort(-lengths), lengths, 100).max()


def hard_lengths(n, seed=1):
    return np.random.default_rng(seed).integers(1000, 2001, n)


def test_budget_follows_the_gap():
    """Lengths of which best fit leaves bins above the bound: the algorithm saves some, and none is spent without a gap."""
    lengths = hard_lengths(2000)
    s = grouping_ga.GaSettings()
    first = grouping_ga.first_packing(lengths, s.capacity)
    best = grouping_ga.evolve(lengths, [], s, np.random.default_rng(1))
    assert best.max() < first.max() - 8
    assert np.bincount(best, weights=lengths).max() <= s.capacity
    easy = np.random.default_rng(2).integers(1, 900, 3000)
    assert grouping_ga.bound(easy, 4096) == grouping_ga.first_packing(easy, 4096).max() + 1


def test_hard_lengths_through_islands(spark):
    """Two blocks, islands and dealing again, against best fit in one block."""
    lengths = hard_lengths(1200, 4)
    items = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "item long, length long")
    s = packing.PackingSettings(block=700)
    prepare(spark)
    rows = packing.pack_items(Scratch(spark, "test"), items, s).collect()
    assert sorted(r.item for r in rows) == list(range(1200))
    held = collections.defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, int(lengths[r.item])))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(held) < grouping_ga.first_packing(lengths, 4096).max() + 1
