"""Components against brute force over all pairs."""

import collections

import pytest
from edge_rows import CLASHES, ROWS, documents, empty
from rankweave.llm import near_dedup
from test_kernels import shingle_set


def brute(texts: dict, size: int, percent: int = 80) -> dict:
    sets = {i: shingle_set(t, size) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for i, s in sets.items():
        for j, k in collections.Counter(j for x in s for j in holders[x] if j < i).items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: top(i) for i in sets}


@pytest.mark.parametrize("size,block", [(2, 512), (5, 3)])
def test_components_match_brute_force(spark, folder, size, block):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(200)
    texts = {r.doc_id: r.text for r in docs.collect()}
    # A family of edited copies, whose members are close to the original but often not to each other.
    words = [f"w{k}" for k in range(120)]
    for m in range(40):
        texts[10_000 + m] = " ".join(w if (k * 7 + m * 13) % 41 > m % 9 else f"x{m}" for k, w in enumerate(words))
    texts[20_000] = " ".join(words)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = near_dedup.near_duplicates(frame, near_dedup.NearDedupSettings(words=size, block=block)).collect()
    want = brute(texts, size)
    assert {r.doc_id: r.component_id for r in found} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    assert {r.doc_id: r.n_shingles for r in found} == {i: len(shingle_set(t, size)) for i, t in texts.items()}


def test_edges(spark):
    rows = near_dedup.near_duplicates(documents(spark)).collect()
    assert len(rows) == len(ROWS)
    assert {(r.doc_id, r.component_id, r.kept) for r in rows if not r.n_shingles} == {
        (2, 2, True), (None, None, True), (3, 3, True), (4, 4, True)
    }
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_one_of_each_stays(spark):
    docs = documents(spark, [*ROWS, (9, ROWS[0][1], "en", "s1", 1)], clashes=True)
    kept = near_dedup.keep_one_of_each(docs)
    assert kept.columns == docs.columns and set(CLASHES) <= set(kept.columns)
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda i: (i is None, i))
    assert ids == [1, 2, 3, 4, 5, 6, 7, 8, None, None]
    assert near_dedup.keep_one_of_each(empty(spark)).count() == 0
