"""Counts against plain Python; outliers planted among ordinary prose."""

import collections
import random

import pytest
from edge_rows import ROWS, documents, empty
from rankweave.llm import quality
from test_kernels import WORD


def counts(text):
    words = WORD.findall(text or "")
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), again, len(covered)


def test_counts_match_plain_python(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.judge(docs).collect():
        s = r.stats
        got = (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words)
        assert got == counts(texts[r.doc.doc_id])
        assert r.base_failed == (got[0] < 50 or 100 * got[4] > 50 * got[0])
        assert not (r.kept and r.base_failed)


def test_planted_outliers_go_and_prose_stays(spark):
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice(["alpha", "be", "gamma,", "Delta", "to", "epsilon."]) + str(rng.randint(0, 999)) for _ in range(n))
    rows = [(i, prose(rng.randint(60, 300)), "en", f"s{i % 2}", 0) for i in range(600)]
    rows += [(1000 + i, " ".join(w + "###" for w in prose(100).split()), "en", "s0", 0) for i in range(30)]
    rows += [(2000 + i, prose(100).upper() + "!!", "en", "s1", 0) for i in range(30)]
    kept = {r.doc_id for r in quality.keep_good(documents(spark, rows)).collect()}
    assert kept == set(range(600))


def test_scatter_of_the_group_decides(spark):
    rng = random.Random(7)

    def prose(length):
        sizes = [int(length + rng.random()) for _ in range(200)]
        return " ".join("".join(rng.choice("abcdefghijklm") for _ in range(n)) for n in sizes)

    rows = [(i, prose(rng.uniform(4.7, 5.3)), "en", "narrow", 0) for i in range(300)]
    rows += [(300 + i, prose(rng.uniform(4, 8)), "en", "wide", 0) for i in range(300)]
    probe = prose(7)
    rows += [(1000, probe, "en", "narrow", 0), (1001, probe, "en", "wide", 0)]
    kept = {r.doc_id for r in quality.keep_good(documents(spark, rows)).collect()}
    assert kept == {*range(600), 1001}


def test_edges(spark):
    judged = quality.judge(documents(spark, clashes=True)).collect()
    assert len(judged) == len(ROWS) and all(r.base_failed for r in judged if r.doc.doc_id != 5)
    kept = quality.keep_good(documents(spark, clashes=True))
    assert kept.columns == documents(spark, clashes=True).columns
    assert quality.judge(empty(spark)).count() == 0


@pytest.mark.parametrize("share", [0.5, 0.75, 0.999999])
def test_chi_square_quantile(share):
    x = quality.chi_square_quantile(share, 2)
    import math
    assert abs((1 - math.exp(-x / 2)) - share) < 1e-9


@pytest.mark.parametrize("x, degrees, share", [(3.841459, 1, 0.95), (7.814728, 3, 0.95), (12.591587, 6, 0.95)])
def test_chi_square_share(x, degrees, share):
    assert abs(quality.chi_square_share(x, degrees) - share) < 1e-6
