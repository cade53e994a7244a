"""Words, shingles, sketches against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
from rankweave.llm import kernels, similarity_sketch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(word):
    return re.sub("[A-Z]", lambda m: m[0].lower(), word)


def shingle_set(text, size):
    words = [lower(w) for w in WORD.findall(text or "")]
    if 0 < len(words) < size:
        return {tuple(words)}
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def test_words_and_shingles():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aAbé \n\t\x0b\x0c\r\xa0中") for _ in range(rng.randint(0, 40))) for _ in range(400)]
    texts += ["", None, "x", " ", "é"]
    for most in (50, 1 << 20):
        found, sizes = [], {k: [] for k in (1, 2, 5)}
        for part in kernels.text_slices(pa.array(texts), most):
            w = kernels.words(part)
            found += [part.data[s:e].tobytes().decode() for s, e in zip(w.start, w.end)]
            for k, out in sizes.items():
                row, _ = kernels.shingles(part, k)
                out += np.bincount(row, minlength=part.rows).tolist()
        assert found == [w for t in texts for w in WORD.findall(t or "")]
        for k, out in sizes.items():
            assert out == [len(shingle_set(t, k)) for t in texts]


def test_equal_words_have_equal_hashes_wherever_they_are():
    texts = ["alpha beta", "BETA alpha x", "é" * 700 + " beta"]
    seen = {}
    for part in kernels.text_slices(pa.array(texts), 8):
        w = kernels.words(part, lower=True)
        for s, e, h in zip(w.start, w.end, w.hash):
            assert seen.setdefault(lower(part.data[s:e].tobytes().decode()), h) == h
    assert len(set(seen.values())) == len(seen)


def test_sketch_fills_and_estimates_similarity():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    for n, shared in ((1, 1), (3, 2), (40, 20), (400, 320)):
        a, b = base[:n], np.concatenate([base[:shared], rng.integers(0, 2**63, n - shared).astype(np.uint64)])
        rows = np.repeat([0, 1], n)
        table = similarity_sketch.sketch(rows, np.concatenate([a, b]), 2, 288)
        assert (table != 2**64 - 1).all()
        true = shared / (2 * n - shared)
        assert abs((table[0] == table[1]).mean() - true) < 0.13
