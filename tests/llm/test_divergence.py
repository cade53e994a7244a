"""The divergence audit against a plain computation over every group, peer and term."""

import re
from collections import Counter, defaultdict

import edge_rows
import pytest

from rankweave.llm import divergence
from rankweave.llm.common import prepare


def terms(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def brute(rows, least=3, top=200):
    held, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, _ in rows:
        key = (lang or "", source or "")
        held[key].update(terms(text))
        docs[key[0]].update(set(terms(text)))
    out = set()
    kept = {lang: sorted(t for t, n in met.items() if n >= least) for lang, met in docs.items()}

    def shares(counts, lang):
        size = sum(counts[t] for t in kept[lang]) + len(kept[lang])
        return {t: 1 + 10**9 * (counts[t] + 1) // size for t in kept[lang]}

    for (lang, source), counts in held.items():
        p = shares(counts, lang)
        values = {}
        for other, theirs in held.items():
            if other[0] == lang and other[1] != source:
                q = shares(theirs, lang)
                values["pair", other[1]] = sum((p[t] - q[t]) ** 2 // q[t] for t in p)
        q = shares(sum((c for (l, _), c in held.items() if l == lang), Counter()), lang)
        values |= {("term", t): (p[t] - q[t]) ** 2 // q[t] for t in p if counts[t] and p[t] > q[t]}
        for part, most in (("pair", None), ("term", top)):
            ranked = sorted(((-v, item.encode()) for (kind, item), v in values.items() if kind == part))[:most]
            out |= {(lang, source, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(ranked)}
    return out


def found(df, **settings):
    got = [tuple(r) for r in divergence.audit(df, divergence.DivergenceSettings(**settings)).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("clashes", [False, True])
def test_edge_rows(spark, clashes):
    prepare(spark)
    rows = edge_rows.ROWS * 2
    assert found(edge_rows.documents(spark, rows, clashes), least_docs=2, top_terms=5) == brute(rows, 2, 5)


def test_supplied_documents(spark, folder):
    prepare(spark)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert found(docs) == brute(rows)


def test_small_runs_give_the_same(spark, folder, monkeypatch):
    """Cut texts, counts handed on early and postings scattered in many runs change nothing."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(60)
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    batches = docs.select("lang", "source", "text").toArrow().to_batches()
    monkeypatch.setattr(divergence, "_PIECE", 7)
    monkeypatch.setattr(divergence, "_HELD", 50)
    held = Counter()
    for batch in divergence._counted(iter(batches)):
        for lang, source, term, n, _ in zip(*(c.to_pylist() for c in batch.columns)):
            held[lang, source, term] += n
    want = Counter((lang, source, t) for _, text, lang, source, _ in rows for t in terms(text))
    assert +held == want


def test_empty(spark):
    prepare(spark)
    assert found(edge_rows.empty(spark)) == set()
    none = edge_rows.documents(spark, [(1, None, "en", "a", 0), (2, "", "en", "b", 0)])
    assert found(none) == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}
