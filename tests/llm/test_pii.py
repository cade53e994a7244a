"""Personal data against plain expressions; contexts learnt from seeds."""

import hashlib
import random
import re

from edge_rows import ROWS, documents, empty
from rankweave.llm import pii


def luhn(digits):
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_base_spans_of_random_texts():
    rng = random.Random(5)
    for _ in range(20_000):
        text = "".join(rng.choice("a1.@-_ +()2%é9") for _ in range(rng.randint(0, 30)))
        raw = text.encode()
        place = lambda k: len(raw[:k].decode(errors="ignore"))
        assert ",".join(f"{pii.KINDS[k]}:{place(s)}:{place(e)}" for s, e, k in pii.base_spans(raw)) == base(text)


def test_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.find(docs).collect():
        assert r.base_sha256 == hashlib.sha256(base(texts[r.doc_id]).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(base(texts[r.doc_id]).count(k) for k in pii.KINDS)


def test_contexts_find_what_rules_miss(spark):
    rows = [(i, f"well contact mail: user{i}@site{i}.org yes", "en", "s", 0) for i in range(9)]
    rows += [(100 + i, f"some words customer number: X{100 + i * 7}Y and more", "en", "s", 0) for i in range(9)]
    rows += [(200, "well contact mail: user-at-home99 yes", "en", "s", 0), (None, "well contact mail: 77user yes", "en", "s", 0)]
    found = {r.doc_id: r.spans for r in pii.find(documents(spark, rows)).collect()}
    assert found[200] == "like_email:19:33" and found[None] == "like_email:19:25"
    assert found[3] == "email:19:34" and not any(found[100 + i] for i in range(9))


def test_shapes_without_digits_and_of_several_words(spark):
    rows = [(i, f"well contact mail: user{i}@site{i}.org yes", "en", "s", 0) for i in range(9)]
    rows += [(50 + i, f"please call phone number +1 415 555 01{i}{i} today", "en", "s", 0) for i in range(9)]
    rows += [
        (200, "well contact mail: jane[at]mail.org yes", "en", "s", 0), (201, "well contact mail: john.doe at example.com yes", "en", "s", 0),
        (202, "please call phone number (555) 123 4567 today", "en", "s", 0), (203, "well contact mail: tomorrow yes", "en", "s", 0),
        (204, "please call phone number twelve today", "en", "s", 0), (205, "they met at home.com today", "en", "s", 0),
    ]
    texts = {r[0]: r[1] for r in rows}
    found = {r.doc_id: r.spans for r in pii.find(documents(spark, rows)).collect()}
    said = {k: [texts[k][int(a) : int(b)] for _, a, b in (x.split(":") for x in v.split(",") if v)] for k, v in found.items()}
    assert said[200] == ["jane[at]mail.org"] and said[201] == ["john.doe at example.com"] and said[202] == ["(555) 123 4567"]
    assert not said[203] and not said[204] and not said[205]
    assert found[202].startswith("like_phone") and found[201].startswith("like_email")


def test_found_identifiers_bring_in_new_patterns(spark):
    """Handles met beside seeds support a context that no seed has; a context of strangers stays unknown."""
    rows = [(i, f"well contact mail: user{i}@site{i}.org yes", "en", "s", 0) for i in range(9)]
    rows += [(100 + i, f"well contact mail: handle{i}x yes", "en", "s", 0) for i in range(4)]
    rows += [(200 + i, f"now ask nickname = handle{i}x again", "en", "s", 0) for i in range(4)]
    rows += [(300, "now ask nickname = stranger77 again", "en", "s", 0)]
    rows += [(400 + i, f"the part code is Z{i}77Q in stock", "en", "s", 0) for i in range(9)]
    few = {r.doc_id: r.spans for r in pii.find(documents(spark, rows), pii.BootstrapSettings(rounds=1)).collect()}
    found = {r.doc_id: r.spans for r in pii.find(documents(spark, rows)).collect()}
    assert all(found[100 + i] for i in range(4)) and not few[300] and not few[200]
    assert found[300] == "like_email:19:29" and all(found[200 + i] for i in range(4))
    assert not any(found[400 + i] for i in range(9))


def brute_force(texts, s=pii.BootstrapSettings()):
    """The graph with plain loops over words: (text number, start, stop, kind) of what contexts find."""
    sights, totals = [], {}
    for k, text in enumerate(texts):
        raw = text.encode()
        cut = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
        said = [raw[a:b].lower() for a, b in cut]

        def contexts(i, j):
            yield ("before", said[i - 2], said[i - 1]) if i >= 2 else None
            yield ("around", said[i - 1], said[j + 1], j - i) if i >= 1 and j + 1 < len(said) and j - i < pii.MOST_WORDS else None

        for i in range(len(said)):
            for width in range(pii.MOST_WORDS):
                for c in list(contexts(i, i + width))[width > 0 :]:
                    if c:
                        totals[c] = totals.get(c, 0) + 1
        hits = pii.base_spans(raw)
        things = [(a, b, kind, 1 << kind) for a, b, kind in hits]
        marked = [(a, b) for a, b in cut if re.search(rb"[0-9@_\[]", raw[a:b])]
        if marked or b" at " in raw or b"(at" in raw:
            things += [(a, b, -1, x) for a, b, x in pii.candidates(raw, marked, s.least_length) if not any(p < b and a < q for p, q, _ in hits)]
        for a, b, kind, bits in things:
            i = max(n for n, (x, _) in enumerate(cut) if x <= a)
            j = max(n for n, (x, _) in enumerate(cut) if x <= b - 1)
            place = len(raw[:a].decode()), len(raw[:b].decode())
            for c in contexts(i, j):
                if c:
                    sights.append((k, place, kind, bits, raw[a:b].lower(), c))
    edges, seeded = {}, set()
    for _, _, kind, bits, instance, c in set(sights):
        for n in range(4):
            if bits >> n & 1:
                edges.setdefault((n, c), {}).setdefault(instance, 0)
    for _, _, kind, bits, instance, c in set(sights):
        for n in range(4):
            if bits >> n & 1:
                edges[n, c][instance] += 1
                if kind == n:
                    seeded.add((n, c, instance))
    weight, scores = {}, {}
    for _ in range(s.rounds):
        scores = {}
        for (n, c), held in edges.items():
            value = {i: 1.0 if (n, c, i) in seeded else weight.get((n, i), 0.0) for i in held}
            if sum(v >= s.confidence for v in value.values()) >= s.support:
                scores[n, c] = min(1.0, sum(value[i] * m for i, m in held.items()) / totals[c])
        weight = {}
        for (n, c), score in scores.items():
            for i in edges[n, c]:
                weight[n, i] = 1 - (1 - weight.get((n, i), 0.0)) * max(1 - score, 1e-9)
    best = {}
    for k, place, kind, bits, _, c in sights:
        for n in range(4):
            score = scores.get((n, c), 0)
            if kind < 0 and bits >> n & 1 and score >= s.confidence:
                best[k, place] = max(best.get((k, place), (0, 0)), (score, -n))
    inside = lambda a, b: b[0] <= a[0] and b[1] >= a[1] and b[1] - b[0] > a[1] - a[0]
    return {(k, *p, -n) for (k, p), (_, n) in best.items() if not any(q == k and inside(p, r) for q, r in best)}


def test_method_spans_match_brute_force(spark, folder):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = sorted(texts)
    want = {(ids[k], a, b, n) for k, a, b, n in brute_force([texts[i] for i in ids])}
    got = {
        (r.doc_id, int(a), int(b), pii.KINDS.index(kind.removeprefix("like_")))
        for r in pii.find(docs).collect() for kind, a, b in (x.split(":") for x in r.spans.split(",") if x) if kind.startswith("like_")
    }
    assert got == want


def test_edges(spark):
    rows = pii.find(documents(spark, clashes=True)).collect()
    assert len(rows) == len(ROWS)
    assert {r.doc_id: r.spans for r in rows if r.spans} == {8: base(ROWS[-1][1])}
    assert pii.find(empty(spark)).count() == 0
