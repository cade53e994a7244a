"""Personal data by rules and by bootstrapped contextual extraction.

The rules' matches are seeds. Candidates are one to a few words in a loose shape of a kind: an address with
its sign spelt out, a number with other marks or a failing check digit, a word with digits. The words
around a seed or candidate are its lexical patterns: the two before it, and the one before with the one
after and the number of words between. A pattern takes part once it is seen with ``support`` identifiers, at
first seeds, later also candidates that earlier rounds trust. Its confidence is the weight of these identifiers
over all its occurrences in the corpus; a candidate's weight is the noisy-or of its patterns. The two are
scored in turn on the pattern-instance graph, so patterns found in one round bring in identifiers whose
other contexts become patterns in the next. Candidates in confident patterns are what the rules miss.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import Scratch, arrow_pass
from rankweave.llm.kernels import U, Texts, hash_spans, mix, text_slices, words

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(rb"[0-9](?<![0-9][0-9])[0-9]*(?:\.[0-9]+){3}")
_CARD = re.compile(rb"[0-9](?<![0-9][0-9])(?:[ -]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(rb"[0-9]")
# Loose shapes: an address with its signs spelt out, a number with marks or masked digits, a word with a digit or sign.
_AT = rb"(?:@|\[at\]|\(at\)|\{at\}|\x20\[at\]\x20|\x20\(at\)\x20)"
_DOT = rb"(?:\.|\[dot\]|\(dot\)|\x20dot\x20)"
_LOOSE_EMAIL = re.compile(
    rb"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:" + _AT + rb"[A-Za-z0-9-]+(?:" + _DOT + rb"[A-Za-z0-9-]+)*"
    rb"|\x20at\x20[A-Za-z0-9-]+(?:" + _DOT + rb"[A-Za-z0-9-]+)+)"
)
_MAYBE_AT = re.compile(rb"(?i)[\[({\x20]at[\])}\x20]|@")
_LOOSE_NUMBER = re.compile(rb"(?<![0-9])[+(]{0,2}[0-9][0-9Xx*().\x20/-]*[0-9]")
_ODD_WORD = re.compile(rb"[A-Za-z0-9](?:[^\x00-\x20]*[A-Za-z0-9])?")
MOST_WORDS = 5  # of a candidate, and between the words of a pattern
_SCANNED = (
    "id long, text_key long, spans array<struct<start:int,stop:int,kind:int>>, "
    "seen array<struct<kind:int,shapes:int,instance:long,start:int,stop:int,pattern:long>>"
)


@dataclass(frozen=True)
class BootstrapSettings:
    """A pattern needs ``support`` different identifiers; patterns, and candidates to support others, need
    ``confidence``; candidates have ``least_length`` characters at least."""

    rounds: int = 3
    support: int = 2
    confidence: float = 0.5
    least_length: int = 4
    bitmap_bits: int = 24


def emails(text: bytes) -> list[tuple[int, int]]:
    """From each @ back over the local part, then on over the domain; linear in the text."""
    out, free, at = [], 0, text.find(b"@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            free = found.end()
        at = text.find(b"@", max(at + 1, free))
    return out


def _luhn(digits: bytes) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d -= 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _only_digits(text: bytes) -> bytes:
    return bytes(c for c in text if 48 <= c <= 57)


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind) in bytes, by start and kind. Failing matches are dropped without a retry."""
    out = [(s, e, 0) for s, e in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p) < 20 and int(p) <= 255 for p in (q.lstrip(b"0") or b"0" for q in m[0].split(b"."))):
                out.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            digits = _only_digits(m[0])
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), m.end(), 2))
        for m in _PHONE.finditer(text):
            if 9 <= len(_only_digits(m[0])) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda x: (x[0], x[2]))


def shapes(span: bytes) -> int:
    """A bit for every kind that the span has a loose shape of."""
    digits = sum(48 <= c <= 57 for c in span)
    masked = digits + span.count(b"*") + span.lower().count(b"x")
    letters = any(65 <= c <= 90 or 97 <= c <= 122 for c in span)
    numeral = not letters or masked > digits and not re.search(rb"(?i)[a-wyz]", span)
    groups = span.count(b".") + span.count(b":")
    out = 1 if letters and (digits or b"_" in span or _MAYBE_AT.search(span)) else 0
    out |= 2 if groups >= 3 and (digits >= 4 or b":" in span) and b" " not in span else 0
    out |= 4 if numeral and 12 <= masked <= 19 else 0
    return out | (8 if numeral and digits == masked and 7 <= digits <= 15 else 0)


def candidates(text: bytes, found: list[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
    """(start, end, shapes) of what may be an identifier; ``found`` are the words, in bytes."""
    out: dict[tuple[int, int], int] = {}
    digit = _DIGIT.search(text) is not None

    def add(start: int, end: int) -> None:
        bits = shapes(text[start:end]) if end - start >= least else 0
        if bits:
            out[start, end] = bits

    if _MAYBE_AT.search(text):
        for m in _LOOSE_EMAIL.finditer(text):
            add(m.start(), m.end())
    if digit:
        for m in _LOOSE_NUMBER.finditer(text):
            if sum(48 <= c <= 57 for c in m[0]) >= 7 and m[0].count(b" ") < MOST_WORDS:
                add(m.start(), m.end())
    for start, end in found:
        core = _ODD_WORD.search(text, start, end)
        if core:
            add(core.start(), core.end())
    return [(s, e, bits) for (s, e), bits in sorted(out.items())]


def _patterns(hashes: np.ndarray, row: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Two pattern hashes for the words ``first`` to ``last``; 0 where the row has no such neighbours."""
    n = len(row)
    at = lambda i: hashes[np.clip(i, 0, n - 1)]
    inside = lambda i: (i >= 0) & (i < n) & (row[np.clip(i, 0, n - 1)] == row[np.clip(first, 0, n - 1)])
    before = np.where(inside(first - 2), mix(mix(at(first - 2) + U(1)) + at(first - 1)), U(0))
    width = (last - first + 2).astype(np.uint64)
    around = np.where(inside(first - 1) & inside(last + 1), mix(mix(at(first - 1) + width) + at(last + 1)), U(0))
    return np.stack([before, around])


def _scan_slice(texts: Texts, spans: list, seen: list, least: int) -> None:
    found = words(texts, lower=True)
    code_points = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
    odd = np.concatenate([[0], np.cumsum(_ODD[texts.data])])
    bounds = np.searchsorted(found.row, np.arange(texts.rows + 1))
    things: list[tuple[int, int, int, int, int]] = []  # row, start, end, kind or -1, shapes
    for k in range(texts.rows):
        low, high = int(texts.offsets[k]), int(texts.offsets[k + 1])
        raw = texts.data[low:high].tobytes()
        hits = base_spans(raw) if odd[high] > odd[low] else []
        cp = code_points[low : high + 1] - code_points[low]
        spans.append([{"start": int(cp[s]), "stop": int(cp[e]), "kind": kind} for s, e, kind in hits])
        things += [(k, low + s, low + e, kind, 1 << kind) for s, e, kind in hits]
        own = slice(bounds[k], bounds[k + 1])
        marked = np.flatnonzero(odd[found.end[own]] > odd[found.start[own]]) + bounds[k]
        near = [(int(found.start[i]) - low, int(found.end[i]) - low) for i in marked]
        if near or _MAYBE_AT.search(raw):
            taken = np.zeros(high - low + 1, bool)
            for s, e, _ in hits:
                taken[s:e] = True
            things += [(k, low + s, low + e, -1, bits) for s, e, bits in candidates(raw, near, least) if not taken[s:e].any()]
    base = len(seen)
    seen.extend([] for _ in range(texts.rows))
    if not things:
        return
    row, start, end, kind, shape = (np.asarray(x, np.int64) for x in zip(*things))
    first = np.searchsorted(found.start, start, "right") - 1
    last = np.searchsorted(found.start, end - 1, "right") - 1
    both = _patterns(found.hash, found.row, first, last)
    both[1][last - first >= MOST_WORDS] = 0
    value = np.empty(len(start), np.uint64)
    for i in range(len(start)):  # spans of different kinds may overlap
        value[i] = hash_spans(texts.data, start[i : i + 1], end[i : i + 1], lower=True)[0]
    for pattern in both:
        for i in np.flatnonzero(pattern):
            origin = int(texts.offsets[row[i]])
            seen[base + row[i]].append({
                "kind": int(kind[i]), "shapes": int(shape[i]), "instance": int(value[i].view(np.int64)),
                "start": int(code_points[start[i]] - code_points[origin]),
                "stop": int(code_points[end[i]] - code_points[origin]), "pattern": int(pattern[i].view(np.int64)),
            })


_ODD = np.zeros(256, bool)  # digits and signs that candidates and base spans need
_ODD[[*range(48, 58), ord("@"), ord("_"), ord("[")]] = True


def scan(docs: DataFrame, least: int) -> DataFrame:
    """Per row of ``docs(id, text_key, text)``: base spans, and what stands in which pattern."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans: list = []
        seen: list = []
        for texts in text_slices(batch.column("text")):
            _scan_slice(texts, spans, seen, least)
        span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.int32())]))
        sight = pa.list_(pa.struct([
            ("kind", pa.int32()), ("shapes", pa.int32()), ("instance", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()),
            ("pattern", pa.int64()),
        ]))
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("text_key"), pa.array(spans, span), pa.array(seen, sight)],
            ["id", "text_key", "spans", "seen"],
        )

    return arrow_pass(docs, step, _SCANNED)


def pattern_totals(docs: DataFrame, wanted: DataFrame, bits: int) -> DataFrame:
    """(pattern, total): occurrences in all texts of the patterns in ``wanted(pattern)``.

    Tasks count what passes a bitmap of fixed size that the wanted patterns set, so counts and not
    occurrences are shuffled.
    """
    place = F.shiftrightunsigned("pattern", 64 - bits)
    held = wanted.groupBy(F.shiftright(place, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(pattern, {64 - bits}) & 63 as int))")).alias("held")
    ).toArrow()
    bitmap = np.zeros(2 ** (bits - 6), np.int64)
    bitmap[held.column("word").to_numpy()] = held.column("held").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [np.zeros(0, np.uint64)]
        for texts in text_slices(batch.column("text")):
            found = words(texts, lower=True)
            if len(found.row):
                here = np.arange(len(found.row))
                for width in range(MOST_WORDS):
                    before, around = _patterns(found.hash, found.row, here, here + width)
                    for hashed in (before, around) if not width else (around,):
                        hashed = hashed[hashed != 0]
                        at = (hashed >> U(64 - bits)).astype(np.int64)
                        parts.append(hashed[(shared.value[at >> 6] >> (at & 63)) & 1 == 1])
        pattern, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pattern.view(np.int64)), pa.array(n)], ["pattern", "n"])

    counted = arrow_pass(docs.select("text"), step, "pattern long, n long")
    totals = counted.groupBy("pattern").agg(F.sum("n").alias("total"))
    return totals.join(wanted, "pattern", "left_semi")


def bootstrap(scratch: Scratch, sights: DataFrame, keyed: DataFrame, s: BootstrapSettings) -> DataFrame:
    """(kind, pattern, confidence) of the patterns learnt from ``sights(kind, shapes, instance, pattern)``.

    A pattern that any number of rounds can bring in is seen with ``support`` different identifiers or candidates of
    its kind, so these are counted in the corpus once.
    """
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(1 << k).alias("bit")) for k in range(len(KINDS))]))
    per_kind = sights.select("pattern", "instance", F.col("kind").alias("seed"), "shapes", kinds.alias("k")).filter(
        F.col("shapes").bitwiseAND(F.col("k.bit")) > 0
    )
    edges = scratch.store(
        per_kind.groupBy(F.col("k.kind").alias("kind"), "pattern", "instance").agg(
            F.count("*").alias("n"), F.max((F.col("seed") == F.col("k.kind")).cast("int")).alias("seeded")
        )
    )
    many = edges.groupBy("kind", "pattern").agg(F.count("*").alias("m")).filter(F.col("m") >= s.support).drop("m")
    many = scratch.store(many.join(edges.filter("seeded = 1").select("kind").distinct(), "kind"))
    totals = scratch.store(pattern_totals(keyed, many.select("pattern").distinct(), s.bitmap_bits))
    edges = scratch.store(edges.join(many, ["kind", "pattern"]).join(totals, "pattern"))
    weights = scores = None
    for _ in range(s.rounds):
        known = edges if weights is None else edges.join(weights, ["kind", "instance"], "left")
        weight = F.lit(0.0) if weights is None else F.coalesce("weight", F.lit(0.0))
        value = F.when(F.col("seeded") == 1, F.lit(1.0)).otherwise(weight)
        scores = scratch.store(
            known.withColumn("value", value).groupBy("kind", "pattern").agg(
                F.least(F.lit(1.0), F.sum(F.col("value") * F.col("n")) / F.first("total")).alias("confidence"),
                F.count(F.when(F.col("value") >= s.confidence, 1)).alias("backed"),
            ).filter(F.col("backed") >= s.support).drop("backed")
        )
        missed = F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))
        weights = scratch.store(
            edges.select("kind", "pattern", "instance").join(scores, ["kind", "pattern"])
            .groupBy("kind", "instance").agg((1 - F.exp(F.sum(missed))).alias("weight"))
        )
    return scores


def find(docs: DataFrame, s: BootstrapSettings = BootstrapSettings()) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_<kind>, base_sha256, spans.

    ``spans`` lists kind:start:end by start, then kind, in code points with the end exclusive; spans
    found by context are called like_<kind>. ``base_sha256`` is the digest of the list of base spans.
    Null and empty texts have no spans. Rows of equal doc_id and text count as one document and all get the
    result; a null doc_id is kept. Very long texts are read whole. Of spans found by context that lie in each other, the
    longest stays; ties between kinds go to the more confident pattern, then the first kind. An empty table
    gives no rows; further columns are not read. Runs jobs and writes below ``spark.checkpoint.dir`` when called.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    keyed = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_key"), "text")
    scanned = scratch.store(scan(keyed, s.least_length))
    sights = scratch.store(
        scanned.select("id", "text_key", F.explode("seen").alias("x")).select("id", "text_key", "x.*").distinct()
    )
    scores = bootstrap(scratch, sights, keyed, s).filter(F.col("confidence") >= s.confidence)
    found = (
        sights.filter("kind < 0").drop("kind").join(scores, "pattern")
        .filter(F.expr("(shapes & shiftleft(1, kind)) > 0"))
        .groupBy("id", "text_key", "start", "stop")
        .agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"))
        .groupBy(F.col("id").alias("found"), F.col("text_key").alias("found_key"))
        .agg(F.collect_list(F.struct("start", "stop", (F.col("kind") + len(KINDS)).alias("kind"))).alias("more"))
    )
    same = F.col("id").eqNullSafe(F.col("found")) & (F.col("text_key") == F.col("found_key"))
    names = F.array(*[F.lit(k) for k in KINDS], *[F.lit(f"like_{k}") for k in KINDS])
    listed = lambda spans: F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["stop"])), ","
    )
    of_kind = lambda n: lambda x: x["kind"] == n
    by_start = lambda spans: F.array_sort(F.transform(
        spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["stop"].alias("stop"))
    ))
    none = F.array().cast("array<struct<start:int,stop:int,kind:int>>")
    within = lambda x, y: (y["start"] <= x["start"]) & (y["stop"] >= x["stop"]) & (y["stop"] - y["start"] > x["stop"] - x["start"])
    found = found.withColumn("more", F.filter("more", lambda x: ~F.exists("more", lambda y: within(x, y))))
    return scanned.join(found, same, "left").select(
        F.col("id").alias("doc_id"),
        *[F.size(F.filter("spans", of_kind(n))).cast("long").alias(f"n_{k}") for n, k in enumerate(KINDS)],
        F.sha2(listed(by_start(F.col("spans"))), 256).alias("base_sha256"),
        listed(by_start(F.concat("spans", F.coalesce("more", none)))).alias("spans"),
    )
