"""Source divergence audit: how far each source of a language strays from its peers, term by term.

The counts form a sparse matrix of groups (language, source) by terms. Pair sums are rows of a
product with its own transpose, computed by Gustavson's row accumulation: each group walks its
terms, scatters them through the term-major index into a dense accumulator with a cell per peer,
and only the accumulators are shuffled; a posting pair is never a row. Terms that one side lacks are
not walked at all. With f(p, q) the divergence of a term, p0 and q0 the smoothed shares of absent
terms, V kept terms and |g| of them in group g,

    sum f(p, q) = sum over g of f(p, q0) + sum over h of f(p0, q) + (V - |g| - |h|) f(p0, q0)
                + sum over terms of both of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0).

The first line, the corrected zero baselines, needs only the histogram of each group's counts; the
second is the scatter. All of it is integer arithmetic.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.llm.common import Scratch

_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
_GAP = re.compile(rb"[^A-Za-z\x80-\xff]")
_PIECE = 1 << 20  # bytes of a text cut into terms at once
_HELD = 200_000  # entries a task counts before it hands them on
_POSTINGS = 1 << 19  # postings scattered at once
ONE = 1_000_000_000


@dataclass(frozen=True)
class DivergenceSettings:
    least_docs: int = 3
    top_terms: int = 200


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in runs of about ``_PIECE`` bytes that cut no term."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + _PIECE)
        end = gap.end() if gap else len(text)
        yield text[at:end]
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) summed over runs of documents; a row with term '' names each group."""
    held: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = [b"", *n]
            one = lambda value: pa.repeat(pa.scalar(value, pa.binary()), len(terms)).cast(pa.string())
            yield pa.record_batch(
                [
                    one(lang), one(source), pa.array(terms, pa.binary()).cast(pa.string()),
                    pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, n)], pa.int64()),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )
        held.clear()

    for batch in batches:
        lang, source, text = (c.fill_null("").cast(pa.binary()).to_pylist() for c in batch.columns)
        for key, body in zip(zip(lang, source), text):
            n, docs = held.setdefault(key, (Counter(), Counter()))
            met: set[bytes] = set()
            for piece in _pieces(body):
                terms = _TERM.findall(piece.lower())
                n.update(terms)
                met.update(terms)
            docs.update(met)
        if sum(len(n) for n, _ in held.values()) > _HELD:
            yield from rows()
    yield from rows()


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _partial(lang: str, source, item, value: np.ndarray) -> pa.RecordBatch:
    n = len(value)
    full = lambda x: pa.repeat(pa.scalar(x, pa.string()), n) if isinstance(x, str) else x.cast(pa.string())
    return pa.record_batch(
        [full(lang), full(source), full(item), pa.array(value, pa.int64())], names=["lang", "source", "item", "value"]
    )


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of index rows with about ``_POSTINGS`` postings."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch.column("source").flatten())
        if size >= _POSTINGS:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _scattered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every group's accumulator over the terms of each run of the index."""
    for chunk in _chunks(batches):
        for lang in pc.unique(chunk.column("lang")).to_pylist():
            rows = chunk.filter(pc.equal(chunk.column("lang"), lang)).combine_chunks()
            lists = rows.column("source").chunk(0) if rows.num_rows else None
            if lists is None:
                continue
            width = pc.list_value_length(lists).to_numpy().astype(np.int64)
            first = np.concatenate([[0], np.cumsum(width)])[:-1]
            names = lists.flatten().dictionary_encode()
            peer = names.indices.to_numpy().astype(np.int64)
            p, base = (rows.column(c).chunk(0).flatten().to_numpy() for c in ("p", "base"))
            term = np.repeat(np.arange(len(width)), width)
            order = np.argsort(peer, kind="stable")
            bounds = np.searchsorted(peer[order], np.arange(len(names.dictionary) + 1))
            for group in range(len(names.dictionary)):
                own = order[bounds[group] : bounds[group + 1]]
                accumulator = np.zeros(len(names.dictionary), np.int64)
                reach = np.cumsum(width[term[own]])
                at = 0
                while at < len(own):
                    end = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + _POSTINGS, "right")))
                    part = own[at:end]
                    wide = width[term[part]]
                    before = np.concatenate([[0], np.cumsum(wide)])
                    there = np.repeat(first[term[part]] - before[:-1], wide) + np.arange(before[-1])
                    mine, zero, q, q0 = np.repeat(p[part], wide), base[own[0]], p[there], base[there]
                    change = _divergence(mine, q) - _divergence(mine, q0) - _divergence(zero, q) + _divergence(zero, q0)
                    np.add.at(accumulator, peer[there], change)
                    at = end
                yield _partial(lang, names.dictionary[group].as_py(), names.dictionary, accumulator)


def _baselines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What terms absent on one side or on both give for each pair, from one group's histogram of shares."""
    for batch in batches:
        for row in range(batch.num_rows):
            lang, source, base, n_terms, size = (
                batch.column(c)[row].as_py() for c in ("lang", "source", "base", "n_terms", "v")
            )
            p, m = (np.array(batch.column(c)[row].values or [], np.int64) for c in ("p", "m"))
            peers = batch.column("peers")[row].values
            bases, counts = (np.array(peers.field(f), np.int64) for f in ("base", "n_terms"))
            over, under = np.zeros(len(bases), np.int64), np.zeros(len(bases), np.int64)
            for at in range(len(p)):
                over += m[at] * _divergence(p[at], bases)
                under += m[at] * _divergence(bases, p[at])
            over += (size - n_terms - counts) * _divergence(np.int64(base), bases)
            yield _partial(lang, source, peers.field("source"), over)
            yield _partial(lang, peers.field("source"), source, under)


def _share(n: str, size: str) -> Column:
    """1 + floor(ONE * (n + 1) / size), exactly; 1 where there are no terms."""
    return F.expr(f"if({size} = 0, 1, 1 + cast({ONE} as decimal(19,0)) * ({n} + 1) div ({size}))").cast("long")


def audit(docs: DataFrame, settings: DivergenceSettings = DivergenceSettings()) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows rank all peers of a group, ``term`` rows
    its most outstanding terms.

    A term is a run of ASCII letters and other code points from U+0080, A-Z lower-cased. Every row is
    a document, also a repeated one. Null text, language or source is ''. Very long texts are cut into
    terms piece by piece. A group without terms still has its pair rows; a source without peers has
    none. Ties rank by the item's bytes. An empty table gives no rows; further columns are not read.
    Runs jobs and writes its index below ``spark.checkpoint.dir`` when called.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "divergence")
    found = docs.select("lang", "source", "text").mapInArrow(
        _counted, "lang string, source string, term string, n long, docs long"
    )
    counts = scratch.store(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    groups = counts.filter("term = ''").select("lang", "source")
    index = scratch.store(
        counts.filter("term <> ''").groupBy("lang", "term")
        .agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("postings"))
        .filter(F.col("docs") >= settings.least_docs).drop("docs")
    )
    postings = index.select("lang", "term", "total", F.inline("postings"))
    histogram = scratch.store(postings.groupBy("lang", "source", "n").agg(F.count("*").alias("m")))
    languages = index.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    sizes = histogram.groupBy("lang", "source").agg(F.sum(F.expr("n * m")).alias("group_n"), F.sum("m").alias("n_terms"))
    groups = scratch.store(
        groups.join(languages, "lang", "left").join(sizes, ["lang", "source"], "left").na.fill(0)
        .withColumn("base", _share("0", "group_n + v"))
    )

    shares = scratch.store(
        postings.join(groups, ["lang", "source"])
        .select("lang", "term", "source", "base", _share("n", "group_n + v").alias("p"), _share("total", "lang_n + v").alias("q"))
    )
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = (
        shares.filter("p > q")
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
        .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= settings.top_terms)
    )

    partial = "lang string, source string, item string, value long"
    rows = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "base")).alias("x"))
    scattered = rows.select("lang", "x.source", "x.p", "x.base").mapInArrow(_scattered, partial)
    scratch.drop(counts)
    scratch.drop(index)
    bars = (
        histogram.join(groups, ["lang", "source"]).groupBy("lang", "source")
        .agg(F.collect_list(F.struct(_share("n", "group_n + v").alias("p"), "m")).alias("x"))
        .select("lang", "source", "x.p", "x.m")
    )
    peers = groups.groupBy("lang").agg(F.collect_list(F.struct("source", "base", "n_terms")).alias("peers"))
    baselines = (
        groups.join(bars, ["lang", "source"], "left").join(peers, "lang")
        .select("lang", "source", "base", "n_terms", "v", "p", "m", "peers").mapInArrow(_baselines, partial)
    )
    pairs = (
        scattered.unionByName(baselines).filter("source <> item").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
        .withColumn("rank", F.row_number().over(best))
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    )
    return pairs.unionByName(terms)
