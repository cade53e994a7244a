"""Toxicity by a classifier chain of linear models.

Categories are predicted in order. The model of each category sees the words of a text and the probabilities of
the earlier categories; in training these are out-of-fold predictions, so a later model learns from
probabilities as good as those it gets when scoring. Models are logistic regressions on the presence
of selected words and beginnings of words, fitted on a bounded sample of labelled documents; every document is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.llm.common import Scratch, arrow_pass
from rankweave.llm.kernels import Texts, U, chain, hash_spans, list_array, mix, text_slices, words

# Words that make a toxic-labelled text an example of a category.
CATEGORY_WORDS = {
    "insult": "idiot idiots moron morons stupid fool dumb clown loser imbecile jerk".split(),
    "contempt": "worthless pathetic disgusting trash scum garbage vermin filth useless vile".split(),
}

STEMS = (4, 5, 6)


@dataclass(frozen=True)
class ChainSettings:
    """At most about ``fit_rows`` labelled documents train the chain, drawn evenly by hash; all are used if
    there are fewer. ``features``: words and beginnings kept, by association with any category."""

    fit_rows: int = 20_000
    features: int = 768
    folds: int = 3
    least_documents: int = 4
    least_chi_square: float = 10.8
    ridge: float = 0.5
    threshold: float = 0.5


_WORDS = "row long, family long, y array<int>, words array<long>"
_FIT = "part int, row long, chance double, weights array<double>"


def _features(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word, lower case and without signs, and of its beginnings.

    Beginnings of ``STEMS`` letters stand for the forms of one stem; a word has those shorter than it.
    """
    found = words(texts, lower=True, plain=True)
    letters = np.flatnonzero((texts.data & 0xC0) != 0x80)  # where each code point starts
    first, last = np.searchsorted(letters, found.start), np.searchsorted(letters, found.end)
    rows, hashes = [found.row], [found.hash]
    for n in STEMS:
        longer = last - first > n
        end = letters[first[longer] + n]
        rows.append(found.row[longer])
        hashes.append(mix(hash_spans(texts.data, found.start[longer], end, lower=True) + U(n)))
    return np.concatenate(rows), np.concatenate(hashes)


def _distinct(row: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((hashed, row))
    row, hashed = row[order], hashed[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashed[1:] != hashed[:-1])
    return row[new], hashed[new]


FAMILY = 4


def word_sets(labelled: DataFrame) -> DataFrame:
    """Distinct word hashes of ``labelled(row, y, text)``, and a family that copies and most near copies share.

    It joins the least word-pair hashes of ``FAMILY`` orders, so unrelated texts with one frequent pair in
    common do not meet in it.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, values, family = [], [], []
        for texts in text_slices(batch.column("text")):
            row, hashed = _distinct(*_features(texts))
            counts.append(np.bincount(row, minlength=texts.rows))
            values.append(hashed.view(np.int64))
            plain = words(texts, lower=True)
            pairs, at = chain(plain.hash, plain.row, 2)
            key = np.zeros(texts.rows, np.uint64)
            for order in range(FAMILY):
                least = np.full(texts.rows, U(2**64 - 1))
                np.minimum.at(least, plain.row[at], mix(pairs + U(order)))
                key = mix(key * U(3) + least)
            family.append(key.view(np.int64))
        gather = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
        return pa.RecordBatch.from_arrays(
            [
                batch.column("row"), pa.array(gather(family)), batch.column("y"),
                list_array(gather(values), gather(counts), pa.int64()),
            ],
            ["row", "family", "y", "words"],
        )

    return arrow_pass(labelled.select("row", "y", "text"), step, _WORDS)


def _select_words(sample: DataFrame, categories: int, s: ChainSettings) -> np.ndarray:
    """Hashes of the words most associated with any category, by chi-square; at most ``features``."""
    totals = sample.agg(F.count("*").alias("n"), *[F.sum(F.col("y")[k]).alias(f"t{k}") for k in range(categories)]).first()
    n = totals["n"]
    if not n:
        return np.zeros(0, np.uint64)
    seen = sample.select("y", F.explode("words").alias("word")).groupBy("word").agg(
        F.count("*").alias("held"), *[F.sum(F.col("y")[k]).alias(f"p{k}") for k in range(categories)]
    ).filter(F.col("held") >= s.least_documents)
    held, scores = F.col("held"), []
    for k in range(categories):
        positive = int(totals[f"t{k}"] or 0)
        if 0 < positive < n:
            expected = held * positive / n
            spread = expected * (1 - positive / n) * (1 - (held - 1) / n)
            scores.append(F.pow(F.col(f"p{k}") - expected, 2) / F.greatest(spread, F.lit(1e-9)))
    if not scores:
        return np.zeros(0, np.uint64)
    score = F.greatest(*scores) if len(scores) > 1 else scores[0]
    best = seen.select("word", score.alias("score")).filter(F.col("score") >= s.least_chi_square)
    rows = best.orderBy(F.desc("score"), "word").limit(s.features).select("word").collect()
    return np.sort(np.asarray([r["word"] for r in rows], np.int64).view(np.uint64))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 25) -> np.ndarray:
    """Weights and, last, the intercept, by Newton steps with a ridge penalty on the weights."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + penalty * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        move = np.linalg.solve(bend, slope)
        w -= np.clip(move, -4, 4)
        if np.abs(move).max() < 1e-5:
            break
    return w


def _inputs(columns: list, features: int, earlier: np.ndarray) -> np.ndarray:
    """0-1 columns of the words and the log odds of the earlier categories."""
    x = np.zeros((len(columns), features + earlier.shape[1]))
    for i, held in enumerate(columns):
        x[i, held] = 1
    x[:, features:] = _logit(earlier)
    return x


def _trainer(category: int, features: int, s: ChainSettings):
    """A task's work: fit without fold ``part`` and predict it, or fit on all where no fold has that number."""

    def train(key: tuple[pa.Scalar, ...], groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(groups)).sort_by("row")
        part = key[0].as_py()
        earlier = np.asarray(table.column("earlier").to_pylist(), float).reshape(table.num_rows, category)
        x = _inputs(table.column("held").to_pylist(), features, earlier)
        y = np.asarray([v[category] for v in table.column("y").to_pylist()], float)
        own = table.column("fold").to_numpy() == part
        w = fit_logistic(x[~own], y[~own], s.ridge)
        if part == s.folds:
            found = [{"part": part, "row": None, "chance": None, "weights": w.tolist()}]
            yield pa.RecordBatch.from_pylist(found, schema=_fit_schema)
        else:
            chance = 1 / (1 + np.exp(-np.clip(x[own] @ w[:-1] + w[-1], -30, 30)))
            n = int(own.sum())
            rows = table.column("row").filter(pa.array(own)).combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, np.int32)), rows, pa.array(chance), pa.nulls(n, pa.list_(pa.float64()))],
                schema=_fit_schema,
            )

    return train


def _held(vocabulary: np.ndarray):
    """A column function: word hashes to places in the vocabulary."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def held(listed: pa.Array) -> pa.Array:
        counts = pc.list_value_length(listed).to_numpy(zero_copy_only=False).astype(np.int64)
        hashed = listed.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        at = np.searchsorted(vocabulary, hashed)
        known = at < len(vocabulary)
        known[known] = vocabulary[at[known]] == hashed[known]
        row = np.repeat(np.arange(len(counts)), counts)[known]
        return list_array(at[known].astype(np.int32), np.bincount(row, minlength=len(counts)), pa.int32())

    return held


def fit_chain(scratch: Scratch, sample: DataFrame, categories: int, s: ChainSettings) -> tuple[np.ndarray, list[np.ndarray]]:
    """The selected words and one weight vector per category, from ``sample(row, y, words)``.

    For each category a task per fold fits on the other folds and predicts its own, and one more task fits on
    all; each holds the bounded sample once.
    """
    vocabulary = _select_words(sample, categories, s)
    fold = F.pmod(F.xxhash64("row", F.lit(11)), F.lit(s.folds)).cast("int")
    rows = scratch.store(
        sample.select("row", fold.alias("fold"), "y", _held(vocabulary)(F.col("words")).alias("held"))
    ).withColumn("earlier", F.array().cast("array<double>"))
    models: list[np.ndarray] = []
    for category in range(categories):
        dealt = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(s.folds))))
        fitted = scratch.store(dealt.groupBy("part").applyInArrow(_trainer(category, len(vocabulary), s), _FIT))
        whole = fitted.filter(F.col("part") == s.folds).select("weights").first()
        models.append(np.asarray(whole["weights"]) if whole else np.zeros(len(vocabulary) + category + 1))
        chances = fitted.filter("row is not null").select("row", "chance")
        rows = scratch.store(
            rows.join(chances, "row").withColumn("earlier", F.concat("earlier", F.array("chance"))).drop("chance")
        )
    return vocabulary, models


_fit_schema = pa.schema([
    ("part", pa.int32()), ("row", pa.int64()), ("chance", pa.float64()), ("weights", pa.list_(pa.float64())),
])


def scorer(vocabulary: np.ndarray, models: list[np.ndarray]):
    """A column function: text to the array of category probabilities, each fed to the later ones."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def chances(text: pa.Array) -> pa.Array:
        parts = [np.zeros((0, len(models)))]
        for texts in text_slices(text):
            row, hashed = _features(texts)
            at = np.searchsorted(vocabulary, hashed)
            known = at < len(vocabulary)
            known[known] = vocabulary[at[known]] == hashed[known]
            row, at = _distinct(row[known], at[known])
            out = np.zeros((texts.rows, len(models)))
            for k, w in enumerate(models):
                size = len(vocabulary)
                score = np.bincount(row, weights=w[at], minlength=texts.rows) + w[-1]
                score = score + _logit(out[:, :k]) @ w[size : size + k]
                out[:, k] = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
            parts.append(out)
        table = np.concatenate(parts)
        return list_array(table.reshape(-1), np.full(len(table), len(models)), pa.float64())

    return chances


def category_labels(toxic: Column, text: Column) -> Column:
    """0-1 labels in chain order: the categories a toxic text has words of, then the label itself."""
    spaced = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), "[^a-z]+", " "), F.lit(" "))
    weak = [toxic & spaced.rlike(f" ({'|'.join(listed)}) ") for listed in CATEGORY_WORDS.values()]
    return F.array(*[F.coalesce(c, F.lit(False)).cast("int") for c in (*weak, toxic)])


def score_toxicity(docs: DataFrame, labels: DataFrame, s: ChainSettings = ChainSettings()) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, p_insult, p_contempt, p_toxic, toxic.

    ``labels(doc_id, toxic)`` names the training documents; null labels are left out, and of a family of
    copies or near copies the one with the smallest doc_id, then text, trains for each label. A null or empty text is
    scored by the intercepts. Without labels of both kinds the chain predicts the base rate. Repeated
    rows get equal scores; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = labels.filter("toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.col("toxic").cast("int")).alias("toxic")
    )
    share = s.fit_rows / max(s.fit_rows, marks.count())
    chosen = marks.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < int(share * 1_000_000))
    labelled = texts.join(chosen, "doc_id").select(
        F.col("doc_id").alias("row"), category_labels(F.col("toxic") == 1, F.col("text")).alias("y"), "text"
    )
    place = F.struct("row", F.xxhash64("words"))
    families = word_sets(labelled).groupBy("family", "y").agg(F.min(place).alias("first"), F.min_by("words", place).alias("words"))
    sample = scratch.store(families.select(F.col("first.row").alias("row"), "y", "words"))
    vocabulary, models = fit_chain(scratch, sample, len(CATEGORY_WORDS) + 1, s)
    chance = scorer(vocabulary, models)(F.col("text"))
    names = [*CATEGORY_WORDS, "toxic"]
    return texts.select("doc_id", chance.alias("chance")).select(
        "doc_id", *[F.col("chance")[k].alias(f"p_{name}") for k, name in enumerate(names)],
        (F.col("chance")[len(names) - 1] >= s.threshold).alias("toxic"),
    )
