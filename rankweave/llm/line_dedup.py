"""Line dedup by overlapping windows of three lines.

Lines without a word are not counted. Every run of three counted lines is hashed; a window found
more than once anywhere stays where it comes first (by doc_id, then place), and the lines that its later
occurrences cover are removed, overlapping covers merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.llm.common import arrow_pass
from rankweave.llm.kernels import Lines, Texts, chain, hash_spans, lines, text_slices, words

WINDOW = 3
_WINDOWS = "doc_id long, text_key long, at int, hash long, size long"
_CLEANED = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()),
    T.StructField("n_removed", T.LongType()),
])


def _worded(texts: Texts, split: Lines) -> np.ndarray:
    found = words(texts).start
    return np.searchsorted(found, split.start) < np.searchsorted(found, split.end)


def line_windows(docs: DataFrame) -> DataFrame:
    """Every window of ``docs(doc_id, text_key, text)``: where its first counted line is, hash, bytes."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, places, hashes, sizes = [], [], [], []
        for texts in text_slices(batch.column("text")):
            split = lines(texts)
            worded = _worded(texts, split)
            row, start, end = split.row[worded], split.start[worded], split.end[worded]
            hashed, at = chain(hash_spans(texts.data, start, end), row, WINDOW)
            rows.append(texts.first + row[at])
            places.append(at - np.searchsorted(row, row[at]))
            hashes.append(hashed.view(np.int64))
            sizes.append(sum((end - start)[at + k] for k in range(WINDOW)))
        gather = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts]).astype(kind)
        which = pa.array(gather(rows, np.int64))
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").cast(pa.int64()).take(which), batch.column("text_key").take(which),
                pa.array(gather(places, np.int32)), pa.array(gather(hashes, np.int64)),
                pa.array(gather(sizes, np.int64)),
            ],
            ["doc_id", "text_key", "at", "hash", "size"],
        )

    return arrow_pass(docs.select("doc_id", "text_key", "text"), step, _WINDOWS)


@F.arrow_udf(_CLEANED)
def _without(text: pa.Array, from_line: pa.Array, to_line: pa.Array) -> pa.Array:
    """Each text without the counted lines of its [from, to] covers, and the line counts."""
    out, counted, removed = [], [], []
    firsts, lasts, given = from_line.to_pylist(), to_line.to_pylist(), text.to_pylist()
    for texts in text_slices(text):
        split = lines(texts)
        worded = _worded(texts, split)
        bounds = np.searchsorted(split.row, np.arange(texts.rows + 1))
        for k in range(texts.rows):
            row = texts.first + k
            low, high = bounds[k], bounds[k + 1]
            real = worded[low:high]
            n = int(real.sum())
            counted.append(n)
            if not firsts[row]:
                out.append(given[row])
                removed.append(0)
                continue
            depth = np.zeros(n + 1, np.int64)
            np.add.at(depth, np.asarray(firsts[row]), 1)
            np.add.at(depth, np.asarray(lasts[row]) + 1, -1)
            gone = np.concatenate([np.cumsum(depth)[:n] > 0, [False]])
            # A line without words goes with the counted line before it.
            cut = gone[np.cumsum(real) - 1]
            pieces = given[row].split("\n")
            out.append("\n".join([pieces[i] for i in np.flatnonzero(~cut)]))
            removed.append(int(gone[:n].sum()))
    return pa.StructArray.from_arrays(
        [pa.array(out, pa.string()), pa.array(counted, pa.int64()), pa.array(removed, pa.int64())],
        ["text", "n_lines", "n_removed"],
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """Every row of ``docs(doc_id, text, ...)`` as ``doc``, with ``cleaned(text, n_lines, n_removed)``.

    ``n_lines`` counts lines with a word. Texts of fewer than three such lines, null texts (they stay
    null) and texts without repeats are unchanged. Rows of equal doc_id and text are one document:
    they do not repeat each other. Null doc_ids come last in the order. An occurrence that overlaps
    the first one in the same text loses only the lines beyond it. Very long texts are read whole; an empty
    table gives no rows; further columns stay in ``doc``, whatever their names.
    """
    key = F.xxhash64("text")
    windows = line_windows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("text_key"), "text"))
    place = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc"), "text_key", "at")
    repeated = (
        windows.groupBy("hash", "size").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1")
    )
    same = (F.coalesce("doc_id", F.lit(2**63 - 1)) == F.col("first.doc")) & (F.col("text_key") == F.col("first.text_key"))
    covers = (
        windows.join(repeated, ["hash", "size"])
        .select(
            "doc_id", "text_key",
            F.when(same, F.greatest("at", F.col("first.at") + WINDOW)).otherwise(F.col("at")).alias("from_line"),
            (F.col("at") + WINDOW - 1).alias("to_line"),
        )
        .filter("from_line <= to_line")
        .distinct()
        .groupBy(F.col("doc_id").alias("cover_id"), F.col("text_key").alias("cover_key"))
        .agg(F.collect_list(F.struct("from_line", "to_line")).alias("covers"))
    )
    packed = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("id"), key.alias("text_key"))
    met = packed.join(covers, F.col("id").eqNullSafe(F.col("cover_id")) & (F.col("text_key") == F.col("cover_key")), "left")
    return met.select("doc", _without(F.col("doc.text"), F.col("covers.from_line"), F.col("covers.to_line")).alias("cleaned"))


def apply(docs: DataFrame) -> DataFrame:
    """``docs`` with the cleaned texts and, where there is one, a new ``n_chars``; all other columns stay.

    A document that loses all its lines with words is a copy of earlier text and goes.
    """
    cleaned = dedup_lines(docs).filter("cleaned.n_removed = 0 or cleaned.n_removed < cleaned.n_lines")
    changed = F.col("cleaned.n_removed") > 0
    new = {"text": F.col("cleaned.text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(changed, F.length("cleaned.text").cast(kind)).otherwise(F.col("doc.n_chars"))
    return cleaned.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
