"""Benchmark decontamination by templates: windows of placeholders and words joined by hash.

Benchmark items with one template form a class. A document matches a class where enough of the class's
windows meet the document's at one offset. Slots must be consistent there: one value of the
benchmark's slots always meets the same value of the document. Then the passage is an exact copy of an
item, or the item with other numbers, names and units put in.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.llm.common import Scratch, arrow_pass
from rankweave.llm.kernels import U, list_array, mix, text_slices
from rankweave.llm.templates import Canonical, canonical


@dataclass(frozen=True)
class TemplateSettings:
    """``window`` tokens a window; ``coverage``: least share of a template's windows that match;
    ``drift``: tokens by which neighbouring matches of one passage may be shifted.

    The benchmark's window hashes set bits in a bitmap that every task tests its windows against
    before they are shuffled: about 32 bits a window, 2 ** ``most_bitmap_bits`` at most.
    """

    window: int = 8
    coverage: float = 0.5
    drift: int = 3
    most_bitmap_bits: int = 28


_ITEM = "item_id long, text string, template long, slot_at array<int>, slot_value array<long>"
_WINDOW = "template long, size int, n_windows int, at int, hash long, slot_at array<int>, slot_value array<long>"
_FOUND = "doc_id long, text_key long, at int, hash long, slot_value array<long>"
_BYTES = 1 << 18  # of texts canonicalised at once
def _slots(c: Canonical, starts: np.ndarray, size: int, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, places and values of the slots of each window."""
    inside = starts[:, None] + np.arange(size)
    marked = c.slot[inside] & used[:, None] if len(starts) else np.zeros((0, size), bool)
    return marked.sum(axis=1), inside[marked], c.value[inside[marked]]


def benchmark_items(benchmark: DataFrame, window: int) -> DataFrame:
    """Every item with a hash of all its windows, its template, and the slots that these windows have.

    Items without a word have no row.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [part(batch.slice(t.first, t.rows), canonical(t)) for t in text_slices(batch.column("text"))]
        return _joined(parts, _ITEM_SCHEMA)

    def part(batch: pa.RecordBatch, c: Canonical) -> pa.RecordBatch:
        n = np.bincount(c.row, minlength=batch.num_rows)
        first = np.concatenate([[0], np.cumsum(n)])[:-1]
        whole = n.astype(np.uint64)
        slots: list[np.ndarray] = [np.zeros((3, 0), np.int64)]
        for size in sorted({min(window, int(k)) for k in n if k}):
            for turn, (v, start, hashed, used) in enumerate(c.versions(size)):
                keep = np.minimum(n[v.row[start]], window) == size
                start, hashed, used = start[keep], hashed[keep], used[keep]
                if not turn:
                    np.add.at(whole, v.row[start], mix(hashed ^ mix((v.place[start] + 1).astype(np.uint64))))
                _, at, values = _slots(v, start, size, used)
                slots.append(np.stack([v.row[at], v.place[at], values.view(np.int64)]))
        row, at, values = np.unique(np.concatenate(slots, axis=1), axis=1)
        kept = np.flatnonzero(n > 0)
        counts = np.bincount(row, minlength=batch.num_rows)[kept]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("item_id").cast(pa.int64()).take(pa.array(kept)),
                batch.column("text").take(pa.array(kept)),
                pa.array(mix(whole).view(np.int64)[kept]),
                list_array(at.astype(np.int32), counts, pa.int32()),
                list_array(values, counts, pa.int64()),
            ],
            schema=_ITEM_SCHEMA,
        )

    return arrow_pass(benchmark.select("item_id", "text"), step, _ITEM)


def template_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """The windows of ``benchmark(template, text)``: one of the whole template if it is shorter.

    Windows with a capitalised word that opens a sentence come twice: with the word, and with a name
    in its place. Places are those of the tokens without that change.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = []
        for t in text_slices(batch.column("text")):
            c = canonical(t)
            n = np.bincount(c.row, minlength=t.rows)
            for size in sorted({min(window, int(k)) for k in n if k}):
                found = []
                for v, start, hashed, used in c.versions(size):
                    keep = np.minimum(n[v.row[start]], window) == size
                    found.append((v, start[keep], hashed[keep], used[keep]))
                places = np.unique(np.concatenate([np.stack([v.row[x], v.place[x]]) for v, x, _, _ in found], axis=1), axis=1)
                total = np.bincount(places[0], minlength=t.rows)
                for v, start, hashed, used in found:
                    counts, at, values = _slots(v, start, size, used)
                    row = v.row[start]
                    parts.append(pa.RecordBatch.from_arrays(
                        [
                            batch.column("template").take(pa.array(t.first + row)),
                            pa.array(np.full(len(start), size, np.int32)),
                            pa.array(total[row].astype(np.int32)),
                            pa.array(v.place[start].astype(np.int32)),
                            pa.array(hashed.view(np.int64)),
                            list_array(v.place[at].astype(np.int32), counts, pa.int32()),
                            list_array(values.view(np.int64), counts, pa.int64()),
                        ],
                        schema=_WINDOW_SCHEMA,
                    ))
        return _joined(parts, _WINDOW_SCHEMA)

    return arrow_pass(benchmark.select("template", "text"), step, _WINDOW)


def _joined(parts: list[pa.RecordBatch], schema: pa.Schema) -> pa.RecordBatch:
    whole = pa.Table.from_batches(parts, schema).combine_chunks().to_batches()
    return whole[0] if whole else pa.RecordBatch.from_pylist([], schema=schema)


_ITEM_SCHEMA = pa.schema([
    ("item_id", pa.int64()), ("text", pa.string()), ("template", pa.int64()),
    ("slot_at", pa.list_(pa.int32())), ("slot_value", pa.list_(pa.int64())),
])
_WINDOW_SCHEMA = pa.schema([
    ("template", pa.int64()), ("size", pa.int32()), ("n_windows", pa.int32()), ("at", pa.int32()),
    ("hash", pa.int64()), ("slot_at", pa.list_(pa.int32())), ("slot_value", pa.list_(pa.int64())),
])


def _bitmap(windows: DataFrame, bits: int) -> np.ndarray:
    """A bit for every window hash; at most 2 ** (bits - 6) rows come to the driver."""
    place = F.shiftrightunsigned("hash", 64 - bits)
    rows = windows.groupBy(F.shiftright(place, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - bits}) & 63 as int))")).alias("held")
    ).toArrow()
    out = np.zeros(2 ** (bits - 6), np.int64)
    out[rows.column("word").to_numpy()] = rows.column("held").to_numpy()
    return out


def _document_windows(docs: DataFrame, sizes: list[int], bitmap: np.ndarray, bits: int) -> DataFrame:
    """The windows of ``docs(doc_id, text_key, text)`` whose hash has its bit set."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = shared.value
        columns: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(5)]
        for t in text_slices(batch.column("text"), _BYTES):  # no text is cut
            c = canonical(t)
            for size in sizes:
                for v, start, hashed, used in c.versions(size):
                    place = (hashed >> U(64 - bits)).astype(np.int64)
                    hit = (held[place >> 6] >> (place & 63)) & 1 == 1
                    start, hashed, used = start[hit], hashed[hit], used[hit]
                    counts, _, values = _slots(v, start, size, used)
                    found = (t.first + v.row[start], v.place[start], hashed.view(np.int64), counts, values.view(np.int64))
                    for out, new in zip(columns, found):
                        out.append(new)
        row, at, hashed, counts, values = (np.concatenate(x) for x in columns)
        which = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").cast(pa.int64()).take(which), batch.column("text_key").take(which),
                pa.array(at.astype(np.int32)), pa.array(hashed), list_array(values, counts, pa.int64()),
            ],
            ["doc_id", "text_key", "at", "hash", "slot_value"],
        )

    return arrow_pass(docs.select("doc_id", "text_key", "text"), step, _FOUND)


def _filling(slots: Column) -> Column:
    """A hash of the values in slot order of an array of (slot_at, value)."""
    return F.xxhash64(F.transform(F.array_sort(slots), lambda s: s["value"]))


def _passages(met: DataFrame, drift: int) -> DataFrame:
    """``met`` with the passage of each match: shifts of one text and template at most ``drift`` apart."""
    key = ["doc_id", "text_key", "template"]
    by_shift = Window.partitionBy(*key).orderBy("shift")
    shifts = met.select(*key, "shift").distinct().withColumn(
        "opens", F.when(F.col("shift") - F.lag("shift").over(by_shift) <= drift, 0).otherwise(1)
    )
    numbered = shifts.select(
        *[F.col(c).alias(f"_{c}") for c in key], F.col("shift").alias("_shift"), F.sum("opens").over(by_shift).alias("passage")
    )
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*key, "shift"]]
    return met.join(numbered, same).drop("_shift", *[f"_{c}" for c in key])


def _without_overlaps(runs: DataFrame) -> DataFrame:
    """Runs of one text and template that meet no better one: more windows, then the earlier."""
    better = runs.select(
        F.col("doc_id").alias("_doc_id"), F.col("text_key").alias("_text_key"), F.col("template").alias("_template"),
        F.col("hits").alias("_hits"), F.col("from_word").alias("_from"), F.col("to_word").alias("_to"), F.col("passage").alias("_passage"),
    )
    stronger = (F.col("_hits") > F.col("hits")) | ((F.col("_hits") == F.col("hits")) & (F.col("_passage") < F.col("passage")))
    meets = (F.col("_from") < F.col("to_word")) & (F.col("_to") > F.col("from_word"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_key") == F.col("_text_key")) & (F.col("template") == F.col("_template"))
    return runs.join(better, same & stronger & meets, "left_anti")


def contaminated(docs: DataFrame, benchmark: DataFrame, s: TemplateSettings = TemplateSettings()) -> DataFrame:
    """One row per passage of a document, of ``docs(doc_id, text)``, that holds a benchmark item.

    doc_id, text_key (hash of the text), item_id, kind (exact, edited or reparameterised), from_word and
    to_word (places among the document's tokens, end exclusive), coverage (share of the item's distinct
    windows), n_slots. Windows count together at neighbouring shifts, so words added inside a passage
    do not break it. Passages of one template that overlap give the one with most windows, others a row each. The item is the
    one with the passage's values in all covered slots: ``exact`` if all its slots are covered, ``edited`` if
    some; else the template's smallest item. Where slots contradict each other, only windows
    without slots count. Null and empty texts on either side match nothing; an empty benchmark or no
    documents give no rows; rows of equal doc_id and text give one row. Very long texts are read
    whole; further columns are not read. Runs jobs and writes below ``spark.checkpoint.dir`` when called.
    """
    scratch = Scratch(docs.sparkSession, "decontamination")
    items = scratch.store(benchmark_items(benchmark, s.window))
    leaders = items.groupBy("template").agg(F.min(F.struct("item_id", "text")).alias("lead")).select("template", "lead.*")
    windows = scratch.store(template_windows(leaders, s.window))
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most ``window`` values
    bits = min(s.most_bitmap_bits, max(20, (32 * windows.count()).bit_length()))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    found = _document_windows(keyed, sizes, _bitmap(windows, bits), bits)

    theirs = windows.select(
        "hash", "template", "n_windows", "size", F.col("at").alias("item_at"), "slot_at", F.col("slot_value").alias("item_value")
    )
    passage = ["doc_id", "text_key", "template", "passage"]
    matches = scratch.store(found.join(theirs, "hash").withColumn("shift", F.col("at") - F.col("item_at")))
    met = scratch.store(_passages(matches, s.drift))
    runs = met.groupBy(*passage).agg(
        F.countDistinct("item_at").alias("hits"),
        F.countDistinct(F.when(F.size("slot_at") == 0, F.col("item_at"))).alias("plain_hits"),
        F.max("n_windows").alias("n_windows"), F.min("at").alias("from_word"),
        F.max(F.col("at") + F.col("size")).alias("to_word"),
    ).filter(F.col("hits") >= s.coverage * F.col("n_windows"))
    filled = (
        met.filter(F.size("slot_at") > 0)
        .select(*passage, F.explode(F.arrays_zip("slot_at", "item_value", F.col("slot_value"))).alias("slot")).distinct()
    )
    slots = (
        filled.groupBy(*passage)
        .agg(F.collect_list("slot").alias("slots"))
        .select(
            *[F.col(c).alias(f"_{c}") for c in passage],
            F.size(F.array_distinct(F.transform("slots", lambda x: x["item_value"]))).alias("n_values"),
            F.size(F.array_distinct(F.transform("slots", lambda x: F.struct(x["item_value"], x["slot_value"])))).alias("n_pairs"),
            F.size("slots").alias("n_slots"),
            _filling(F.transform("slots", lambda x: F.struct(x["slot_at"].alias("at"), x["slot_value"].alias("value")))).alias("filling"),
        )
    )
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in passage]
    judged = runs.join(slots, same, "left").withColumn("consistent", F.coalesce(F.col("n_values") == F.col("n_pairs"), F.lit(True)))
    judged = judged.withColumn("hits", F.when(F.col("consistent"), F.col("hits")).otherwise(F.col("plain_hits")))
    judged = judged.withColumn("coverage", F.col("hits") / F.col("n_windows")).filter(F.col("coverage") >= s.coverage)
    judged = judged.select(*passage, "hits", "coverage", "from_word", "to_word", F.coalesce("n_slots", F.lit(0)).alias("n_slots"), "filling")
    best = scratch.store(_without_overlaps(scratch.store(judged)))
    members = items.select(
        F.col("template").alias("_template"), "item_id", F.size("slot_at").alias("n_item_slots"),
        _filling(F.transform(F.arrays_zip("slot_at", "slot_value"), lambda x: F.struct(x["slot_at"].alias("at"), x["slot_value"].alias("value")))).alias("item_filling"),
    )
    exact = members.groupBy("_template", "n_item_slots", "item_filling").agg(F.min("item_id").alias("exact_id"))
    plain = exact.filter("n_item_slots = 0").select(F.col("_template").alias("plain_template"), F.col("exact_id").alias("plain_id"))
    named = (
        best.join(
            exact, (F.col("template") == F.col("_template")) & (F.col("n_slots") == F.col("n_item_slots"))
            & (F.col("filling") == F.col("item_filling")), "left",
        )
        .join(plain, F.col("template") == F.col("plain_template"), "left")
        .join(leaders.select(F.col("template").alias("lead_template"), F.col("item_id").alias("lead_id")), F.col("template") == F.col("lead_template"))
        .withColumn("exact_id", F.coalesce("exact_id", "plain_id"))
        .select(*passage, "exact_id", "lead_id", "from_word", "to_word", "coverage", "n_slots")
    )
    partly = _agreeing(named, filled, items, passage)
    return named.join(partly, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in passage], "left").select(
        "doc_id", "text_key", F.coalesce("exact_id", "edited_id", "lead_id").alias("item_id"),
        F.when(F.col("exact_id").isNotNull(), "exact").when(F.col("edited_id").isNotNull(), "edited").otherwise("reparameterised").alias("kind"),
        "from_word", "to_word", "coverage", "n_slots",
    )


def _agreeing(named: DataFrame, filled: DataFrame, items: DataFrame, passage: list[str]) -> DataFrame:
    """The smallest item that has a passage's values in all its covered slots, where not all are covered."""
    open_ = named.filter("exact_id IS NULL AND n_slots > 0").select(*[F.col(c).alias(f"_{c}") for c in passage], "n_slots")
    values = filled.join(open_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in passage]).select(
        *[f"_{c}" for c in passage], "n_slots", F.col("slot.slot_at").alias("slot_at"), F.col("slot.slot_value").alias("slot_value")
    )
    theirs = items.select(F.col("template").alias("_template"), "item_id", F.explode(F.arrays_zip("slot_at", "slot_value")).alias("slot"))
    theirs = theirs.select("_template", "item_id", F.col("slot.slot_at").alias("slot_at"), F.col("slot.slot_value").alias("slot_value"))
    agreed = values.join(theirs, ["_template", "slot_at", "slot_value"]).groupBy(*[f"_{c}" for c in passage], "n_slots", "item_id").count()
    return agreed.filter(F.col("count") == F.col("n_slots")).groupBy(*[f"_{c}" for c in passage]).agg(F.min("item_id").alias("edited_id"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, s: TemplateSettings = TemplateSettings()) -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage; all columns kept."""
    gone = contaminated(docs, benchmark, s).select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    packed = docs.select(
        F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_key")
    )
    same = F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("text_key") == F.col("gone_key"))
    return packed.join(gone, same, "left_anti").select("doc.*")
