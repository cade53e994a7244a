"""Near-duplicate documents: fast similarity sketching, banding, exact confirmation, components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import Scratch, arrow_pass, components
from rankweave.llm.kernels import U, list_array, mix, shingles, text_slices
from rankweave.llm.similarity_sketch import bands, sketch


@dataclass(frozen=True)
class NearDedupSettings:
    """``percent`` of intersection to union links two documents.

    With 48 bands of 6 coordinates a pair at 0.8 shares no band with probability 5e-7; pairs above
    share one more surely. ``block``: members of a hub compared at once.
    """

    words: int = 5
    percent: int = 80
    bands: int = 48
    per_band: int = 6
    block: int = 512


def sketch_documents(docs: DataFrame, settings: NearDedupSettings) -> DataFrame:
    """doc_id, n_shingles, a 128-bit key of the shingle set, and the set's band keys (empty set: none)."""
    t = settings.bands * settings.per_band

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, keys, found = [], ([], []), []
        for texts in text_slices(batch.column("text")):
            rows, hashes = shingles(texts, settings.words)
            n = np.bincount(rows, minlength=texts.rows)
            for out, salt in zip(keys, (0xA5A5A5A5A5A5A5A5, 0x3C3C3C3C3C3C3C3C)):
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ U(salt)))])
                ends = np.cumsum(n)
                out.append(mix(sums[ends] - sums[ends - n] + n.astype(np.uint64)))
            table = sketch(rows, hashes, texts.rows, t)
            counts.append(n)
            found.append(bands(table, settings.per_band)[n > 0])
        n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        listed = np.concatenate(found) if found else np.zeros((0, settings.bands), np.uint64)
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").cast(pa.int64()),
                pa.array(n, pa.int64()),
                *[pa.array(np.concatenate(k).view(np.int64) if k else [], pa.int64()) for k in keys],
                list_array(listed.reshape(-1).view(np.int64), np.where(n > 0, settings.bands, 0), pa.int64()),
            ],
            ["doc_id", "n_shingles", "key_1", "key_2", "bands"],
        )

    schema = "doc_id long, n_shingles long, key_1 long, key_2 long, bands array<long>"
    return arrow_pass(docs.select("doc_id", "text"), step, schema)


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id and the whole set of shingle hashes of the text."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, values = [], []
        for texts in text_slices(batch.column("text")):
            rows, hashes = shingles(texts, words)
            counts.append(np.bincount(rows, minlength=texts.rows))
            values.append(hashes.view(np.int64))
        held = list_array(
            np.concatenate(values) if values else np.zeros(0, np.int64),
            np.concatenate(counts) if counts else np.zeros(0, np.int64),
            pa.int64(),
        )
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), held], ["doc_id", "shingles"])

    return arrow_pass(docs.select("doc_id", "text"), step, "doc_id long, shingles array<long>")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets pass: 100 x intersection >= percent x union."""
    first = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a")), "a")
    both = first.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b")), "b")
    a, b = F.size("set_a"), F.size("set_b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    likely = 100 * F.least(a, b) >= percent * F.greatest(a, b)
    passed = F.when(likely, 100 * common >= percent * (a + b - common)).otherwise(False)
    return both.filter(passed).select("a", "b")


def _with_hubs(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """(band, rep, hub) of the buckets of two or more: the hub is the member that meets most others.

    In a group of copies with edits the text they come from shares bands with more of them than any
    of them does, so nearly all links are found against it.
    """
    sizes = rows.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    shared = scratch.store(rows.join(sizes, "band"))
    met = shared.groupBy("rep").agg(F.sum(F.col("n") - 1).alias("met"))
    ranked = shared.join(met, "rep").select("band", F.struct("met", (-F.col("rep")).alias("turned")).alias("rank"))
    hubs = ranked.groupBy("band").agg((-F.max("rank")["turned"]).alias("hub"))
    return shared.select("band", "rep").join(hubs, "band")


def _apart(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(hub, rep, label) of the members that still differ in label from others in a bucket of that hub."""
    rest = buckets.filter("rep <> hub").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    rest = rest.select("band", "hub", "rep", F.coalesce("label", "rep").alias("label"))
    split = rest.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    return rest.join(split.select("band"), "band").select("hub", "rep", "label").distinct()


def compare_blocks(apart: DataFrame, sets: DataFrame, settings: NearDedupSettings) -> DataFrame:
    """Links (a, b) between members of one hub in different components, on full sets.

    The members of a hub are dealt into blocks of about ``block`` by hash; a task gets two blocks and
    compares those outside its most common component with all others, as products of 0-1 matrices. No
    pair becomes a row unless it is a link, and no task grows with the group.
    """
    sizes = apart.groupBy("hub").agg(F.ceil(F.count("*") / settings.block).alias("blocks"))
    dealt = apart.join(sizes, "hub").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    placed = dealt.select(
        "hub", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", "rep", "label"
    )
    held = placed.join(sets.withColumnRenamed("doc_id", "rep"), "rep")

    def compare(key: tuple[pa.Scalar, ...], groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(groups)).combine_chunks()
        reps, labels, own = (table.column(c).to_numpy() for c in ("rep", "label", "own"))
        lists = table.column("shingles").combine_chunks()
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        token, index = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        row = np.repeat(np.arange(len(reps)), counts)
        names, many = np.unique(labels, return_counts=True)
        asked = np.flatnonzero(labels != names[many.argmax()])
        common = np.zeros((len(asked), len(reps)), np.float32)
        order = np.argsort(index, kind="stable")
        row, index = row[order], index[order]
        for low in range(0, len(token), 4096):
            a, b = np.searchsorted(index, [low, low + 4096])
            part = np.zeros((len(reps), 4096), np.float32)
            part[row[a:b], index[a:b] - low] = 1
            common += part[asked] @ part.T
        union = counts[asked][:, None] + counts[None, :] - common
        linked = (100 * common >= settings.percent * union) & (labels[asked][:, None] != labels[None, :])
        if key[1].as_py() != key[2].as_py():  # pairs within a block belong to the task of that block
            linked &= own[asked][:, None] != own[None, :]
        x, y = np.nonzero(linked)
        yield pa.RecordBatch.from_arrays([pa.array(reps[asked[x]]), pa.array(reps[y])], ["a", "b"])

    return held.groupBy("hub", "one", "two").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, settings: NearDedupSettings = NearDedupSettings()) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id, kept.

    Documents with equal shingle sets form one class, which its smallest doc_id stands for. Classes
    that share a band are candidates. In each bucket all members are confirmed against one hub, on
    full sets; members that are still apart from others of their bucket are compared with them in
    blocks, so no candidate link is lost and groups of copies are not expanded into pairs.

    Null or wordless texts have no shingles and are linked with nothing. A row without doc_id is
    linked with nothing either: component_id null, kept. Rows that share a doc_id are one document. Very
    long texts are read whole; an empty table gives no rows; further columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "near-dedup")
    sketched = scratch.store(sketch_documents(docs, settings))
    usable = sketched.filter("doc_id is not null and n_shingles > 0")
    classes = usable.groupBy("key_1", "key_2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    rows = classes.select("rep", F.explode("bands").alias("band"))
    buckets = scratch.store(_with_hubs(scratch, rows))
    wanted = buckets.select(F.col("rep").alias("doc_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = scratch.store(shingle_sets(texts.join(wanted, "doc_id", "left_semi"), settings.words))

    tested = buckets.filter("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    labels = components(scratch, confirm(tested, sets, settings.percent))
    apart = scratch.store(_apart(buckets, labels))
    if not apart.isEmpty():
        edges = compare_blocks(apart, sets, settings)
        known = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
        labels = components(scratch, edges.unionByName(known))

    members = usable.select("doc_id", "n_shingles", "key_1", "key_2").join(
        classes.select("key_1", "key_2", "rep"), ["key_1", "key_2"]
    )
    placed = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "doc_id", "n_shingles", F.coalesce("label", "rep").alias("component_id")
    )
    alone = sketched.filter("doc_id is null or n_shingles = 0").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id")
    )
    return placed.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one_of_each(docs: DataFrame, settings: NearDedupSettings = NearDedupSettings()) -> DataFrame:
    """``docs`` without the documents that another one of their component stands for; all columns kept.

    Rows that share a doc_id are one document, of which the row with the smallest hash of its text stays, then the first as JSON.
    """
    found = near_duplicates(docs, settings).filter("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    packed = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("id"))
    kept = packed.join(found, F.col("id") == F.col("gone_id"), "left_anti")
    again = docs.select(F.col("doc_id").cast("long").alias("again")).filter("again is not null").groupBy("again").count()
    again = again.filter("count > 1").select("again")
    if again.isEmpty():
        return kept.select("doc.*")
    order = F.struct(F.xxhash64("doc.text"), F.to_json("doc"))
    repeated = kept.join(again, F.col("id") == F.col("again"), "left_semi").groupBy("id").agg(F.min_by("doc", order).alias("doc"))
    once = kept.join(again, F.col("id") == F.col("again"), "left_anti")
    return once.select("doc.*").unionByName(repeated.select("doc.*"))
