"""Main text of web pages by wrappers inferred from each host's pages.

Every task aligns its pages, host by host, into union-free expressions (``wrappers``); expressions of one host
are aligned with each other in rounds of small groups until one is left, so a host of any size takes
part in parallel and no group grows with the pages. The host's expression tells which places hold
articles, and it is laid over every page.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import Scratch
from rankweave.llm.markup import Tags
from rankweave.llm.wrappers import Element, Rules, add_page, decide, expression, merged

GROUP = 16  # expressions aligned in one group
_HELD = 20_000  # pages (of 10,000 characters) a task aligns before it hands its expressions on
_WRAPPER = "host string, n_pages long, wrapper string"
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def _with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), _HOST, 1))
    return pages.select("page_id", "url", "html", host.alias("host"))


def _inferred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Expressions of the pages of a task, one or more per host."""
    tags = Tags()
    held: dict[str, Element] = {}
    size = 0

    def rows() -> pa.RecordBatch:
        out = pa.record_batch(
            [
                pa.array(list(held), pa.string()), pa.array([e.pages for e in held.values()], pa.int64()),
                pa.array([json.dumps(e.dump()) for e in held.values()], pa.string()),
            ],
            names=["host", "n_pages", "wrapper"],
        )
        held.clear()
        return out

    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            if page is not None:
                add_page(held.setdefault(host, Element()), page, tags)
                size += 1 + len(page) // 10_000
        if size > _HELD:
            yield rows()
            size = 0
    yield rows()


def _merged(key: tuple, group: pa.Table) -> pa.Table:
    root = merged(group.column("wrapper").to_pylist())
    return pa.table(
        {"host": [key[0].as_py()], "n_pages": pa.array([root.pages], pa.int64()), "wrapper": [json.dumps(root.dump())]}
    )


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roots = [Element.load(json.loads(w)) for w in batch.column("wrapper").to_pylist()]
        yield pa.record_batch(
            [
                batch.column("host"), batch.column("n_pages"), pa.array(map(expression, roots), pa.string()),
                pa.array([json.dumps(decide(r)) for r in roots], pa.string()),
            ],
            names=["host", "n_pages", "expression", "rules"],
        )


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, n_pages, expression, rules): one wrapper per host of ``pages(page_id, url, html)``.

    The host is the part of the url between scheme and path, lower-cased; null and odd urls share ''.
    Pages with null html take no part. Runs jobs and writes below ``spark.checkpoint.dir`` when called.
    """
    scratch = Scratch(pages.sparkSession, "wrappers")
    number = F.monotonically_increasing_id()
    known = _with_host(pages).select("host", "html").mapInArrow(_inferred, _WRAPPER)
    now = scratch.store(known.withColumn("part", number))
    while True:
        counts = now.groupBy("host").agg(F.count("*").alias("n"))
        if (counts.agg(F.max("n")).first()[0] or 0) <= 1:
            break
        dealt = now.join(counts, "host").withColumn("group", F.expr(f"pmod(xxhash64(part), ceil(n / {GROUP}))"))
        fewer = dealt.groupBy("host", "group").applyInArrow(_merged, _WRAPPER)
        then = scratch.store(fewer.withColumn("part", number))
        scratch.drop(now)
        now = then
    read = now.select("host", "n_pages", "wrapper").mapInArrow(_read, "host string, n_pages long, expression string, rules string")
    return scratch.store(read)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's blocks by its host's rules; a page without any by those inferred from itself."""
    tags = Tags()
    known: dict[str, Rules] = {}
    for batch in batches:
        texts = []
        for page, held in zip(batch.column("html").to_pylist(), batch.column("rules").to_pylist()):
            blocks: list[str] = []
            if page and held:
                if held not in known:
                    if len(known) >= 256:
                        known.clear()
                    known[held] = Rules(json.loads(held))
                blocks = known[held].blocks(page, tags)
                if not blocks:
                    own = Element()
                    add_page(own, page, tags)
                    blocks = Rules(decide(own)).blocks(page, tags)
            texts.append("\n\n".join(blocks))
        yield pa.record_batch(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages(page_id, url, html)``: the main text.

    Blocks stand in page order, joined by an empty line; character references are decoded, white space
    in a block is one space. Null and empty html gives ''; a null url counts as a host of its own
    kind. Repeated rows are extracted each; they count each in the wrapper. Very long pages are read
    whole; elements nested deeper than 100 count as at that depth. An empty table gives no rows;
    further columns are not read. Runs jobs when called, see ``infer_wrappers``.
    """
    rules = infer_wrappers(pages).select("host", "rules")
    read = _with_host(pages).join(rules, "host", "left").select("page_id", "url", "html", "rules")
    kind = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return read.mapInArrow(_texts, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")
