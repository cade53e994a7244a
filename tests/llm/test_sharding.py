"""The laws of the shards."""

import collections
import zlib

from edge_rows import ROWS, documents, empty
from rankweave.llm import sharding


def test_laws(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("doc_id", "text", "if(doc_id % 3 = 0, 'hot', source) AS source")
    texts = {r.doc_id: r.text for r in docs.collect()}
    s = sharding.ShardSettings()
    rows = sharding.interleave(docs, s).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
    shards = collections.defaultdict(list)
    for r in rows:
        shards[r.shard].append(r.slot)
    assert sorted(shards) == list(range(8)) and all(sorted(v) == list(range(len(v))) for v in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    mixture = collections.Counter((r.shard, r.source) for r in rows)
    totals = collections.Counter(r.source for r in rows)
    spare = len(totals) / len(rows)
    assert all(abs(mixture[k, name] - n / 8) <= 1 + n * spare for k in range(8) for name, n in totals.items())
    again = sharding.interleave(docs.repartition(5), s).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, rows), key=repr)


def brute(spark, docs, s):
    """Places by plain sorting; only the seeded hashes are Spark's."""
    key = "xxhash64(%d, cast(doc_id as long), text) AS shuffle" % s.seed
    turn = "xxhash64(%d, to_json(array(source))) AS turn" % (s.seed + 1)
    rows = docs.selectExpr("cast(doc_id as long) AS doc_id", "text", "source", "to_json(array(source)) AS stratum", key, turn).collect()
    size = lambda r: len((r.text or "").encode()) + 1
    low = lambda x: (x is not None, x)  # noqa: E731  nulls first
    order = lambda r: (r.shuffle, low(r.doc_id), zlib.crc32((r.text or "").encode()), size(r))
    placed = []
    for stratum in {r.stratum for r in rows}:
        own = sorted((r for r in rows if r.stratum == stratum), key=order)
        placed += [((2 * k + 1) / (2 * len(own)), r.turn, stratum, r) for k, r in enumerate(own)]
    placed.sort(key=lambda x: x[:3])
    n, out, seen = len(placed), [], collections.Counter()
    for at, (*_, r) in enumerate(placed):
        shard = at * s.shards // n
        out.append((r.doc_id, r.source, size(r), shard, seen[shard]))
        seen[shard] += 1
    return sorted(out, key=repr)


def test_places_match_brute_force(spark, folder):
    many = "if(doc_id % 3 = 0, concat('own', doc_id), if(doc_id % 3 = 1, 'hot', source)) AS source"
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("doc_id", "text", many)
    for rows in (docs, documents(spark).select("doc_id", "text", "source")):
        s = sharding.ShardSettings()
        got = sharding.interleave(rows.repartition(7), s).select("doc_id", "source", "size", "shard", "slot").collect()
        assert sorted((tuple(r) for r in got), key=repr) == brute(spark, rows, s)


def test_edges(spark):
    rows = sharding.interleave(documents(spark, clashes=True)).collect()
    assert len(rows) == len(ROWS) and {r.size for r in rows if r.doc_id in (2, 3)} == {1}
    assert sorted((r.shard, r.slot) for r in rows) == sorted({(r.shard, r.slot) for r in rows})
    assert sharding.interleave(empty(spark)).count() == 0
