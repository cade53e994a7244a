"""Secret scan by a trigram inverted index, in DataFrame operations only.

Each rule's regular expression gives a Boolean query on trigrams. The index lists, for the trigrams the
rules ask for, the documents that have them; counting postings per document and conjunction
intersects them. Candidates are verified by the expression itself. Rules without mandatory trigrams
scan every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.llm.common import Scratch
from rankweave.llm.trigrams import trigram_query


@dataclass(frozen=True)
class Rule:
    """A match counts if its ``group`` has ``least`` characters; matches are leftmost and do not overlap."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The base rules, then common formats of issued credentials. Runs of hex digits are
# matched from 24 up, which equals matching all runs and dropping the short ones.
BASE_RULES = (
    Rule(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
ISSUED_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE_RULES + ISSUED_RULES


def _any_trigram(trigrams: list[str]) -> str:
    """An expression that matches before every listed trigram, overlapping ones too, as group 1."""
    escape = lambda s: "".join(c if c.isalnum() else f"\\x{ord(c):02x}" for c in s)
    by_first: dict[str, list[str]] = {}
    for t in sorted(trigrams):
        by_first.setdefault(t[0], []).append(escape(t[1:]))
    branches = [f"{escape(first)}(?:{'|'.join(rest)})" for first, rest in by_first.items()]
    return f"(?=({'|'.join(branches)}))"


def _clauses(rules: tuple[Rule, ...]) -> list[tuple[str, int, str, int]]:
    """(kind, clause, trigram, trigrams of the clause) of the rules that have mandatory trigrams."""
    out = []
    for rule in rules:
        query = trigram_query(rule.pattern)
        if all(query):
            out += [(rule.kind, k, t, len(clause)) for k, clause in enumerate(query) for t in sorted(clause)]
    return out


def postings(keyed: DataFrame, trigrams: list[str]) -> DataFrame:
    """(id, text_key, trigram): the inverted index over the listed trigrams, each once a text."""
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_any_trigram(trigrams)), F.lit(1)))
    return keyed.select("id", "text_key", F.explode(found).alias("trigram"))


def candidates(keyed: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(candidate, candidate_key, kinds): documents whose trigrams satisfy a rule's query."""
    clauses = _clauses(rules)
    asked = keyed.sparkSession.createDataFrame(clauses, "kind string, clause int, trigram string, needed int")
    listed = postings(keyed, sorted({c[2] for c in clauses})).distinct()
    return (
        listed.join(F.broadcast(asked), "trigram")  # a row per trigram of the rules' own queries
        .groupBy("id", "text_key", "kind", "clause").agg(F.count("*").alias("held"), F.first("needed").alias("needed"))
        .filter("held = needed")
        .groupBy(F.col("id").alias("candidate"), F.col("text_key").alias("candidate_key"))
        .agg(F.collect_set("kind").alias("kinds"))
    )


def _matches(rule: Rule, number: int) -> Column:
    """An array of the rule's matches in ``text``: rule, place in the array, lengths before and in it, keep."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all("text", pattern, F.lit(0))
    counted = found if not rule.group else F.regexp_extract_all("text", pattern, F.lit(rule.group))
    gaps = F.split("text", rule.pattern, -1)
    return F.transform(
        F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("whole"), counted.alias("part")),
        lambda x, i: F.struct(
            F.lit(number).alias("rule"), i.alias("nth"), F.length(x["gap"]).alias("gap"),
            F.length(x["whole"]).alias("long"), (F.length(x["part"]) >= rule.least).alias("keep"),
        ),
    )


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_<kind> of the base rules, base_sha256, spans.

    ``spans`` lists kind:start:end by start, then rule order, in code points with the end exclusive;
    ``base_sha256`` is the digest of the list of base spans. Null and empty texts have no spans. Rows of
    equal doc_id and text are scanned once and all get the result; a null doc_id is kept. Very long texts are
    scanned whole; an empty table gives no rows; further columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    keyed = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_key"), "text")
    indexed = {c[0] for c in _clauses(rules)}
    chosen = candidates(keyed, rules)
    met = keyed.join(
        chosen, F.col("id").eqNullSafe(F.col("candidate")) & (F.col("text_key") == F.col("candidate_key"))
    )
    none = F.array().cast("array<struct<rule:int,nth:int,gap:int,long:int,keep:boolean>>")
    from_index = [
        F.when(F.array_contains("kinds", r.kind), _matches(r, n)).otherwise(none) for n, r in enumerate(rules) if r.kind in indexed
    ]
    from_scan = [
        F.when(F.col("text").rlike(r.pattern), _matches(r, n)).otherwise(none)
        for n, r in enumerate(rules) if r.kind not in indexed
    ]
    parts = [
        rows.select("id", "text_key", F.explode(F.flatten(F.array(*columns))).alias("m"))
        for rows, columns in ((met, from_index), (keyed, from_scan)) if columns
    ]
    hits = reduce(DataFrame.unionByName, parts).select("id", "text_key", "m.*").dropDuplicates(["id", "text_key", "rule", "nth"])
    so_far = Window.partitionBy("id", "text_key", "rule").orderBy("nth")
    end = F.sum(F.col("gap") + F.col("long")).over(so_far).alias("end")
    placed = hits.select("*", end).filter("keep").withColumn("start", F.col("end") - F.col("long"))
    names = F.array(*[F.lit(r.kind) for r in rules])
    listed = lambda spans: F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["rule"]), x["start"], x["end"])), ","
    )
    n_base = len(base)
    spans = F.array_sort(F.collect_list(F.struct("start", "rule", "end")))
    per_text = placed.groupBy(F.col("id").alias("found"), F.col("text_key").alias("found_key")).agg(
        *[F.count_if(F.col("rule") == n).alias(f"n_{r.kind}") for n, r in enumerate(base)], spans.alias("all")
    ).select(
        "found", "found_key", *[f"n_{r.kind}" for r in base], listed(F.col("all")).alias("spans"),
        F.sha2(listed(F.filter("all", lambda x: x["rule"] < n_base)), 256).alias("base_sha256"),
    )
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"))
    same = F.col("doc_id").eqNullSafe(F.col("found")) & (F.col("text_key") == F.col("found_key"))
    return ids.join(scratch.store(per_text), same, "left").select(
        "doc_id", *[F.coalesce(f"n_{r.kind}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in base],
        F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
    )
