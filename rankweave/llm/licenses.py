"""License scan by canonical digests: texts are normalised, hashed whole and joined to known digests.

The canonical form is lower case, without copyright lines, with letters and digits only, and with one
spelling of words that licenses spell in several ways. Whole documents are looked up among license
texts; their single lines among license notices, which are whole texts of one line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm.license_texts import EQUIVALENT, LICENSE_TEXTS, notice_marks, notice_rows


COPYRIGHT_LINE = (
    r"^[^\n]*(copyright \(c\)|\(c\) copyright|copyright ©|copyright [0-9]|all rights reserved)[^\n]*$"
)


def canonical(text: Column) -> Column:
    """The canonical form of a text or line; null stays null."""
    out = F.regexp_replace(F.lower(text), "(?md)" + COPYRIGHT_LINE, " ")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}]+", " ")
    out = F.concat(F.lit(" "), out, F.lit(" "))
    for said, meant in EQUIVALENT:
        out = F.replace(out, F.lit(f" {said} "), F.lit(f" {meant} "))
    return F.trim(F.regexp_replace(out, " +", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_licenses(spark: SparkSession) -> DataFrame:
    """(license, known): digests of the license texts."""
    rows = spark.createDataFrame(sorted(LICENSE_TEXTS.items()), "license string, text string")
    return rows.select("license", digest(F.col("text")).alias("known"))


def known_notices(spark: SparkSession) -> DataFrame:
    """(notice, known): digests of one-line notices, one license each."""
    rows = spark.createDataFrame(notice_rows(), "notice string, text string")
    return rows.groupBy(digest(F.col("text")).alias("known")).agg(F.min("notice").alias("notice"))


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, digest, license, notices, n_notice_lines.

    ``license`` is the known license that the whole text is, else null; ``notices`` lists the licenses
    that lines of the text announce, sorted and comma-joined. A null text counts as empty, which is no
    license. Rows of equal doc_id and text count as one document and all get the result; null doc_ids stay. Very
    long texts are read whole; an empty table gives no rows; further columns are not read. Copyright lines are
    no part of the canonical text, so a notice on one is not found.
    """
    spark = docs.sparkSession
    marks = "|".join(notice_marks())  # a line without one of them is no notice and need not be hashed
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    whole = keyed.select("doc_id", "text_key", digest(F.col("text")).alias("digest"))
    lines = (
        keyed.filter(F.lower("text").rlike(marks)).dropDuplicates(["doc_id", "text_key"])
        .select("doc_id", "text_key", F.explode(F.split("text", "\n")).alias("line")).filter(F.lower("line").rlike(marks))
        .select("doc_id", "text_key", digest(F.col("line")).alias("known"))
    )
    noted = lines.join(F.broadcast(known_notices(spark)), "known").groupBy(  # a fixed table of one-liners
        F.col("doc_id").alias("noted_id"), F.col("text_key").alias("noted_key")
    ).agg(F.array_join(F.array_sort(F.collect_set("notice")), ",").alias("notices"), F.count("*").alias("n"))
    same = F.col("doc_id").eqNullSafe(F.col("noted_id")) & (F.col("text_key") == F.col("noted_key"))
    named = F.broadcast(known_licenses(spark))  # a fixed table of license texts
    return whole.join(named, F.col("digest") == F.col("known"), "left").join(noted, same, "left").select(
        "doc_id", "digest", "license", F.coalesce("notices", F.lit("")).alias("notices"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_notice_lines"),
    )
