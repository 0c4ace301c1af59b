"""Exact dedup by skew-safe combining.

Texts are equal when identical without the characters of ``[\\x20\\x09-\\x0D]``. Rows are
deduplicated where they are read (partial aggregation), merged by digest, salt and full text,
and the salts' winners are merged once more by digest and full text. Every stage groups by the
whole normalised text beside its digests, so equal digests alone never merge two rows. A group of
copies sends one row a reading task to one of ``salts`` reducers, whatever its size.

Rows then find their winner. Where the merge has found one text only of a digest, which it has
compared in full, the digest names the text, and rows join by it: texts needn't move again. Rows of
digests that two texts share, should there ever be any, join by the full text. Groups with over a
ten-thousandth of all rows are joined by broadcast (at most ten thousand of them).

Defined results: null text counts as empty; a null id ranks after every other id; rows that
repeat the keeper's id and length are all marked kept, as they are the same row; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, attach, discard, ids_and_text, stash

_LAST = 2**63 - 1
_DIGEST = ["first", "second"]


def _digests(norm: Column) -> list[Column]:
    return [F.xxhash64(norm), F.xxhash64(F.lit("second"), norm)]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, norm, its digests, n_chars of the whole text."""
    rows = ids_and_text(docs, id_col, text_col).select("doc_id", F.translate("text", ASCII_SPACE, "").alias("norm"), F.length("text").alias("n_chars"))
    return rows.select("doc_id", "norm", "n_chars", *[d.alias(n) for n, d in zip(_DIGEST, _digests(F.col("norm")))])


def _best() -> Column:
    """Most code points, then the smallest id, null last."""
    return F.min(F.struct((-F.col("n_chars")).alias("short"), F.col("doc_id").isNull().alias("nameless"), F.coalesce("doc_id", F.lit(_LAST)).alias("id")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    keyed = _keyed(docs, id_col, text_col)
    rows = stash(keyed.select("doc_id", "n_chars", *_DIGEST), "rows")
    salted = (
        keyed.withColumn("salt", F.spark_partition_id() % salts)
        .groupBy(*_DIGEST, "salt", "norm")
        .agg(_best().alias("best"), F.count("*").alias("n"))
    )
    merged = salted.groupBy(*_DIGEST, "norm").agg(F.min("best").alias("best"), F.sum("n").alias("group_size"))
    winners = stash(merged.select(*_DIGEST, "best", "group_size", F.sha2("norm", 256).alias("text_sha256")), "winners")
    shared = stash(winners.groupBy(*_DIGEST).count().filter("count > 1").select(*_DIGEST), "shared")
    if shared.isEmpty():
        found = attach(rows, winners, _DIGEST, "group_size", rows.count())
        discard(shared)
    else:
        apart = keyed.select("doc_id", "n_chars", *_DIGEST, "norm").join(shared, _DIGEST)
        own = apart.groupBy("norm").agg(_best().alias("best"), F.count("*").alias("group_size")).withColumn("text_sha256", F.sha2("norm", 256))
        alone = stash(winners.join(shared, _DIGEST, "left_anti"), "alone")
        found = attach(stash(rows.join(shared, _DIGEST, "left_anti"), "others"), alone, _DIGEST, "group_size", rows.count())
        found = found.unionByName(apart.join(own, "norm").drop("norm"))
    best = F.col("best")
    return found.select(
        "doc_id",
        F.when(~best["nameless"], best["id"]).alias("keep_id"),
        "group_size",
        ((F.col("n_chars") == -best["short"]) & F.col("doc_id").eqNullSafe(F.when(~best["nameless"], best["id"]))).alias("kept"),
        "text_sha256",
    )


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
g AS (
  SELECT norm, count(*) AS group_size,
         first(doc_id ORDER BY length(t) DESC, doc_id) AS keep_id FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size::BIGINT AS group_size, d.doc_id = g.keep_id AS kept,
       sha256(d.norm) AS text_sha256
FROM d JOIN g USING (norm)
"""
