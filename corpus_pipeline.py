"""From raw documents to packed token sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
back as the next one's docs. All stages but the last return the columns of ``documents``; where a
stage changes the text, ``n_chars`` follows.

The order is given: near copies are compared by what line dedup has left of them.

Defined results. Null texts: their score is that of the empty text, no stage changes them, and they
are near copies of all texts without words. Empty texts: likewise; texts that line dedup has emptied
are among them, so one of all empty documents stays. Very long texts are read whole. Rows without an
id: scored, redacted and packed like others; they count in line dedup but keep their lines, and never
go as near copies. Repeated rows of one id: a document to line dedup, and as such a near copy of
itself, so all of them stay or go together. Null labels are none; without labels of both kinds no
model tells documents apart, and all stay or, if most labels are toxic, go. An empty table gives an
empty result. Other columns come along unchanged up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.common import discard, fresh, scope, stash
from loam.llm.line_dedup import drop_lines
from loam.llm.packing import pack_documents
from loam.llm.pii import redact
from loam.llm.simhash import similar_documents
from loam.llm.toxicity import THRESHOLD, scored, train


def _recounted(docs: DataFrame, like: DataFrame) -> DataFrame:
    if "n_chars" in like.columns:
        kind = like.schema["n_chars"].dataType
        docs = docs.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(kind))
    return docs.select(*like.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold."""
    scorer = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh(docs, "score")
    return scored(docs, scorer, docs.columns, score).filter(F.col(score) < THRESHOLD).select(*docs.columns)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines of recurring templates that another document keeps."""
    return _recounted(drop_lines(docs).drop("n_dropped"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (a similarity of about 0.8 or more, shingles of five words) the
    document with the smallest id; documents without an id stay."""
    stays = similar_documents(docs).filter("doc_id = component_id").select("doc_id").distinct()
    named = docs.join(stays, "doc_id", "left_semi").select(*docs.columns)
    return named.unionByName(docs.filter("doc_id is null"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data replaced by its kind."""
    return _recounted(redact(docs), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in sequences of at most 4096 tokens."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_recurring_lines),
    ("near_dedup", drop_near_copies),
    ("pii", redact_pii),
    ("packing", pack_sequences),
]

#: The first stage is a fitted model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after another; a stage's own tables go when its result is written, and that result
    when the next one is. What the last stage reads stays until the process ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES[:-1]:
        with scope() as own:
            docs = stash(stage(spark, docs, sf_dir), name)
        own.release(docs)
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
