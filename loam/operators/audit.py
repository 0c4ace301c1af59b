"""Integrity audits of existing tables: keys, references, rules, overlaps and fan-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, nulls: one pass over all columns."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in columns])).alias("s")).select("s.*")


def unique(df: DataFrame, columns: list[str], where: Column | str | None = None) -> DataFrame:
    """Tuples that occur more than once, with their count; tuples with a null never do."""
    whole = F.lit(True)
    for c in columns:
        whole &= F.col(c).isNotNull()
    rows = df.filter(whole) if where is None else df.filter(where).filter(whole)
    return rows.groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1")


def uniqueness(df: DataFrame, name: str, columns: list[str], where: Column | str | None = None) -> DataFrame:
    """rule, groups, extra_rows: how many tuples repeat and how many rows are too many."""
    return unique(df, columns, where).agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("extra_rows")).select(F.lit(name).alias("rule"), "groups", "extra_rows")


def orphans(child: DataFrame, columns: list[str], parent: DataFrame, parent_columns: list[str]) -> DataFrame:
    """Child rows whose reference is not null and has no parent (the parent's distinct keys alone are moved)."""
    keys = parent.select(*[F.col(p).alias(f"__p{i}") for i, p in enumerate(parent_columns)]).distinct()
    on, whole = F.lit(True), F.lit(True)
    for i, c in enumerate(columns):
        on &= F.col(c) == F.col(f"__p{i}")
        whole &= F.col(c).isNotNull()
    return child.filter(whole).join(keys, on, "left_anti")


def orphan_counts(spark, rules: list[tuple[str, DataFrame, list[str], DataFrame, list[str]]]) -> DataFrame:
    """rule, orphans for each (name, child, columns, parent, parent columns)."""
    parts = [orphans(c, cc, p, pc).agg(F.count("*").alias("orphans")).select(F.lit(n).alias("rule"), "orphans") for n, c, cc, p, pc in rules]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def checks(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """rule, violations: rows for which the expression is false (null passes), in one pass."""
    one = df.agg(*[F.count_if(~F.expr(e)).alias(f"r{i}") for i, e in enumerate(rules.values())])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"r{i}").alias("violations")) for i, n in enumerate(rules)])).alias("s")).select("s.*")


def overlaps(df: DataFrame, keys: list[str], start: Column, end: Column, order: list[str]) -> DataFrame:
    """Rows whose half-open interval begins before an earlier row's of the same key has ended.

    A running maximum of the ends finds them in one sorted pass; no pair is formed.
    """
    w = W.partitionBy(*keys).orderBy("__start", *order)
    rows = df.withColumns({"__start": start, "__end": end}).filter(F.col("__end") > F.col("__start"))
    before = F.max("__end").over(w.rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("__before", before).filter(F.col("__before") > F.col("__start")).drop("__start", "__end", "__before")


def fanout(parent: DataFrame, key: str, child: DataFrame, column: str) -> DataFrame:
    """children, parents: how many parents have so many children."""
    per = child.groupBy(F.col(column).alias("__k")).agg(F.count("*").alias("__n"))
    all_ = parent.select(key).join(per, F.col(key) == F.col("__k"), "left").select(F.coalesce("__n", F.lit(0)).alias("children"))
    return all_.groupBy("children").agg(F.count("*").alias("parents"))
