"""Inference as joins: columns meet the match rules by family, the best score wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loam.functions.generators import Column, Registry

RULES = "factory string, place int, family string, pattern string, unless string, normal boolean, score int"
COLUMNS = "table_name string, column_name string, families array<string>"


def rule_rows(registry: Registry) -> list[tuple]:
    return [(f.name, i, r.family, r.pattern, r.unless, r.normal, r.score) for i, f in enumerate(registry.all) if isinstance(f.rules, tuple) for r in f.rules]


def column_rows(tables: dict[str, list[Column]]) -> list[tuple]:
    return [(t, c.name, c.families()) for t, columns in tables.items() for c in columns]


def scores(columns: DataFrame, rules: DataFrame) -> DataFrame:
    """Each column's score for each factory that matches it; both sides are metadata, the rules a few dozen rows."""
    lower = F.lower("column_name")
    met = columns.withColumn("family", F.explode("families")).join(F.broadcast(rules), "family")
    name = F.when(F.col("normal"), F.regexp_replace(lower, "[_-]", "")).otherwise(lower)
    hit = F.rlike(name, F.col("pattern")) & ~((F.col("unless") != "") & F.rlike(name, F.col("unless")))
    return met.filter(hit).groupBy("table_name", "column_name", "factory", "place").agg(F.max("score").alias("score"))


def best(columns: DataFrame, rules: DataFrame) -> DataFrame:
    """table_name, column_name, factory, score, unresolved; ties go to the earlier registration."""
    first = W.partitionBy("table_name", "column_name").orderBy(F.col("score").desc(), "place")
    won = scores(columns, rules).withColumn("r", F.row_number().over(first)).filter("r = 1")
    out = columns.select("table_name", "column_name").join(won.drop("r", "place"), ["table_name", "column_name"], "left")
    return out.select("table_name", "column_name", "factory", F.coalesce("score", F.lit(0)).alias("score"), (F.coalesce("score", F.lit(0)) < 60).alias("unresolved"))


def top(columns: DataFrame, rules: DataFrame, n: int = 8) -> DataFrame:
    """The n best candidates of each column, by score, then name."""
    order = W.partitionBy("table_name", "column_name").orderBy(F.col("score").desc(), "factory")
    return scores(columns, rules).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n).select("table_name", "column_name", "place", "factory", "score")


def json_fields(docs: DataFrame, column: str) -> DataFrame:
    """field, data_type, n: the types that the fields of JSON objects hold at the top level."""
    keys = docs.select(F.col(column).alias("j"), F.explode(F.json_object_keys(column)).alias("field"))
    v = F.expr("get_json_object(j, concat('$.', field))")
    kind = (
        F.when(v.isNull(), "text")
        .when(v.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), "numeric")
        .when(v.isin("true", "false"), "boolean")
        .when(v.startswith("{"), "jsonb")
        .otherwise("text")
    )
    return keys.select("field", kind.alias("data_type")).groupBy("field", "data_type").agg(F.count("*").alias("n"))


def frames(spark: SparkSession, tables: dict[str, list[Column]], registry: Registry | None = None) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame(column_rows(tables), COLUMNS), spark.createDataFrame(rule_rows(registry or Registry()), RULES)
