"""Streams of generated rows: the same cell expressions over a rate source's counter, and running audits.

A cell depends on its row's number alone, so a stream that restarts from a checkpoint repeats itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.operators.generate import Generator
from loam.plans.config import Config


def stream_table(spark: SparkSession, cfg: Config, key: str, rows_per_second: int = 1000, partitions: int = 8) -> DataFrame:
    """An endless table; references must be to parents that take no join."""
    rows = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).option("numPartitions", partitions).load()
    return stream_rows(spark, cfg, key, rows.select(F.col("value").alias("row"), F.col("timestamp").alias("arrived")))


def stream_rows(spark: SparkSession, cfg: Config, key: str, rows: DataFrame) -> DataFrame:
    """Any stream with ``row`` (and other columns, which stay) with the table's columns added."""
    from loam.operators.generate import cast_sql

    g = Generator(spark, cfg)
    t = cfg.tables[key]
    cells = {c: g.cell(key, c) for c in t.active()}
    if missing := [c for c, sql in cells.items() if sql is None]:
        raise ValueError(f"{key}: {', '.join(missing)} need a join with the parent's rows")
    return rows.selectExpr("*", *[f"{cast_sql(sql, t.columns[c], g.registry)} AS `{c}`" for c, sql in cells.items()])


def counts_by_window(stream: DataFrame, time: str, keys: list[str], width: str = "1 minute", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Rows per window and keys; rows later than the watermark are left out."""
    win = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, late).groupBy(win, *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def first_of_key(stream: DataFrame, keys: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    """A stream without repeated keys within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
