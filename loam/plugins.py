"""Generators of one's own.

A plugin is a Python file with ``FACTORIES``, a list of ``Factory``: SQL text for Spark, preferably,
as it stays inside code generation. For what SQL can't express, ``python_factory`` makes a factory of
any Python function, and ``with_python_column`` adds a column to a finished table, both by Arrow batches.
"""

from __future__ import annotations

import importlib.util
import pathlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions.generators import Factory, Registry


def load_plugins(folder: str, registry: Registry, spark: SparkSession | None = None) -> list[str]:
    """Register the factories of every file; with a session, executors get the files too."""
    added = []
    for path in sorted(pathlib.Path(folder).glob("*.py")):
        spec = importlib.util.spec_from_file_location(f"loam_plugin_{path.stem}", path)
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        if spark is not None:
            spark.sparkContext.addPyFile(str(path))
        added += [f.name for f in getattr(module, "FACTORIES", ()) if registry.register(f)]
    return added


def sql_factory(name: str, template: str, kind: str = "string", tags=(), unique_per_row: bool = False) -> Factory:
    """``template`` is Spark SQL with {row}, {h} (a uniform 52-bit integer) and {unit} (0 to 1)."""
    return Factory(name, None, lambda d, p, c: template.format(row=d.row, h=d.h(), unit=d.unit()), kind, tuple(tags), unique_per_row)


def with_python_column(df: DataFrame, name: str, function: Callable[[int], object], kind: str = "string", row: str = "row") -> DataFrame:
    """A column from a Python function of the row number, a batch at a time."""
    @F.pandas_udf(kind)
    def make(rows: pd.Series) -> pd.Series:
        return rows.map(function)

    return df.withColumn(name, make(F.col(row)))


def python_factory(spark: SparkSession, name: str, function: Callable[[int, int], object], kind: str = "string", tags=(), unique_per_row: bool = False) -> Factory:
    """A factory from ``function(row, h)``: the row number and a uniform 52-bit integer, which alone decide
    the value, so that a lost task makes the same one again. The function is registered with the session."""
    udf_name = f"loam_python_{name}"

    @F.pandas_udf(kind)
    def make(rows: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series([function(int(r), int(h)) for r, h in zip(rows, hashes)], dtype="object")

    spark.udf.register(udf_name, make)
    return Factory(name, None, lambda d, p, c: f"{udf_name}({d.row}, {d.h()})", kind, tuple(tags), unique_per_row)
