"""The library: load a configuration, generate its tables, write them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loam.functions.generators import Registry
from loam.operators.emit import script_lines, write_jdbc, write_parquet, write_script
from loam.operators.generate import Generated, Generator
from loam.plans.build import build
from loam.plans.config import Config, load, loads
from loam.plans.lint import Issue, lint
from loam.ship import ship
from loam.sources.ddl import read_ddl

__all__ = ["Config", "Generated", "Issue", "apply", "from_ddl", "generate", "lint", "load", "loads", "script", "ship", "write_parquet", "write_script"]


def from_ddl(text: str, seed: int = 0, registry: Registry | None = None) -> Config:
    return build(read_ddl(text), registry, seed)


def generate(spark: SparkSession, cfg: Config, registry: Registry | None = None, existing: dict[str, DataFrame] | None = None, **options) -> Generated:
    ship(spark)
    return Generator(spark, cfg, registry, existing, **options).run()


def script(spark: SparkSession, cfg: Config, registry: Registry | None = None) -> str:
    ship(spark)
    made = Generator(spark, cfg, registry).run(keep_row=True)
    return "\n".join(script_lines(made.tables, made.plan, {k: cfg.tables[k].active() for k in made.tables})) + "\n"


def apply(spark: SparkSession, cfg: Config, url: str, properties: dict | None = None) -> Generated:
    """Generate and append to a database, parents first."""
    made = generate(spark, cfg)
    write_jdbc(made.tables, made.plan, url, properties)
    return made
