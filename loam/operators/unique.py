"""Uniqueness: which sets of columns can collide, and drawing colliding rows again in rounds."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loam.functions.generators import Registry
from loam.plans.config import Table

from .storage import settled


@dataclass(frozen=True)
class UniqueSet:
    columns: tuple[str, ...]
    constant: bool  # all columns are literals: one row at most
    safe: bool  # a column that is unique per row and isn't cut

    @property
    def needs_rounds(self) -> bool:
        return not self.safe


def unique_sets(t: Table, registry: Registry) -> list[UniqueSet]:
    """UNIQUE, partial UNIQUE (without its predicate, which is stricter) and the key; equal sets once."""
    found: dict[tuple[str, ...], UniqueSet] = {}
    for columns in [*t.unique_keys, *[p["columns"] for p in t.partial_unique_keys], *([t.primary_key] if t.primary_key else [])]:
        specs = [t.columns.get(c) for c in columns]
        if not columns or any(s is None or s.removed for s in specs):
            continue
        constant = all(s.value is not None for s in specs)
        safe = any(
            s.value is None and not s.values and (f := registry.get(s.factory)) is not None and f.unique_per_row and not s.params.get("max_len") for s in specs
        )
        found.setdefault(tuple(sorted(columns)), UniqueSet(tuple(columns), constant, safe))
    return list(found.values())


def first_wins(df: DataFrame, sets: list[tuple[str, ...]], order: str = "row") -> DataFrame:
    """Rows that come first in every set; tuples with a null never collide."""
    out = df
    for i, columns in enumerate(sets):
        whole = F.lit(True)
        for c in columns:
            whole &= F.col(c).isNotNull()
        place = F.row_number().over(W.partitionBy(*columns).orderBy(order))
        out = out.withColumn(f"__wins_{i}", ~whole | (place == 1))
    won = F.lit(True)
    for i in range(len(sets)):
        won &= F.col(f"__wins_{i}")
    return out.filter(won).drop(*[f"__wins_{i}" for i in range(len(sets))])


def resample(rows: DataFrame, project: Callable[[DataFrame, int], DataFrame], sets: list[tuple[str, ...]], retries: int = 50) -> DataFrame:
    """Rows in rounds: those that collide, with each other or with accepted ones, are drawn again.

    ``project`` makes the columns of the rows numbered in ``row`` for an attempt. Accepted keys are
    kept apart by hash joins, and each round is checkpointed. What still collides after the retries
    is left out.
    """
    accepted: DataFrame | None = None
    pending = rows.select("row")
    for attempt in range(retries + 1):
        drawn = first_wins(project(pending, attempt), sets)
        if accepted is not None:
            for columns in sets:
                drawn = drawn.join(accepted.select(*columns), list(columns), "left_anti")
        drawn = settled(drawn)
        accepted = drawn if accepted is None else settled(accepted.unionByName(drawn))
        pending = settled(pending.join(drawn.select("row"), "row", "left_anti"))
        if pending.isEmpty():
            break
    return accepted
