"""Tables from a configuration, as DataFrames.

A cell is an expression over the row's number, so a table is one projection of ``spark.range``. A
reference to a parent whose keys are pure expressions is the parent's expression at a hashed row:
no join and no shuffle. Where a parent may have dropped rows, or exists already, its keys are
numbered densely and joined on the hashed number.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions.dialect import Dialect
from loam.functions.generators import Column, Params, Registry, array_type, value_sql
from loam.plans.checks import parse_check, strip_casts
from loam.plans.config import ColumnSpec, Config, qualified, split_target
from loam.plans.graph import Plan, plan

from .unique import UniqueSet, resample, unique_sets

JSON_DEPTH = 20
RETRIES = 50


def class_name(table: str) -> str:
    """``order_items`` as ``OrderItem``."""
    return "".join(p[:1].upper() + p[1:] for p in table.split("_")).removesuffix("s")


@dataclass
class Dropped:
    table: str
    requested: int
    emitted: int
    reason: str = ""


@dataclass
class Generated:
    tables: dict[str, DataFrame]
    plan: Plan
    dropped: list[Dropped] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


class Generator:
    """fill_cycles: references that close a cycle get values, where by default they are null.
    verify_checks: rows that break a CHECK which no parameter expresses are drawn again, then dropped."""

    def __init__(self, spark: SparkSession, cfg: Config, registry: Registry | None = None, existing: dict[str, DataFrame] | None = None, fill_cycles: bool = False, hash: str = "md5", partitions: int | None = None, verify_checks: bool = False):
        self.spark, self.cfg, self.registry = spark, cfg, registry or Registry()
        self.existing = {qualified(k): v for k, v in (existing or {}).items()}
        self.fill_cycles, self.partitions = fill_cycles, partitions
        self.plan, self.hash = plan(cfg), hash
        self.warnings: list[str] = []
        self.sets: dict[str, list[UniqueSet]] = {k: unique_sets(t, self.registry) for k, t in cfg.tables.items()}
        self.rules = {k: [spark_check(c["expression"]) for c in t.checks if not pushed_down(c)] if verify_checks else [] for k, t in cfg.tables.items()}
        self.done: dict[str, DataFrame] = {}
        self.lost: dict[str, Dropped] = {}
        self._making: set[str] = set()
        self._numbered: dict[str, tuple[DataFrame, int]] = {}

    # --- cells ------------------------------------------------------------------------------

    def dialect(self, key: str, column: str, row: str, attempt: str, path=()) -> Dialect:
        return Dialect(self.cfg.seed, key, column, row, attempt, self.hash, tuple(path))

    def pure(self, key: str) -> bool:
        """Whether row n of the table is known without making the table: nothing can be dropped."""
        return key in self.cfg.tables and key not in self.existing and not self.rules[key] and not any(s.needs_rounds for s in self.sets[key])

    def rows_of(self, key: str) -> int:
        return self.plan.counts.get(key, 0)

    def pick(self, key: str, column: str, spec: ColumnSpec, row: str, attempt: str) -> tuple[str, str, str] | None:
        """(parent, its column, expression of the hashed parent row) of a reference; None if it stays null."""
        found = split_target(spec.params.get("target", ""))
        if not found:
            return None
        parent, target = found
        # Columns with ``consistent`` pick one row of their parent together.
        name = f"fk {parent}" if spec.params.get("consistent") else column
        h = self.dialect(key, name, row, attempt).h("'fk'")
        if parent == key:
            return parent, target, f"({h} % ({row} + 1))"
        if parent in self.existing:
            return parent, target, h
        n = self.rows_of(parent)
        before = parent in self.plan.order and self.plan.order.index(parent) < self.plan.order.index(key)
        if n <= 0 or not (before or (self.fill_cycles and self.pure(parent))):
            return None
        return parent, target, f"({h} % {n})"

    def cell(self, key: str, column: str, row: str = "row", attempt: str = "0", seen: tuple = ()) -> str | None:
        """SQL of a cell; None if it takes a join. ``seen``: the references followed so far, so that a
        chain of them is followed to its end, and a circle is not."""
        spec = self.cfg.tables[key].columns[column]
        pair = next((p for p in self.cfg.tables[key].polymorphs if column in (p["type_column"], p["id_column"]) and p.get("candidates")), None)
        if pair:
            joined = any(not self.direct(c) for c in pair["candidates"])
            return None if joined else self.polymorph(key, pair, row, attempt)[column != pair["type_column"]]
        if spec.factory == "fkref" and spec.value is None and not spec.values:
            picked = self.pick(key, column, spec, row, attempt)
            if picked is None:
                return "CAST(NULL AS STRING)"
            parent, target, at = picked
            if (parent == key or self.pure(parent)) and (parent, target) not in seen and target in self.cfg.tables[parent].columns:
                # A row that retries keeps its key only if the key doesn't follow the attempt.
                return self.cell(parent, target, at, "0", (*seen, (parent, target)))
            return None
        sql = self.value(key, column, spec, row, attempt)
        share = Params(spec.params).float_("null_fraction", 0.0)
        if share > 0 and spec.nullable:
            sql = f"CASE WHEN {self.dialect(key, column, row, attempt).unit(chr(39) + 'null' + chr(39))} >= {share!r}D THEN {sql} END"
        return sql

    def value(self, key: str, column: str, spec: ColumnSpec, row: str, attempt: str, path=()) -> str:
        if spec.value is not None:
            v = spec.value
            return Dialect().s(v) if isinstance(v, str) else ("true" if v else "false") if isinstance(v, bool) else Dialect().s(json.dumps(v)) if isinstance(v, (dict, list)) else repr(v)
        if spec.values:
            if len(path) >= JSON_DEPTH:
                return "'{}'"
            return f"to_json({self.shape(key, column, spec, row, attempt, path)}, map('ignoreNullFields', 'false'))"
        factory = self.registry.get(spec.factory)
        if factory is None:
            warning = f"{key}.{column}: unknown factory {spec.factory!r}, left null"
            if warning not in self.warnings:
                self.warnings.append(warning)
            return "CAST(NULL AS STRING)"
        own = Column(path[-1] if path else column, spec.data_type)
        return value_sql(self.dialect(key, column, row, attempt, path), factory, spec.params, own)

    def shape(self, key: str, column: str, spec: ColumnSpec, row: str, attempt: str, path=()) -> str:
        """The struct of a JSON value, fields by name; beyond the depth limit empty."""
        parts = []
        for name, f in sorted(spec.values.items()):
            here = (*path, name)
            inner = f.values and f.value is None
            if inner and len(here) < JSON_DEPTH:
                sql = self.shape(key, column, f, row, attempt, here)
            else:
                sql = "named_struct()" if inner else self.value(key, column, f, row, attempt, here)
            parts.append(f"{Dialect().s(name)}, {sql}")
        return f"named_struct({', '.join(parts)})"

    def polymorph(self, key: str, pair: dict, row: str, attempt: str, found: dict[int, tuple[int, str]] | None = None) -> tuple[str, str]:
        """SQL of a polymorphic pair's type and id: one candidate for both, both null where it has no rows.
        ``found``: rows and key column of the candidates whose keys are joined."""
        d = self.dialect(key, pair["id_column"], row, attempt)
        null, n = "CAST(NULL AS STRING)", len(pair["candidates"])
        kind, name = null, null
        for i, cand in reversed(list(enumerate(pair["candidates"]))):
            parent, target = self.candidate(cand)
            rows, at = (found or {}).get(i, (self.rows_of(parent), ""))
            hit, key_sql = null, None
            if target and rows > 0:
                key_sql = at or self.cell(parent, target, f"({d.h(1)} % {rows})", "0", ((key, pair["id_column"]),))
                hit = d.s(cand.get("type_name") or class_name(parent.split(".", 1)[1]))
            kind = f"CASE WHEN {d.h(0)} % {n} = {i} THEN {hit} ELSE {kind} END"
            name = f"CASE WHEN {d.h(0)} % {n} = {i} THEN {f'CAST({key_sql} AS STRING)' if key_sql else null} ELSE {name} END"
        return kind, name

    def candidate(self, cand: dict) -> tuple[str, str | None]:
        """The table of a polymorphic candidate and its key column."""
        parent = qualified(cand["table"])
        t = self.cfg.tables.get(parent)
        return parent, cand.get("pk_column") or (t.primary_key[0] if t and t.primary_key else None)

    def direct(self, cand: dict) -> bool:
        """Whether a candidate's keys are known without a join (or it has none)."""
        parent, target = self.candidate(cand)
        return self.pure(parent) and (not target or self.rows_of(parent) <= 0 or self.cell(parent, target) is not None)

    def join_pair(self, key: str, out: DataFrame, pair: dict, attempt: str) -> DataFrame:
        """Both columns of a polymorphic pair of which some candidate may have dropped rows, or exists already:
        such candidates' keys are numbered and joined. A row of another candidate has a number of its own
        below zero there, which meets none and lies in no crowd."""
        d = self.dialect(key, pair["id_column"], "row", attempt)
        n, found = len(pair["candidates"]), {}
        for i, cand in enumerate(pair["candidates"]):
            parent, target = self.candidate(cand)
            if self.direct(cand):
                continue
            rows = self.numbered(parent)[1] if target and self.ready(parent) else 0
            found[i] = (rows, f"`__key_{i}`")
            if rows:
                at = F.expr(f"CASE WHEN {d.h(0)} % {n} = {i} THEN {d.h(1)} % {rows} ELSE -1 - row END").alias(f"__at_{i}")
                side = self.numbered(parent)[0].select(F.col("__ix").alias(f"__at_{i}"), F.col(target).cast("string").alias(f"__key_{i}"))
                out = out.select("*", at).join(side, f"__at_{i}", "left").drop(f"__at_{i}")
        sqls = self.polymorph(key, pair, "row", attempt, found)
        own = self.cfg.tables[key].columns
        return out.selectExpr(
            *[f"`{c}`" for c in out.columns if not c.startswith("__key_")],
            *[f"{cast_sql(sql, own[c], self.registry)} AS `{c}`" for sql, c in zip(sqls, (pair["type_column"], pair["id_column"])) if c in own],
        )

    def ready(self, parent: str) -> bool:
        """Whether a parent's rows can be had: it exists, or is made now if nothing has made it yet."""
        if parent not in self.existing and parent not in self.done and parent in self.cfg.tables and self.rows_of(parent) > 0 and parent not in self._making:
            self.finish(parent)
        return parent in self.existing or parent in self.done

    # --- tables -----------------------------------------------------------------------------

    def numbered(self, parent: str) -> tuple[DataFrame, int]:
        """A finished or existing table with a dense ``__ix`` (numbered within partitions, then shifted)."""
        if parent not in self._numbered:
            self._numbered[parent] = dense_index(self.existing.get(parent, self.done.get(parent)))
        return self._numbered[parent]

    def project(self, key: str, rows: DataFrame, attempt: str) -> DataFrame:
        """All active columns of the rows numbered in ``row``."""
        t = self.cfg.tables[key]
        joined: dict[str, list[tuple[str, str, str]]] = {}
        exprs, pairs = ["row"], []
        for c in t.active():
            sql = self.cell(key, c, "row", attempt)
            pair = next((p for p in t.polymorphs if c in (p["type_column"], p["id_column"]) and p.get("candidates")), None)
            if sql is None and pair:
                pairs += [pair] if pair not in pairs else []
            elif sql is None:
                parent, target, at = self.pick(key, c, t.columns[c], "row", attempt)
                joined.setdefault(parent, []).append((c, target, at))
                exprs.append(f"{at} AS `__at_{c}`")
            else:
                exprs.append(f"{cast_sql(sql, t.columns[c], self.registry)} AS `{c}`")
        out = rows.selectExpr(*exprs)
        for pair in pairs:
            out = self.join_pair(key, out, pair, attempt)
        for parent, columns in joined.items():
            numbered, n = self.numbered(parent)
            for c, target, _ in columns:
                side = numbered.select(F.col("__ix").alias(f"__at_{c}"), F.col(target).alias(c))
                # The hashed number is uniform, so no key is hot; Spark broadcasts a small parent by its size.
                out = out.withColumn(f"__at_{c}", F.col(f"__at_{c}") % n if n else F.lit(None).cast("long")).join(side, f"__at_{c}", "left").drop(f"__at_{c}")
        return out.select("row", *[f"`{c}`" for c in t.active()])

    def table(self, key: str) -> tuple[DataFrame, Dropped | None]:
        n = self.rows_of(key)
        rows = self.spark.range(0, n, 1, self.partitions or max(1, min(2_000, -(-n // 1_000_000)))).withColumnRenamed("id", "row")
        sets = [s for s in self.sets[key] if s.needs_rounds]
        if not sets and not self.rules[key]:
            return self.project(key, rows, "0"), None

        def draw(r: DataFrame, attempt: int) -> DataFrame:
            out = self.project(key, r, str(attempt))
            for rule in self.rules[key]:
                out = out.filter(F.coalesce(F.expr(rule), F.lit(True)))
            return out

        kept = resample(rows, draw, [s.columns for s in sets], 0 if any(s.constant for s in sets) else RETRIES)
        emitted = kept.count()
        reason = "constant UNIQUE columns" if any(s.constant for s in sets) else f"no fitting row in {RETRIES} retries"
        return kept, Dropped(key, n, emitted, reason) if emitted < n else None

    def run(self, keep_row: bool = False) -> Generated:
        out = Generated({}, self.plan, warnings=self.warnings)
        for key in self.plan.order:
            if self.rows_of(key) <= 0 or key in self.existing:
                continue
            if key not in self.done:
                self.finish(key)
            out.tables[key] = self.done[key] if keep_row else self.done[key].drop("row")
            if key in self.lost:
                out.dropped.append(self.lost[key])
        return out

    def finish(self, key: str) -> None:
        self._making.add(key)
        self.done[key], dropped = self.table(key)
        if dropped:
            self.lost[key] = dropped


def pushed_down(check: dict) -> bool:
    names = check.get("columns") or []
    return len(names) == 1 and parse_check(check["expression"], names[0]) is not None


def spark_check(expression: str) -> str:
    """A CHECK's text for Spark: casts go, as columns have their types already."""
    return strip_casts(expression)


def dense_index(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` with ``__ix`` from 0 without gaps, and its rows.

    Rows are counted per partition, the counts (one a partition) are summed on the driver, and each
    row gets its partition's start plus its place: no single task sees all rows. The input must give
    the same partitions each time, so it is checkpointed first.
    """
    from .storage import settled

    df = settled(df.withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    counts = sorted((r["p"], r["n"]) for r in df.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    places = df.sparkSession.createDataFrame(starts, "__p long, __start long")
    low = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    out = df.withColumn("__p", part).join(F.broadcast(places), "__p").withColumn("__ix", F.col("__start") + low)
    return out.drop("__p", "__start", "__id"), total


# Spark types of the data types that a generator's own type doesn't settle.
SPARK_TYPES = {
    "smallint": "smallint", "integer": "int", "bigint": "bigint", "int": "int", "int2": "smallint", "int4": "int", "int8": "bigint", "real": "float", "double precision": "double",
    "boolean": "boolean", "date": "date", "timestamp with time zone": "timestamp", "timestamptz": "timestamp", "timestamp without time zone": "timestamp_ntz", "timestamp": "timestamp_ntz", "bytea": "binary",
}


def spark_type(spec: ColumnSpec, registry: Registry) -> str:
    kind = spec.data_type.lower()
    if kind in ("numeric", "decimal") and spec.params.get("precision"):
        return f"decimal({spec.params['precision']},{spec.params.get('scale', 0)})"
    if kind in SPARK_TYPES:
        return SPARK_TYPES[kind]
    factory = registry.get(spec.factory) if spec.value is None and not spec.values else None
    if kind in ("numeric", "decimal"):
        return "double"
    if factory and factory.kind == "array":
        return array_type(Params(spec.params), Column())
    return factory.kind if factory and not kind else "string"


def cast_sql(sql: str, spec: ColumnSpec, registry: Registry) -> str:
    kind = spark_type(spec, registry)
    return sql if kind.startswith("array") else f"CAST({sql} AS {kind})"


def permutation(n: int, size: int, seed: int = 0) -> tuple[int, int]:
    """(a, b) so that row -> (a * row + b) mod size visits distinct places: a is coprime to size."""
    import math

    a = (0x9E3779B97F4A7C15 ^ (seed * 0x2545F4914F6CDD1D)) % max(1, size) | 1
    while math.gcd(a, size) != 1:
        a += 2
    return a % size if size > 1 else 0, seed % max(1, size)


def fill_pairs(rows: DataFrame, sizes: dict[str, int], seed: int = 0) -> DataFrame:
    """Distinct tuples of numbers below ``sizes``, one for each row below their product: exact, without
    retries or a shuffle, by an affine permutation of the product's places."""
    size = 1
    for s in sizes.values():
        size *= s
    a, b = permutation(0, size, seed)
    wide = "decimal(38,0)"
    out = rows.filter(F.col("row") < size).withColumn("__at", ((F.col("row").cast(wide) * F.lit(a).cast(wide) + F.lit(b).cast(wide)) % F.lit(size).cast(wide)).cast("long"))
    step = 1
    for name, s in sizes.items():
        out = out.withColumn(name, F.floor(F.col("__at") / step).cast("long") % s if step > 1 else F.col("__at") % s)
        step *= s
    return out.drop("__at")


def expand_children(parents: DataFrame, key: str, lo: int, hi: int, seed: int = 42, table: str = "t") -> DataFrame:
    """Each parent's key with its children's numbers, ``lo`` to ``hi`` of them (the exact form of a range per parent)."""
    d = Dialect(seed, table, "children", f"`{key}`")
    n = F.expr(d.between(lo, hi))
    return parents.select(F.col(key), n.alias("__n")).filter("__n > 0").select(key, F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))).alias("child"))


