"""Queries over the test tables, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions.dialect import Dialect, Duck
from loam.functions.generators import Column, Registry, value_sql
from loam.operators import audit, emit, infer
from loam.operators.generate import Generator, class_name, dense_index, expand_children, fill_pairs, permutation
from loam.operators.unique import first_wins, resample
from loam.plans import checks, fix, graph
from loam.plans.config import from_mapping
from loam.plans.lint import counts, fix_order, issues_frame, lint
from loam.plans.merge import merge
from loam.sources import catalog

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
REGISTRY = Registry()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row numbers: the keys of ``orders``."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row"))


ROWS_SQL = "(SELECT o_orderkey AS row FROM orders) AS r"


# --- generators ------------------------------------------------------------------------------


def _shown(d: Dialect, sql: str, kind: str) -> str:
    """In a form that both engines compare alike."""
    duck = isinstance(d, Duck)
    if kind == "timestamp":
        return f"epoch_us({sql})" if duck else f"unix_micros({sql})"
    if kind == "date":
        return d.text(sql)
    if kind == "binary":
        return f"lower(hex({sql}))"
    if kind == "array":
        return d.join(sql, ",")
    return f"CAST({sql} AS BIGINT)" if kind in ("bigint", "int") else sql


def _generator(name: str, factory: str, params: dict | None = None, column: Column | None = None) -> None:
    f = REGISTRY.get(factory)
    c = column or Column(f"{factory.lower()}_column")
    sql, duck = (_shown(d, value_sql(d, f, params, c), f.kind) for d in (Dialect(42, "t", c.name), Duck(42, "t", c.name)))
    query(name, f"SELECT row AS row_id, {duck} AS value FROM {ROWS_SQL}")(lambda spark, sf_dir, sql=sql: rows(spark, sf_dir).select(F.col("row").alias("row_id"), F.expr(sql).alias("value")))


_PARAMS = {"enum_value": {"values": ["pending", "paid", "shipped"]}, "EnumValueStr": {"values": ["open", "it's", "closed"]}, "decimal": {"precision": 5, "scale": 2}}
_COLUMNS = {"array": Column("tags", "ARRAY", "_text", 1), "integer": Column("quantity", "integer"), "localized_json": Column("title", "jsonb"), "string": Column("notes", "text")}
for _f in REGISTRY.all:
    if _f.name != "fkref":
        _generator(f"gen_{_f.name.lower()}", _f.name, _PARAMS.get(_f.name), _COLUMNS.get(_f.name))
for _kind in ("_int4", "_numeric", "_bool", "_uuid", "_jsonb"):
    _generator(f"gen_array{_kind}", "array", {"element": _kind, "size": 4}, Column("items"))
_generator("gen_truncate", "full_name", {"max_len": 6}, Column("short_name"))
_generator("gen_integer_wide", "integer", {"min": -(2**62), "max": 2**62}, Column("big"))
_generator("gen_integer_bounds", "integer", {"min": 18, "max": 120}, Column("age", "integer"))
_generator("gen_token_long", "token", {"length": 70}, Column("api_token"))
_generator("gen_enum_numeric", "enum_value", {"values": [1, 2, 5]}, Column("grade"))


@query("gen_literal", f"SELECT row AS row_id, 'fixed' AS text_value, 7::BIGINT AS int_value, true AS bool_value FROM {ROWS_SQL}")
def _literal(spark, sf_dir):
    g = Generator(spark, _config({"t": {"row_count": 1, "columns": {"text_value": {"value": "fixed"}, "int_value": {"value": 7}, "bool_value": {"value": True}}}}))
    text, number, flag = (F.expr(g.cell("public.t", c)) for c in ("text_value", "int_value", "bool_value"))
    return rows(spark, sf_dir).select(F.col("row").alias("row_id"), text.alias("text_value"), number.cast("long").alias("int_value"), flag.alias("bool_value"))


def _config(tables: dict, seed: int = 42):
    return from_mapping({"version": 1, "defaults": {"seed": seed}, "tables": tables})


_SHAPE = {"name": {"factory": "full_name"}, "score": {"factory": "integer", "params": {"min": 1, "max": 100}}, "addr": {"values": {"city": {"factory": "city"}, "code": {"value": "X"}}}}


def _shape_sql() -> str:
    def at(*path):
        return Duck(42, "public.profiles", "meta", path=path)

    city = value_sql(at("addr", "city"), REGISTRY.get("city"))
    name = value_sql(at("name"), REGISTRY.get("full_name"))
    score = value_sql(at("score"), REGISTRY.get("integer"), {"min": 1, "max": 100})
    return f"SELECT row AS row_id, json_object('addr', json_object('city', {city}, 'code', 'X'), 'name', {name}, 'score', {score})::VARCHAR AS value FROM {ROWS_SQL}"


@query("gen_json_shape", _shape_sql())
def _json_shape(spark, sf_dir):
    g = Generator(spark, _config({"profiles": {"row_count": 1, "columns": {"meta": {"values": _SHAPE, "data_type": "jsonb"}}}}))
    return rows(spark, sf_dir).select(F.col("row").alias("row_id"), F.expr(g.cell("public.profiles", "meta")).alias("value"))


# What a generator's text must look like, or the bounds of its number, or the size of its pool (0: no pool).
_FORMATS = {
    "full_name": r"^\S+ \S+$",
    "email": r"^user[0-9]+_[0-9]{1,4}@example\.com$",
    "phone": r"^\+[0-9]{1,3}[0-9]{8}$",
    "url": r"^https://example\.com/[0-9]+$",
    "image_url": r"^https://picsum\.photos/seed/[0-9]+/200/200$",
    "hostname": r"^tenant-[0-9]+\.example\.[a-z]+$",
    "slug": r"^[a-z]+-[a-z]+-[0-9]+$",
    "color": r"^#[0-9A-F]{6}$",
    "gender": r"^(male|female)$",
    "token": r"^[0-9a-f]{32}$",
    "ip_address": r"^10\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$",
    "filename": r"^file_[0-9]+\.[a-z0-9]+$",
    "username": r"^[a-z]+_user_[0-9]+$",
    "uuid": r"^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$",
    "checksum": r"^[0-9a-f]{40}$",
    "version_str": r"^[0-4]\.1?[0-9]\.[0-9]{1,2}$",
    "bool": r"^(true|false)$",
    "bytea": r"^[0-9a-f]{32}$",
    "date": r"^202[4-8]-[01][0-9]-[0-3][0-9]",
    "timestamp_str": r"^202[45]-[01][0-9]-[0-3][0-9]T[0-2][0-9]:[0-5][0-9]:[0-5][0-9]\+00:00$",
    "point": r"^\(-?[0-9]{1,2}\.[0-9]{6},-?[0-9]{1,3}\.[0-9]{6}\)$",
    "time_of_day": r"^([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]$",
    "pg_interval": r"^(0[0-9]|1[0-2]):[0-5][0-9]:00$",
    "string": r"^string_column_[0-9]+$",
    "json_any": r'^\{"row": ?[0-9]+\}$',
}
_BOUNDS = {
    "position": (1, 100), "version_int": (1, 50), "level": (1, 10), "year": (2015, 2026), "priority": (1, 10), "percentage": (0, 100), "duration": (0, 7200),
    "file_size": (1024, 52428800), "counter": (0, 100), "amount": (0, 9999.99), "port": (1024, 65535), "latitude": (-90, 90), "longitude": (-180, 180),
    "integer": (0, 1000000), "decimal": (0, 10000),
}
_POOLS = {"first_name": 62, "last_name": 62, "company": 7, "city": 44, "country": 48, "mime_type": 12, "currency": 10, "language_code": 14, "status_code": 14}


@query("gen_formats", "SELECT factory, (SELECT count(*) FROM orders) AS n, 0::BIGINT AS misfits, pool FROM (VALUES " + ", ".join(f"('{f}', {_POOLS.get(f, 0)}::BIGINT)" for f in (*_FORMATS, *_BOUNDS, *_POOLS)) + ") v(factory, pool)")
def _formats(spark, sf_dir):
    """Values held against formats, bounds and pool sizes that are stated apart from the generators; one pass over the rows."""
    d = Dialect(42, "t")

    def shown(name):
        f, at = REGISTRY.get(name), Dialect(42, "t", f"{name}_column")
        return _shown(d, value_sql(at, f, None, Column(f"{name}_column")), f.kind)

    fits = {f: f"CAST({shown(f)} AS STRING) RLIKE {d.s(p)}" for f, p in _FORMATS.items()} | {f: f"CAST({shown(f)} AS DOUBLE) BETWEEN {a} AND {b}" for f, (a, b) in _BOUNDS.items()}
    fits |= {f: f"{shown(f)} IS NOT NULL" for f in _POOLS}
    cells = rows(spark, sf_dir).select(*[F.expr(x).alias(f"fit_{f}") for f, x in fits.items()], *[F.expr(f"CAST({shown(f)} AS STRING)").alias(f"pool_{f}") for f in _POOLS])
    one = cells.agg(
        F.count("*").alias("n"),
        *[F.count(F.when(F.coalesce(F.col(f"fit_{f}"), F.lit(False)), None).otherwise(1)).alias(f"odd_{f}") for f in fits],
        *[F.size(F.collect_set(f"pool_{f}")).cast("long").alias(f"size_{f}") for f in _POOLS],  # a pool has at most 62 values
    )
    each = F.array(*[F.struct(F.lit(f).alias("factory"), F.col(f"odd_{f}").alias("misfits"), (F.col(f"size_{f}") if f in _POOLS else F.lit(0).cast("long")).alias("pool")) for f in fits])
    return one.select("n", F.explode(each).alias("x")).select("x.factory", "n", "x.misfits", "x.pool")


# --- references ------------------------------------------------------------------------------

_PARENTS = {
    "customers": {"row_count": 1500, "primary_key": ["id"], "columns": {"id": {"factory": "pk_serial", "data_type": "integer"}}},
    "suppliers": {"row_count": 100, "primary_key": ["id"], "columns": {"id": {"factory": "pk_serial", "data_type": "integer"}}},
    "parts": {"row_count": 2000, "primary_key": ["id"], "columns": {"id": {"factory": "uuid", "data_type": "uuid"}}},
}


def _child(columns: dict, **more) -> dict:
    return {**_PARENTS, "orders": {"row_count": 1, "columns": columns, **more}}


def _fk_hash(column: str) -> str:
    return Duck(42, "public.orders", column).h("'fk'")


@query("fk_sample_recompute", f"SELECT row AS row_id, CAST(1 + {_fk_hash('customer_id')} % 1500 AS BIGINT) AS customer_id, {value_sql(Duck(42, 'public.parts', 'id', f'({_fk_hash('part_id')} % 2000)'), REGISTRY.get('uuid'))} AS part_id FROM {ROWS_SQL}")
def _fk_recompute(spark, sf_dir):
    g = Generator(spark, _config(_child({"customer_id": {"factory": "fkref", "params": {"target": "customers.id"}}, "part_id": {"factory": "fkref", "params": {"target": "parts.id"}}})))
    return rows(spark, sf_dir).select(F.col("row").alias("row_id"), F.expr(g.cell("public.orders", "customer_id")).cast("long").alias("customer_id"), F.expr(g.cell("public.orders", "part_id")).alias("part_id"))


def ordered_index(df: DataFrame, key: str) -> tuple[DataFrame, int]:
    """Dense numbers in the order of the key: ranges are sorted apart and numbered on from one another."""
    return dense_index(df.repartitionByRange(key).sortWithinPartitions(key))


@query("fk_sample_join", f"WITH p AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS ix, count(*) OVER () AS n FROM customer), r AS (SELECT row, {_fk_hash('customer_key')} AS h FROM {ROWS_SQL}) SELECT r.row AS row_id, p.c_custkey AS customer_key FROM r JOIN p ON p.ix = r.h % p.n")
def _fk_join(spark, sf_dir):
    parents, n = ordered_index(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    h = Dialect(42, "public.orders", "customer_key").h("'fk'")
    child = rows(spark, sf_dir).select(F.col("row").alias("row_id"), (F.expr(h) % n).alias("__ix"))
    return child.join(parents, "__ix").select("row_id", F.col("c_custkey").alias("customer_key"))


@query("fk_self_reference", f"SELECT row AS row_id, CAST(1 + {Duck(42, 'public.categories', 'parent_id').h(chr(39) + 'fk' + chr(39))} % (row + 1) AS BIGINT) AS parent_id FROM {ROWS_SQL}")
def _fk_self(spark, sf_dir):
    cfg = _config({"categories": {"row_count": 1, "columns": {"id": {"factory": "pk_serial"}, "parent_id": {"factory": "fkref", "params": {"target": "categories.id"}}}}})
    return rows(spark, sf_dir).select(F.col("row").alias("row_id"), F.expr(Generator(spark, cfg).cell("public.categories", "parent_id")).cast("long").alias("parent_id"))


@query("fk_cycle_null", f"SELECT row AS row_id, CAST(1 + {Duck(42, 'public.b', 'a_id').h(chr(39) + 'fk' + chr(39))} % 10 AS BIGINT) AS later_id, CAST(NULL AS VARCHAR) AS earlier_id FROM {ROWS_SQL}")
def _fk_cycle(spark, sf_dir):
    ref = lambda t: {"factory": "fkref", "nullable": True, "params": {"target": t}}
    cfg = _config({"a": {"row_count": 10, "columns": {"id": {"factory": "pk_serial"}, "b_id": ref("b.id")}}, "b": {"row_count": 10, "columns": {"id": {"factory": "pk_serial"}, "a_id": ref("a.id")}}})
    g = Generator(spark, cfg)
    return rows(spark, sf_dir).select(F.col("row").alias("row_id"), F.expr(g.cell("public.b", "a_id")).cast("long").alias("later_id"), F.expr(g.cell("public.a", "b_id")).alias("earlier_id"))


def _polymorph_sql() -> str:
    d = Duck(42, "public.orders", "owner_id")
    h0, h1 = d.h(0), d.h(1)
    part = value_sql(Duck(42, "public.parts", "id", f"({h1} % 2000)"), REGISTRY.get("uuid"))
    return (
        f"SELECT row AS row_id, CASE {h0} % 3 WHEN 0 THEN 'Customer' WHEN 1 THEN 'Supplier' ELSE 'Part' END AS owner_type, "
        f"CASE {h0} % 3 WHEN 0 THEN CAST(1 + {h1} % 1500 AS VARCHAR) WHEN 1 THEN CAST(1 + {h1} % 100 AS VARCHAR) ELSE {part} END AS owner_id FROM {ROWS_SQL}"
    )


@query("fk_polymorphic", _polymorph_sql())
def _fk_polymorphic(spark, sf_dir):
    pair = {"type_column": "owner_type", "id_column": "owner_id", "candidates": [{"table": t} for t in ("customers", "suppliers", "parts")]}
    g = Generator(spark, _config(_child({"owner_type": {"data_type": "text"}, "owner_id": {"data_type": "text"}}, polymorphs=[pair])))
    return rows(spark, sf_dir).select(F.col("row").alias("row_id"), *[F.expr(g.cell("public.orders", c)).alias(c) for c in ("owner_type", "owner_id")])


def _polymorph_dropped_sql(type_name: str, keys: str, salt: str) -> str:
    """A pair of one candidate whose keys are numbered from 0 in their order."""
    d = Duck(42, "public.orders", salt)
    return f"WITH p AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS ix, count(*) OVER () AS n FROM ({keys})), r AS (SELECT row, {d.h(1)} AS h FROM {ROWS_SQL}) SELECT r.row AS row_id, '{type_name}' AS owner_type, CAST(p.k AS VARCHAR) AS owner_id FROM r JOIN p ON p.ix = r.h % p.n"


def _polymorph_over(spark, sf_dir, tables: dict, candidate: dict, existing=None):
    pair = {"type_column": "owner_type", "id_column": "owner_id", "candidates": [candidate]}
    g = Generator(spark, _config({**tables, "orders": {"row_count": 1, "columns": {"owner_type": {"data_type": "text"}, "owner_id": {"data_type": "text"}}, "polymorphs": [pair]}}), existing=existing)
    return g.project("public.orders", rows(spark, sf_dir), "0").withColumnRenamed("row", "row_id")


@query("fk_polymorphic_dropped_parent", f"SELECT row AS row_id, 'Single' AS owner_type, '1' AS owner_id FROM {ROWS_SQL}")
def _fk_polymorphic_dropped(spark, sf_dir):
    """Of the parent's fifty rows one is left, as its UNIQUE column is a literal: every reference names that row."""
    parent = {"row_count": 50, "primary_key": ["id"], "unique_keys": [["kind"]], "columns": {"id": {"factory": "pk_serial", "data_type": "integer"}, "kind": {"value": "config"}}}
    return _polymorph_over(spark, sf_dir, {"singles": parent}, {"table": "singles"})


@query("fk_polymorphic_existing_parent", _polymorph_dropped_sql("Customer", "SELECT c_custkey AS k FROM customer", "owner_id"))
def _fk_polymorphic_existing(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select("c_custkey")
    return _polymorph_over(spark, sf_dir, {}, {"table": "customers", "pk_column": "c_custkey"}, {"customers": keys.repartitionByRange("c_custkey").sortWithinPartitions("c_custkey")})


@query("fk_composite_consistent", f"SELECT row AS row_id, CAST(1 + ({Duck(42, 'public.orders', 'fk public.pairs').h(chr(39) + 'fk' + chr(39))} % 500) AS BIGINT) AS pair_a, CAST(1001 + ({Duck(42, 'public.orders', 'fk public.pairs').h(chr(39) + 'fk' + chr(39))} % 500) AS BIGINT) AS pair_b FROM {ROWS_SQL}")
def _fk_composite(spark, sf_dir):
    pairs = {"row_count": 500, "primary_key": ["a", "b"], "columns": {"a": {"factory": "pk_serial"}, "b": {"factory": "pk_serial", "params": {"start": 1001}}}}
    ref = lambda t: {"factory": "fkref", "params": {"target": t, "consistent": True}}
    g = Generator(spark, _config({"pairs": pairs, "orders": {"row_count": 1, "columns": {"pair_a": ref("pairs.a"), "pair_b": ref("pairs.b")}}}))
    return rows(spark, sf_dir).select(F.col("row").alias("row_id"), *[F.expr(g.cell("public.orders", c)).cast("long").alias(c) for c in ("pair_a", "pair_b")])


@query("fk_expand_children", f"WITH c AS (SELECT c_custkey AS row FROM customer) SELECT row AS c_custkey, unnest(range(1, 1 + {Duck(42, 'lines', 'children').between(0, 4)})) AS child FROM c")
def _expand(spark, sf_dir):
    return expand_children(table(spark, sf_dir, "customer"), "c_custkey", 0, 4, 42, "lines")


# --- uniqueness ------------------------------------------------------------------------------

_LINE_ORDER = "l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


@query("unique_first_wins", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LINE_ORDER}) = 1")
def _first_wins(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("row", F.struct(*_LINE_ORDER.split(", ")))
    return first_wins(lines, [("l_orderkey", "l_linenumber")]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


_PLACES, _ROUNDS = 20_000, 3


def _rounds_sql() -> str:
    parts = ["r AS (SELECT o_orderkey AS row FROM orders)"]
    for a in range(_ROUNDS + 1):
        d = Duck(42, "seats", "seat", attempt=str(a))
        left = "" if a == 0 else " WHERE " + " AND ".join(f"row NOT IN (SELECT row FROM w{k})" for k in range(a))
        free = "" if a == 0 else " WHERE " + " AND ".join(f"seat NOT IN (SELECT seat FROM w{k})" for k in range(a))
        parts.append(f"d{a} AS (SELECT row, {d.h()} % {_PLACES} AS seat FROM r{left})")
        parts.append(f"w{a} AS (SELECT row, seat FROM (SELECT *, row_number() OVER (PARTITION BY seat ORDER BY row) AS n FROM d{a}) WHERE n = 1{free.replace(' WHERE', ' AND', 1)})")
    return f"WITH {', '.join(parts)} " + " UNION ALL ".join(f"SELECT row AS row_id, seat FROM w{a}" for a in range(_ROUNDS + 1))


def _seats(spark, sf_dir):
    draw = lambda r, a: r.select("row", (F.expr(Dialect(42, "seats", "seat", attempt=str(a)).h()) % _PLACES).alias("seat"))
    return resample(rows(spark, sf_dir), draw, [("seat",)], _ROUNDS)


@query("unique_resample_rounds", _rounds_sql())
def _resample(spark, sf_dir):
    return _seats(spark, sf_dir).select(F.col("row").alias("row_id"), "seat")


@query("unique_drop_report", f"SELECT 'seats' AS table_name, (SELECT count(*) FROM orders) AS requested, count(*) AS emitted, (SELECT count(*) FROM orders) - count(*) AS dropped FROM ({_rounds_sql()})")
def _drop_report(spark, sf_dir):
    return emit.drop_report({"seats": table(spark, sf_dir, "orders").count()}, {"seats": _seats(spark, sf_dir)})


@query("unique_literal_drop", "SELECT 'config' AS kind, 3::BIGINT AS requested, 1::BIGINT AS emitted")
def _literal_drop(spark, sf_dir):
    made = Generator(spark, _config({"singleton": {"row_count": 3, "unique_keys": [["kind"]], "columns": {"kind": {"value": "config"}}}})).run()
    d = made.dropped[0]
    return made.tables["public.singleton"].select("kind", F.lit(d.requested).cast("long").alias("requested"), F.lit(d.emitted).cast("long").alias("emitted"))


_FILL = {"a": 30_000, "b": 40_000}  # places for every row
_A, _B = permutation(0, 30_000 * 40_000, 7)


@query("unique_permutation_fill", f"WITH p AS (SELECT row, CAST(({_A}::HUGEINT * row + {_B}) % 1200000000 AS BIGINT) AS spot FROM {ROWS_SQL}) SELECT row AS row_id, spot % 30000 AS a, (spot // 30000) % 40000 AS b FROM p")
def _permutation(spark, sf_dir):
    return fill_pairs(rows(spark, sf_dir), _FILL, 7).select(F.col("row").alias("row_id"), "a", "b")


# --- graph and plan --------------------------------------------------------------------------

# (child, column, parent, nullable, deferrable): the test tables' references and a cycle.
EDGES = (
    ("customer", "c_nationkey", "nation", False, False),
    ("employee", "department_id", "department", False, False),
    ("department", "head_id", "employee", True, True),
    ("events", "user_id", "customer", False, False),
    ("labels", "doc_id", "documents", False, False),
    ("lineitem", "l_orderkey", "orders", False, False),
    ("lineitem", "l_partkey", "part", False, False),
    ("lineitem", "l_suppkey", "supplier", False, False),
    ("nation", "n_regionkey", "region", False, False),
    ("orders", "o_custkey", "customer", False, False),
    ("supplier", "s_nationkey", "nation", False, False),
)
_EDGE_VALUES = ", ".join(f"('{c}', '{n}', '{p}', {str(x).lower()}, {str(d).lower()})" for c, n, p, x, d in EDGES)
_EDGES_SQL = f"edges(child, col, parent, nullable, later) AS (VALUES {_EDGE_VALUES})"
_REACH_SQL = f"{_EDGES_SQL}, reach(child, ancestor) AS (SELECT child, parent FROM edges UNION SELECT reach.child, edges.parent FROM reach JOIN edges ON edges.child = reach.ancestor)"


def _edges() -> list[graph.Edge]:
    return [graph.Edge(c, n, p, "", x, d) for c, n, p, x, d in EDGES]


def _nodes() -> list[str]:
    return sorted({x for e in EDGES for x in (e[0], e[2])})


@query("graph_reachability", f"WITH RECURSIVE {_REACH_SQL} SELECT child, ancestor FROM reach")
def _reachability(spark, sf_dir):
    """Transitive closure by doubling joins over the edge table until nothing is added."""
    step = catalog.edges_frame(spark, _edges()).select("child", F.col("parent").alias("ancestor")).distinct()
    known, size = step, step.count()
    while True:
        longer = known.join(step.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("next")), "ancestor").select("child", F.col("next").alias("ancestor"))
        known = known.union(longer).distinct()
        if (now := known.count()) == size:
            return known
        size = now


@query("graph_cycles", f"WITH RECURSIVE {_REACH_SQL} SELECT a.child AS member, b.child AS with_member FROM reach a JOIN reach b ON a.ancestor = b.child AND b.ancestor = a.child WHERE a.child <> b.child")
def _cycles(spark, sf_dir):
    groups = [g for g in graph.components(_nodes(), _edges()) if len(g) > 1]
    return spark.createDataFrame([(a, b) for g in groups for a in g for b in g if a != b], "member string, with_member string")


@query("graph_insert_order", f"WITH RECURSIVE {_EDGES_SQL}, acyclic AS (SELECT child, parent FROM edges WHERE NOT nullable), depth(node, level) AS (SELECT parent, 0 FROM edges UNION SELECT child, 0 FROM edges UNION SELECT a.child, d.level + 1 FROM depth d JOIN acyclic a ON a.parent = d.node) SELECT node AS table_name, max(level)::BIGINT AS level FROM depth GROUP BY node")
def _insert_order(spark, sf_dir):
    edges = [e for e in _edges() if not e.nullable]
    groups = graph.components(_nodes(), _edges())
    level: dict[str, int] = {}
    for n in (n for g in groups for n in graph.within_cycle(g, _edges())):
        level[n] = max([level.get(e.parent, 0) + 1 for e in edges if e.child == n], default=0)
    return spark.createDataFrame(list(level.items()), "table_name string, level long")


@query("graph_nondeferrable_edges", f"WITH RECURSIVE {_REACH_SQL} SELECT e.child, e.col AS column_name, e.parent FROM edges e JOIN reach r ON r.child = e.parent AND r.ancestor = e.child WHERE e.child <> e.parent AND NOT e.later AND NOT e.nullable")
def _nondeferrable(spark, sf_dir):
    p = graph.Plan([], [g for g in graph.components(_nodes(), _edges()) if len(g) > 1], {}, {}, _edges())
    return spark.createDataFrame([(e.child, e.column, e.parent) for e in graph.non_deferrable(p)], "child string, column_name string, parent string")


@query("plan_row_count_per", "WITH o AS (SELECT count(*) AS n FROM orders) SELECT * FROM (SELECT 'a' AS table_name, n AS rows FROM o UNION ALL SELECT 'b', n * 2 FROM o UNION ALL SELECT 'c', n * 2 * 3 FROM o UNION ALL SELECT 'd', n + n * 2 * 4 FROM o UNION ALL SELECT 'none', 0 FROM o)")
def _row_count_per(spark, sf_dir):
    n = table(spark, sf_dir, "orders").count()
    per = lambda **k: {"row_count_per": {p: list(v) for p, v in k.items()}, "columns": {}}
    ref = lambda t, p: {**t, "columns": {x: {"factory": "fkref", "nullable": True, "params": {"target": f"{x}.id"}} for x in p}}
    cfg = _config({"a": {"row_count": n, "columns": {}}, "b": ref(per(a=(2, 2)), "a"), "c": ref(per(b=(3, 3)), "b"), "d": ref(per(a=(0, 1), b=(3, 6)), "ab"), "none": per(a=(0, 0))})
    return spark.createDataFrame([(k.split(".")[1], v) for k, v in graph.plan(cfg).counts.items()], "table_name string, rows long")


@query("plan_zero_cascade", f"WITH RECURSIVE {_EDGES_SQL}, empty(t) AS (SELECT 'nation' UNION SELECT e.child FROM empty JOIN edges e ON e.parent = empty.t AND NOT e.nullable) SELECT node AS table_name, CASE WHEN node IN (SELECT t FROM empty) THEN 0 ELSE 5 END::BIGINT AS rows FROM (SELECT child AS node FROM edges UNION SELECT parent FROM edges)")
def _zero_cascade(spark, sf_dir):
    n = {k: 0 if k == "nation" else 5 for k in _nodes()}
    graph.cascade(n, _edges())
    return spark.createDataFrame(list(n.items()), "table_name string, rows long")


# --- inference and catalogue -----------------------------------------------------------------

CATALOG: dict[str, list[Column]] = {
    "users": [Column("id", "integer"), Column("email", "text"), Column("first_name", "text"), Column("display_name", "text"), Column("home_phone", "text"), Column("created_at", "timestamp with time zone"), Column("is_active", "boolean"), Column("birth_year", "integer"), Column("avatar", "text"), Column("last_ip", "inet", "inet")],
    "orders": [Column("id", "uuid"), Column("user_id", "integer"), Column("status", "USER-DEFINED", "order_status", enum_values=("pending", "paid")), Column("total", "numeric"), Column("unit_price", "numeric"), Column("shipping_cost", "integer"), Column("placed", "date"), Column("order_type", "text"), Column("status_code", "integer"), Column("delivery_time", "text")],
    "articles": [Column("id", "bigint"), Column("slug", "text"), Column("title", "text"), Column("description", "text"), Column("body_color", "text"), Column("tags", "ARRAY", "_text", 1), Column("meta", "jsonb"), Column("name_localized", "jsonb"), Column("view_count", "integer"), Column("version", "text"), Column("attrs", "USER-DEFINED", "hstore"), Column("commentable_type", "text"), Column("commentable_id", "integer"), Column("weird", "xml")],
    "places": [Column("id", "integer"), Column("lat", "numeric"), Column("lon", "double precision"), Column("spot", "point", "point"), Column("opens", "time without time zone", "time"), Column("stay", "interval", "interval"), Column("valid", "tstzrange", "tstzrange"), Column("photo", "bytea"), Column("user_score", "smallint"), Column("file_size", "bigint"), Column("owner_type", "text"), Column("owner_id", "bigint")],
}
_text = lambda x: "'" + str(x).replace("'", "''") + "'"
_CATALOG_SQL = "cols(table_name, column_name, families) AS (VALUES " + ", ".join(f"({_text(t)}, {_text(c)}, [{', '.join(map(_text, f))}]::VARCHAR[])" for t, c, f in infer.column_rows(CATALOG)) + ")"
_RULES_SQL = "rules(factory, place, family, pattern, unless, normal, score) AS (VALUES " + ", ".join(f"({_text(n)}, {i}, {_text(f)}, {_text(p)}, {_text(u)}, {str(x).lower()}, {s})" for n, i, f, p, u, x, s in infer.rule_rows(REGISTRY)) + ")"
_SCORES_SQL = f"""{_CATALOG_SQL}, {_RULES_SQL},
  met AS (SELECT table_name, column_name, unnest(families) AS family FROM cols),
  named AS (SELECT m.table_name, m.column_name, r.*, CASE WHEN normal THEN regexp_replace(lower(column_name), '[_-]', '', 'g') ELSE lower(column_name) END AS name FROM met m JOIN rules r USING (family)),
  scores AS (SELECT table_name, column_name, factory, place, max(score) AS score FROM named WHERE regexp_matches(name, pattern) AND NOT (unless <> '' AND regexp_matches(name, unless)) GROUP BY ALL)"""


@query("infer_factory", f"WITH {_SCORES_SQL}, won AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY table_name, column_name ORDER BY score DESC, place) = 1) SELECT c.table_name, c.column_name, factory, coalesce(score, 0) AS score, coalesce(score, 0) < 60 AS unresolved FROM cols c LEFT JOIN won USING (table_name, column_name)")
def _infer(spark, sf_dir):
    return infer.best(*infer.frames(spark, CATALOG, REGISTRY))


@query("infer_top8", f"WITH {_SCORES_SQL} SELECT table_name, column_name, row_number() OVER (PARTITION BY table_name, column_name ORDER BY score DESC, factory) AS place, factory, score FROM scores QUALIFY row_number() OVER (PARTITION BY table_name, column_name ORDER BY score DESC, factory) <= 8")
def _infer_top(spark, sf_dir):
    return infer.top(*infer.frames(spark, CATALOG, REGISTRY)).withColumn("place", F.col("place").cast("long"))


@query("infer_json_shape", "WITH k AS (SELECT props, unnest(json_keys(props)) AS field FROM events), t AS (SELECT field, json_type(props, '$.' || field) AS j FROM k) SELECT field, CASE WHEN j IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT') THEN 'numeric' WHEN j = 'BOOLEAN' THEN 'boolean' WHEN j = 'OBJECT' THEN 'jsonb' ELSE 'text' END AS data_type, count(*) AS n FROM t GROUP BY ALL")
def _json_fields(spark, sf_dir):
    return infer.json_fields(table(spark, sf_dir, "events"), "props")


_META_ROWS = [("public", t, c.name, i + 1, c.data_type, c.udt, True) for t, cs in CATALOG.items() for i, c in enumerate(cs)]
_META_SQL = "meta(table_schema, table_name, column_name, position, data_type) AS (VALUES " + ", ".join(f"({_text(s)}, {_text(t)}, {_text(c)}, {i}, {_text(d)})" for s, t, c, i, d, _, _ in _META_ROWS) + ")"


@query("catalog_polymorph_pairs", f"WITH {_META_SQL} SELECT a.table_schema, a.table_name, a.column_name AS type_column, b.column_name AS id_column FROM meta a JOIN meta b ON a.table_schema = b.table_schema AND a.table_name = b.table_name AND a.column_name LIKE '%\\_type' ESCAPE '\\' AND b.column_name = left(a.column_name, length(a.column_name) - 5) || '_id' WHERE (a.data_type LIKE '%text%' OR a.data_type LIKE '%char%' OR a.data_type = 'USER-DEFINED') AND b.data_type LIKE '%int%'")
def _polymorph_pairs(spark, sf_dir):
    return catalog.polymorph_pairs(spark.createDataFrame(_META_ROWS, catalog.COLUMNS))


@query("catalog_only_exclude", f"WITH {_META_SQL}, t AS (SELECT DISTINCT table_schema, table_name FROM meta) SELECT * FROM t WHERE (table_name IN ('orders', 'places') OR table_schema || '.' || table_name IN ('public.users')) AND table_name <> 'places'")
def _only_exclude(spark, sf_dir):
    t = spark.createDataFrame(_META_ROWS, catalog.COLUMNS).select("table_schema", "table_name").distinct()
    return catalog.only_exclude(t, ["orders", "places", "public.users"], ["places"])


@query("catalog_pk_targets", f"WITH {_META_SQL} SELECT table_schema || '.' || table_name || '.' || column_name AS target FROM meta WHERE lower(column_name) = 'id'")
def _pk_targets(spark, sf_dir):
    m = spark.createDataFrame(_META_ROWS, catalog.COLUMNS)
    return m.filter(F.lower("column_name") == "id").select(F.concat_ws(".", "table_schema", "table_name", "column_name").alias("target")).orderBy("target")


def class_name_column(c: str):
    parts = F.transform(F.split(c, "_"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1_000_000)))
    return F.regexp_replace(F.array_join(parts, ""), "s$", "")


_NAMES = ("users", "order_items", "aPI_keys", "news", "x", "people_of_interests")


@query("classify_table_name", "SELECT t AS table_name, regexp_replace(array_to_string(list_transform(string_split(t, '_'), lambda p: upper(left(p, 1)) || substr(p, 2)), ''), 's$', '') AS class_name FROM (VALUES " + ", ".join(f"({_text(n)})" for n in _NAMES) + ") v(t)")
def _classify(spark, sf_dir):
    assert class_name("order_items") == "OrderItem"
    return spark.createDataFrame([(n,) for n in _NAMES], "table_name string").select("table_name", class_name_column("table_name").alias("class_name"))


@query("merge_full_outer", "WITH old AS (SELECT c_custkey AS k, 'f' || (c_custkey % 7) AS factory, c_nationkey AS nation FROM customer), new AS (SELECT c_custkey + 50 AS k, 'n' || (c_custkey % 5) AS factory, c_nationkey + 100 AS nation FROM customer) SELECT coalesce(old.k, new.k) AS k, CASE WHEN coalesce(old.factory, 'f0') <> 'f0' THEN old.factory ELSE coalesce(new.factory, old.factory) END AS factory, coalesce(new.nation, old.nation)::BIGINT AS nation, new.k IS NULL AS removed FROM old FULL JOIN new ON old.k = new.k")
def _merge(spark, sf_dir):
    """Two generations of a table's settings, key by key: the old factory stays if set, the schema's part is renewed."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey")
    old = c.select("k", F.concat(F.lit("f"), (F.col("k") % 7).cast("string")).alias("of"), F.col("c_nationkey").alias("on"))
    new = c.select((F.col("k") + 50).alias("nk"), F.concat(F.lit("n"), (F.col("k") % 5).cast("string")).alias("nf"), (F.col("c_nationkey") + 100).alias("nn"))
    both = old.join(new, F.col("k") == F.col("nk"), "full_outer")
    return both.select(
        F.coalesce("k", "nk").alias("k"),
        F.when(F.coalesce("of", F.lit("f0")) != "f0", F.col("of")).otherwise(F.coalesce("nf", "of")).alias("factory"),
        F.coalesce("nn", "on").cast("long").alias("nation"),
        F.col("nk").isNull().alias("removed"),
    )


# (table, column, factory, min (set by people), max_len (the schema's)); a null is unset.
_OLD_COLUMNS = (("t", "kept", "city", 3, 20), ("t", "limit_gone", "email", None, 9), ("t", "unset", None, 4, None), ("t", "dropped", "token", 1, 7), ("gone", "c", "city", None, 5))
_NEW_COLUMNS = (("t", "kept", "string", 1, 30), ("t", "limit_gone", "string", 2, None), ("t", "unset", "slug", None, 6), ("t", "added", "uuid", None, None), ("fresh", "c", "city", 8, None))


def _columns_config(rows):
    tables: dict[str, dict] = {}
    for t, c, factory, low, longest in rows:
        params = {k: v for k, v in (("min", low), ("max_len", longest)) if v is not None}
        tables.setdefault(t, {"row_count": 1, "columns": {}})["columns"][c] = {"factory": factory or "", "params": params}
    return _config(tables)


def _columns_sql(name: str, rows) -> str:
    cell = lambda x: "NULL" if x is None else _text(x) if isinstance(x, str) else str(x)
    return f"{name}(t, c, factory, low, longest) AS (VALUES " + ", ".join(f"({', '.join(map(cell, r))})" for r in rows) + ")"


@query("merge_columns", f"WITH {_columns_sql('old', _OLD_COLUMNS)}, {_columns_sql('new', _NEW_COLUMNS)} SELECT coalesce(old.t, new.t) AS table_name, coalesce(old.c, new.c) AS column_name, coalesce(old.factory, new.factory) AS factory, coalesce(old.low, new.low)::VARCHAR AS min, CASE WHEN new.c IS NULL THEN old.longest ELSE new.longest END::VARCHAR AS max_len, new.c IS NULL AS removed FROM old FULL JOIN new ON old.t = new.t AND old.c = new.c")
def _merge_columns(spark, sf_dir):
    """Two configurations by the merge itself: factories and bounds that people set stay, the schema's limits are renewed."""
    made = merge(_columns_config(_OLD_COLUMNS), _columns_config(_NEW_COLUMNS))
    shown = lambda v: None if v is None else str(v)
    found = [(k.split(".")[1], n, c.factory, shown(c.params.get("min")), shown(c.params.get("max_len")), t.removed or c.removed) for k, t in made.tables.items() for n, c in t.columns.items()]
    return spark.createDataFrame(found, "table_name string, column_name string, factory string, min string, max_len string, removed boolean")


# --- CHECK push-down -------------------------------------------------------------------------

# (expression, column, smallest, largest, longest, values), as the rules say, written by hand; all null: not understood.
_PUSHED = (
    ("(age >= 0)", "age", 0, None, None, None),
    ("(price > 0)", "price", 1, None, None, None),
    ("(price > (0)::numeric)", "price", 1, None, None, None),
    ("(age BETWEEN 18 AND 120)", "age", 18, 120, None, None),
    ("((age >= 18) AND (age <= 120) AND (age < 65))", "age", 18, 64, None, None),
    ("(char_length((name)::text) <= 100)", "name", None, None, 100, None),
    ("(length(name) < 100)", "name", None, None, 99, None),
    ("((length(name) <= 50) AND (length(name) <= 80))", "name", None, None, 50, None),
    ("(status = ANY (ARRAY['pending'::text, 'paid'::text]))", "status", None, None, None, "pending|paid"),
    ("(status IN ('a', 'it''s', 'x, y'))", "status", None, None, None, "a|it's|x, y"),
    ("(kind = 'only')", "kind", None, None, None, "only"),
    ("(n IN (1, 2))", "n", None, None, None, "1|2"),
    ("(now() > created_at)", "created_at", None, None, None, None),
    ("(start_date < end_date)", "start_date", None, None, None, None),
    ("((a > 0) AND (b > 0))", "a", None, None, None, None),
    ("((a > 0) OR (a < -5))", "a", None, None, None, None),
)


@query("check_pushdown", "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL::VARCHAR" if x is None else _text(x) for x in r) + ")" for r in _PUSHED) + ") v(expression, column_name, smallest, largest, longest, allowed)")
def _check_pushdown(spark, sf_dir):
    found = [(e, c, checks.parse_check(e, c) or {}) for e, c, *_ in _PUSHED]
    out = [(e, c, *(None if k not in p else str(p[k]) for k in ("min", "max", "max_len")), "|".join(map(str, p["values"])) if "values" in p else None) for e, c, p in found]
    return spark.createDataFrame(out, "expression string, column_name string, smallest string, largest string, longest string, allowed string")


_HELD = {
    "age": ("((age >= 18) AND (age <= 65))", "age BETWEEN 18 AND 65", {"factory": "integer", "data_type": "integer"}),
    "status": ("(status = ANY (ARRAY['new'::text, 'done'::text]))", "status IN ('new', 'done')", {"factory": "string", "data_type": "text"}),
    "name": ("(char_length((name)::text) <= 5)", "length(name) <= 5", {"factory": "full_name", "data_type": "text"}),
    "price": ("((price > (0)::numeric) AND (price <= 99.5))", "price > 0 AND price <= 99.5", {"factory": "amount", "data_type": "numeric"}),
}


@query("check_generated", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS rule, count(*) AS checked, 0::BIGINT AS violations FROM orders" for c in _HELD) + ")")
def _check_generated(spark, sf_dir):
    """Rows generated under pushed-down CHECKs, held against the rules as SQL says them."""
    cfg = _config({"t": {"row_count": 1, "checks": [{"name": c, "expression": e, "columns": [c]} for c, (e, _, _) in _HELD.items()], "columns": {c: spec for c, (_, _, spec) in _HELD.items()}}})
    left = checks.apply_checks(cfg.tables["public.t"])
    made = Generator(spark, cfg).project("public.t", rows(spark, sf_dir), "0")
    bad = audit.checks(made.filter(" AND ".join(f"{c} IS NOT NULL" for c in _HELD)), {c: rule for c, (_, rule, _) in _HELD.items() if c not in left})
    return bad.join(F.broadcast(made.agg(F.count("*").alias("checked"))), how="cross").select("rule", "checked", "violations")  # one row


# --- lint ------------------------------------------------------------------------------------

LINTED = {
    "parents": {"row_count": 0, "primary_key": ["id"], "columns": {"id": {"factory": "pk_serial", "data_type": "integer"}, "code": {"factory": "pk_serial", "data_type": "integer"}}},
    "children": {
        "row_count": 5, "row_count_per": {"ghosts": [1, 2]}, "unique_keys": [["code"], ["a", "b"]], "partial_unique_keys": [{"columns": ["code"], "predicate": "a > 0"}],
        "checks": [{"name": "across", "expression": "(a < b)", "columns": ["a", "b"]}], "excludes": [{"name": "apart", "definition": "EXCLUDE ...", "columns": ["a"]}],
        "columns": {
            "parent_id": {"factory": "fkref", "params": {"target": "parents.id"}, "data_type": "integer"}, "parent_code": {"factory": "fkref", "params": {"target": "parents.code"}, "nullable": True, "data_type": "integer"},
            "lost": {"factory": "fkref", "params": {"target": "ghosts.id"}, "nullable": True}, "bare": {"factory": "fkref", "nullable": True}, "none": {"data_type": "text"}, "odd": {"factory": "no_such"},
            "open": {"factory": "string", "unresolved": True}, "wrong": {"value": "x", "data_type": "integer"}, "pick": {"factory": "enum_value"}, "code": {"factory": "city"}, "a": {"factory": "integer"}, "b": {"factory": "integer"},
            "meta": {"values": {"plan": {"unresolved": True, "factory": "string"}}},
        },
    },
    "left": {"row_count": 2, "columns": {"id": {"factory": "pk_serial"}, "right_id": {"factory": "fkref", "params": {"target": "right.id"}}}},
    "right": {"row_count": 2, "columns": {"id": {"factory": "pk_serial"}, "left_id": {"factory": "fkref", "nullable": True, "params": {"target": "left.id"}}}},
}


# The findings that the model above has by the rules, written by hand: level, kind, location, message, hint, fixable.
_FOUND_SQL = """found(level, kind, location, message, hint, fixable) AS (VALUES
  ('ERR', 'fkref-missing-target', 'public.children.bare', 'fkref: missing target', 'name the target as schema.table.column', true),
  ('ERR', 'fkref-target-not-found', 'public.children.lost', 'fkref: target ghosts.id not found', 'pick an existing key column', true),
  ('ERR', 'no-factory', 'public.children.none', 'no factory', 'add a factory or a literal value', true),
  ('ERR', 'unknown-factory', 'public.children.odd', 'unknown factory no_such', 'is it misspelt, or a plugin''s?', true),
  ('ERR', 'value-type-mismatch', 'public.children.wrong', 'value type mismatch: text in a integer column', 'use a literal of the right type', true),
  ('ERR', 'row-count-per-missing', 'public.children', 'row_count_per: parent ghosts missing', 'fix the key or remove the entry', true),
  ('ERR', 'fkref-empty-pool', 'public.children.parent_id', 'fkref NOT NULL: public.parents has no rows', 'raise the parent''s count, allow nulls or set a value', true),
  ('ERR', 'fkref-in-cycle', 'public.left.right_id', 'fkref NOT NULL within a cycle: public.right', 'allow nulls or set a value', true),
  ('ERR', 'non-deferrable-cycle', 'fk cycle', 'public.right, public.left', 'public.left.right_id', false),
  ('WARN', 'json-field-unresolved', 'public.children.meta.plan', 'json field unresolved', 'pick a factory for the field', true),
  ('WARN', 'unresolved', 'public.children.open', 'unresolved', 'pick a factory or set one by hand', true),
  ('WARN', 'missing-factory-param', 'public.children.pick', 'factory enum_value requires values', 'set the parameters', true),
  ('WARN', 'unique-unsafe-factory', 'public.children.code', 'UNIQUE: factory city may repeat', 'pick a factory that is unique per row', true),
  ('WARN', 'composite-fk', 'public.children', 'composite FK to public.parents (code, id)', 'set consistent to pick whole parent rows', false),
  ('WARN', 'exclude', 'public.children', 'EXCLUDE apart', 'independent columns can''t keep it', false),
  ('INFO', 'composite-unique', 'public.children', 'composite UNIQUE (a, b)', 'colliding rows are drawn again, then dropped', false),
  ('INFO', 'check-not-applied', 'public.children', 'CHECK across not applied', '(a < b)', false),
  ('INFO', 'partial-unique', 'public.children', 'partial UNIQUE (code)', 'a > 0', false))"""


@query("lint_issues", f"WITH {_FOUND_SQL} SELECT * FROM found")
def _lint(spark, sf_dir):
    return issues_frame(spark, lint(_config(LINTED), REGISTRY))


@query("lint_counts", f"WITH {_FOUND_SQL} SELECT level, count(*) AS n FROM found GROUP BY level")
def _lint_counts(spark, sf_dir):
    found = lint(_config(LINTED), REGISTRY)
    out = issues_frame(spark, found).groupBy("level").agg(F.count("*").alias("n"))
    assert sum(counts(found).values()) == len(found)
    return out


@query("lint_fix_order", f"WITH {_FOUND_SQL} SELECT row_number() OVER (ORDER BY CASE level WHEN 'ERR' THEN 0 WHEN 'WARN' THEN 1 ELSE 2 END, location) - 1 AS place, level, kind, location FROM found WHERE fixable")
def _fix_order(spark, sf_dir):
    ordered = fix_order(lint(_config(LINTED), REGISTRY))
    return spark.createDataFrame([(i, x.level, x.kind, x.location) for i, x in enumerate(ordered)], "place long, level string, kind string, location string")


@query("fix_key_targets", "SELECT * FROM (VALUES ('public.left.id'), ('public.parents.code'), ('public.parents.id'), ('public.right.id')) v(target)")
def _key_targets(spark, sf_dir):
    """What a repaired reference may name: primary keys and serial columns."""
    return spark.createDataFrame([(t,) for t in fix.key_targets(_config(LINTED))], "target string")


_REFS = [(k, c, s["params"]["target"]) for k, t in LINTED.items() for c, s in t["columns"].items() if s.get("factory") == "fkref" and s.get("params", {}).get("target")]
_KNOWN = [(f"{k}.{c}",) for k, t in LINTED.items() for c in t["columns"]]
_REFS_SQL = "refs(table_name, column_name, target) AS (VALUES " + ", ".join(f"({_text(a)}, {_text(b)}, {_text(c)})" for a, b, c in _REFS) + "), known(target) AS (VALUES " + ", ".join(f"({_text(a)})" for (a,) in _KNOWN) + ")"


@query("lint_fk_target", f"WITH {_REFS_SQL} SELECT * FROM refs WHERE target NOT IN (SELECT target FROM known)")
def _lint_target(spark, sf_dir):
    cfg = _config(LINTED)
    found = [(i.table.split(".")[1], i.column, cfg.tables[i.table].columns[i.column].params["target"]) for i in lint(cfg, REGISTRY) if i.kind == "fkref-target-not-found"]
    return spark.createDataFrame(found, "table_name string, column_name string, target string")


@query("lint_composite_fk", f"WITH {_REFS_SQL} SELECT table_name, split_part(target, '.', 1) AS parent, count(DISTINCT split_part(target, '.', 2)) AS n FROM refs GROUP BY ALL HAVING n > 1")
def _lint_composite(spark, sf_dir):
    """Read from the findings' texts: the table, its parent, and how many of the parent's columns it names."""
    found = [(i.location.split(".")[1], i.message) for i in lint(_config(LINTED), REGISTRY) if i.kind == "composite-fk"]
    parts = F.regexp_extract("message", r"FK to \w+\.(\w+) ", 1), F.size(F.split(F.regexp_extract("message", r"\((.*)\)", 1), ", "))
    return spark.createDataFrame(found, "table_name string, message string").select("table_name", parts[0].alias("parent"), parts[1].cast("long").alias("n"))


# --- audits ----------------------------------------------------------------------------------


@query("audit_pk_unique", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS rule, count(*) AS groups, coalesce(sum(n - 1), 0)::BIGINT AS extra_rows FROM (SELECT {k}, count(*) AS n FROM {t} GROUP BY {k} HAVING n > 1)" for t, k in (("customer", "c_custkey"), ("orders", "o_orderkey"), ("events", "event_id"), ("documents", "doc_id"))) + ")")
def _pk_unique(spark, sf_dir):
    parts = [audit.uniqueness(table(spark, sf_dir, t), t, [k]) for t, k in (("customer", "c_custkey"), ("orders", "o_orderkey"), ("events", "event_id"), ("documents", "doc_id"))]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("audit_unique_composite", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING n > 1")
def _unique_composite(spark, sf_dir):
    return audit.unique(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


_FKS = (("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("events", "user_id", "customer", "c_custkey"), ("labels", "doc_id", "documents", "doc_id"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("orders", "o_orderkey", "lineitem", "l_orderkey"))


@query("audit_fk_orphans", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}.{k}' AS rule, count(*) AS orphans FROM {c} WHERE {k} IS NOT NULL AND {k} NOT IN (SELECT {pk} FROM {p})" for c, k, p, pk in _FKS) + ")")
def _fk_orphans(spark, sf_dir):
    return audit.orphan_counts(spark, [(f"{c}.{k}", table(spark, sf_dir, c), [k], table(spark, sf_dir, p), [pk]) for c, k, p, pk in _FKS])


_EVENT_COLUMNS = ("event_id", "ts", "user_id", "event_type", "value", "props")


@query("audit_not_null", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS nulls FROM events" for c in _EVENT_COLUMNS) + ")")
def _not_null(spark, sf_dir):
    return audit.not_null(table(spark, sf_dir, "events"), list(_EVENT_COLUMNS))


_CHECKS = {"quantity": "l_quantity BETWEEN 1 AND 45", "discount": "l_discount <= 0.05", "flag": "l_returnflag IN ('A', 'N')", "tax": "l_tax >= 0"}


@query("audit_check_constraints", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER (NOT ({e})) AS violations FROM lineitem" for n, e in _CHECKS.items()) + ")")
def _check_constraints(spark, sf_dir):
    return audit.checks(table(spark, sf_dir, "lineitem"), _CHECKS)


@query("audit_partial_unique", "SELECT user_id, count(*) AS n FROM events WHERE event_type = 'signup' AND user_id IS NOT NULL GROUP BY user_id HAVING n > 1")
def _partial_unique(spark, sf_dir):
    return audit.unique(table(spark, sf_dir, "events"), ["user_id"], "event_type = 'signup'")


@query("audit_exclude_overlap", "SELECT event_id, user_id FROM (SELECT *, max(ts + INTERVAL 1 DAY) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events) WHERE before > ts")
def _exclude_overlap(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return audit.overlaps(e, ["user_id"], F.col("ts"), F.col("ts") + F.expr("INTERVAL 1 DAY"), ["event_id"]).select("event_id", "user_id")


@query("audit_fanout", "WITH per AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT coalesce(n, 0) AS children, count(*) AS parents FROM orders LEFT JOIN per ON l_orderkey = o_orderkey GROUP BY 1")
def _fanout(spark, sf_dir):
    return audit.fanout(table(spark, sf_dir, "orders"), "o_orderkey", table(spark, sf_dir, "lineitem"), "l_orderkey")


# --- emission --------------------------------------------------------------------------------


def _quote_sql(c: str) -> str:
    out = f"replace({c}, '\\', '\\\\')"
    for found, written in (("''", "''''"), ("' || chr(10) || '", "\\n"), ("' || chr(13) || '", "\\r"), ("' || chr(9) || '", "\\t")):
        out = f"replace({out}, '{found}', '{written}')"
    for code in [k for k in range(1, 32) if k not in (9, 10, 13)] + [127]:
        out = f"replace({out}, chr({code}), '\\x{code:02x}')"
    return f"'E''' || {out} || ''''"


@query("emit_quote_string", f"SELECT doc_id, md5({_quote_sql('text')}) AS quoted_md5, length({_quote_sql('text')}) AS quoted_length FROM documents")
def _quote(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", emit.quote_string(F.col("text")).alias("q"))
    return d.select("doc_id", F.md5("q").alias("quoted_md5"), F.length("q").cast("long").alias("quoted_length"))


_MONEY_SQL = "regexp_replace(CAST(o_totalprice AS VARCHAR), '\\.0$', '')"


@query("emit_literals", f"SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS key_text, {_quote_sql('o_orderstatus')} AS status_text, {_MONEY_SQL} AS price_text, CASE WHEN o_orderstatus = 'F' THEN 'TRUE' WHEN o_orderstatus = 'P' THEN 'NULL' ELSE 'FALSE' END AS flag_text, '''' || regexp_replace(regexp_replace(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f'), '0+$', ''), '\\.$', '') || '+00''' AS date_text, '''\\x' || lower(hex(encode(o_orderpriority))) || '''' AS bytes_text, 'ARRAY[' || CAST(o_orderkey AS VARCHAR) || ', ' || CAST(o_custkey AS VARCHAR) || ']' AS list_text FROM orders")
def _literals(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("price"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F").alias("flag"),
        F.col("o_orderdate").cast("timestamp").alias("at"), F.encode("o_orderpriority", "UTF-8").alias("b"), F.array("o_orderkey", "o_custkey").alias("l"),
    )
    names = {"o_orderkey": "key_text", "o_orderstatus": "status_text", "price": "price_text", "flag": "flag_text", "at": "date_text", "b": "bytes_text", "l": "list_text"}
    return o.select("o_orderkey", *[emit.literal(F.col(c), o.schema[c].dataType).alias(n) for c, n in names.items()])


@query("emit_insert_batches", f"""WITH t AS (SELECT c_custkey AS row, '  (' || c_custkey || ', ' || {_quote_sql('c_name')} || ', ' || c_nationkey || ')' AS x FROM customer) SELECT row // 500 AS batch, count(*) AS n, 'INSERT INTO "public"."customer" ("c_custkey", "c_name", "c_nationkey") VALUES' || chr(10) || string_agg(x, ',' || chr(10) ORDER BY row) || ';' AS statement FROM t GROUP BY 1""")
def _batches(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row"), "c_custkey", "c_name", "c_nationkey")
    return emit.insert_batches(c, "public.customer", ["c_custkey", "c_name", "c_nationkey"])


_PICKED = f"CAST(1 + {Duck(42, 'public.children', 'parent_id').h(chr(39) + 'fk' + chr(39))} % 3 AS BIGINT)"


@query(
    "emit_script",
    f"""WITH picked AS (SELECT string_agg('  (' || v || ')', ',' || chr(10) ORDER BY row) AS body FROM (SELECT row, {_PICKED} AS v FROM range(4) r(row)))
    SELECT place::BIGINT AS place, line FROM (VALUES (0, 'BEGIN;'), (1, ''), (2, '-- public.parents'), (3, 'INSERT INTO "public"."parents" ("id") VALUES' || chr(10) || '  (1),' || chr(10) || '  (2),' || chr(10) || '  (3);'), (4, ''), (5, '-- public.children'), (7, 'COMMIT;')) v(place, line)
    UNION ALL SELECT 6, 'INSERT INTO "public"."children" ("parent_id") VALUES' || chr(10) || body || ';' FROM picked""",
)
def _script(spark, sf_dir):
    """The framed script of a small generated model, line by line."""
    cfg = _config({"parents": {"row_count": 3, "primary_key": ["id"], "columns": {"id": {"factory": "pk_serial", "data_type": "integer"}}}, "children": {"row_count": 4, "columns": {"parent_id": {"factory": "fkref", "params": {"target": "parents.id"}, "data_type": "integer"}}}})
    made = Generator(spark, cfg).run(keep_row=True)
    lines = [x for x in emit.script_lines(made.tables, made.plan) if not x.startswith("-- Generated")]
    return spark.createDataFrame(list(enumerate(lines)), "place long, line string")


@query("ddl_columns", "SELECT * FROM (VALUES ('public', 'a', 'id', 1, 'bigint', 'int8', false), ('public', 'a', 'm', 2, 'USER-DEFINED', 'mood', false), ('public', 'a', 'n', 3, 'character varying', 'varchar', true), ('public', 'a', 'p', 4, 'numeric', 'numeric', true), ('public', 'a', 'tags', 5, 'ARRAY', '_text', true)) v(table_schema, table_name, column_name, position, data_type, udt, nullable)")
def _ddl(spark, sf_dir):
    """A DDL text's columns as the catalogue sees them."""
    from loam.sources.ddl import read_ddl

    text = "CREATE TYPE mood AS ENUM ('ok', 'bad'); CREATE TABLE a (id bigserial PRIMARY KEY, m mood NOT NULL, n varchar(20), p numeric(8,2) CHECK (p > 0), tags text[]);"
    return catalog.columns_frame(spark, read_ddl(text))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New orders for the existing customers: keys are sampled, audited and summed by market segment."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    keys = customers.repartitionByRange("c_custkey").sortWithinPartitions("c_custkey")  # numbered alike in every run
    cfg = _config(
        {
            "customers": {"row_count": 1, "primary_key": ["c_custkey"], "columns": {"c_custkey": {"factory": "pk_serial", "data_type": "bigint"}}},
            "orders": {
                "row_count": 20_000,
                "primary_key": ["id"],
                "columns": {
                    "id": {"factory": "pk_serial", "data_type": "bigint"},
                    "customer_key": {"factory": "fkref", "params": {"target": "customers.c_custkey"}, "data_type": "bigint"},
                    "status": {"factory": "enum_value", "params": {"values": ["pending", "paid", "shipped"]}},
                    "total": {"factory": "amount", "data_type": "numeric"},
                    "created_at": {"factory": "timestamp", "data_type": "timestamptz"},
                },
            },
        }
    )
    orders = Generator(spark, cfg, existing={"customers": keys}).run().tables["public.orders"]
    lost = audit.orphans(orders, ["customer_key"], customers, ["c_custkey"]).agg(F.count("*").alias("orphans"))
    by = orders.join(customers, orders["customer_key"] == customers["c_custkey"]).groupBy("c_mktsegment", "status").agg(F.count("*").alias("n_orders"), F.round(F.sum("total"), 2).alias("total"))
    return by.crossJoin(F.broadcast(lost))  # one row


def _flagship_sql() -> str:
    key = Duck(42, "public.orders", "customer_key").h("'fk'")
    status = value_sql(Duck(42, "public.orders", "status"), REGISTRY.get("enum_value"), {"values": ["pending", "paid", "shipped"]})
    total = value_sql(Duck(42, "public.orders", "total"), REGISTRY.get("amount"))
    return (
        f"WITH p AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_custkey) - 1 AS ix, count(*) OVER () AS n FROM customer), "
        f"o AS (SELECT {key} AS h, {status} AS status, {total} AS total FROM range(20000) r(row)) "
        "SELECT c_mktsegment, status, count(*) AS n_orders, round(sum(total), 2) AS total, 0::BIGINT AS orphans FROM o JOIN p ON p.ix = o.h % p.n GROUP BY ALL"
    )


QUERIES["entry_orders_by_segment"], SQL["entry_orders_by_segment"] = flagship, _flagship_sql()
