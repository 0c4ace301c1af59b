"""Catalogues as DataFrames, and models from Spark schemas, the Spark catalogue or a database by JDBC.

The joins, anti-joins and grouped lists that read a database catalogue are DataFrame operators over
tables in the shape of ``information_schema``, so they run alike on a live database, on files that
were saved from one, and on the catalogue of a Spark session.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.plans.model import ColumnModel, ForeignKey, SchemaModel, TableModel, find_polymorphs

COLUMNS = "table_schema string, table_name string, column_name string, position int, data_type string, udt string, nullable boolean"


def columns_frame(spark: SparkSession, model: SchemaModel) -> DataFrame:
    rows = [(t.schema, t.name, c.name, c.position, c.data_type, c.udt, c.nullable) for t in model.tables for c in t.columns]
    return spark.createDataFrame(rows, COLUMNS)


def edges_frame(spark: SparkSession, edges) -> DataFrame:
    rows = [(e.child, e.column, e.parent, e.target, e.nullable, e.deferrable) for e in edges]
    return spark.createDataFrame(rows, "child string, column string, parent string, target string, nullable boolean, deferrable boolean")


def only_exclude(tables: DataFrame, only=(), exclude=()) -> DataFrame:
    """Tables named, short or qualified, in ``only`` (if any) and not in ``exclude``."""
    full = F.concat("table_schema", F.lit("."), "table_name")
    hit = lambda names: full.isin(list(names)) | F.col("table_name").isin(list(names))
    out = tables.filter(hit(only)) if only else tables
    return out.filter(~hit(exclude)) if exclude else out


def polymorph_pairs(columns: DataFrame) -> DataFrame:
    """``x_type`` (text) beside ``x_id`` (integer) in one table, by an equi-join on the table and x."""
    c = columns.select("table_schema", "table_name", "column_name", F.lower("data_type").alias("t"))
    kinds = c.filter(F.col("column_name").endswith("_type") & F.col("t").rlike("text|char|user-defined")).select(
        "table_schema", "table_name", F.col("column_name").alias("type_column"), F.regexp_replace("column_name", "_type$", "").alias("base")
    )
    ids = c.filter(F.col("column_name").endswith("_id") & F.col("t").contains("int")).select(
        "table_schema", "table_name", F.col("column_name").alias("id_column"), F.regexp_replace("column_name", "_id$", "").alias("base")
    )
    return kinds.join(ids, ["table_schema", "table_name", "base"]).select("table_schema", "table_name", "type_column", "id_column")


def key_columns(constraints: DataFrame, usage: DataFrame) -> DataFrame:
    """Columns of each PRIMARY KEY and UNIQUE constraint, in their order."""
    keys = ["constraint_schema", "constraint_name", "table_schema", "table_name"]
    both = constraints.filter(F.col("constraint_type").isin("PRIMARY KEY", "UNIQUE")).join(usage, keys)
    return both.groupBy(*keys, "constraint_type").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("ordinal_position", "column_name"))), lambda s: s["column_name"]).alias("columns")
    )


def enum_labels(enums: DataFrame) -> DataFrame:
    """Labels of each enum in their sort order."""
    return enums.groupBy("enum_schema", "enum_name").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("sort_order", "label"))), lambda s: s["label"]).alias("labels")
    )


def unique_indexes(indexes: DataFrame, constraints: DataFrame) -> DataFrame:
    """Unique indexes that neither are a primary key nor belong to a constraint."""
    own = indexes.filter("is_unique AND NOT is_primary")
    named = constraints.select("table_schema", "table_name", F.col("constraint_name").alias("index_name"))
    return own.join(named, ["table_schema", "table_name", "index_name"], "left_anti")


def index_keys(indexes: DataFrame, constraints: DataFrame) -> DataFrame:
    """The unique indexes' expressions in their order, and their predicate (empty: none)."""
    return unique_indexes(indexes, constraints).groupBy("table_schema", "table_name", "index_name", "predicate").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "expression"))), lambda s: s["expression"]).alias("expressions")
    )


def foreign_keys(references: DataFrame, usage: DataFrame) -> DataFrame:
    """Each reference with its columns and their targets, position by position, actions spelled out.
    Constraints are known by schema, table and name: every table may have its own of one name."""
    at = F.col("ordinal_position").alias("at")
    own = ["table_schema", "table_name", "constraint_name"]
    child = references.join(usage.select(*own, "column_name", at), own)
    target = usage.select(F.col("table_schema").alias("parent_schema"), F.col("table_name").alias("parent_name"), F.col("constraint_name").alias("unique_name"), F.col("column_name").alias("parent_column"), at)
    # The catalogue's action codes.
    word = lambda c: F.coalesce(F.create_map(*[F.lit(x) for x in ("a", "NO ACTION", "r", "RESTRICT", "c", "CASCADE", "n", "SET NULL", "d", "SET DEFAULT")])[F.col(c)], F.lit("NO ACTION"))
    listed = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("at", c))), lambda s: s[c])
    return (
        child.join(target, ["parent_schema", "parent_name", "unique_name", "at"])
        .withColumns({"on_delete": word("delete_code"), "on_update": word("update_code")})
        .groupBy("constraint_name", "table_schema", "table_name", "parent_schema", "parent_name", "on_delete", "on_update", "deferrable")
        .agg(listed("column_name").alias("columns"), listed("parent_column").alias("parent_columns"))
    )


def trigger_populated(bodies: DataFrame, tables: DataFrame) -> DataFrame:
    """Tables that some trigger body inserts into."""
    names = bodies.select(F.explode(F.regexp_extract_all(F.lower("body"), F.lit(r'insert\s+into\s+(?:only\s+)?([a-z0-9_."]+)'), 1)).alias("n"))
    names = names.select(F.replace("n", F.lit('"'), F.lit("")).alias("n")).distinct()
    full = F.concat("table_schema", F.lit("."), "table_name")
    named = tables.join(names, (F.col("n") == F.lower(full)) | (F.col("n") == F.lower("table_name")), "left_semi")
    return named.select("table_schema", "table_name")


_PG = {"string": ("text", "text"), "int": ("integer", "int4"), "bigint": ("bigint", "int8"), "smallint": ("smallint", "int2"), "tinyint": ("smallint", "int2"), "double": ("double precision", "float8"), "float": ("real", "float4"), "boolean": ("boolean", "bool"), "date": ("date", "date"), "timestamp": ("timestamp with time zone", "timestamptz"), "timestamp_ntz": ("timestamp without time zone", "timestamp"), "binary": ("bytea", "bytea"), "variant": ("jsonb", "jsonb")}


def column_of(field: T.StructField, position: int) -> ColumnModel:
    kind, dims = field.dataType, 0
    while isinstance(kind, T.ArrayType):
        kind, dims = kind.elementType, dims + 1
    c = ColumnModel(field.name, "", nullable=field.nullable, position=position)
    if isinstance(kind, T.DecimalType):
        c.data_type, c.udt, c.precision, c.scale = "numeric", "numeric", kind.precision, kind.scale
    elif isinstance(kind, (T.StructType, T.MapType)):
        c.data_type = c.udt = "jsonb"
    else:
        name = kind.simpleString()
        if isinstance(kind, (T.VarcharType, T.CharType)):
            c.char_max, name = kind.length, "string"
        c.data_type, c.udt = _PG.get(name, ("text", "text"))
    if dims:
        c.data_type, c.udt, c.array_dims = "ARRAY", f"_{c.udt}", dims
    meta = field.metadata or {}
    c.char_max = meta.get("max_len", c.char_max)
    return c


def model_from_frames(frames: dict[str, DataFrame], keys: dict[str, list[str]] | None = None, references=()) -> SchemaModel:
    """Model of DataFrames by table name; Spark keeps no keys, so they are given.

    references: (table, columns, parent, parent columns).
    """
    model = SchemaModel("spark", ["public"])
    for name, df in frames.items():
        t = TableModel("public", name, [column_of(f, i + 1) for i, f in enumerate(df.schema)], list((keys or {}).get(name, [])))
        model.tables.append(t)
    for i, (child, columns, parent, parent_columns) in enumerate(references):
        model.table(f"public.{child}").foreign_keys.append(ForeignKey(f"fk_{i}", list(columns), f"public.{parent}", list(parent_columns)))
    for t in model.tables:
        t.polymorphs = find_polymorphs(t)
    return model.settled()


def model_from_spark_catalog(spark: SparkSession, database: str = "default") -> SchemaModel:
    frames = {t.name: spark.table(f"{database}.{t.name}") for t in spark.catalog.listTables(database) if not t.isTemporary}
    return model_from_frames(frames)


# The catalogue queries of a live PostgreSQL database, for ``spark.read.jdbc``.
PG_QUERIES = {
    "tables": "SELECT table_schema, table_name FROM information_schema.tables WHERE table_type = 'BASE TABLE'",
    "columns": "SELECT table_schema, table_name, column_name, ordinal_position::int AS position, data_type, udt_name AS udt, is_nullable = 'YES' AS nullable, coalesce(column_default, '') AS column_default, is_generated = 'ALWAYS' AS generated, is_identity = 'YES' AS identity, character_maximum_length::int AS char_max, numeric_precision::int AS num_precision, numeric_scale::int AS num_scale FROM information_schema.columns",
    "constraints": "SELECT constraint_schema, constraint_name, table_schema, table_name, constraint_type FROM information_schema.table_constraints",
    "usage": "SELECT constraint_schema, constraint_name, table_schema, table_name, column_name, ordinal_position::int AS ordinal_position FROM information_schema.key_column_usage",
    "enums": "SELECT n.nspname AS enum_schema, t.typname AS enum_name, e.enumsortorder::float8 AS sort_order, e.enumlabel AS label FROM pg_type t JOIN pg_enum e ON e.enumtypid = t.oid JOIN pg_namespace n ON n.oid = t.typnamespace",
    "references": "SELECT n.nspname AS table_schema, r.relname AS table_name, c.conname AS constraint_name, pn.nspname AS parent_schema, pr.relname AS parent_name, u.conname AS unique_name, c.confdeltype::text AS delete_code, c.confupdtype::text AS update_code, c.condeferrable AS deferrable FROM pg_constraint c JOIN pg_class r ON r.oid = c.conrelid JOIN pg_namespace n ON n.oid = r.relnamespace JOIN pg_class pr ON pr.oid = c.confrelid JOIN pg_namespace pn ON pn.oid = pr.relnamespace JOIN pg_constraint u ON u.conrelid = c.confrelid AND u.conindid = c.conindid AND u.contype IN ('p', 'u') WHERE c.contype = 'f'",
    "indexes": "SELECT n.nspname AS table_schema, r.relname AS table_name, x.relname AS index_name, i.indisunique AS is_unique, i.indisprimary AS is_primary, k.place::int AS place, pg_get_indexdef(i.indexrelid, k.place::int, false) AS expression, coalesce(pg_get_expr(i.indpred, i.indrelid), '') AS predicate FROM pg_index i JOIN pg_class x ON x.oid = i.indexrelid JOIN pg_class r ON r.oid = i.indrelid JOIN pg_namespace n ON n.oid = r.relnamespace CROSS JOIN LATERAL generate_series(1, i.indnkeyatts) AS k(place) WHERE i.indisunique AND i.indisvalid",
    "checks": "SELECT n.nspname AS table_schema, r.relname AS table_name, c.conname AS name, pg_get_constraintdef(c.oid) AS definition, c.contype::text AS kind FROM pg_constraint c JOIN pg_class r ON r.oid = c.conrelid JOIN pg_namespace n ON n.oid = r.relnamespace WHERE c.contype IN ('c', 'x') AND c.convalidated",
    "triggers": "SELECT p.prosrc AS body FROM pg_trigger t JOIN pg_proc p ON p.oid = t.tgfoid WHERE NOT t.tgisinternal",
}


def _columns_in(t: TableModel, expression: str) -> list[str]:
    """The table's columns that an expression names, outside its strings."""
    bare = re.sub(r"'(?:[^']|'')*'", "", expression)
    return [c.name for c in t.columns if re.search(rf"(?<![\w:]){re.escape(c.name)}\b(?!\s*\()", bare)]


def read_jdbc_catalog(spark: SparkSession, url: str, properties: dict | None = None) -> dict[str, DataFrame]:
    return {k: spark.read.jdbc(url, f"({q}) AS q", properties=properties or {}) for k, q in PG_QUERIES.items()}


def model_from_catalog(frames: dict[str, DataFrame], schemas=("public",)) -> SchemaModel:
    """Model of catalogue tables as ``read_jdbc_catalog`` gives them; a catalogue is small, so rows are collected."""
    model = SchemaModel("postgres", list(schemas))
    wanted = lambda df: df.filter(F.col("table_schema").isin(list(schemas)) if schemas else ~F.col("table_schema").rlike("^(pg_|information_schema)"))
    for r in frames["enums"].transform(enum_labels).collect():
        model.enums[f"{r['enum_schema']}.{r['enum_name']}"] = list(r["labels"])
    for r in wanted(frames["tables"]).collect():
        model.tables.append(TableModel(r["table_schema"], r["table_name"]))
    by_key = {t.key: t for t in model.tables}
    for r in wanted(frames["columns"]).collect():
        t = by_key.get(f"{r['table_schema']}.{r['table_name']}")
        if t:
            c = ColumnModel(r["column_name"], r["data_type"], r["udt"], r["nullable"], r["column_default"] or "", r["generated"], r["identity"], r["char_max"], r["num_precision"], r["num_scale"], int(r["data_type"] == "ARRAY"), position=r["position"])
            c.enum = next((e for e in (f"{t.schema}.{c.udt}", f"public.{c.udt}") if e in model.enums), "") if c.data_type == "USER-DEFINED" else ""
            t.columns.append(c)
    for r in key_columns(frames["constraints"], frames["usage"]).collect():
        if t := by_key.get(f"{r['table_schema']}.{r['table_name']}"):
            if r["constraint_type"] == "PRIMARY KEY":
                t.primary_key = list(r["columns"])
            else:
                t.unique_keys.append(list(r["columns"]))
    for r in index_keys(frames["indexes"], frames["constraints"]).orderBy("table_schema", "table_name", "index_name").collect():
        if t := by_key.get(f"{r['table_schema']}.{r['table_name']}"):
            columns = list(dict.fromkeys(c for e in r["expressions"] for c in _columns_in(t, e)))
            if columns and r["predicate"]:
                t.partial_unique_keys.append({"columns": columns, "predicate": r["predicate"]})
            elif columns:
                t.unique_keys.append(columns)
    for r in foreign_keys(frames["references"], frames["usage"]).collect():
        if t := by_key.get(f"{r['table_schema']}.{r['table_name']}"):
            t.foreign_keys.append(ForeignKey(r["constraint_name"], list(r["columns"]), f"{r['parent_schema']}.{r['parent_name']}", list(r["parent_columns"]), r["on_delete"], r["on_update"], r["deferrable"]))
    for r in wanted(frames["checks"]).collect():
        if t := by_key.get(f"{r['table_schema']}.{r['table_name']}"):
            body = re.sub(r"^CHECK\s*", "", r["definition"])
            names = _columns_in(t, body)
            (t.checks if r["kind"] == "c" else t.excludes).append({"name": r["name"], ("expression" if r["kind"] == "c" else "definition"): body, "columns": names})
    for r in trigger_populated(frames["triggers"], frames["tables"]).collect():
        if t := by_key.get(f"{r['table_schema']}.{r['table_name']}"):
            t.trigger_populated = True
    for t in model.tables:
        t.polymorphs = find_polymorphs(t)
    return model.settled()
