"""Emission: typed SQL literals, batched INSERT statements, the script around them, and other sinks."""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.plans.graph import Plan

BATCH = 500


def quote_ident(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def quote_string(c: Column) -> Column:
    """E'...' with quotes doubled, backslashes and controls escaped, NUL left out."""
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for found, written in (("'", "''"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\0", "")):
        out = F.replace(out, F.lit(found), F.lit(written))
    rest = [k for k in range(1, 32) if k not in (9, 10, 13)] + [127]
    each = F.aggregate(
        F.array(*[F.lit(chr(k)) for k in rest]), out, lambda text, k: F.replace(text, k, F.concat(F.lit("\\x"), F.lower(F.lpad(F.hex(F.ascii(k)), 2, "0"))))
    )
    odd = F.rlike(out, F.lit(r"[\x01-\x08\x0b\x0c\x0e-\x1f\x7f]"))  # rare, so the codes are gone through only then
    return F.concat(F.lit("E'"), F.when(odd, each).otherwise(out), F.lit("'"))


def _trimmed(c: Column) -> Column:
    """Decimal text without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(c, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def _float_text(d: Column) -> Column:
    """The shortest digits that read back as the double: plain from 1e-4 up to 1e15, else with an exponent
    of a sign and two digits or more."""
    long, short = d.cast("string"), F.format_string("%.15e", d)
    # The JVM's text has at times a digit too many; sixteen digits are tried wherever it has more.
    digits = F.length(F.regexp_replace(F.regexp_replace(long, "E.*", ""), "[^0-9]", ""))
    best = F.when((digits > 16) & (short.cast("double") == d), short).otherwise(long)
    plain = _trimmed(best.cast("decimal(38,22)").cast("string"))
    power = F.regexp_extract(best, "[eE]([+-]?[0-9]+)$", 1).cast("int")
    mantissa = F.regexp_replace(F.regexp_replace(best, "[eE].*$", ""), r"\.?0*$", "")
    wide = F.concat(mantissa, F.lit("e"), F.when(power < 0, F.lit("-")).otherwise(F.lit("+")), F.when(F.abs(power) < 10, F.lit("0")).otherwise(F.lit("")), F.abs(power).cast("string"))
    zero = F.when(long.startswith("-"), F.lit("-0")).otherwise(F.lit("0"))
    return F.when(d == 0, zero).when((F.abs(d) >= 1e-4) & (F.abs(d) < 1e15), plain).otherwise(wide)


def literal(c: Column, kind: T.DataType, cast: str | None = None) -> Column:
    """A value as PostgreSQL text by its Spark type; null as NULL."""
    if isinstance(kind, T.BooleanType):
        out = F.when(c, F.lit("TRUE")).otherwise(F.lit("FALSE"))
    elif isinstance(kind, T.IntegralType):
        out = c.cast("string")
    elif isinstance(kind, T.DecimalType):
        out = _trimmed(c.cast("string")) if kind.scale else c.cast("string")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        d, text = c.cast("double"), _float_text(c.cast("double"))
        out = F.when(F.isnan(d), F.lit("'NaN'::float8")).when(d == float("inf"), F.lit("'Infinity'::float8")).when(d == float("-inf"), F.lit("'-Infinity'::float8")).otherwise(text)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        zone = "+00" if isinstance(kind, T.TimestampType) else ""
        text = F.regexp_replace(F.regexp_replace(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"), "0+$", ""), r"\.$", "")
        out = F.concat(F.lit("'"), text, F.lit(zone + "'"))
    elif isinstance(kind, T.BinaryType):
        out = F.concat(F.lit("'\\x"), F.lower(F.hex(c)), F.lit("'"))
    elif isinstance(kind, T.ArrayType):
        inner = F.array_join(F.transform(c, lambda x: literal(x, kind.elementType)), ", ")
        element = {"bigint": "bigint", "double": "float8", "boolean": "boolean"}.get(kind.elementType.simpleString(), "text")
        out = F.when(F.size(c) == 0, F.lit(f"ARRAY[]::{element}[]")).otherwise(F.concat(F.lit("ARRAY["), inner, F.lit("]")))
    elif isinstance(kind, (T.StructType, T.MapType)):
        out = quote_string(F.to_json(c))
    else:
        out = quote_string(c.cast("string"))
    if cast:
        out = F.concat(out, F.lit(f"::{cast}"))
    return F.when(c.isNull(), F.lit("NULL")).otherwise(out)


def row_text(df: DataFrame, columns: list[str], casts: dict[str, str] | None = None) -> Column:
    parts = [literal(F.col(f"`{c}`"), df.schema[c].dataType, (casts or {}).get(c)) for c in columns]
    return F.concat(F.lit("  ("), *[x for i, p in enumerate(parts) for x in ([F.lit(", ")] if i else []) + [p]], F.lit(")"))


def insert_batches(df: DataFrame, key: str, columns: list[str] | None = None, row: str = "row", size: int = BATCH, casts: dict[str, str] | None = None) -> DataFrame:
    """batch, n, statement: rows numbered in ``row``, ``size`` numbers a statement; rows that were
    dropped leave their batch smaller, empty batches have no statement."""
    columns = columns or [c for c in df.columns if c != row]
    schema, name = key.split(".", 1) if "." in key else ("public", key)
    head = f"INSERT INTO {quote_ident(schema)}.{quote_ident(name)} ({', '.join(map(quote_ident, columns))}) VALUES\n"
    rows = df.select(F.floor(F.col(row) / size).cast("long").alias("batch"), F.col(row).alias("__row"), row_text(df, columns, casts).alias("__text"))
    return rows.groupBy("batch").agg(
        F.count("*").alias("n"),
        F.concat(F.lit(head), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__row", "__text"))), lambda s: s["__text"]), ",\n"), F.lit(";")).alias("statement"),
    )


def script_frame(plan: Plan) -> tuple[list[str], list[str]]:
    """Lines before and after the tables' statements."""
    head = [f"-- Generated at {datetime.now(timezone.utc):%Y-%m-%dT%H:%M:%SZ}", "BEGIN;"]
    if plan.cycles:
        head.append("SET CONSTRAINTS ALL DEFERRED;")
    return head, ["COMMIT;"]


def script_lines(tables: dict[str, DataFrame], plan: Plan, columns: dict[str, list[str]] | None = None, size: int = BATCH) -> Iterable[str]:
    """The script, statement by statement in plan order; the driver holds one partition of statements at a time."""
    head, tail = script_frame(plan)
    yield from head
    for key in plan.order:
        if key in tables:
            yield ""
            yield f"-- {key}"
            for r in insert_batches(tables[key], key, (columns or {}).get(key), size=size).orderBy("batch").toLocalIterator():
                yield r["statement"]
    yield from tail


def write_script(tables: dict[str, DataFrame], plan: Plan, path: str, columns: dict[str, list[str]] | None = None) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(line + "\n" for line in script_lines(tables, plan, columns))


def write_script_parts(tables: dict[str, DataFrame], plan: Plan, folder: str, columns: dict[str, list[str]] | None = None) -> list[str]:
    """For scripts that no driver should hold: a folder of text parts for each table, named in plan order."""
    out = []
    for i, key in enumerate(k for k in plan.order if k in tables):
        path = f"{folder.rstrip('/')}/{i:04d}-{key}"
        insert_batches(tables[key], key, (columns or {}).get(key)).select(F.col("statement").alias("value")).write.mode("overwrite").text(path)
        out.append(path)
    return out


def write_parquet(tables: dict[str, DataFrame], folder: str, mode: str = "overwrite") -> None:
    for key, df in tables.items():
        df.drop("row").write.mode(mode).parquet(f"{folder.rstrip('/')}/{key}.parquet")


def write_jdbc(tables: dict[str, DataFrame], plan: Plan, url: str, properties: dict | None = None) -> None:
    """Append in plan order, parents first."""
    for key in plan.order:
        if key in tables:
            tables[key].drop("row").write.mode("append").jdbc(url, key, properties=properties or {})


def split_statements(script: str) -> list[str]:
    """Statements of a script: semicolons inside strings (with doubled or escaped quotes), names and comments don't count."""
    out, last = [], 0
    for m in re.finditer(r"--[^\n]*|E'(?:[^'\\]|''|\\.)*'|'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|;", script, re.S):
        if m.group() == ";":
            out.append(script[last : m.start()])
            last = m.end()
    bare = lambda s: re.sub(r"^\s*(--[^\n]*(\n|$)\s*)*", "", s).strip()
    return [b for s in [*out, script[last:]] if (b := bare(s))]


def drop_report(requested: dict[str, int], tables: dict[str, DataFrame]) -> DataFrame:
    """Requested and emitted rows of each table."""
    parts = [df.agg(F.count("*").alias("emitted")).select(F.lit(k).alias("table_name"), F.lit(requested[k]).cast("long").alias("requested"), "emitted") for k, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("dropped", F.col("requested") - F.col("emitted"))
