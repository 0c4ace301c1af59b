import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam import api
from loam.functions.generators import Registry
from loam.operators import audit, emit
from loam.operators.generate import Generator, class_name, dense_index, expand_children, fill_pairs
from loam.plans.config import from_mapping
from loam.plugins import load_plugins, python_factory, sql_factory, with_python_column
from loam.sources import catalog
from loam.streaming.generate import counts_by_window, stream_rows

SERIAL = {"factory": "pk_serial", "data_type": "integer"}


def config(tables, seed=42):
    return from_mapping({"version": 1, "defaults": {"seed": seed}, "tables": tables})


def ref(target, **more):
    params = {"target": target} | more.pop("params", {})
    return {"factory": "fkref", "params": params, "data_type": "integer", **more}


def run(spark, tables, **options):
    return Generator(spark, config(tables), **options).run()


def test_references_hit_parents(spark):
    t = run(spark, {"users": {"row_count": 30, "primary_key": ["id"], "columns": {"id": SERIAL}}, "orders": {"row_count": 5000, "columns": {"user_id": ref("users.id")}}}).tables
    assert audit.orphans(t["public.orders"], ["user_id"], t["public.users"], ["id"]).count() == 0
    assert t["public.orders"].select("user_id").distinct().count() == 30
    plan = t["public.orders"]._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_self_reference_looks_back(spark):
    t = run(spark, {"c": {"row_count": 400, "primary_key": ["id"], "columns": {"id": SERIAL, "up": ref("c.id", nullable=True)}}}).tables["public.c"]
    assert t.filter("up is null or up > id").count() == 0


def test_cycle_is_null_or_filled(spark):
    tables = {"a": {"row_count": 20, "columns": {"id": SERIAL, "b_id": ref("b.id", nullable=True)}}, "b": {"row_count": 20, "columns": {"id": SERIAL, "a_id": ref("a.id")}}}
    assert run(spark, tables).tables["public.a"].filter("b_id is not null").count() == 0
    assert run(spark, tables, fill_cycles=True).tables["public.a"].filter("b_id is null").count() == 0


def test_same_rows_each_time(spark):
    tables = {"u": {"row_count": 50, "columns": {"id": SERIAL, "m": {"factory": "email"}, "x": {"values": {"a": {"factory": "city"}, "b": {"factory": "city"}}}}}}
    a, b = (sorted(map(tuple, run(spark, tables, partitions=p).tables["public.u"].collect())) for p in (1, 7))
    assert a == b


def test_saturated_composite_key_is_filled(spark):
    parent = {"row_count": 3, "primary_key": ["id"], "columns": {"id": SERIAL}}
    made = run(spark, {"g": parent, "p": parent, "gp": {"row_count": 9, "primary_key": ["g", "p"], "columns": {"g": ref("g.id"), "p": ref("p.id")}}, "child": {"row_count": 60, "columns": {"g": ref("gp.g", params={"consistent": True}), "p": ref("gp.p", params={"consistent": True})}}})
    gp = made.tables["public.gp"]
    assert gp.distinct().count() == 9 and not made.dropped
    assert audit.orphans(made.tables["public.child"], ["g", "p"], gp, ["g", "p"]).count() == 0


def test_overfull_key_drops_rows(spark):
    made = run(spark, {"t": {"row_count": 20, "unique_keys": [["e"]], "columns": {"e": {"factory": "enum_value", "params": {"values": ["a", "b"]}}}}})
    d = made.dropped[0]
    assert (d.requested, d.emitted) == (20, 2) and made.tables["public.t"].count() == 2


def test_constant_key_keeps_one_row(spark):
    made = run(spark, {"t": {"row_count": 3, "unique_keys": [["kind"]], "columns": {"kind": {"value": "config"}}}})
    assert (made.dropped[0].requested, made.dropped[0].emitted) == (3, 1)


def test_nulls_do_not_collide(spark):
    made = run(spark, {"t": {"row_count": 3, "unique_keys": [["x"]], "columns": {"id": SERIAL, "x": {"factory": "no_such"}}}})
    assert made.tables["public.t"].count() == 3 and made.warnings


def test_checks_across_columns(spark):
    part = {"factory": "integer", "params": {"min": 1, "max": 20}, "data_type": "integer"}
    table = {"row_count": 500, "checks": [{"name": "c", "expression": "((a)::integer < b)", "columns": ["a", "b"]}], "columns": {"a": part, "b": part}}
    made = run(spark, {"t": table}, verify_checks=True)
    assert made.tables["public.t"].count() == 500 and made.tables["public.t"].filter("a >= b").count() == 0 and not made.dropped
    assert run(spark, {"t": table}).tables["public.t"].filter("a >= b").count() > 0


def test_null_fraction(spark):
    t = run(spark, {"t": {"row_count": 4000, "columns": {"a": {"factory": "city", "nullable": True, "params": {"null_fraction": 0.25}}, "b": {"factory": "city", "params": {"null_fraction": 0.5}}}}}).tables["public.t"]
    assert 850 < t.filter("a is null").count() < 1150 and t.filter("b is null").count() == 0


def test_empty_parent_empties_child(spark):
    made = run(spark, {"p": {"row_count": 0, "columns": {"id": SERIAL}}, "c": {"row_count": 5, "columns": {"p": ref("p.id")}}, "d": {"row_count": 5, "columns": {"p": ref("p.id", nullable=True)}}})
    assert set(made.tables) == {"public.d"} and made.tables["public.d"].filter("p is not null").count() == 0


def test_polymorph(spark):
    pair = {"type_column": "k_type", "id_column": "k_id", "candidates": [{"table": "users"}, {"table": "order_items", "type_name": "Line"}]}
    parent = {"row_count": 2, "primary_key": ["id"], "columns": {"id": SERIAL}}
    t = run(spark, {"users": parent, "order_items": parent, "c": {"row_count": 50, "polymorphs": [pair], "columns": {"k_type": {"data_type": "text"}, "k_id": {"data_type": "integer"}}}}).tables["public.c"]
    assert {r[0] for r in t.select("k_type").distinct().collect()} == {"User", "Line"} and t.filter("k_id not between 1 and 2").count() == 0
    assert class_name("order_items") == "OrderItem" and class_name("aPI_key") == "APIKey"


def test_json_shape_and_depth(spark):
    deep = {"factory": "city"}
    for _ in range(25):
        deep = {"values": {"x": deep}}
    t = run(spark, {"t": {"row_count": 2, "columns": {"m": deep, "n": {"values": {"b": {"value": 1}, "a": {"values": {"c": {"factory": "integer", "params": {"min": 1, "max": 1}}}}}}}}}).tables["public.t"]
    row = t.first()
    assert row["n"] == '{"a":{"c":1},"b":1}' and row["m"].count('"x"') == 20 and row["m"].endswith("{}" + "}" * 20)


def test_existing_parent(spark):
    users = spark.range(100, 110).withColumnRenamed("id", "key")
    made = run(spark, {"users": {"row_count": 1, "columns": {"key": SERIAL}}, "o": {"row_count": 300, "columns": {"u": ref("users.key")}}}, existing={"users": users})
    assert {r[0] for r in made.tables["public.o"].select("u").distinct().collect()} == set(range(100, 110))


def test_dense_index(spark):
    df, n = dense_index(spark.range(0, 1000, 1, 7).filter("id % 3 = 0"))
    got = sorted(r["__ix"] for r in df.collect())
    assert got == list(range(n)) and n == 334


def test_pairs_and_children(spark):
    rows = spark.range(1200).withColumnRenamed("id", "row")
    got = fill_pairs(rows, {"a": 30, "b": 40}, 3)
    assert got.select("a", "b").distinct().count() == 1200 and got.agg(F.max("a"), F.max("b")).first()[:] == (29, 39)
    assert fill_pairs(rows, {"a": 2, "b": 2}).count() == 4
    kids = expand_children(spark.range(500).withColumnRenamed("id", "k"), "k", 1, 3)
    per = [r["count"] for r in kids.groupBy("k").count().collect()]
    assert len(per) == 500 and set(per) == {1, 2, 3}


# --- emission


def test_literals(spark):
    schema = T.StructType([T.StructField(n, k) for n, k in (("s", T.StringType()), ("i", T.IntegerType()), ("b", T.BooleanType()), ("d", T.DoubleType()), ("t", T.TimestampType()), ("y", T.BinaryType()), ("a", T.ArrayType(T.StringType())))])
    rows = [("it's\\ \n\t\r\0\x01", 4, True, 1022.6, datetime.datetime(2024, 1, 2, 3, 4, 5, 120000), b"\x01\xff", ["x", "y'"]), ("", 0, False, float("nan"), datetime.datetime(2024, 1, 2), b"", []), (None,) * 7]
    df = spark.createDataFrame(rows, schema)
    got = [list(r) for r in df.select(*[emit.literal(F.col(c), df.schema[c].dataType) for c in df.columns]).collect()]
    assert got[0] == ["E'it''s\\\\ \\n\\t\\r\\x01'", "4", "TRUE", "1022.6", "'2024-01-02 03:04:05.12+00'", "'\\x01ff'", "ARRAY[E'x', E'y''']"]
    assert got[1] == ["E''", "0", "FALSE", "'NaN'::float8", "'2024-01-02 00:00:00+00'", "'\\x'", "ARRAY[]::text[]"]
    assert got[2] == ["NULL"] * 7
    d = spark.createDataFrame([(1e7,), (0.00001,), (1e20,), (100.0,), (float("-inf"),)], "d double")
    assert [r[0] for r in d.select(emit.literal(F.col("d"), T.DoubleType())).collect()] == ["10000000", "1e-05", "1e+20", "100", "'-Infinity'::float8"]


def test_script(spark):
    cfg = config({"p": {"row_count": 3, "primary_key": ["id"], "columns": {"id": SERIAL, "n": {"factory": "city"}}}, "c": {"row_count": 1100, "columns": {"p_id": ref("p.id"), "tag": {"value": "a;b"}}}})
    text = api.script(spark, cfg)
    parts = emit.split_statements(text)
    assert parts[0] == "BEGIN" and parts[-1] == "COMMIT" and len(parts) == 2 + 1 + 3
    assert parts[1].startswith('INSERT INTO "public"."p" ("id", "n") VALUES\n  (1, E\'') and "SET CONSTRAINTS" not in text
    assert [x.count("\n") for x in parts[2:5]] == [500, 500, 100]


@pytest.mark.parametrize(
    ("text", "n"),
    [("", 0), ("a", 1), ("a; b;", 2), ("a 'x;y'; b", 2), ("a E'x\\';y'; b", 2), ("-- c;\na; -- d;", 1), ('a "x;y"; b', 2), ("a 'x'';y'; b", 2)],
)
def test_split_statements(text, n):
    assert len(emit.split_statements(text)) == n


def test_sinks(spark, tmp_path):
    made = Generator(spark, config({"t": {"row_count": 600, "columns": {"id": SERIAL}}})).run(keep_row=True)
    emit.write_parquet(made.tables, str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq" / "public.t.parquet")).columns == ["id"]
    paths = emit.write_script_parts(made.tables, made.plan, str(tmp_path / "parts"))
    assert spark.read.option("wholetext", True).text(paths[0]).count() >= 1
    emit.write_script(made.tables, made.plan, str(tmp_path / "x.sql"))
    assert (tmp_path / "x.sql").read_text().count("INSERT INTO") == 2


# --- audits


def test_audits(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 1, 7), (2, None, -1), (2, None, 3)], "a int, b int, v int")
    assert [tuple(r) for r in audit.unique(df, ["a", "b"]).collect()] == [(1, 1, 2)]
    assert audit.uniqueness(df, "r", ["a", "b"]).first()[:] == ("r", 1, 1)
    assert {tuple(r) for r in audit.not_null(df, ["a", "b"]).collect()} == {("a", 0), ("b", 2)}
    assert {tuple(r) for r in audit.checks(df, {"pos": "v > 0", "b": "b = 2"}).collect()} == {("pos", 1), ("b", 2)}
    assert audit.orphans(df, ["b"], spark.createDataFrame([(9,)], "k int"), ["k"]).count() == 2
    spans = spark.createDataFrame([(1, 0, 10, 1), (1, 2, 3, 2), (1, 9, 12, 3), (1, 12, 13, 4), (2, 0, 1, 5)], "k int, s int, e int, id int")
    assert {r["id"] for r in audit.overlaps(spans, ["k"], F.col("s"), F.col("e"), ["id"]).collect()} == {2, 3}
    assert {tuple(r) for r in audit.fanout(spark.range(3), "id", spark.createDataFrame([(0,), (0,), (2,)], "p long"), "p").collect()} == {(0, 1), (1, 1), (2, 1)}


# --- sources, plugins, streams, commands


def test_catalogue_operators(spark):
    cons = spark.createDataFrame([("s", "pk", "s", "t", "PRIMARY KEY"), ("s", "fk", "s", "c", "FOREIGN KEY")], "constraint_schema string, constraint_name string, table_schema string, table_name string, constraint_type string")
    usage = spark.createDataFrame([("s", "pk", "s", "t", "b", 2), ("s", "pk", "s", "t", "a", 1), ("s", "fk", "s", "c", "x", 1), ("s", "fk", "s", "c", "y", 2)], "constraint_schema string, constraint_name string, table_schema string, table_name string, column_name string, ordinal_position int")
    assert catalog.key_columns(cons, usage).first()["columns"] == ["a", "b"]
    kinds = "table_schema string, table_name string, constraint_name string, parent_schema string, parent_name string, unique_name string, delete_code string, update_code string, deferrable boolean"
    refs = spark.createDataFrame([("s", "c", "fk", "s", "t", "pk", "c", "a", True)], kinds)
    r = catalog.foreign_keys(refs, usage).first()
    assert (r["columns"], r["parent_columns"], r["on_delete"], r["on_update"]) == (["x", "y"], ["a", "b"], "CASCADE", "NO ACTION")
    # Constraints of one name on two tables are two references.
    both = usage.union(spark.createDataFrame([("s", "pk", "s", "u", "k", 1), ("s", "fk", "s", "d", "z", 1)], usage.schema))
    refs = refs.union(spark.createDataFrame([("s", "d", "fk", "s", "u", "pk", "n", "a", False)], kinds))
    got = {r["table_name"]: (r["columns"], r["parent_name"], r["parent_columns"], r["on_delete"]) for r in catalog.foreign_keys(refs, both).collect()}
    assert got == {"c": (["x", "y"], "t", ["a", "b"], "CASCADE"), "d": (["z"], "u", ["k"], "SET NULL")}
    ix = spark.createDataFrame([("s", "t", "pk", True, True), ("s", "t", "u", True, False), ("s", "t", "n", False, False)], "table_schema string, table_name string, index_name string, is_unique boolean, is_primary boolean")
    assert [x["index_name"] for x in catalog.unique_indexes(ix, cons).collect()] == ["u"]
    tables = spark.createDataFrame([("s", "log"), ("s", "t")], "table_schema string, table_name string")
    assert [x["table_name"] for x in catalog.trigger_populated(spark.createDataFrame([("BEGIN INSERT INTO s.log VALUES (1)",)], "body string"), tables).collect()] == ["log"]
    enums = spark.createDataFrame([("s", "e", 2.0, "b"), ("s", "e", 1.0, "a")], "enum_schema string, enum_name string, sort_order double, label string")
    assert catalog.enum_labels(enums).first()["labels"] == ["a", "b"]


def test_model_from_a_catalogue(spark):
    """Keys, unique indexes (of a constraint, whole, partial, over expressions) and references of one name."""
    f = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    key = "constraint_schema string, constraint_name string, table_schema string, table_name string"
    column = lambda t, c, at, kind="integer": ("s", t, c, at, kind, kind, True, "", False, False, None, None, None)
    frames = {
        "tables": f([("s", "t"), ("s", "c"), ("s", "d")], "table_schema string, table_name string"),
        "columns": f([column("t", "id", 1), column("t", "name", 2, "text"), column("t", "state", 3, "text"), column("c", "t_id", 1), column("d", "t_id", 1)], "table_schema string, table_name string, column_name string, position int, data_type string, udt string, nullable boolean, column_default string, generated boolean, identity boolean, char_max int, num_precision int, num_scale int"),
        "constraints": f([("s", "pk", "s", "t", "PRIMARY KEY"), ("s", "own", "s", "t", "UNIQUE")], key + ", constraint_type string"),
        "usage": f([("s", "pk", "s", "t", "id", 1), ("s", "own", "s", "t", "state", 1), ("s", "fk", "s", "c", "t_id", 1), ("s", "fk", "s", "d", "t_id", 1)], key + ", column_name string, ordinal_position int"),
        "enums": f([], "enum_schema string, enum_name string, sort_order double, label string"),
        "references": f([("s", x, "fk", "s", "t", "pk", "a", "a", False) for x in "cd"], "table_schema string, table_name string, constraint_name string, parent_schema string, parent_name string, unique_name string, delete_code string, update_code string, deferrable boolean"),
        "indexes": f(
            [("s", "t", "pk", True, True, 1, "id", ""), ("s", "t", "own", True, False, 1, "state", ""), ("s", "t", "two", True, False, 2, "id", ""), ("s", "t", "two", True, False, 1, "lower(name)", ""), ("s", "t", "part", True, False, 1, "name", "(state = 'name'::text)"), ("s", "t", "plain", False, False, 1, "name", "")],
            "table_schema string, table_name string, index_name string, is_unique boolean, is_primary boolean, place int, expression string, predicate string",
        ),
        "checks": f([], "table_schema string, table_name string, name string, definition string, kind string"),
        "triggers": f([], "body string"),
    }
    assert frames.keys() == catalog.PG_QUERIES.keys()
    m = catalog.model_from_catalog(frames, ["s"])
    t = m.table("s.t")
    assert t.primary_key == ["id"] and t.unique_keys == [["state"], ["name", "id"]]
    assert t.partial_unique_keys == [{"columns": ["name"], "predicate": "(state = 'name'::text)"}]
    assert [(x.columns, x.parent, x.parent_columns) for k in "cd" for x in m.table(f"s.{k}").foreign_keys] == [(["t_id"], "s.t", ["id"])] * 2


def test_floats_read_back(spark):
    values = [0.00012345678901234567, 1e-4, 9.999e-5, 123456789012345.67, 999999999999999.9, 1e15, 1.5e300, -2.5e-7, 0.1, 100.0, 1e7, 2.0, 1 / 3, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, 0.0, -0.0, 4.35, 2e-3, 1e23, 9007199254740993.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(emit.literal(F.col("v"), T.DoubleType())).collect()]
    assert all(float(g) == v for g, v in zip(got, values)), list(zip(got, values))
    assert got[:6] == ["0.00012345678901234567", "0.0001", "9.999e-05", "123456789012345.67", "999999999999999.9", "1e+15"]
    assert got[6:12] == ["1.5e+300", "-2.5e-07", "0.1", "100", "10000000", "2"] and got[16:18] == ["0", "-0"]


def test_polymorphs_name_rows_that_are_there(spark):
    """Over a parent that dropped rows, one that exists, one that is made later, and none."""
    few = {"row_count": 50, "primary_key": ["id"], "unique_keys": [["k"]], "columns": {"id": SERIAL, "k": {"factory": "integer", "params": {"min": 1, "max": 3}}}}
    pair = {"type_column": "o_type", "id_column": "o_id", "candidates": [{"table": "zfew"}, {"table": "old", "pk_column": "key"}, {"table": "users"}, {"table": "ghosts"}]}
    cfg = from_mapping({"version": 1, "tables": {"zfew": few, "users": {"row_count": 7, "primary_key": ["id"], "columns": {"id": SERIAL}}, "c": {"row_count": 400, "polymorphs": [pair], "columns": {"o_type": {"data_type": "text"}, "o_id": {"data_type": "integer"}}}}})
    made = Generator(spark, cfg, existing={"old": spark.createDataFrame([(1001,), (1002,)], "key long")}).run()
    t, ids = made.tables["public.c"], {r["id"] for r in made.tables["public.zfew"].collect()}
    assert t.count() == 400 and len(ids) == 3 and made.dropped[0].emitted == 3
    by: dict = {}
    for r in t.collect():
        by.setdefault(r["o_type"], set()).add(r["o_id"])
    assert by == {"Zfew": ids, "Old": {1001, 1002}, "User": set(range(1, 8)), None: {None}}


def test_long_chains_of_references_need_no_join(spark):
    n = 24
    tables = {f"t{i:02d}": {"row_count": 9, "primary_key": ["id"], "columns": {"id": SERIAL if i == 0 else ref(f"t{i - 1:02d}.id")}} for i in range(n)}
    tables["t23"]["primary_key"] = []
    last = Generator(spark, from_mapping({"version": 1, "tables": {k: {**t, "primary_key": []} for k, t in tables.items()}})).run().tables["public.t23"]
    assert "Join" not in last._jdf.queryExecution().executedPlan().toString() and last.filter("id between 1 and 9").count() == 9


def test_model_from_frames_generates_like_tables(spark, sf):
    frames = {t: spark.read.parquet(f"{sf}/{t}.parquet") for t in ("customer", "orders")}
    from loam.plans.build import build

    m = catalog.model_from_frames(frames, {"customer": ["c_custkey"]}, [("orders", ["o_custkey"], "customer", ["c_custkey"])])
    cfg = build(m)
    assert cfg.tables["public.orders"].columns["o_custkey"].factory == "fkref"
    made = Generator(spark, cfg, existing={"customer": frames["customer"]}).run()
    assert audit.orphans(made.tables["public.orders"], ["o_custkey"], frames["customer"], ["c_custkey"]).count() == 0


def test_plugins(spark, tmp_path):
    (tmp_path / "mine.py").write_text("from loam.plugins import sql_factory\nFACTORIES = [sql_factory('sku', \"concat('SKU-', lpad(cast({row} as string), 6, '0'))\", unique_per_row=True)]\n")
    registry = Registry()
    assert load_plugins(str(tmp_path), registry) == ["sku"]
    registry.register(sql_factory("stars", "1 + {h} % 5", "bigint", ("rating",)))
    t = run(spark, {"r": {"row_count": 3, "columns": {"s": {"factory": "sku"}, "n": {"factory": "stars", "data_type": "integer"}}}}, registry=registry).tables["public.r"]
    assert sorted(x["s"] for x in t.collect()) == ["SKU-000000", "SKU-000001", "SKU-000002"] and t.filter("n between 1 and 5").count() == 3
    got = with_python_column(spark.range(3).withColumnRenamed("id", "row"), "sq", lambda n: n * n, "long")
    assert [r["sq"] for r in got.orderBy("row").collect()] == [0, 1, 4]


def test_stream_equals_batch(spark, tmp_path):
    cfg = config({"t": {"row_count": 100, "columns": {"id": SERIAL, "c": {"factory": "city"}}}})
    spark.range(100).selectExpr("id AS row", "timestamp_seconds(id * 10) AS at").write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("row long, at timestamp").parquet(str(tmp_path / "in"))
    made = stream_rows(spark, cfg, "public.t", src)
    q = made.writeStream.format("memory").queryName("made").trigger(availableNow=True).start()
    w = counts_by_window(made, "at", ["c"]).writeStream.format("memory").outputMode("complete").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    w.awaitTermination()
    batch = Generator(spark, cfg).run().tables["public.t"]
    assert sorted(map(tuple, spark.table("made").select("id", "c").collect())) == sorted(map(tuple, batch.select("id", "c").collect()))
    assert spark.table("windows").agg(F.sum("n")).first()[0] == 100
    bad = config({"p": {"row_count": 9, "unique_keys": [["e"]], "columns": {"e": {"factory": "city"}}}, "c": {"row_count": 9, "columns": {"e": ref("p.e")}}})
    with pytest.raises(ValueError):
        stream_rows(spark, bad, "public.c", src)


def test_row_number_source(spark):
    from loam.sources.datasource import RowNumbers

    spark.dataSource.register(RowNumbers)
    assert spark.read.format("loam_rows").option("rows", 25).option("size", 10).load().count() == 25


def test_commands(spark, tmp_path, capsys):
    from loam.cli import main

    ddl, cfg, out = (str(tmp_path / n) for n in ("s.sql", "c.yaml", "o.sql"))
    (tmp_path / "s.sql").write_text("CREATE TABLE a (id serial PRIMARY KEY, email text UNIQUE, note text); CREATE TABLE b (a_id int NOT NULL REFERENCES a(id));")
    assert main(["init", "--ddl", ddl, "-o", cfg, "--seed", "4"]) == 0
    assert main(["validate", "-c", cfg]) == 0 and "unresolved" in capsys.readouterr().out
    assert main(["fix", "-c", cfg, "--location", "public.a.note", "--choice", "city"]) == 0
    assert main(["sync", "--ddl", ddl, "-o", cfg]) == 0
    assert api.load(cfg).tables["public.a"].columns["note"].factory == "city"
    assert main(["generate", "-c", cfg, "-o", out]) == 0 and open(out).read().count("INSERT INTO") == 2
    assert main(["introspect", "--ddl", ddl]) == 0 and '"name": "email"' in capsys.readouterr().out


def test_python_functions_are_factories(spark):
    registry = Registry()
    assert registry.register(python_factory(spark, "plate", lambda row, h: f"P{row}-{h % 10}", unique_per_row=True))
    cfg = from_mapping({"version": 1, "defaults": {"seed": 1}, "tables": {"cars": {"row_count": 20, "primary_key": ["plate"], "columns": {"plate": {"factory": "plate", "data_type": "text"}}}, "trips": {"row_count": 30, "columns": {"car": {"factory": "fkref", "data_type": "text", "params": {"target": "cars.plate"}}}}}})
    made = Generator(spark, cfg, registry).run().tables
    cars = sorted(r.plate for r in made["public.cars"].collect())
    assert len(set(cars)) == 20 and cars[0].startswith("P0-")
    assert {r.car for r in made["public.trips"].collect()} <= set(cars)


def test_report_is_aligned(capsys):
    from loam.cli import _report
    from loam.plans.lint import Issue

    assert _report([Issue("ERR", "no-factory", "public.t.c", "no factory", "add one"), Issue("INFO", "exclude", "public." + "x" * 60, "m" * 60)]) == 1
    first, second, _ = capsys.readouterr().out.splitlines()
    assert first.index("no factory") == second.index("mmm") and "…" in second
