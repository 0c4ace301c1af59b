import pytest

from loam.functions.generators import Registry
from loam.plans.build import build
from loam.plans.checks import apply_checks, parse_check, tighten
from loam.plans.config import VERSION, ColumnSpec, ConfigError, dumps, from_mapping, loads, split_target, to_mapping
from loam.plans.fix import FixError, coerce, fix, key_targets, parse_list, shape_of
from loam.plans.graph import components, non_deferrable, plan, within_cycle
from loam.plans.lint import KINDS, counts, fix_order, lint
from loam.plans.merge import merge, merge_params, sync
from loam.queries import LINTED
from loam.sources.ddl import read_ddl, statements


def config(tables, **more):
    return from_mapping({"version": 1, "tables": tables, **more})


def ref(target, **more):
    return {"factory": "fkref", "params": {"target": target}, **more}


SERIAL = {"factory": "pk_serial", "data_type": "integer"}


# --- plan


def test_parents_come_first():
    p = plan(config({"orders": {"row_count": 5, "columns": {"user_id": ref("users.id")}}, "users": {"row_count": 3, "columns": {"id": SERIAL}}}))
    assert p.order == ["public.users", "public.orders"] and not p.cycles


def test_counts_per_parent_chain():
    cfg = config({"a": {"row_count": 10, "columns": {}}, "b": {"row_count_per": {"a": [2, 2]}, "columns": {"x": ref("a.id", nullable=True)}}, "c": {"row_count_per": {"public.b": [3, 3]}, "columns": {"x": ref("b.id", nullable=True)}}})
    assert plan(cfg).counts == {"public.a": 10, "public.b": 20, "public.c": 60}


def test_range_middle_and_no_rows():
    cfg = config({"a": {"row_count": 10, "columns": {}}, "low": {"row_count_per": {"a": [0, 1]}, "columns": {}}, "none": {"row_count_per": {"a": [0, 0]}, "columns": {}}, "odd": {"row_count_per": {"a": [1, 4]}, "columns": {}}})
    n = plan(cfg).counts
    assert (n["public.low"], n["public.none"], n["public.odd"]) == (10, 0, 20)


def test_cycles():
    cfg = config({"a": {"row_count": 1, "columns": {"id": SERIAL, "b_id": ref("b.id", nullable=True)}}, "b": {"row_count": 1, "columns": {"id": SERIAL, "a_id": ref("a.id")}}, "self": {"row_count": 1, "columns": {"id": SERIAL, "up": ref("self.id")}}})
    p = plan(cfg)
    assert p.cycles == [["public.a", "public.b"]] and p.order.index("public.a") < p.order.index("public.b")
    assert [(e.child, e.column) for e in non_deferrable(p)] == [("public.b", "a_id")]


def test_cycle_without_a_break_goes_by_name():
    from loam.plans.graph import Edge

    assert within_cycle(["b", "a"], [Edge("a", "x", "b"), Edge("b", "x", "a")]) == ["a", "b"]


def test_long_chain_needs_no_recursion():
    from loam.plans.graph import Edge

    n = 3000
    names = [f"t{i:04d}" for i in range(n)]
    groups = components(names, [Edge(names[i], "x", names[i + 1]) for i in range(n - 1)])
    assert [g[0] for g in groups] == names[::-1]


def test_emptied_tables():
    cfg = config({"p": {"row_count": 0, "columns": {"id": SERIAL}}, "c": {"row_count": 5, "columns": {"id": SERIAL, "p": ref("p.id")}}, "d": {"row_count": 5, "columns": {"c": ref("c.id")}}, "e": {"row_count": 5, "columns": {"p": ref("p.id", nullable=True)}}})
    p = plan(cfg)
    assert [p.counts[f"public.{t}"] for t in "pcde"] == [0, 0, 0, 5] and set(p.emptied) == {"public.c", "public.d"}


# --- configuration


def test_round_trip_and_versions():
    cfg = config({"t": {"row_count": 1, "primary_key": ["id"], "columns": {"id": SERIAL, "v": {"value": "42"}, "n": {"value": 42}, "m": {"values": {"a": {"factory": "city"}}}}}}, defaults={"seed": 3})
    again = loads(dumps(cfg))
    assert to_mapping(again) == to_mapping(cfg)
    assert again.tables["public.t"].columns["v"].value == "42" and again.tables["public.t"].columns["n"].value == 42
    with pytest.raises(ConfigError):
        from_mapping({"version": VERSION + 1})
    assert from_mapping({"tables": {}}).warnings
    assert split_target("users.id") == ("public.users", "id") and split_target("a") is None


def test_column_order_is_key_then_names():
    cfg = config({"t": {"primary_key": ["z"], "columns": {"b": {}, "z": {}, "a": {}, "gone": {"removed": True}}}})
    assert cfg.tables["public.t"].active() == ["z", "a", "b"]


# --- CHECK


@pytest.mark.parametrize(
    ("text", "column", "found"),
    [
        ("(age >= 0)", "age", {"min": 0}),
        ("(price > 0)", "price", {"min": 1}),
        ("(price > (0)::numeric)", "price", {"min": 1}),
        ("(rate < 1.5)", "rate", {"max": 1.5}),
        ("(age BETWEEN 0 AND 120)", "age", {"min": 0, "max": 120}),
        ("((age >= 0) AND (age <= 120))", "age", {"min": 0, "max": 120}),
        ("(char_length((name)::text) <= 100)", "name", {"max_len": 100}),
        ("(length(name) < 100)", "name", {"max_len": 99}),
        ("(status = ANY (ARRAY['pending'::text, 'paid'::text]))", "status", {"values": ["pending", "paid"]}),
        ("(status IN ('a', 'it''s', 'x, y'))", "status", {"values": ["a", "it's", "x, y"]}),
        ("(kind = 'only')", "kind", {"values": ["only"]}),
        ("(n IN (1, 2))", "n", {"values": [1, 2]}),
        ("(now() > created_at)", "created_at", None),
        ("(start_date < end_date)", "start_date", None),
        ("((a > 0) AND (b > 0))", "a", None),
        ("((a > 0) OR (a < -5))", "a", None),
    ],
)
def test_parse_check(text, column, found):
    assert parse_check(text, column) == found


def test_tighter_bound_stays():
    p = {"max_len": 50, "min": 1}
    tighten(p, {"max_len": 100, "min": 5, "max": 9})
    assert p == {"max_len": 50, "min": 5, "max": 9}


def test_apply_checks():
    cfg = config({"t": {"checks": [{"name": "c", "expression": "(s IN ('a'))", "columns": ["s"]}, {"name": "d", "expression": "(a < b)", "columns": ["a", "b"]}], "columns": {"s": {"factory": "string", "unresolved": True}, "a": {}, "b": {}}}})
    t = cfg.tables["public.t"]
    assert apply_checks(t) == ["d"] and t.columns["s"].factory == "enum_value" and not t.columns["s"].unresolved


# --- merge


def test_merge_keeps_edits_and_renews_schema():
    old = config({"t": {"row_count": 7, "columns": {"a": {"factory": "city", "params": {"x": 1, "max_len": 9, "target": "old"}, "data_type": "text"}, "gone": {"factory": "string"}}}, "lost": {"columns": {}}})
    new = config({"t": {"row_count": 100, "columns": {"a": {"factory": "string", "unresolved": True, "params": {"max_len": 20, "y": 2}, "data_type": "varchar"}, "b": {"factory": "email"}}}})
    out = merge(old, new)
    a = out.tables["public.t"].columns["a"]
    assert (out.tables["public.t"].row_count, a.factory, a.unresolved, a.data_type) == (7, "city", False, "varchar")
    assert a.params == {"x": 1, "y": 2, "max_len": 20}  # the target is gone from the schema
    assert out.tables["public.t"].columns["gone"].removed and out.tables["public.lost"].removed
    assert to_mapping(merge(out, new)) == to_mapping(out)
    assert merge_params({"values": [1], "k": 1}, {"values": [2], "k": 2}) == {"values": [2], "k": 1}
    assert merge_params({"values": [1], "max_len": 3, "deferrable": True, "element": "_text"}, {}) == {}


def test_sync_leaves_other_tables_alone():
    old = config({"a": {"columns": {}}, "b": {"columns": {}}})
    out = sync(old, config({"a": {"row_count": 1, "columns": {}}}), lambda k: k == "public.a")
    assert not out.tables["public.b"].removed and out.tables["public.a"].row_count == 1


# --- DDL

DDL = """
-- a comment; with a semicolon
CREATE TYPE order_status AS ENUM ('pending', 'it''s; paid');
CREATE TABLE users (id serial PRIMARY KEY, email text NOT NULL, created_at timestamptz DEFAULT now(), CONSTRAINT u UNIQUE (email));
CREATE TABLE public.orders (
  id bigserial PRIMARY KEY, user_id int, status order_status, status_qualified public.order_status NOT NULL DEFAULT 'pending',
  total numeric(12,2) CHECK (total >= 0), name varchar(20) UNIQUE, tags text[], "Odd Name" boolean, g int GENERATED ALWAYS AS (1) STORED,
  note_type text, note_id bigint,
  CONSTRAINT fk FOREIGN KEY (user_id) REFERENCES users(id) ON DELETE CASCADE DEFERRABLE INITIALLY DEFERRED,
  CHECK (user_id < note_id));
ALTER TABLE ONLY public.orders ADD CONSTRAINT x UNIQUE (id, user_id);
CREATE UNIQUE INDEX ON orders (lower(name)) WHERE total > 0;
CREATE VIEW v AS SELECT 1;
CREATE FUNCTION f() RETURNS trigger AS $$ BEGIN INSERT INTO audit_log VALUES (1); RETURN NEW; END $$ LANGUAGE plpgsql;
CREATE TABLE audit_log (id int);
"""


def test_read_ddl():
    m = read_ddl(DDL)
    o = m.table("public.orders")
    assert m.enums == {"public.order_status": ["pending", "it's; paid"]}
    by = {c.name: c for c in o.columns}
    assert [c.name for c in o.columns][:4] == ["id", "user_id", "status", "status_qualified"]
    assert (by["id"].data_type, by["id"].nullable, by["id"].default) == ("bigint", False, "nextval")
    assert by["status"].enum == by["status_qualified"].enum == "public.order_status" and not by["status_qualified"].nullable
    assert (by["total"].precision, by["total"].scale, by["name"].char_max) == (12, 2, 20)
    assert (by["tags"].data_type, by["tags"].udt, by["tags"].array_dims) == ("ARRAY", "_text", 1)
    assert by["g"].generated and "Odd Name" in by
    f = o.foreign_keys[0]
    assert (f.columns, f.parent, f.parent_columns, f.on_delete, f.deferrable) == (["user_id"], "public.users", ["id"], "CASCADE", True)
    assert o.unique_keys == [["name"], ["id", "user_id"]] and o.partial_unique_keys == [{"columns": ["name"], "predicate": "total > 0"}]
    assert [c["columns"] for c in o.checks] == [["total"], ["user_id", "note_id"]]
    assert o.polymorphs == [{"type_column": "note_type", "id_column": "note_id"}]
    assert m.table("public.audit_log").trigger_populated
    assert m.table("public.users").unique_keys == [["email"]]
    assert len(statements("a; 'b;c'; -- d;\n e")) == 3


def test_build_from_ddl():
    cfg = build(read_ddl(DDL), seed=5)
    o = cfg.tables["public.orders"]
    assert o.columns["user_id"].params == {"target": "public.users.id", "deferrable": True}
    assert o.columns["status"].params["values"][0] == "pending" and o.columns["total"].params["min"] == 0
    assert o.row_count == 0 and cfg.tables["public.audit_log"].row_count == 0 and cfg.tables["public.users"].row_count == 100
    assert o.columns["note_type"].unresolved and "g" not in o.columns
    assert to_mapping(loads(dumps(cfg))) == to_mapping(cfg)


def test_filter_tables():
    m = read_ddl(DDL)
    assert [t.name for t in m.only(["orders", "public.users"], ["users"]).tables] == ["orders"]


# --- lint and repair


def test_every_kind_can_be_found():
    found = {i.kind for i in lint(config(LINTED))}
    deferred = {"a": {"row_count": 1, "columns": {"id": SERIAL, "b": ref("b.id", nullable=True)}}, "b": {"row_count": 1, "columns": {"id": SERIAL, "a": ref("a.id", nullable=True)}}}
    found |= {i.kind for i in lint(config(deferred))}
    assert found == set(KINDS) and len(KINDS) == 19


def test_counts_and_order():
    issues = lint(config(LINTED))
    n = counts(issues)
    assert sum(n.values()) == len(issues)
    ordered = fix_order(issues)
    assert [i.level for i in ordered] == sorted((i.level for i in ordered), key=["ERR", "WARN", "INFO"].index)


def test_clean_configuration_has_no_issue():
    assert lint(config({"t": {"row_count": 1, "primary_key": ["id"], "columns": {"id": SERIAL, "email": {"factory": "email"}}, "unique_keys": [["email"]]}})) == []


def test_fixes_remove_their_issue():
    cfg, registry = config(LINTED), Registry()
    choices = {"fkref-missing-target": "parents.code", "fkref-target-not-found": "parents.code", "row-count-per-missing": "parents", "value-type-mismatch": "5", "missing-factory-param": {"values": "a, b"}, "fkref-empty-pool": 3, "fkref-in-cycle": "nullable", "no-factory": "city", "unknown-factory": "city", "unresolved": "city", "json-field-unresolved": "company", "unique-unsafe-factory": "slug"}
    for issue in fix_order(lint(cfg)):
        fix(cfg, issue, choices[issue.kind], registry)
    assert not fix_order(lint(cfg))
    assert cfg.tables["public.children"].columns["pick"].params["values"] == ["a", "b"]
    assert "public.parents.id" in key_targets(cfg)


def test_bad_choices_change_nothing():
    cfg = config(LINTED)
    issue = next(i for i in lint(cfg) if i.kind == "unknown-factory")
    before = to_mapping(cfg)
    with pytest.raises(FixError):
        fix(cfg, issue, "still_no_such")
    assert to_mapping(cfg) == before
    with pytest.raises(FixError):
        coerce("x", "integer")
    assert parse_list("1, 2", "int") == [1, 2] and parse_list('["a"]') == ["a"] and coerce("true", "boolean") is True


def test_shape_from_example():
    s = shape_of('{"city": "x", "score": 3, "on": true, "addr": {"zip": "1"}}', Registry())
    assert s["city"].factory == "city" and s["on"].factory == "bool" and s["score"].data_type == "numeric"
    assert isinstance(s["addr"].values["zip"], ColumnSpec)
