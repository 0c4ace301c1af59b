"""Findings about a configuration, of 19 kinds, as rows."""

from __future__ import annotations

from dataclasses import dataclass

from loam.functions.generators import Registry

from .config import ColumnSpec, Config, Table, qualified, split_target
from .graph import Plan, non_deferrable, plan

ERROR, WARN, INFO = "ERR", "WARN", "INFO"
RANK = {ERROR: 0, WARN: 1, INFO: 2}
#: Kind -> level.
KINDS = {
    "unresolved": WARN, "no-factory": ERROR, "unknown-factory": ERROR, "value-type-mismatch": ERROR, "fkref-missing-target": ERROR,
    "fkref-target-not-found": ERROR, "row-count-per-missing": ERROR, "fkref-empty-pool": ERROR, "fkref-in-cycle": ERROR,
    "unique-unsafe-factory": WARN, "composite-unique": INFO, "composite-fk": WARN, "deferrable-cycle": INFO, "non-deferrable-cycle": ERROR,
    "check-not-applied": INFO, "exclude": WARN, "partial-unique": INFO, "json-field-unresolved": WARN, "missing-factory-param": WARN,
}
FIXABLE = frozenset({"unresolved", "no-factory", "unknown-factory", "value-type-mismatch", "fkref-missing-target", "fkref-target-not-found", "row-count-per-missing", "fkref-empty-pool", "fkref-in-cycle", "unique-unsafe-factory", "json-field-unresolved", "missing-factory-param"})


@dataclass(frozen=True)
class Issue:
    level: str
    kind: str
    location: str
    message: str
    hint: str = ""
    table: str = ""
    column: str = ""
    field: str = ""

    @property
    def fixable(self) -> bool:
        return self.kind in FIXABLE


def _issue(kind: str, location: str, message: str, hint: str = "", table: str = "", column: str = "", field: str = "") -> Issue:
    return Issue(KINDS[kind], kind, location, message, hint, table, column, field)


def target_exists(cfg: Config, target: str) -> bool:
    found = split_target(target)
    t = cfg.tables.get(found[0]) if found else None
    return bool(t and not t.removed and found[1] in t.columns and not t.columns[found[1]].removed)


def value_mismatch(value, data_type: str) -> str | None:
    kind = data_type.lower()
    if isinstance(value, str) and any(x in kind for x in ("int", "bool")) and kind != "interval":
        return f"text in a {data_type} column"
    if isinstance(value, bool) and "int" in kind and kind != "interval":
        return f"boolean in a {data_type} column"
    return None


def missing_params(registry: Registry, factory: str, params: dict) -> list[str]:
    f = registry.get(factory)
    return [n for n, _ in (f.required if f else ()) if not params.get(n)]


def _fields(values: dict[str, ColumnSpec], path: str = ""):
    for name, spec in sorted(values.items()):
        here = f"{path}.{name}" if path else name
        yield here, spec
        yield from _fields(spec.values, here)


def _column_issues(cfg: Config, registry: Registry, key: str, name: str, c: ColumnSpec):
    at = f"{key}.{name}"
    where = {"table": key, "column": name}
    if c.unresolved:
        yield _issue("unresolved", at, "unresolved", "pick a factory or set one by hand", **where)
    if c.value is None and not c.values:
        if not c.factory:
            yield _issue("no-factory", at, "no factory", "add a factory or a literal value", **where)
        elif registry.get(c.factory) is None:
            yield _issue("unknown-factory", at, f"unknown factory {c.factory}", "is it misspelt, or a plugin's?", **where)
        elif missing := missing_params(registry, c.factory, c.params):
            yield _issue("missing-factory-param", at, f"factory {c.factory} requires {', '.join(missing)}", "set the parameters", **where)
    if c.value is not None and (why := value_mismatch(c.value, c.data_type)):
        yield _issue("value-type-mismatch", at, f"value type mismatch: {why}", "use a literal of the right type", **where)
    if c.factory == "fkref" and c.value is None:
        target = c.params.get("target")
        if not target:
            yield _issue("fkref-missing-target", at, "fkref: missing target", "name the target as schema.table.column", **where)
        elif not target_exists(cfg, target):
            yield _issue("fkref-target-not-found", at, f"fkref: target {target} not found", "pick an existing key column", **where)
    for path, f in _fields(c.values):
        if f.unresolved or not (f.factory or f.values or f.value is not None):
            yield _issue("json-field-unresolved", f"{at}.{path}", "json field unresolved", "pick a factory for the field", field=path, **where)
        elif f.factory and (missing := missing_params(registry, f.factory, f.params)):
            yield _issue("missing-factory-param", f"{at}.{path}", f"factory {f.factory} requires {', '.join(missing)}", "set the parameters", field=path, **where)


def _reference_issues(cfg: Config, p: Plan, key: str, t: Table):
    for name, c in sorted(t.columns.items()):
        found = split_target(c.params.get("target", "")) if c.factory == "fkref" and not c.removed and c.value is None else None
        if not found or c.nullable:
            continue
        if p.counts.get(found[0]) == 0:
            yield _issue("fkref-empty-pool", f"{key}.{name}", f"fkref NOT NULL: {found[0]} has no rows", "raise the parent's count, allow nulls or set a value", table=key, column=name)
        if p.in_cycle(key, found[0]):
            yield _issue("fkref-in-cycle", f"{key}.{name}", f"fkref NOT NULL within a cycle: {found[0]}", "allow nulls or set a value", table=key, column=name)


def _key_issues(registry: Registry, key: str, t: Table):
    for columns in t.unique_keys:
        if len(columns) > 1:
            yield _issue("composite-unique", key, f"composite UNIQUE ({', '.join(columns)})", "colliding rows are drawn again, then dropped")
            continue
        c = t.columns.get(columns[0])
        f = registry.get(c.factory) if c and not c.removed and c.value is None else None
        if f and not f.unique_per_row:
            yield _issue("unique-unsafe-factory", f"{key}.{columns[0]}", f"UNIQUE: factory {c.factory} may repeat", "pick a factory that is unique per row", table=key, column=columns[0])
    by_parent: dict[str, set[str]] = {}
    for c in t.columns.values():
        found = split_target(c.params.get("target", "")) if c.factory == "fkref" and not c.removed else None
        if found:
            by_parent.setdefault(found[0], set()).add(found[1])
    for parent, columns in sorted(by_parent.items()):
        if len(columns) > 1:
            yield _issue("composite-fk", key, f"composite FK to {parent} ({', '.join(sorted(columns))})", "set consistent to pick whole parent rows")


def _rule_issues(key: str, t: Table):
    for check in t.checks:
        specs = [t.columns[c] for c in check.get("columns") or [] if c in t.columns]
        if not any(k in s.params for s in specs for k in ("values", "min", "max", "max_len")):
            yield _issue("check-not-applied", key, f"CHECK {check['name']} not applied", check["expression"])
    for x in t.excludes:
        yield _issue("exclude", key, f"EXCLUDE {x['name']}", "independent columns can't keep it")
    for x in t.partial_unique_keys:
        yield _issue("partial-unique", key, f"partial UNIQUE ({', '.join(x['columns'])})", x["predicate"])


def lint(cfg: Config, registry: Registry | None = None) -> list[Issue]:
    registry, p = registry or Registry(), plan(cfg)
    out: list[Issue] = []
    for key in sorted(k for k, t in cfg.tables.items() if not t.removed):
        t = cfg.tables[key]
        for name, c in sorted(t.columns.items()):
            if not c.removed:
                out += _column_issues(cfg, registry, key, name, c)
        for parent in sorted(t.row_count_per):
            other = cfg.tables.get(qualified(parent))
            if other is None or other.removed:
                out.append(_issue("row-count-per-missing", key, f"row_count_per: parent {parent} missing", "fix the key or remove the entry", table=key, field=parent))
        out += _reference_issues(cfg, p, key, t)
        out += _key_issues(registry, key, t)
        out += _rule_issues(key, t)
    strict = {frozenset(c): [e for e in non_deferrable(p) if e.child in c] for c in p.cycles}
    for c in p.cycles:
        bad = strict[frozenset(c)]
        kind = "non-deferrable-cycle" if bad else "deferrable-cycle"
        out.append(_issue(kind, "fk cycle", ", ".join(c), ", ".join(f"{e.child}.{e.column}" for e in bad)))
    return out


def counts(issues: list[Issue]) -> dict[str, int]:
    return {level: sum(i.level == level for i in issues) for level in RANK}


def fix_order(issues: list[Issue]) -> list[Issue]:
    return sorted((i for i in issues if i.fixable), key=lambda i: (RANK[i.level], i.location))


def issues_frame(spark, issues: list[Issue]):
    rows = [(i.level, i.kind, i.location, i.message, i.hint, i.fixable) for i in issues]
    return spark.createDataFrame(rows, "level string, kind string, location string, message string, hint string, fixable boolean")
