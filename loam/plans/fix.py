"""Repairs of findings, without a terminal: each takes the issue and a choice and changes the configuration."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from loam.functions.generators import Column, Registry

from .config import ColumnSpec, Config, qualified, split_target
from .lint import Issue, missing_params, target_exists

SETUP_ROUNDS = 16


class FixError(ValueError):
    pass


def _spec(cfg: Config, issue: Issue) -> ColumnSpec:
    t = cfg.tables.get(issue.table)
    spec = t.columns.get(issue.column) if t else None
    if spec is None:
        raise FixError(f"no column {issue.table}.{issue.column}")
    for name in issue.field.split(".") if issue.field else ():
        spec = spec.values.get(name)
        if spec is None:
            raise FixError(f"no field {issue.field} in {issue.table}.{issue.column}")
    return spec


def candidates(cfg: Config, registry: Registry, issue: Issue, top: int | None = 8) -> list[tuple[str, int]]:
    """Factories for the issue's column or field, best first."""
    spec = _spec(cfg, issue)
    name = issue.field.rsplit(".", 1)[-1] if issue.field else issue.column
    return registry.ranked(Column(name, spec.data_type, fk_target=spec.params.get("target", "")), top)


def key_targets(cfg: Config) -> list[str]:
    """Columns that a reference may name: keys and serial columns."""
    return sorted(f"{k}.{c}" for k, t in cfg.tables.items() if not t.removed for c, s in t.columns.items() if not s.removed and (c in t.primary_key or s.factory == "pk_serial"))


def coerce(raw: str, data_type: str) -> Any:
    """Text as a literal of the column's type; raises FixError if it can't be one."""
    kind = data_type.lower()
    try:
        if "int" in kind and kind != "interval":
            return int(raw)
        if any(x in kind for x in ("numeric", "decimal", "real", "double", "float")):
            return float(raw)
    except ValueError as e:
        raise FixError(f"{raw!r} is no {data_type}") from e
    if "bool" in kind:
        if raw.lower() not in ("true", "false"):
            raise FixError(f"{raw!r} is no boolean")
        return raw.lower() == "true"
    return raw


def parse_list(raw: str, kind: str = "text") -> list:
    """Comma-separated values, or a JSON list."""
    if raw.strip().startswith("["):
        return list(json.loads(raw))
    parts = [p.strip() for p in raw.split(",") if p.strip()]
    return [coerce(p, {"int": "integer", "float": "numeric", "bool": "boolean"}.get(kind, "text")) for p in parts]


def json_type(value: Any) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "numeric"
    return "jsonb" if isinstance(value, dict) else "text"


def shape_of(example: str, registry: Registry) -> dict[str, ColumnSpec]:
    """Fields of an example object with an inferred factory each; nested objects become nested shapes."""
    value = json.loads(example)
    if not isinstance(value, dict):
        raise FixError("the example must be an object")
    out = {}
    for name, v in value.items():
        kind = json_type(v)
        if kind == "jsonb":
            out[name] = ColumnSpec(values=shape_of(json.dumps(v), registry), data_type=kind)
            continue
        factory, _, unresolved = registry.infer(Column(name, kind))
        out[name] = ColumnSpec(factory=factory.name if factory else "string", unresolved=unresolved, data_type=kind)
    return out


def set_factory(cfg: Config, registry: Registry, issue: Issue, choice: str, params: dict | None = None) -> None:
    if registry.get(choice) is None:
        raise FixError(f"unknown factory {choice}")
    spec = _spec(cfg, issue)
    spec.factory, spec.unresolved, spec.value = choice, False, None
    if params:
        spec.params |= params


def _set_value(cfg, registry, issue, choice):
    spec = _spec(cfg, issue)
    if choice in (None, ""):
        spec.value = None
    else:
        spec.value = coerce(choice, spec.data_type) if isinstance(choice, str) else choice


def _set_target(cfg, registry, issue, choice):
    if not split_target(choice) or not target_exists(cfg, choice):
        raise FixError(f"no such column {choice}")
    _spec(cfg, issue).params["target"] = choice


def _set_parent(cfg, registry, issue, choice):
    t = cfg.tables[issue.table]
    span = t.row_count_per.pop(issue.field)
    if choice:
        if qualified(choice) not in cfg.tables:
            raise FixError(f"no such table {choice}")
        t.row_count_per[choice] = span


def _fill_pool(cfg, registry, issue, choice):
    """choice: a row count for the parent, "nullable", or {"value": literal}."""
    spec = _spec(cfg, issue)
    if choice == "nullable":
        spec.nullable = True
    elif isinstance(choice, dict):
        spec.value = choice["value"]
    else:
        cfg.tables[split_target(spec.params["target"])[0]].row_count = int(choice)


def _open_cycle(cfg, registry, issue, choice):
    spec = _spec(cfg, issue)
    if choice == "nullable":
        spec.nullable = True
    else:
        spec.value = choice["value"]


def _set_params(cfg, registry, issue, choice):
    """choice: parameters by name; asked for again until the factory lacks none."""
    spec = _spec(cfg, issue)
    for _ in range(SETUP_ROUNDS):
        lacking = missing_params(registry, spec.factory, spec.params)
        if not lacking:
            return
        name = lacking[0]
        if name not in choice:
            raise FixError(f"{spec.factory} requires {', '.join(lacking)}")
        spec.params[name] = parse_list(choice[name]) if isinstance(choice[name], str) else choice[name]
    raise FixError(f"{spec.factory}: setup does not end")


FIXES: dict[str, Callable[[Config, Registry, Issue, Any], None]] = {
    "unresolved": set_factory,
    "no-factory": set_factory,
    "unknown-factory": set_factory,
    "unique-unsafe-factory": set_factory,
    "json-field-unresolved": set_factory,
    "value-type-mismatch": _set_value,
    "fkref-missing-target": _set_target,
    "fkref-target-not-found": _set_target,
    "row-count-per-missing": _set_parent,
    "fkref-empty-pool": _fill_pool,
    "fkref-in-cycle": _open_cycle,
    "missing-factory-param": _set_params,
}


def fix(cfg: Config, issue: Issue, choice: Any, registry: Registry | None = None) -> None:
    """Apply the choice to the issue; the configuration is unchanged where it doesn't fit."""
    if issue.kind not in FIXES:
        raise FixError(f"{issue.kind} has no fix")
    FIXES[issue.kind](cfg, registry or Registry(), issue, choice)
