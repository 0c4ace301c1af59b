"""The versioned configuration: which tables, how many rows, and a generator for every column."""

from __future__ import annotations

import copy
from dataclasses import dataclass, field, fields
from typing import Any

VERSION = 1
#: Migrations by the version they start from; each takes and returns the raw mapping.
MIGRATIONS: dict[int, Any] = {}


class ConfigError(ValueError):
    pass


@dataclass
class ColumnSpec:
    factory: str = ""
    value: Any = None
    params: dict[str, Any] = field(default_factory=dict)
    values: dict[str, ColumnSpec] = field(default_factory=dict)
    unresolved: bool = False
    removed: bool = False
    nullable: bool = False
    data_type: str = ""


@dataclass
class Table:
    schema: str = "public"
    name: str = ""
    row_count: int | None = None
    row_count_per: dict[str, tuple[int, int]] = field(default_factory=dict)
    tags: list[str] = field(default_factory=list)
    removed: bool = False
    primary_key: list[str] = field(default_factory=list)
    unique_keys: list[list[str]] = field(default_factory=list)
    partial_unique_keys: list[dict] = field(default_factory=list)  # columns, predicate
    checks: list[dict] = field(default_factory=list)  # name, expression, columns
    excludes: list[dict] = field(default_factory=list)  # name, definition, columns
    trigger_populated: bool = False
    polymorphs: list[dict] = field(default_factory=list)  # type_column, id_column, candidates
    columns: dict[str, ColumnSpec] = field(default_factory=dict)

    def active(self) -> list[str]:
        """Columns to emit: the key first, then the others by name."""
        rest = sorted(c for c, s in self.columns.items() if not s.removed and c not in self.primary_key)
        return [c for c in self.primary_key if c in self.columns and not self.columns[c].removed] + rest


@dataclass
class Config:
    version: int = VERSION
    dialect: str = "postgres"
    schemas: list[str] = field(default_factory=lambda: ["public"])
    locale: str = ""
    seed: int = 0
    tables: dict[str, Table] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)


def qualified(name: str) -> str:
    return name if "." in name else f"public.{name}"


def split_target(target: str) -> tuple[str, str] | None:
    """``schema.table.column`` (or ``table.column`` in public) as (table key, column)."""
    parts = target.split(".") if isinstance(target, str) else []
    if len(parts) == 2:
        parts = ["public", *parts]
    return (".".join(parts[:2]), parts[2]) if len(parts) == 3 and all(parts) else None


def _column(raw: Any) -> ColumnSpec:
    raw = dict(raw or {})
    spec = ColumnSpec(**{k: raw[k] for k in ("factory", "value", "unresolved", "removed", "nullable", "data_type") if raw.get(k) is not None})
    spec.params = dict(raw.get("params") or {})
    spec.values = {k: _column(v) for k, v in (raw.get("values") or {}).items()}
    return spec


def _table(key: str, raw: dict) -> Table:
    schema, name = qualified(key).split(".", 1)
    known = {f.name for f in fields(Table)} - {"schema", "name", "columns", "row_count_per"}
    t = Table(schema, name, **{k: copy.deepcopy(v) for k, v in raw.items() if k in known and v is not None})
    t.row_count_per = {k: (int(v[0]), int(v[1])) for k, v in (raw.get("row_count_per") or {}).items()}
    t.columns = {k: _column(v) for k, v in (raw.get("columns") or {}).items()}
    return t


def from_mapping(raw: dict) -> Config:
    """Newer versions are refused, older ones migrated; short table names are taken as ``public.``."""
    raw = copy.deepcopy(raw or {})
    version, warnings = raw.get("version"), []
    if version is None:
        warnings.append(f"version missing, taken as {VERSION}")
        version = VERSION
    if version > VERSION:
        raise ConfigError(f"version {version} is newer than {VERSION}")
    while version < VERSION:
        if version not in MIGRATIONS:
            raise ConfigError(f"no migration from version {version}")
        raw, version = MIGRATIONS[version](raw), version + 1
    database, defaults = raw.get("database") or {}, raw.get("defaults") or {}
    tables = {qualified(k): _table(k, v or {}) for k, v in (raw.get("tables") or {}).items()}
    return Config(version, database.get("dialect", "postgres"), list(database.get("schemas") or []), str(defaults.get("locale") or ""), int(defaults.get("seed") or 0), tables, warnings)


def _column_mapping(c: ColumnSpec) -> dict:
    out: dict[str, Any] = {}
    if c.factory:
        out["factory"] = c.factory
    if c.value is not None:
        out["value"] = c.value
    if c.params:
        out["params"] = dict(sorted(c.params.items()))
    if c.values:
        out["values"] = {k: _column_mapping(v) for k, v in sorted(c.values.items())}
    out |= {k: True for k in ("unresolved", "removed") if getattr(c, k)}
    if c.data_type:
        out["data_type"] = c.data_type
    if c.nullable:
        out["nullable"] = True
    return out


def to_mapping(cfg: Config) -> dict:
    out: dict[str, Any] = {"version": cfg.version, "database": {"dialect": cfg.dialect, "schemas": list(cfg.schemas)}}
    out["defaults"] = {k: v for k, v in (("locale", cfg.locale), ("seed", cfg.seed)) if v}
    out["tables"] = {}
    for key, t in sorted(cfg.tables.items()):
        row: dict[str, Any] = {}
        if t.row_count is not None:
            row["row_count"] = t.row_count
        if t.row_count_per:
            row["row_count_per"] = {k: list(v) for k, v in sorted(t.row_count_per.items())}
        for name in ("tags", "removed", "primary_key", "unique_keys", "partial_unique_keys", "checks", "excludes", "trigger_populated", "polymorphs"):
            if getattr(t, name):
                row[name] = copy.deepcopy(getattr(t, name))
        row["columns"] = {c: _column_mapping(t.columns[c]) for c in [*[c for c in t.primary_key if c in t.columns], *sorted(c for c in t.columns if c not in t.primary_key)]}
        out["tables"][key] = row
    return out


def _yaml():
    try:
        import yaml
    except ImportError as e:
        raise ConfigError("YAML files need the yaml package; from_mapping takes a dict") from e
    return yaml


def loads(text: str) -> Config:
    return from_mapping(_yaml().safe_load(text) or {})


def dumps(cfg: Config) -> str:
    yaml = _yaml()

    class Leaf(dict):
        """A column without nested fields goes on one line."""

    class Dumper(yaml.SafeDumper):
        pass

    Dumper.add_representer(Leaf, lambda d, v: d.represent_mapping("tag:yaml.org,2002:map", v.items(), flow_style=True))
    tree = to_mapping(cfg)
    for t in tree["tables"].values():
        t["columns"] = {k: v if "values" in v else Leaf(v) for k, v in t["columns"].items()}
    return yaml.dump(tree, Dumper=Dumper, sort_keys=False, allow_unicode=True, width=10_000)


def load(path: str) -> Config:
    with open(path, encoding="utf-8") as f:
        return loads(f.read())


def save(cfg: Config, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(dumps(cfg))
