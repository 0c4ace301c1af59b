"""The neutral schema model that every source fills."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from fnmatch import fnmatchcase


@dataclass
class ColumnModel:
    name: str
    data_type: str
    udt: str = ""
    nullable: bool = True
    default: str = ""
    generated: bool = False
    identity: bool = False
    char_max: int | None = None
    precision: int | None = None
    scale: int | None = None
    array_dims: int = 0
    enum: str = ""  # schema.name
    position: int = 0


@dataclass
class ForeignKey:
    name: str
    columns: list[str]
    parent: str  # schema.table
    parent_columns: list[str]
    on_delete: str = "NO ACTION"
    on_update: str = "NO ACTION"
    deferrable: bool = False


@dataclass
class TableModel:
    schema: str
    name: str
    columns: list[ColumnModel] = field(default_factory=list)
    primary_key: list[str] = field(default_factory=list)
    unique_keys: list[list[str]] = field(default_factory=list)
    partial_unique_keys: list[dict] = field(default_factory=list)
    foreign_keys: list[ForeignKey] = field(default_factory=list)
    checks: list[dict] = field(default_factory=list)
    excludes: list[dict] = field(default_factory=list)
    trigger_populated: bool = False
    polymorphs: list[dict] = field(default_factory=list)

    @property
    def key(self) -> str:
        return f"{self.schema}.{self.name}"

    def column(self, name: str) -> ColumnModel | None:
        return next((c for c in self.columns if c.name == name), None)


@dataclass
class SchemaModel:
    dialect: str = "postgres"
    schemas: list[str] = field(default_factory=list)
    tables: list[TableModel] = field(default_factory=list)
    enums: dict[str, list[str]] = field(default_factory=dict)  # schema.name -> labels

    def table(self, key: str) -> TableModel | None:
        return next((t for t in self.tables if t.key == key), None)

    def settled(self) -> SchemaModel:
        """Tables by schema and name, columns by position, references by name."""
        self.tables.sort(key=lambda t: (t.schema, t.name))
        for t in self.tables:
            t.columns.sort(key=lambda c: c.position)
            t.foreign_keys.sort(key=lambda f: f.name)
        self.enums = dict(sorted(self.enums.items()))
        return self

    def only(self, only=(), exclude=()) -> SchemaModel:
        """Tables by short or qualified name (patterns allowed)."""
        hit = lambda t, names: any(fnmatchcase(t.name, n) or fnmatchcase(t.key, n) for n in names)
        kept = [t for t in self.tables if (not only or hit(t, only)) and not hit(t, exclude)]
        return SchemaModel(self.dialect, list(self.schemas), kept, dict(self.enums))


TEXT_LIKE = re.compile(r"text|char|USER-DEFINED", re.I)
INT_LIKE = re.compile(r"int", re.I)


def find_polymorphs(t: TableModel) -> list[dict]:
    """Pairs of a text ``x_type`` and an integer or uuid ``x_id`` without a declared reference."""
    declared = {c for f in t.foreign_keys for c in f.columns}
    out = []
    for c in t.columns:
        base = c.name.removesuffix("_type")
        other = t.column(f"{base}_id") if base != c.name and base else None
        if other and TEXT_LIKE.search(c.data_type) and INT_LIKE.search(other.data_type) and other.name not in declared:
            out.append({"type_column": c.name, "id_column": other.name})
    return out
