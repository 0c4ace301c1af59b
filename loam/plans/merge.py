"""A fresh configuration merged into an edited one: what people decide stays, what the schema says is renewed."""

from __future__ import annotations

import copy

from .config import ColumnSpec, Config, Table

#: Parameters that follow the schema, whoever set them: they are there if the schema says so.
FROM_SCHEMA = frozenset({"target", "values", "deferrable", "element", "max_len"})


def merge_params(old: dict, new: dict) -> dict:
    return new | {k: v for k, v in old.items() if k not in FROM_SCHEMA}


def merge_column(old: ColumnSpec, new: ColumnSpec) -> ColumnSpec:
    out = copy.deepcopy(new)
    if old.factory:
        out.factory, out.unresolved = old.factory, old.unresolved
    if old.value is not None:
        out.value = old.value
    if old.values:
        out.values = copy.deepcopy(old.values)
    out.params = merge_params(old.params, new.params)
    return out


def merge_table(old: Table, new: Table) -> Table:
    out = copy.deepcopy(new)
    out.row_count = old.row_count if old.row_count is not None else new.row_count
    out.row_count_per = dict(old.row_count_per or new.row_count_per)
    out.tags = list(old.tags or new.tags)
    out.columns = {k: merge_column(old.columns[k], c) if k in old.columns else copy.deepcopy(c) for k, c in new.columns.items()}
    for k, c in old.columns.items():
        if k not in new.columns:
            out.columns[k] = copy.deepcopy(c)
            out.columns[k].removed = True
    known = {(p["type_column"], p["id_column"]): p.get("candidates") for p in old.polymorphs}
    for p in out.polymorphs:
        if kept := known.get((p["type_column"], p["id_column"])):
            p["candidates"] = copy.deepcopy(kept)
    return out


def merge(old: Config, new: Config) -> Config:
    """Tables and columns that are gone from ``new`` are flagged, never deleted."""
    out = copy.deepcopy(new)
    out.locale, out.seed = old.locale or new.locale, old.seed or new.seed
    out.tables = {k: merge_table(old.tables[k], t) if k in old.tables else copy.deepcopy(t) for k, t in new.tables.items()}
    for k, t in old.tables.items():
        if k not in new.tables:
            out.tables[k] = copy.deepcopy(t)
            out.tables[k].removed = True
    return out


def sync(old: Config, new: Config, in_scope) -> Config:
    """Merge the tables that ``in_scope`` accepts; the others stay as they are."""
    scoped = copy.deepcopy(old)
    scoped.tables = {k: t for k, t in old.tables.items() if in_scope(k)}
    out = merge(scoped, new)
    out.tables |= {k: copy.deepcopy(t) for k, t in old.tables.items() if not in_scope(k)}
    return out
