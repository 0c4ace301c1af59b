"""From a schema model to a fresh configuration: inference, references, limits, CHECK push-down."""

from __future__ import annotations

from loam.functions.generators import Column, Registry

from .checks import apply_checks, unsatisfiable
from .config import ColumnSpec, Config, Table
from .model import ColumnModel, SchemaModel, TableModel

DEFAULT_ROWS = 100


def api_column(t: TableModel, c: ColumnModel, enums: dict[str, list[str]], target: str = "") -> Column:
    return Column(c.name, c.data_type, c.udt, c.array_dims, tuple(enums.get(c.enum, ())), target, c.precision, c.scale)


def _spec(t: TableModel, c: ColumnModel, model: SchemaModel, registry: Registry) -> ColumnSpec:
    fk = next(((f, f.parent_columns[f.columns.index(c.name)]) for f in t.foreign_keys if c.name in f.columns), None)
    target = f"{fk[0].parent}.{fk[1]}" if fk else ""
    column = api_column(t, c, model.enums, target)
    factory, _, unresolved = registry.infer(column)
    spec = ColumnSpec(factory=factory.name if factory else "string", unresolved=unresolved, nullable=c.nullable, data_type=c.data_type)
    if fk:
        spec.params["target"] = target
        if fk[0].deferrable:
            spec.params["deferrable"] = True
    if column.enum_values and spec.factory == "enum_value":
        spec.params["values"] = list(column.enum_values)
    if spec.factory == "array":
        spec.params["element"] = c.udt
    if c.char_max:
        spec.params["max_len"] = c.char_max
    if spec.factory == "decimal" and c.precision:
        spec.params |= {"precision": c.precision, "scale": c.scale or 0}
    return spec


def build(model: SchemaModel, registry: Registry | None = None, seed: int = 0, locale: str = "") -> Config:
    registry = registry or Registry()
    cfg = Config(dialect=model.dialect, schemas=list(model.schemas), seed=seed, locale=locale)
    for t in model.tables:
        out = Table(
            t.schema, t.name, DEFAULT_ROWS, primary_key=list(t.primary_key), unique_keys=[list(u) for u in t.unique_keys],
            partial_unique_keys=[dict(p) for p in t.partial_unique_keys], checks=[dict(c) for c in t.checks], excludes=[dict(x) for x in t.excludes],
            trigger_populated=t.trigger_populated, polymorphs=[dict(p) for p in t.polymorphs],
        )
        out.columns = {c.name: _spec(t, c, model, registry) for c in t.columns if not c.generated}
        for p in t.polymorphs:
            for name in (p["type_column"], p["id_column"]):
                if name in out.columns:
                    out.columns[name].unresolved = True
        apply_checks(out)
        if unsatisfiable(out):
            out.row_count = 0
        cfg.tables[t.key] = out
    return cfg
