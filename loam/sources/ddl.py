"""PostgreSQL DDL text as a schema model: tables, constraints, enums and unique indexes; the rest is passed over."""

from __future__ import annotations

import re

from loam.plans.model import ColumnModel, ForeignKey, SchemaModel, TableModel, find_polymorphs

# PostgreSQL's internal type names and the standard's.
TYPES = {
    "int2": "smallint", "int4": "integer", "int8": "bigint", "int": "integer", "float4": "real", "float8": "double precision", "float": "double precision",
    "decimal": "numeric", "bool": "boolean", "varchar": "character varying", "bpchar": "character", "char": "character",
    "timestamptz": "timestamp with time zone", "timestamp": "timestamp without time zone", "timetz": "time with time zone", "time": "time without time zone",
}
KNOWN = set(TYPES.values()) | {"text", "uuid", "json", "jsonb", "bytea", "date", "interval", "inet", "xml", "citext", "numeric", "smallint", "integer", "bigint", "boolean"}
UDT = {v: k for k, v in TYPES.items() if k not in ("int", "float", "decimal", "char")} | {"character": "bpchar"}
SERIAL = {"smallserial": "smallint", "serial2": "smallint", "serial": "integer", "serial4": "integer", "bigserial": "bigint", "serial8": "bigint"}

_TOKEN = re.compile(r"--[^\n]*|/\*.*?\*/|\$(\w*)\$.*?\$\1\$|E?'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|[A-Za-z_][\w$]*|\d+(?:\.\d+)?|::|[<>!=]+|\S", re.S)
_ACTIONS = r"(CASCADE|RESTRICT|SET NULL|SET DEFAULT|NO ACTION)"


def statements(text: str) -> list[str]:
    """Statements between semicolons outside literals, comments and dollar quotes."""
    out, last = [], 0
    for m in _TOKEN.finditer(text):
        if m.group() == ";":
            out.append(text[last : m.start()])
            last = m.end()
    return [s for s in (_plain(x) for x in [*out, text[last:]]) if s]


def _plain(text: str) -> str:
    """Without comments, white space as single blanks outside literals."""
    parts = [m.group() for m in re.finditer(r"--[^\n]*|/\*.*?\*/|E?'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|\s+|[^\s'\"]", text, re.S)]
    return "".join(" " if p.isspace() or p.startswith(("--", "/*")) else p for p in parts).strip()


def _items(text: str) -> list[str]:
    depth, last, out, quote = 0, 0, [], ""
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "," and depth == 0:
            out.append(text[last:i].strip())
            last = i + 1
    return [x for x in [*out, text[last:].strip()] if x]


def _bracket(text: str, start: int) -> tuple[str, int]:
    """What stands in the brackets that open at or after ``start``, and where they close."""
    at = text.index("(", start)
    depth, quote = 0, ""
    for i in range(at, len(text)):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        else:
            depth += (c == "(") - (c == ")")
            if depth == 0:
                return text[at + 1 : i], i + 1
    raise ValueError("brackets don't close")


def _name(text: str) -> str:
    text = text.strip()
    return text[1:-1].replace('""', '"') if text.startswith('"') else text.lower()


def _qualified(text: str) -> str:
    parts = re.findall(r'"(?:[^"]|"")*"|[\w$]+', text)
    names = [_name(p) for p in parts[-2:]]
    return ".".join(names if len(names) == 2 else ["public", *names])


def _names(text: str) -> list[str]:
    return [_name(x) for x in _items(text)]


_COLUMN_END = re.compile(r"\b(CONSTRAINT|PRIMARY KEY|UNIQUE|REFERENCES|NOT NULL|NULL|DEFAULT|CHECK|GENERATED|COLLATE)\b", re.I)
_TYPE = re.compile(r'((?:"[^"]+"|[\w.]+)(?:\s+(?:varying|precision))?)\s*(\([\d\s,]+\))?((?:\s+with(?:out)? time zone)?)\s*((?:\[\d*\]|\s+ARRAY)*)\s*$', re.I)


def _column(text: str, position: int, enums: dict[str, list[str]]) -> tuple[ColumnModel, str]:
    head = re.match(r'("(?:[^"]|"")*"|[\w$]+)\s+', text)
    rest = text[head.end() :]
    end = _COLUMN_END.search(rest)
    kind, tail = (rest[: end.start()], rest[end.start() :]) if end else (rest, "")
    m = _TYPE.match(kind.strip())
    raw = re.sub(r"\s+", " ", (m[1] if m else kind).strip().lower().replace('"', "")).removeprefix("pg_catalog.")
    zone, mods = (m[3] or "").strip().lower() if m else "", [int(x) for x in re.findall(r"\d+", (m[2] or "") if m else "")]
    c = ColumnModel(_name(head[1]), "", position=position)
    if raw in SERIAL:
        c.data_type, c.nullable, c.default = SERIAL[raw], False, "nextval"
    else:
        full = f"{raw} {zone}" if zone else TYPES.get(raw, raw)
        enum = raw if "." in raw else f"public.{raw}"
        if full in KNOWN:
            c.data_type = full
        else:
            c.data_type, c.enum = "USER-DEFINED", enum if enum in enums else ""
    c.udt = UDT.get(c.data_type, c.data_type) if c.data_type != "USER-DEFINED" else raw.split(".")[-1]
    if c.data_type.startswith("character") and mods:
        c.char_max = mods[0]
    if c.data_type == "numeric" and mods:
        c.precision, c.scale = mods[0], mods[1] if len(mods) > 1 else 0
    if m and m[4].strip():
        c.data_type, c.udt, c.array_dims = "ARRAY", f"_{c.udt}", max(1, m[4].count("["))
    return c, tail


class _Reader:
    def __init__(self):
        self.model, self.names = SchemaModel(), 0

    def constraint_name(self, given: str, t: TableModel, kind: str) -> str:
        self.names += 1
        return given or f"{t.name}_{kind}_{self.names}"

    def references(self, t: TableModel, columns: list[str], text: str, name: str) -> None:
        m = re.match(r"REFERENCES\s+([\w.$\"]+)", text, re.I)
        rest, parent_columns = text[m.end() :], []
        if rest.lstrip().startswith("("):
            inner, end = _bracket(rest, 0)
            parent_columns, rest = _names(inner), rest[end:]
        act = lambda on: (x := re.search(rf"ON {on} {_ACTIONS}", rest, re.I)) and x[1].upper() or "NO ACTION"
        later = bool(re.search(r"(?<!NOT )\bDEFERRABLE\b", rest, re.I))
        t.foreign_keys.append(ForeignKey(self.constraint_name(name, t, "fkey"), columns, _qualified(m[1]), parent_columns, act("DELETE"), act("UPDATE"), later))

    def table_rule(self, t: TableModel, text: str) -> bool:
        name = ""
        if m := re.match(r'CONSTRAINT\s+("(?:[^"]|"")*"|[\w$]+)\s+', text, re.I):
            name, text = _name(m[1]), text[m.end() :]
        if re.match(r"PRIMARY KEY\s*\(", text, re.I):
            t.primary_key = _names(_bracket(text, 0)[0])
            for c in t.columns:
                c.nullable = c.nullable and c.name not in t.primary_key
        elif re.match(r"UNIQUE\s*(NULLS\s+(NOT\s+)?DISTINCT\s*)?\(", text, re.I):
            t.unique_keys.append(_names(_bracket(text, 0)[0]))
        elif re.match(r"FOREIGN KEY\s*\(", text, re.I):
            inner, end = _bracket(text, 0)
            self.references(t, _names(inner), text[end:].strip(), name)
        elif re.match(r"CHECK\s*\(", text, re.I):
            t.checks.append({"name": self.constraint_name(name, t, "check"), "expression": f"({_bracket(text, 0)[0]})", "columns": []})
        elif re.match(r"EXCLUDE\b", text, re.I):
            inner = _bracket(text, 0)[0]
            columns = [c.name for c in t.columns if re.search(rf"\b{re.escape(c.name)}\b", inner)]
            t.excludes.append({"name": self.constraint_name(name, t, "excl"), "definition": text, "columns": columns})
        else:
            return False
        return True

    def column(self, t: TableModel, text: str) -> None:
        c, tail = _column(text, len(t.columns) + 1, self.model.enums)
        t.columns.append(c)
        while tail:
            name = ""
            if m := re.match(r'CONSTRAINT\s+("(?:[^"]|"")*"|[\w$]+)\s+', tail, re.I):
                name, tail = _name(m[1]), tail[m.end() :]
            after = None
            if m := re.match(r"PRIMARY KEY", tail, re.I):
                t.primary_key, c.nullable, after = [c.name], False, m.end()
            elif m := re.match(r"UNIQUE", tail, re.I):
                t.unique_keys.append([c.name])
                after = m.end()
            elif m := re.match(r"NOT NULL", tail, re.I):
                c.nullable, after = False, m.end()
            elif m := re.match(r"REFERENCES\b", tail, re.I):
                nxt = _COLUMN_END.search(re.sub(r"SET (NULL|DEFAULT)|NOT DEFERRABLE", lambda x: "#" * len(x[0]), tail, flags=re.I), m.end())
                after = nxt.start() if nxt else len(tail)
                self.references(t, [c.name], tail[:after], name)
            elif re.match(r"CHECK\s*\(", tail, re.I):
                inner, after = _bracket(tail, 0)
                t.checks.append({"name": self.constraint_name(name, t, "check"), "expression": f"({inner})", "columns": []})
            elif m := re.match(r"GENERATED\b", tail, re.I):
                c.identity = bool(re.match(r"GENERATED\s+(ALWAYS|BY DEFAULT)\s+AS IDENTITY", tail, re.I))
                c.generated = not c.identity
                c.nullable = c.nullable and not c.identity
                nxt = _COLUMN_END.search(tail, m.end())
                after = nxt.start() if nxt else len(tail)
            elif m := re.match(r"DEFAULT\b", tail, re.I):
                nxt = _COLUMN_END.search(tail, m.end())
                after = nxt.start() if nxt else len(tail)
                c.default = tail[m.end() : after].strip()
            else:
                nxt = _COLUMN_END.search(tail, 1)
                after = nxt.start() if nxt else len(tail)
            tail = tail[after:].strip()

    def read(self, text: str) -> None:
        todo = statements(text)
        for s in todo:  # enums first, so that columns can name later ones
            if m := re.match(r"CREATE TYPE\s+([\w.$\"]+)\s+AS ENUM\s*", s, re.I):
                self.model.enums[_qualified(m[1])] = [x.strip()[1:-1].replace("''", "'") for x in _items(_bracket(s, m.end() - 1)[0])]
        for s in todo:
            if m := re.match(r"CREATE (?:UNLOGGED |TEMP |TEMPORARY )?TABLE\s+(?:IF NOT EXISTS\s+)?([\w.$\"]+)\s*\(", s, re.I):
                t = TableModel(*_qualified(m[1]).split(".", 1))
                rules = []
                for item in _items(_bracket(s, m.end() - 1)[0]):
                    if re.match(r"(CONSTRAINT|PRIMARY KEY|UNIQUE|FOREIGN KEY|CHECK|EXCLUDE)\b", item, re.I):
                        rules.append(item)
                    elif not re.match(r"LIKE\b", item, re.I):
                        self.column(t, item)
                for item in rules:
                    self.table_rule(t, item)
                self.model.tables.append(t)
            elif m := re.match(r"ALTER TABLE\s+(?:ONLY\s+)?(?:IF EXISTS\s+)?([\w.$\"]+)\s+(.*)", s, re.I | re.S):
                t = self.model.table(_qualified(m[1]))
                for item in _items(m[2]) if t else ():
                    if a := re.match(r"ADD\s+(?=CONSTRAINT|PRIMARY|UNIQUE|FOREIGN|CHECK|EXCLUDE)", item, re.I):
                        self.table_rule(t, item[a.end() :])
                    elif a := re.match(r"ALTER\s+(?:COLUMN\s+)?([\w$\"]+)\s+SET NOT NULL", item, re.I):
                        if col := t.column(_name(a[1])):
                            col.nullable = False
            elif m := re.match(r"CREATE UNIQUE INDEX\s+(?:CONCURRENTLY\s+)?(?:IF NOT EXISTS\s+)?[\w.$\"]*\s*ON\s+(?:ONLY\s+)?([\w.$\"]+)\s*(?:USING\s+\w+\s*)?\(", s, re.I):
                t = self.model.table(_qualified(m[1]))
                inner, end = _bracket(s, m.end() - 1)
                if t:
                    columns = [c for item in _items(inner) for c in ([_name(item)] if t.column(_name(item)) else [x.name for x in t.columns if re.search(rf"\b{re.escape(x.name)}\b", item)])]
                    where = re.search(r"\bWHERE\b(.*)$", s[end:], re.I | re.S)
                    if where and columns:
                        t.partial_unique_keys.append({"columns": columns, "predicate": where[1].strip()})
                    elif columns:
                        t.unique_keys.append(columns)
        for s in todo:  # bodies may name tables that come later
            if re.match(r"CREATE (?:OR REPLACE )?(?:FUNCTION|PROCEDURE|TRIGGER)\b", s, re.I):
                for into in re.findall(r"INSERT INTO\s+([\w.$\"]+)", s, re.I):
                    if t := self.model.table(_qualified(into)):
                        t.trigger_populated = True


def read_ddl(text: str) -> SchemaModel:
    reader = _Reader()
    reader.read(text)
    model = reader.model
    for t in model.tables:
        for f in t.foreign_keys:
            parent = model.table(f.parent)
            f.parent_columns = f.parent_columns or (list(parent.primary_key) if parent else [])
        for c in t.checks:
            words = re.sub(r"'(?:[^']|'')*'", "", c["expression"])
            c["columns"] = [x.name for x in t.columns if re.search(rf'(?<![\w:]){re.escape(x.name)}\b(?!\s*\()', words)]
        t.polymorphs = find_polymorphs(t)
    model.schemas = sorted({t.schema for t in model.tables})
    return model.settled()
