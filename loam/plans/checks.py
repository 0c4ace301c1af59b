"""CHECK expressions pushed down into generator parameters.

Understood, alone or joined by AND: BETWEEN, comparisons with a constant, IN and = ANY(ARRAY[...]),
and upper bounds on a length. Anything else (functions, two columns) is left to verification.
"""

from __future__ import annotations

import re
from typing import Any

from .config import ColumnSpec, Table

_CAST = re.compile(r"::\s*(?:\"[^\"]+\"|[a-z_][a-z_0-9.]*)(?:\s+(?:varying|precision|without time zone|with time zone))?(?:\(\s*\d+(?:\s*,\s*\d+)?\s*\))?(?:\[\])?", re.I)
_NUMBER = re.compile(r"[+-]?\d+(\.\d+)?")


def _outside(text: str):
    """(index, depth) of characters outside string literals."""
    depth, inside = 0, False
    for i, c in enumerate(text):
        if c == "'":
            inside = not inside
        elif not inside:
            depth += (c in "([") - (c in ")]")
            yield i, depth


def strip_casts(text: str) -> str:
    """Without ``::type`` outside string literals."""
    pieces = re.split(r"('(?:[^']|'')*')", text)
    return "".join(p if i % 2 else _CAST.sub("", p) for i, p in enumerate(pieces))


def _bare(text: str) -> str:
    """Without casts, needless brackets around names, numbers and the whole."""
    text = strip_casts(text)
    text = re.sub(r"(?<![\w])\(\s*(\"?\w+\"?|-?\d+(?:\.\d+)?)\s*\)", r"\1", text)
    text = re.sub(r"(char_length|character_length|length)\s*\(?\s*\(*(\"?\w+\"?)\)*", r"\1(\2)", text, flags=re.I)
    return _stripped(text)


def _stripped(text: str) -> str:
    text = text.strip()
    while text.startswith("(") and text.endswith(")"):
        closes = next(i for i, d in _outside(text) if d == 0)
        if closes != len(text) - 1:
            break
        text = text[1:-1].strip()
    return text


def split_top(text: str, by: str) -> list[str]:
    """Parts between separators (a comma or AND) outside brackets and literals."""
    flat = dict(_outside(text))
    out, last = [], 0
    pattern = re.compile(r"\bAND\b", re.I) if by == "AND" else re.compile(re.escape(by))
    for m in pattern.finditer(text):
        if flat.get(m.start()) == 0:
            out.append(text[last : m.start()].strip())
            last = m.end()
    return [*out, text[last:].strip()]


def literal(text: str) -> Any:
    """A quoted string or a number; raises ValueError for anything else."""
    text = _stripped(text)
    if re.fullmatch(r"'(?:[^']|'')*'", text, re.S):
        return text[1:-1].replace("''", "'")
    if _NUMBER.fullmatch(text):
        return float(text) if "." in text else int(text)
    raise ValueError(text)


def _one(text: str, column: str) -> dict[str, Any] | None:
    name = rf'"?{re.escape(column)}"?'
    try:
        if m := re.fullmatch(rf"(?:char_length|character_length|length)\({name}\)\s*(<=|<)\s*(\d+)", text, re.I):
            return {"max_len": int(m[2]) - (m[1] == "<")}
        if m := re.fullmatch(rf"{name}\s+BETWEEN\s+(\S+)\s+AND\s+(\S+)", text, re.I):
            return {"min": literal(m[1]), "max": literal(m[2])}
        if m := re.fullmatch(rf"{name}\s+IN\s*\((.*)\)", text, re.I | re.S) or re.fullmatch(rf"{name}\s*=\s*ANY\s*\(+\s*ARRAY\s*\[(.*)\]\s*\)+", text, re.I | re.S):
            return {"values": [literal(x) for x in split_top(m[1], ",")]}
        if m := re.fullmatch(rf"{name}\s*(>=|<=|=|>|<)\s*(.+)", text, re.S):
            v = literal(m[2])
            if m[1] == "=":
                return {"values": [v]}
            if isinstance(v, str):
                return None
            step = isinstance(v, int)
            return {">=": {"min": v}, "<=": {"max": v}, ">": {"min": v + step}, "<": {"max": v - step}}[m[1]]
    except ValueError:
        pass
    return None


def parse_check(expression: str, column: str) -> dict[str, Any] | None:
    """The parameters that the expression sets for the column; None if a part isn't understood."""
    text = _bare(expression)
    if (whole := _one(text, column)) is not None:
        return whole
    parts = split_top(text, "AND")
    if len(parts) < 2:
        return None
    out: dict[str, Any] = {}
    for part in parts:
        found = parse_check(part, column)
        if found is None:
            return None
        tighten(out, found)
    return out


def tighten(params: dict[str, Any], more: dict[str, Any]) -> None:
    """Of two bounds the tighter one stays."""
    for k, v in more.items():
        old = params.get(k)
        number = isinstance(old, (int, float)) and not isinstance(old, bool) and not isinstance(v, str)
        if number and k == "min":
            params[k] = max(old, v)
        elif number and k in ("max", "max_len"):
            params[k] = min(old, v)
        else:
            params[k] = v


def apply_checks(table: Table) -> list[str]:
    """Push every CHECK on one live column down; returns the names of those that weren't understood."""
    left = []
    for check in table.checks:
        names = check.get("columns") or []
        spec: ColumnSpec | None = table.columns.get(names[0]) if len(names) == 1 else None
        found = parse_check(check["expression"], names[0]) if spec and not spec.removed else None
        if found is None:
            left.append(check["name"])
            continue
        tighten(spec.params, found)
        if "values" in found:
            spec.factory, spec.unresolved = "enum_value", False
    return left


def unsatisfiable(table: Table) -> bool:
    """Tables that independent columns can't fill: overlap rules, triggers, rules across columns."""
    across = any(len(c.get("columns") or []) > 1 for c in table.checks)
    return bool(table.excludes) or table.trigger_populated or across
