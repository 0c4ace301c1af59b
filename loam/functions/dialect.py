"""Expressions as SQL text for Spark and for DuckDB.

A generated cell is a pure function of (seed, table, column, row, attempt, draw): a counter hash of
52 bits from MD5, exact in a double and equal in both engines. Generators are written once against
``Dialect``; Spark evaluates the text by ``F.expr`` inside whole-stage codegen.
"""

from __future__ import annotations

from dataclasses import dataclass, field

TWO_52 = 1 << 52


def quoted(text: str) -> str:
    return "'" + str(text).replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class Dialect:
    """The Spark dialect; ``Duck`` below overrides what differs."""

    seed: int = 42
    table: str = "t"
    column: str = "c"
    row: str = "row"
    attempt: str = "0"
    hash: str = "md5"  # or "xx": faster, Spark only
    path: tuple = field(default_factory=tuple)  # of nested JSON fields

    def at(self, **changes) -> Dialect:
        return type(self)(**{**self.__dict__, **changes})

    # --- literals and casts
    def s(self, text: str) -> str:
        return quoted(text)

    def text(self, x: str) -> str:
        return f"CAST({x} AS STRING)"

    def double(self, x: str) -> str:
        return f"CAST({x} AS DOUBLE)"

    def int_(self, x: str) -> str:
        return f"CAST({x} AS BIGINT)"

    def null(self, kind: str = "STRING") -> str:
        return f"CAST(NULL AS {kind})"

    # --- the counter hash
    def key(self, draw: str | int, prefix: str = "") -> str:
        name = ".".join((self.column, *self.path))
        head = self.s(f"{prefix}{self.seed}|{self.table}|{name}|")
        return f"concat({head}, {self.text(self.row)}, '|', {self.text(self.attempt)}, '|', {self.text(draw)})"

    def h(self, draw: str | int = 0) -> str:
        if self.hash == "xx":
            return f"shiftrightunsigned(xxhash64({self.key(draw)}), 12)"
        return f"CAST(conv(substring(md5({self.key(draw)}), 1, 13), 16, 10) AS BIGINT)"

    def hex(self, draw: str | int = 0) -> str:
        """32 hex digits."""
        return f"md5({self.key(draw, 'x')})"

    def unit(self, draw: str | int = 0) -> str:
        return f"({self.double(self.h(draw))} / {self.double(TWO_52)})"

    def between(self, lo: int, hi: int, draw: str | int = 0) -> str:
        """Uniform integer, both ends included; wide spans take two digests."""
        span = hi - lo + 1
        if span <= 0:
            return self.int_(lo)
        if span <= TWO_52:
            return f"({lo} + {self.h(draw)} % {span})"
        return self.int_(f"({self.wide(lo)} + ({self.wide(self.h(draw))} * {self.wide(TWO_52)} + {self.wide(self.h(f'({draw} + 1000)'))}) % {self.wide(span)})")

    def wide(self, x) -> str:
        return f"CAST({x} AS DECIMAL(38,0))"

    def scaled(self, lo: float, hi: float, places: int, draw: str | int = 0) -> str:
        """Uniform double rounded half up to so many places."""
        p = self.double(10**places)
        return f"(floor(({self.double(lo)} + {self.unit(draw)} * {self.double(hi - lo)}) * {p} + {self.double('0.5')}) / {p})"

    # --- composition
    def cat(self, *parts: str) -> str:
        return f"concat({', '.join(parts)})"

    def pick(self, pool, draw: str | int = 0, text: bool = True) -> str:
        items = ", ".join(self.s(x) if text else str(x) for x in pool)
        return f"element_at(array({items}), CAST(1 + {self.h(draw)} % {len(pool)} AS INT))"

    def pad(self, x: str, n: int) -> str:
        return f"lpad({self.text(x)}, {n}, '0')"

    def fmt(self, pattern: str, *args: str) -> str:
        return f"format_string({self.s(pattern)}, {', '.join(args)})"

    def sub(self, x: str, start: int, n: int) -> str:
        return f"substring({x}, {start}, {n})"

    def array(self, n: int, item, kind: str) -> str:
        """item: from the name of the index to an expression."""
        if n <= 0:
            return f"CAST(array() AS ARRAY<{kind}>)"
        return f"transform(sequence(0, {n - 1}), i -> {item('i')})"

    def join(self, array: str, by: str) -> str:
        return f"array_join({array}, {self.s(by)})"

    def timestamp(self, micros: str) -> str:
        return f"timestamp_micros({micros})"

    def date(self, days: str) -> str:
        return f"date_add(DATE'1970-01-01', CAST({days} AS INT))"

    def time_text(self, micros: str, iso: bool) -> str:
        return f"""date_format({self.timestamp(micros)}, "{"yyyy-MM-dd'T'HH:mm:ss" if iso else "yyyy-MM-dd HH:mm:ss"}")"""

    def bytes_(self, hexed: str) -> str:
        return f"unhex({hexed})"


class Duck(Dialect):
    def s(self, text: str) -> str:
        return "'" + str(text).replace("'", "''") + "'"

    def h(self, draw: str | int = 0) -> str:
        return f"(('0x' || substr(md5({self.key(draw)}), 1, 13))::BIGINT)"

    def pick(self, pool, draw: str | int = 0, text: bool = True) -> str:
        items = ", ".join(self.s(x) if text else f"{x}::INTEGER" for x in pool)
        return f"list_extract([{items}], 1 + {self.h(draw)} % {len(pool)})"

    def fmt(self, pattern: str, *args: str) -> str:
        return f"printf({self.s(pattern)}, {', '.join(args)})"

    def array(self, n: int, item, kind: str) -> str:
        kind = {"STRING": "VARCHAR"}.get(kind, kind)
        return f"list_transform(range({n}), lambda i: {item('i')})::{kind}[]" if n > 0 else f"[]::{kind}[]"

    def join(self, array: str, by: str) -> str:
        return f"array_to_string({array}, {self.s(by)})"

    def timestamp(self, micros: str) -> str:
        return f"make_timestamp({micros})"

    def date(self, days: str) -> str:
        return f"(DATE '1970-01-01' + CAST({days} AS INTEGER))"

    def time_text(self, micros: str, iso: bool) -> str:
        return f"strftime({self.timestamp(micros)}, '{'%Y-%m-%dT%H:%M:%S' if iso else '%Y-%m-%d %H:%M:%S'}')"
