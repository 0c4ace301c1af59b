"""The foreign-key graph and the plan: insert order, cycles, row counts, emptied tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from .config import Config, qualified, split_target


@dataclass(frozen=True, order=True)
class Edge:
    """A child column's reference to a parent table."""

    child: str
    column: str
    parent: str
    target: str = ""
    nullable: bool = False
    deferrable: bool = False


@dataclass
class Plan:
    order: list[str]
    cycles: list[list[str]]
    counts: dict[str, int]
    emptied: dict[str, list[tuple[str, str]]] = field(default_factory=dict)  # child -> (parent, column)
    edges: list[Edge] = field(default_factory=list)

    def in_cycle(self, a: str, b: str) -> bool:
        return any(a in c and b in c for c in self.cycles)


def live(cfg: Config) -> list[str]:
    return sorted(k for k, t in cfg.tables.items() if not t.removed)


def edges_of(cfg: Config) -> list[Edge]:
    out = []
    for key in live(cfg):
        t = cfg.tables[key]
        for name, c in sorted(t.columns.items()):
            target = split_target(c.params.get("target", "")) if c.factory == "fkref" and not c.removed else None
            if target:
                out.append(Edge(key, name, target[0], target[1], c.nullable, bool(c.params.get("deferrable"))))
        for p in t.polymorphs:
            for cand in p.get("candidates") or []:
                out.append(Edge(key, p["id_column"], qualified(cand["table"]), cand.get("pk_column") or "", True, False))
    return out


def components(nodes: list[str], edges: list[Edge]) -> list[list[str]]:
    """Strongly connected components, parents before children (iterative, so depth is no limit)."""
    parents: dict[str, list[str]] = {n: [] for n in nodes}
    children: dict[str, list[str]] = {n: [] for n in nodes}
    for e in edges:
        if e.child in parents and e.parent in parents:
            parents[e.child].append(e.parent)
            children[e.parent].append(e.child)
    finished: list[str] = []
    seen: set[str] = set()
    for n in nodes:
        todo = [(n, iter(parents[n]))] if n not in seen else []
        seen.add(n)
        while todo:
            at, rest = todo[-1]
            nxt = next((p for p in rest if p not in seen), None)
            if nxt is None:
                finished.append(at)
                todo.pop()
            else:
                seen.add(nxt)
                todo.append((nxt, iter(parents[nxt])))
    # In reverse order of finishing, whatever reaches a node along children lies in its component.
    group: dict[str, int] = {}
    out: list[list[str]] = []
    for n in reversed(finished):
        if n in group:
            continue
        members, todo2 = [], [n]
        group[n] = len(out)
        while todo2:
            at = todo2.pop()
            members.append(at)
            for c in children[at]:
                if c not in group:
                    group[c] = len(out)
                    todo2.append(c)
        out.append(sorted(members))
    place = {n: i for i, n in enumerate(finished)}
    return sorted(out, key=lambda m: min(place[n] for n in m))


def within_cycle(members: list[str], edges: list[Edge]) -> list[str]:
    """Parents first along NOT NULL edges, ties by name; if those form a cycle, by name."""
    wait = {n: {e.parent for e in edges if e.child == n and e.parent in members and e.parent != n and not e.nullable} for n in members}
    out: list[str] = []
    while len(out) < len(members):
        ready = sorted(n for n in members if n not in out and wait[n] <= set(out))
        if not ready:
            return sorted(members)
        out.append(ready[0])
    return out


def row_counts(cfg: Config, order: list[str]) -> dict[str, int]:
    """Stated counts; else for each parent its count times the middle of the range, at least 1 (0..0: none)."""
    counts = {k: cfg.tables[k].row_count for k in order if cfg.tables[k].row_count is not None}
    for _ in range(2):  # the second pass is for references inside a cycle
        for key in order:
            parts = [
                0 if lo == hi == 0 else counts[qualified(p)] * max(1, (lo + hi) // 2)
                for p, (lo, hi) in cfg.tables[key].row_count_per.items()
                if qualified(p) in counts
            ]
            if parts:
                counts[key] = sum(parts)
    return counts


def cascade(counts: dict[str, int], edges: list[Edge]) -> dict[str, list[tuple[str, str]]]:
    """Empties, to a fixed point, every table with a NOT NULL reference to an empty one; gives the causes."""
    causes: dict[str, list[tuple[str, str]]] = {}
    changed = True
    while changed:
        changed = False
        for e in edges:
            if not e.nullable and counts.get(e.parent) == 0 and counts.get(e.child, 0) > 0:
                counts[e.child] = 0
                causes.setdefault(e.child, []).append((e.parent, e.column))
                changed = True
    return causes


def plan(cfg: Config) -> Plan:
    nodes, edges = live(cfg), edges_of(cfg)
    groups = components(nodes, edges)
    order = [n for g in groups for n in (within_cycle(g, edges) if len(g) > 1 else g)]
    counts = row_counts(cfg, order)
    causes = cascade(counts, edges)
    return Plan(order, [within_cycle(g, edges) for g in groups if len(g) > 1], counts, causes, edges)


def non_deferrable(p: Plan) -> list[Edge]:
    """References between tables of one cycle that the database checks at once."""
    return [e for e in p.edges if e.child != e.parent and not e.deferrable and not e.nullable and p.in_cycle(e.child, e.parent)]
