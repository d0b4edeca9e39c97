"""Column lineage: a graph of columns, and what each is made of."""

from __future__ import annotations

import json
from collections import deque
from dataclasses import asdict, dataclass

from .errors import ColumnLineageCycle
from .expr import Col, Expr, expression
from .model import Model

EDGE_KINDS = ("pass_through", "rename", "transform", "aggregate", "filter", "join", "group_by", "window")


@dataclass(frozen=True)
class ColumnEdge:
    start: tuple[str, str]
    end: tuple[str, str]
    kind: str


def _measures_in(part) -> list[str]:
    """Names of the measures in a selected expression."""
    from .plans.query import MeasureRef

    if isinstance(part, str | MeasureRef):
        return [part if isinstance(part, str) else part.name]
    return [n for x in vars(part).values() for y in (x if isinstance(x, tuple | list) else [x]) if isinstance(y, Expr) for n in _measures_in(y)]


def references(e: Expr) -> list[tuple[str | None, str]]:
    return list(dict.fromkeys((c.entity, c.name) for c in e.columns()))


class LineageGraph:
    """Edges of all declared tables, facts, dimensions and queries; columns are (entity, column)."""

    def __init__(self, model: Model):
        self.model, self.edges = model, []
        self._known, self._after, self._before = set(), {}, {}
        for d in model.dimensions.values():
            for name, e in d.column_defs.items():
                self._made(d.name, name, Col(name) if e is None else e, [d.source or d.name])
        for t in model.tables.values():
            inputs = [*t.sources, *(s for s, _, _ in t.joins)]
            for name, e in t.column_defs.items():
                self._made(t.name, name, Col(name) if e is None else e, inputs)
            for name, e in t.windows.items():
                self._made(t.name, name, e, [t.name], "window")
            for name in t.column_defs:
                for g in t.groups:
                    self._from(t.name, name, g, inputs, "group_by")
                if t.filter_expr is not None:
                    self._from(t.name, name, t.filter_expr, inputs, "filter")
                for _, on, _ in t.joins:
                    self._from(t.name, name, on, inputs, "join")
        for f in model.facts.values():
            inputs = [f.origin] if f.origin else []
            for g in f.grain_columns:
                self._made(f.name, g.name, g, inputs)
            for i in f.includes:
                for c in i.columns or (model.dimensions[i.dimension].column_defs if i.dimension in model.dimensions else ()):
                    if c not in i.but:
                        self._add((i.dimension, c), (f.name, i.prefix + c), "rename" if i.prefix else "pass_through")
            for name, e in f.column_defs.items():
                if e is not None:
                    self._made(f.name, name, e, inputs)
            for name, e in f.windows.items():
                self._made(f.name, name, e, [f.name], "window")
            for m in f.measures.values():
                self._from(f.name, m.name, m.of, [f.origin or f.name], "aggregate")
                if m.filter is not None:
                    self._from(f.name, m.name, m.filter, [f.origin or f.name], "filter")

        for name, query in model.queries.items():
            self._asked(name, [d[0] if isinstance(d, tuple) else d for d in query.dims], query.select, query.where)
        for name, report in model.reports.items():
            self._asked(name, report.group_by, report.measures, report.filters)
        for name, pivot in model.pivots.items():
            self._asked(name, [*pivot.rows, pivot.column], pivot.values, pivot.filters)

    def _asked(self, name: str, keys: list, measures: list, filters: list) -> None:
        """Edges of a query, report or pivot: its keys group each measure, its filters choose its rows."""
        made = []
        for part in measures:
            for p in _measures_in(part):
                fact, _ = self.model.measure(p)
                short = p.rpartition(".")[2]
                made.append(short)
                self._add((fact, short), (name, short), "pass_through")
        for k in keys:
            e = expression(k)
            if isinstance(e, Col) and e.entity:
                self._add((e.entity, e.name), (name, e.name), "pass_through")
            for short in made:
                self._from(name, short, e, [], "group_by")
        for f in filters:
            for short in made:
                self._from(name, short, expression(f), [], "filter")

    def _add(self, start, end, kind: str) -> None:
        if start != end and (edge := ColumnEdge(start, end, kind)) not in self._known:
            self._known.add(edge)
            self.edges.append(edge)
            self._after.setdefault(start, []).append(end)
            self._before.setdefault(end, []).append(start)

    def _from(self, entity: str, name: str, e: Expr, inputs: list[str], kind: str) -> None:
        for owner, column in references(e):
            for source in [owner] if owner else inputs[:1]:
                self._add((source, column), (entity, name), kind)

    def _made(self, entity: str, name: str, e: Expr, inputs: list[str], kind: str | None = None) -> None:
        from .operators.build import is_aggregate

        if kind is None:
            kind = ("pass_through" if e.name == name else "rename") if isinstance(e, Col) else "aggregate" if is_aggregate(e) else "transform"
        self._from(entity, name, e, inputs, kind)

    def _walk(self, at, forward: bool) -> list[tuple[str, str]]:
        out, queue, near = {}, deque([at]), self._after if forward else self._before
        while queue:
            for b in near.get(queue.popleft(), ()):
                if b not in out:
                    out[b] = None
                    queue.append(b)
        return list(out)

    def upstream(self, entity: str, column: str) -> list[tuple[str, str]]:
        return self._walk((entity, column), False)

    def downstream(self, entity: str, column: str) -> list[tuple[str, str]]:
        return self._walk((entity, column), True)

    def impact(self, entity: str, column: str) -> list[str]:
        """Entities with a column that depends on this one."""
        return list(dict.fromkeys(e for e, _ in self.downstream(entity, column)))

    def required_sources(self, entity: str) -> list[tuple[str, str]]:
        ends = {e.end for e in self.edges if e.end[0] == entity}
        return sorted({u for end in ends for u in self.upstream(*end) if u[0] in self.model.sources})

    def check(self) -> None:
        """Takes away, again and again, columns that nothing left leads to; what stays is on a cycle or behind one."""
        left = {c: len(set(before)) for c, before in self._before.items()}
        ready = deque(c for c in self._after if c not in left)
        while ready:
            for b in set(self._after.get(ready.popleft(), ())):
                left[b] -= 1
                if not left[b]:
                    del left[b]
                    ready.append(b)
        if found := next((c for c in left if c in self._walk(c, True)), None):
            raise ColumnLineageCycle(f"{found[0]}.{found[1]} depends on itself")

    def to_json(self) -> str:
        return json.dumps([asdict(e) for e in self.edges])

    def rows(self) -> list[tuple[str, str, str, str, str]]:
        return [(*e.start, *e.end, e.kind) for e in self.edges]
