"""The join graph: entities and roles as nodes, relationships as edges that can be walked both ways. Metadata only."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from .errors import AmbiguousDimensionRole, CyclicDependency, NoPath, UnknownEntity, UnsafeJoinPath
from .model import Model

_REVERSED = {"one_to_many": "many_to_one", "many_to_one": "one_to_many"}


@dataclass(frozen=True)
class Edge:
    start: str
    start_column: str
    end: str
    end_column: str
    cardinality: str

    @property
    def fans_out(self) -> bool:
        return self.cardinality in ("one_to_many", "many_to_many")

    def reversed(self) -> Edge:
        return Edge(self.end, self.end_column, self.start, self.start_column, _REVERSED.get(self.cardinality, self.cardinality))


class JoinGraph:
    """Roles are nodes of their own: a role stands for a dimension that is joined by one of several relationships. What
    the dimension itself leads to isn't reachable through a role unless a relationship says so."""

    def __init__(self, model: Model):
        self.model = model
        self.edges: dict[str, list[Edge]] = {n: [] for kind in (model.sources, model.dimensions, model.tables, model.facts) for n in kind}
        self.role_of: dict[str, str] = {}
        self.roles: dict[str, list[str]] = {}
        for r in model.relationships:
            for name in (r.from_entity, r.to_entity):
                if name not in self.edges and name not in self.role_of:
                    raise UnknownEntity(f"a relationship names an unknown entity: {name}")
            end = r.to_entity
            if r.role:
                if self.role_of.setdefault(r.role, r.to_entity) != r.to_entity or r.role in model.sources:
                    raise AmbiguousDimensionRole(f"role {r.role} stands for several entities")
                self.edges.setdefault(r.role, [])
                self.roles.setdefault(r.to_entity, []).append(r.role)
                end = r.role
            self._add(Edge(r.from_entity, r.from_column, end, r.to_column, r.cardinality))
        for fact in model.facts.values():
            for include in fact.includes:
                if not any(e.end == include.dimension for e in self.edges[fact.name]) and fact.origin:
                    for e in list(self.edges.get(fact.origin, ())):
                        if e.end == include.dimension:
                            self._add(Edge(fact.name, e.start_column, e.end, e.end_column, e.cardinality))
            if fact.origin and fact.origin in self.edges:  # a fact has the relationships of what it is built from
                for e in list(self.edges[fact.origin]):
                    if e.end != fact.name and e.end not in model.facts and not any((x.end, x.start_column) == (e.end, e.start_column) for x in self.edges[fact.name]):
                        self._add(Edge(fact.name, e.start_column, e.end, e.end_column, e.cardinality))

    def _add(self, edge: Edge) -> None:
        self.edges[edge.start].append(edge)
        self.edges[edge.end].append(edge.reversed())

    def entity_of(self, node: str) -> str:
        return self.role_of.get(node, node)

    def path(self, start: str, end: str) -> list[Edge]:
        """The shortest path, without fan-out where there is one so short or longer; of equals, the first declared."""
        for name in (start, end):
            if name not in self.edges:
                raise UnknownEntity(f"no such entity: {name}")
        found = self._search(start, end, safe=True) or self._search(start, end, safe=False)
        if found is None:
            if roles := [r for r in self.roles.get(end, ()) if self._search(start, r, safe=True) is not None]:
                raise AmbiguousDimensionRole(f"{end} is reached from {start} in the roles {', '.join(roles)}: name one")
            raise NoPath(f"no path from {start} to {end}")
        return found

    def _search(self, start: str, end: str, safe: bool) -> list[Edge] | None:
        came: dict[str, Edge | None] = {start: None}
        queue = deque([start])
        while queue:
            at = queue.popleft()
            if at == end:
                out = []
                while came[at] is not None:
                    out.append(came[at])
                    at = came[at].start
                return out[::-1]
            for e in self.edges[at]:
                if e.end not in came and not (safe and e.fans_out) and not (e.end in self.model.facts and e.end != end):
                    came[e.end] = e
                    queue.append(e.end)
        return None

    def all_paths(self, start: str, end: str, depth: int = 6) -> list[list[Edge]]:
        out: list[list[Edge]] = []

        def walk(at: str, path: list[Edge], seen: set[str]) -> None:
            if at == end:
                out.append(list(path))
                return
            if len(path) < depth:
                for e in self.edges[at]:
                    if e.end not in seen:
                        walk(e.end, [*path, e], seen | {e.end})

        walk(start, [], {start})
        return out

    def is_ambiguous(self, start: str, end: str) -> bool:
        shortest = len(self.path(start, end))
        return sum(len(p) == shortest for p in self.all_paths(start, end, shortest)) > 1

    def reachable(self, start: str) -> list[str]:
        seen, queue = [start], deque([start])
        while queue:
            for e in self.edges[queue.popleft()]:
                if e.end not in seen:
                    seen.append(e.end)
                    queue.append(e.end)
        return seen[1:]

    def join_tree(self, start: str, ends: list[str]) -> list[Edge]:
        """The edges to all ends, each once, in an order in which they can be joined; fan-out is an error."""
        out: list[Edge] = []
        for end in ends:
            for e in self.path(start, end):
                if e.fans_out:
                    raise UnsafeJoinPath(f"{start} to {end}: {e.start} -> {e.end} is {e.cardinality} and would multiply rows")
                if e not in out:
                    out.append(e)
        return out

    def is_safe(self, start: str, end: str) -> bool:
        try:
            return not any(e.fans_out for e in self.path(start, end))
        except (NoPath, AmbiguousDimensionRole):
            return False

    def grain_of(self, entities: list[str]) -> str | None:
        """The entity from which all others are reached without fan-out."""
        return next((a for a in entities if all(a == b or self.is_safe(a, b) for b in entities)), None)

    def fan_out_warnings(self, start: str) -> list[Edge]:
        return [e for n in [start, *self.reachable(start)] for e in self.edges[n] if e.fans_out]


def dependencies(model: Model) -> dict[str, list[str]]:
    """What each declared node is built from."""
    out: dict[str, list[str]] = {n: [] for n in model.sources}
    for t in model.tables.values():
        out[t.name] = [*t.sources, *(s for s, _, _ in t.joins)]
    for d in model.dimensions.values():
        out[d.name] = [d.source] if d.source and d.source != d.name else []
    for f in model.facts.values():
        needs = [f.origin, *(i.dimension for i in f.includes)]
        out[f.name] = [n for n in dict.fromkeys(needs) if n and n != f.name]
    return out


def build_order(model: Model) -> list[str]:
    """Nodes after all that they need."""
    needs, done, path = dependencies(model), [], []

    def visit(name: str) -> None:
        if name in path:
            raise CyclicDependency(" -> ".join([*path[path.index(name) :], name]))
        if name not in done:
            path.append(name)
            for n in needs.get(name, ()):
                visit(n)
            path.pop()
            done.append(name)

    for name in needs:
        visit(name)
    return done


def required_sources(model: Model, name: str) -> list[str]:
    needs, out = dependencies(model), []
    queue = [name]
    while queue:
        at = queue.pop()
        for n in needs.get(at, ()):
            if n not in out:
                out.append(n)
                queue.append(n)
    return [n for n in out if n in model.sources]


def affected(model: Model, name: str) -> list[str]:
    """Nodes that are built, directly or not, from this one, in build order."""
    needs, hit = dependencies(model), {name}
    order = build_order(model)
    for n in order:
        if hit & set(needs.get(n, ())):
            hit.add(n)
    return [n for n in order if n in hit and n != name]
