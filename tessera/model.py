"""The semantic catalog, and the fluent DSL that declares it.

    m = Model()
    m.source("orders").columns(order_id=pk("int64"), customer_id="int64", amount="decimal(10,2)")
    m.fact("sales").grain("orders.order_id").measure("revenue", sum_("amount")).measure("n", count())
    m.link("sales.customer_id", "customers.customer_id")

All maps keep the order of declaration.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from .errors import InvalidModel, UnknownEntity, UnknownMeasure
from .expr import Call, Col, Expr, Star, expression

CARDINALITIES = ("one_to_one", "one_to_many", "many_to_one", "many_to_many")
#: Rows of each grain in a year and in a quarter, finest first.
GRAINS = {"day": (365, 91), "week": (52, 13), "month": (12, 3), "quarter": (4, 1), "year": (1, 0)}


@dataclass
class ColumnDef:
    type: str
    nullable: bool = True
    primary_key: bool = False
    description: str = ""
    unique: bool = False


def column(kind: str | ColumnDef, **options) -> ColumnDef:
    made = kind if isinstance(kind, ColumnDef) else ColumnDef(kind)
    for name, value in options.items():
        setattr(made, name, value)
    return made


def pk(kind) -> ColumnDef:
    return column(kind, primary_key=True, nullable=False, unique=True)


def required(kind) -> ColumnDef:
    return column(kind, nullable=False)


def nullable(kind) -> ColumnDef:
    return column(kind, nullable=True)


def describe(kind, text: str) -> ColumnDef:
    return column(kind, description=text)


def decimal(precision: int, scale: int) -> str:
    return f"decimal({precision},{scale})"


numeric = decimal


def varchar(n: int) -> str:
    return f"varchar({n})"


def char(n: int) -> str:
    return f"char({n})"


def nvarchar(n: int) -> str:
    return f"nvarchar({n})"


@dataclass
class Measure:
    """An aggregate of a column, an expression or *, of the rows that meet the filter."""

    aggregation: str
    of: Expr = field(default_factory=Star)
    filter: Expr | None = None
    name: str = ""

    def where(self, condition: str | Expr) -> Measure:
        return Measure(self.aggregation, self.of, expression(condition), self.name)


def _measure(aggregation: str):
    def made(of: str | Expr = "*") -> Measure:
        return Measure(aggregation, Star() if of == "*" else expression(of) if isinstance(of, str) else of)

    return made


sum_, count, count_distinct, avg, min_, max_ = map(_measure, ("sum", "count", "count_distinct", "avg", "min", "max"))


def when(condition, measure: Measure) -> Measure:
    return measure.where(condition)


def filtered(measure: Measure, condition) -> Measure:
    return measure.where(condition)


@dataclass
class Dedup:
    partition_by: list[str]
    order_by: list[str]
    keep: str = "first"


@dataclass
class ChangeTracking:
    """append_only (timestamp), cdc (operation, timestamp) or full_snapshot."""

    kind: str
    timestamp: str | None = None
    operation: str | None = None


class Entity:
    """What sources, dimensions, facts and tables have in common: a name and described columns."""

    def __init__(self, name: str):
        self.name, self.column_defs, self.description_text, self.tag_list = name, {}, "", []

    def columns(self, *names: str, **defs):
        for n in names:
            self.column_defs[n] = None
        for n, d in defs.items():
            self.column_defs[n] = d if isinstance(d, (ColumnDef, Expr)) or d is None else column(d) if isinstance(self, Source) else expression(d)
        return self

    def description(self, text: str):
        self.description_text = text
        return self

    metadata = description

    def tags(self, *names: str):
        self.tag_list += names
        return self


class Source(Entity):
    def __init__(self, name: str):
        super().__init__(name)
        self.table, self.filter_expr, self.dedup_spec, self.tracking = name, None, None, None

    def from_(self, table: str):
        self.table = table
        return self

    def filter(self, condition):
        self.filter_expr = expression(condition)
        return self

    def dedup(self, partition_by: list[str], order_by: list[str], keep: str = "first"):
        self.dedup_spec = Dedup(partition_by, order_by, keep)
        return self

    def change_tracking(self, kind: str, timestamp: str | None = None, operation: str | None = None):
        self.tracking = ChangeTracking(kind, timestamp, operation)
        return self

    def timestamp_column(self, name: str):
        self.tracking = ChangeTracking(self.tracking.kind if self.tracking else "append_only", name, self.tracking and self.tracking.operation)
        return self

    @property
    def primary_key(self) -> list[str]:
        return [n for n, d in self.column_defs.items() if d is not None and d.primary_key]


class Dimension(Entity):
    """A projection of one source; columns are names, or name=SQL text for renamed and computed ones."""

    def __init__(self, name: str):
        super().__init__(name)
        self.source, self.key, self.scd_type, self.is_materialized, self.target_table = None, [], 1, False, None

    def target(self, table: str):
        self.target_table = table
        return self

    def from_(self, source: str):
        self.source = source
        return self

    def primary_key(self, *names: str):
        self.key = list(names)
        return self

    def scd(self, kind: int):
        if kind not in (0, 1, 2, 3, 6):
            raise InvalidModel(f"no such kind of slowly changing dimension: {kind}")
        self.scd_type = kind
        return self

    def materialized(self, yes: bool = True):
        self.is_materialized = yes
        return self


@dataclass
class Include:
    """Columns of a dimension that a fact carries: named ones, all, or all but some; under a prefix if given."""

    dimension: str
    columns: list[str] | None = None
    but: list[str] = field(default_factory=list)
    prefix: str = ""


class Fact(Entity):
    def __init__(self, name: str):
        super().__init__(name)
        self.grain_columns: list[Col] = []
        self.base, self.includes, self.measures, self.windows = None, [], {}, {}
        self.is_materialized, self.strategy, self.target_table_name, self.dates = False, {}, None, {}

    def target(self, table: str):
        self.target_table_name = table
        return self

    target_table = target

    def grain(self, *columns: str):
        self.grain_columns += [expression(c) for c in columns]
        return self

    def from_(self, source: str):
        self.base = source
        return self

    from_entity = source = from_

    def include(self, dimension: str, columns: list[str] | None = None, but: list[str] | None = None, prefix: str = ""):
        self.includes.append(Include(dimension, columns, but or [], prefix))
        return self

    def column(self, name: str, of: str | Expr):
        self.column_defs[name] = expression(of)
        return self

    def window_column(self, name: str, of: str | Expr):
        self.windows[name] = expression(of)
        return self

    def measure(self, name: str, measure: Measure):
        self.measures[name] = Measure(measure.aggregation, measure.of, measure.filter, name)
        return self

    def materialized(self, yes: bool = True):
        self.is_materialized = yes
        return self

    def incremental(self, unique_key: list[str], incremental_key: str, lookback=0):
        self.strategy = {"kind": "incremental", "unique_key": unique_key, "incremental_key": incremental_key, "lookback": lookback}
        return self

    def table_type(self, kind: str):
        self.strategy["kind"] = kind
        return self

    def unique_key(self, *names: str):
        self.strategy["unique_key"] = list(names)
        return self

    def incremental_key(self, name: str):
        self.strategy["incremental_key"] = name
        return self

    def date_config(self, **grains: str):
        """Columns that hold each grain of time: year="date.year", month="date.month", ..."""
        self.dates.update(grains)
        return self

    @property
    def origin(self) -> str | None:
        return self.base or next((c.entity for c in self.grain_columns), None)


class Table(Entity):
    """A node of the build: from one source or a union, joins, filter, columns, window columns, group by."""

    def __init__(self, name: str):
        super().__init__(name)
        self.sources, self.union_all, self.joins, self.filter_expr, self.dedup_spec = [], False, [], None, None
        self.windows, self.groups, self.strategy, self.key = {}, [], {}, []

    def from_(self, *sources: str, all: bool = False):
        self.sources, self.union_all = list(sources), all
        return self

    def join(self, source: str, on: str | Expr, how: str = "inner"):
        self.joins.append((source, expression(on), how))
        return self

    def filter(self, condition):
        self.filter_expr = expression(condition)
        return self

    def dedup(self, partition_by: list[str], order_by: list[str], keep: str = "first"):
        self.dedup_spec = Dedup(partition_by, order_by, keep)
        return self

    def window_columns(self, **defs):
        self.windows.update({n: expression(d) for n, d in defs.items()})
        return self

    def group_by(self, *columns: str):
        self.groups += [expression(c) for c in columns]
        return self

    def primary_key(self, *names: str):
        self.key = list(names)
        return self


@dataclass(frozen=True)
class Relationship:
    from_entity: str
    from_column: str
    to_entity: str
    to_column: str
    cardinality: str = "many_to_one"
    role: str | None = None
    origin: str = "explicit"
    confidence: float = 1.0


class Model:
    def __init__(self):
        self.sources: dict[str, Source] = {}
        self.dimensions: dict[str, Dimension] = {}
        self.facts: dict[str, Fact] = {}
        self.tables: dict[str, Table] = {}
        self.relationships: list[Relationship] = []
        self.queries: dict[str, object] = {}
        self.reports: dict[str, object] = {}
        self.pivots: dict[str, object] = {}

    def _declare(self, kind: dict, made):
        if made.name in kind:
            raise InvalidModel(f"declared twice: {made.name}")
        kind[made.name] = made
        return made

    def use(self, other: Model) -> Model:
        """All that another model declares; a name that both declare is an error, a link that both have is one."""
        for kind in ("sources", "dimensions", "facts", "tables", "queries", "reports", "pivots"):
            own, theirs = getattr(self, kind), getattr(other, kind)
            if both := own.keys() & theirs.keys():
                raise InvalidModel(f"declared twice: {', '.join(sorted(both))}")
            own.update(theirs)
        self.relationships += [r for r in other.relationships if r not in self.relationships]
        return self

    def source(self, name: str) -> Source:
        return self._declare(self.sources, Source(name))

    def dimension(self, name: str) -> Dimension:
        return self._declare(self.dimensions, Dimension(name))

    def fact(self, name: str) -> Fact:
        return self._declare(self.facts, Fact(name))

    def table(self, name: str) -> Table:
        return self._declare(self.tables, Table(name))

    intermediate = table

    def query(self, name: str, query) -> Model:
        self.queries[name] = query
        return self

    def report(self, name: str, report) -> Model:
        self.reports[name] = report
        return self

    def pivot_report(self, name: str, pivot) -> Model:
        self.pivots[name] = pivot
        return self

    def link(self, start: str, end: str, cardinality: str = "many_to_one", role: str | None = None) -> Model:
        if cardinality not in CARDINALITIES:
            raise InvalidModel(f"no such cardinality: {cardinality}")
        a, b = expression(start), expression(end)
        if not (isinstance(a, Col) and a.entity and isinstance(b, Col) and b.entity):
            raise InvalidModel(f"a relationship links entity.column to entity.column: {start}, {end}")
        self.relationships.append(Relationship(a.entity, a.name, b.entity, b.name, cardinality, role))
        return self

    def link_as(self, start: str, end: str, role: str, cardinality: str = "many_to_one") -> Model:
        return self.link(start, end, cardinality, role)

    def many_to_one(self, a, b):
        return self.link(a, b, "many_to_one")

    def one_to_many(self, a, b):
        return self.link(a, b, "one_to_many")

    def one_to_one(self, a, b):
        return self.link(a, b, "one_to_one")

    def many_to_many(self, a, b):
        return self.link(a, b, "many_to_many")

    def entity(self, name: str):
        for kind in (self.facts, self.dimensions, self.tables, self.sources):
            if name in kind:
                return kind[name]
        raise UnknownEntity(f"no such entity: {name}")

    def measure(self, name: str, anchor: str | None = None) -> tuple[str, Measure]:
        """(fact, measure) of "fact.measure", or of a bare name that one fact has; the anchor's own comes first."""
        fact, _, short = name.rpartition(".")
        if fact:
            if fact not in self.facts:
                raise UnknownEntity(f"no such fact: {fact}")
            if short not in self.facts[fact].measures:
                raise UnknownMeasure(f"{fact} has no measure {short}")
            return fact, self.facts[fact].measures[short]
        if anchor and short in self.facts[anchor].measures:
            return anchor, self.facts[anchor].measures[short]
        owners = [f for f in self.facts.values() if short in f.measures]
        if not owners:
            raise UnknownMeasure(f"no such measure: {name}")
        if len(owners) > 1:
            from .errors import AmbiguousField

            raise AmbiguousField(f"{name} is a measure of {', '.join(o.name for o in owners)}")
        return owners[0].name, owners[0].measures[short]


def call(name: str, *args) -> Call:
    from .expr import wrap

    return Call(name, tuple(wrap(a) for a in args))
