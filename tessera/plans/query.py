"""Semantic queries: what is asked, and how it becomes a DataFrame.

Resolution and validation are plain Python and raise before any Spark job. The plan of one fact is scan, joins, filter,
aggregate; then windows over the aggregate for time calculations; then derived values, having, order and limit. Several
facts are aggregated each to the attributes asked for, and their rows meet in one grouped union, which needs one shuffle
of aggregates however many facts there are, and treats nulls as equal.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import errors
from ..expr import Binary, Call, Cast, Col, Expr, Interval, Lit, Star, Unary, compile, compile_call, expression, quotient, sorted_by
from ..graph import JoinGraph
from ..model import GRAINS, Dimension, Fact, Measure, Model, Source, Table
from ..operators.build import dimension_frame, fact_frame, source_frame, table_frame
from ..types import joinable


@dataclass(frozen=True)
class MeasureRef(Expr):
    """A measure by name; a filter given here replaces the one of its definition."""

    name: str
    condition: Expr | None = None

    def where(self, condition: str | Expr) -> MeasureRef:
        return MeasureRef(self.name, expression(condition))

    def as_(self, alias: str) -> Named:
        return Named(self, alias)


@dataclass(frozen=True)
class Inline(Expr):
    """An aggregate of a column, not declared as a measure."""

    function: str
    of: Expr
    condition: Expr | None = None

    def as_(self, alias: str) -> Named:
        return Named(self, alias)


@dataclass(frozen=True)
class TimeCalc(Expr):
    kind: str
    of: Expr
    n: int = 1


@dataclass(frozen=True)
class Named(Expr):
    of: Expr
    alias: str


def m(name: str) -> MeasureRef:
    return MeasureRef(name)


def agg(function: str, column: str, where: str | Expr | None = None) -> Inline:
    return Inline(function, Star() if column == "*" else expression(column), expression(where) if where is not None else None)


def derived(alias: str, of: Expr) -> Named:
    return Named(of, alias)


def delta(a: Expr, b: Expr) -> Expr:
    return a - b


def growth(a: Expr, b: Expr) -> Expr:
    return (a - b) / b * Lit(100)


def ytd(of: Expr) -> TimeCalc:
    return TimeCalc("ytd", of)


def qtd(of: Expr) -> TimeCalc:
    return TimeCalc("qtd", of)


def mtd(of: Expr) -> TimeCalc:
    return TimeCalc("mtd", of)


def prior_period(of: Expr, n: int = 1) -> TimeCalc:
    return TimeCalc("prior_period", of, n)


def prior_quarter(of: Expr) -> TimeCalc:
    return TimeCalc("prior_quarter", of)


def prior_year(of: Expr) -> TimeCalc:
    return TimeCalc("prior_year", of)


def rolling_sum(of: Expr, n: int) -> TimeCalc:
    return TimeCalc("rolling_sum", of, n)


def rolling_avg(of: Expr, n: int) -> TimeCalc:
    return TimeCalc("rolling_avg", of, n)


@dataclass
class Query:
    """dims: "entity.column" or (that or an expression, alias). select: measures and what derives from them. where: SQL text
    or expressions, and-ed. order_by: output names, with " desc" behind. time: the grain of outputs that are time columns;
    by default outputs named like a grain."""

    dims: list = field(default_factory=list)
    select: list = field(default_factory=list)
    where: list = field(default_factory=list)
    having: list = field(default_factory=list)
    order_by: list[str] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0
    from_: str | None = None
    time: dict[str, str] = field(default_factory=dict)


def leaves(e: Expr):
    """Measures and inline aggregates of a selection, in order."""
    if isinstance(e, (MeasureRef, Inline)):
        yield e
    else:
        for child in e.children():
            yield from leaves(child)


def calcs(e: Expr):
    for child in e.children():
        yield from calcs(child)
    if isinstance(e, TimeCalc):
        yield e


def output_name(e: Expr) -> str:
    match e:
        case Named(_, alias):
            return alias
        case MeasureRef(name, _):
            return name.rpartition(".")[2]
        case Inline(function, of, _):
            return f"{function}_{of.name if isinstance(of, Col) else 'all'}"
        case TimeCalc(kind, of, n):
            return f"{output_name(of)}_{kind}" + (f"_{n}" if kind.startswith("rolling") or n > 1 else "")
    raise errors.InvalidReference("a derived value needs a name: derived(name, ...)")


class Planner:
    """Compiles queries of a model. read(table) gives the DataFrame of a physical table."""

    def __init__(self, model: Model, read: Callable[[str], DataFrame]):
        self.model, self.read, self.graph = model, read, JoinGraph(model)
        self._frames: dict[str, DataFrame] = {}

    # --- frames

    def frame(self, name: str) -> DataFrame:
        """The rows of an entity (or of a physical table that no entity has the name of)."""
        if name not in self._frames:
            try:
                entity = self.model.entity(name)
            except errors.UnknownEntity:
                return self.read(name)
            inner = lambda n: self.frame(n) if n != name else self.read(n)
            match entity:
                case Source():
                    made = source_frame(entity, self.read)
                case Table():
                    made = table_frame(entity, inner)
                case Dimension():
                    made = dimension_frame(entity, inner)
                case Fact() if entity.is_materialized and entity.target_table_name:
                    made = self.read(entity.target_table_name)
                case Fact():
                    if not entity.origin:
                        raise errors.InvalidModel(f"{name} has neither a grain nor a source")
                    made = fact_frame(entity, self.model, inner, self.graph)
            self._frames[name] = made
        return self._frames[name]

    def prefixed(self, node: str) -> DataFrame:
        df = self.frame(self.graph.entity_of(node))
        return df.select(*[F.col(f"`{c}`").alias(f"{node}__{c}") for c in df.columns])

    # --- resolution

    def owner(self, c: Col, anchor: str) -> str:
        """The node of a reference, as seen from an anchor."""
        if c.entity is None:
            if c.name in self.frame(anchor).columns:
                return anchor
            found = [n for n in self.graph.reachable(anchor) if n not in self.model.facts and self.graph.is_safe(anchor, n) and c.name in self.frame(self.graph.entity_of(n)).columns]
            if not found:
                raise errors.UnknownField(f"{anchor} and what it leads to have no column {c.name}")
            if len(found) > 1:
                raise errors.AmbiguousField(f"{c.name} is a column of {', '.join(found)}")
            return found[0]
        node = c.entity
        if node in self.model.facts and node != anchor and c.name in self.model.facts[node].measures:
            raise errors.InvalidReference(f"{node}.{c.name} is a measure: use having")
        fact = self.model.facts.get(anchor)
        if fact and node == fact.origin:
            node = anchor
        if node not in self.graph.edges:
            raise errors.UnknownEntity(f"no such entity: {node}")
        if node == anchor and fact and c.name in fact.measures and c.name not in self.frame(anchor).columns:
            raise errors.InvalidReference(f"{c.name} is a measure: use having")
        if c.name not in self.frame(self.graph.entity_of(node)).columns:
            raise errors.UnknownField(f"{node} has no column {c.name}")
        return node

    def resolver(self, anchor: str) -> Callable[[Col], Column]:
        return lambda c: F.col(f"`{self.owner(c, anchor)}__{c.name}`")

    def joined(self, anchor: str, expressions: list[Expr]) -> DataFrame:
        """The anchor with all that the expressions refer to, along safe paths; columns are entity__column."""
        needed = [n for n in dict.fromkeys(self.owner(c, anchor) for e in expressions for c in e.columns()) if n != anchor]
        df = self.prefixed(anchor)
        for e in self.graph.join_tree(anchor, needed):
            right = self.prefixed(e.end)
            a, b = f"{e.start}__{e.start_column}", f"{e.end}__{e.end_column}"
            for side, name in ((df, a), (right, b)):
                if name not in side.columns:
                    raise errors.UnknownField(f"a relationship uses {name.replace('__', '.')}, which there isn't")
            if not joinable(df.schema[a].dataType, right.schema[b].dataType):
                raise errors.TypeMismatch(f"{a.replace('__', '.')} and {b.replace('__', '.')} have types that can't be joined")
            df = df.join(right, df[f"`{a}`"] == right[f"`{b}`"], "inner")
        return df

    # --- aggregation

    def fact_of(self, leaf: Expr, query_from: str | None) -> str:
        if isinstance(leaf, MeasureRef):
            return self.model.measure(leaf.name, query_from if query_from in self.model.facts else None)[0]
        named = [c.entity for c in leaf.columns() if c.entity in self.model.facts]
        if named or query_from:
            return (named or [query_from])[0]
        origins = [f.name for f in self.model.facts.values() for c in leaf.columns() if f.origin == c.entity]
        if origins:
            return origins[0]
        raise errors.NoAnchor("an inline aggregate needs a fact's column, or from_")

    def measure_parts(self, leaf: Expr, anchor: str) -> tuple[str, Expr, Expr | None]:
        if isinstance(leaf, MeasureRef):
            measure: Measure = self.model.measure(leaf.name, anchor)[1]
            return measure.aggregation, measure.of, leaf.condition if leaf.condition is not None else measure.filter
        return leaf.function, leaf.of, leaf.condition

    def column_of(self, leaf: Expr, anchor: str, extra: Expr | None = None) -> Column:
        function, of, condition = self.measure_parts(leaf, anchor)
        if extra is not None:
            condition = extra if condition is None else condition & extra
        return compile_call(function, (of,), False, condition, self.resolver(anchor))

    def aggregated(self, anchor: str, parts: list[Expr], keys: list[tuple[Expr, str]], where: list[Expr], names: list[str]) -> DataFrame:
        used = [k for k, _ in keys] + where
        for leaf in parts:
            _, of, condition = self.measure_parts(leaf, anchor)
            used += [of] + ([condition] if condition is not None else [])
        df = self.joined(anchor, used)
        resolve = self.resolver(anchor)
        for condition in where:
            df = df.where(compile(condition, resolve))
        columns = [self.column_of(leaf, anchor).alias(n) for leaf, n in zip(parts, names, strict=True)]
        grouped = [compile(k, resolve).alias(n) for k, n in keys]
        if not columns:
            return df.select(*grouped).distinct()
        return df.groupBy(*grouped).agg(*columns) if grouped else df.agg(*columns)

    def keys(self, dims: list) -> list[tuple[Expr, str]]:
        out = []
        for d in dims:
            of, alias = d if isinstance(d, tuple) else (d, None)
            e = expression(of)
            if alias is None:
                if not isinstance(e, Col):
                    raise errors.InvalidReference(f"a computed dimension needs a name: {of}")
                alias = e.name
            out.append((e, alias))
        if len({n for _, n in out}) < len(out):
            raise errors.AmbiguousField("two dimensions have one name: give aliases")
        return out

    def facts(self, query: Query, parts: list[Expr]) -> list[str]:
        found = list(dict.fromkeys(self.fact_of(p, query.from_) for p in parts))
        if query.from_ and query.from_ not in found:
            found.insert(0, query.from_)
        if not found:
            raise errors.NoAnchor("a query needs a measure or from_")
        return sorted(found) if len(found) > 1 else found

    def several(self, facts: list[str], parts: list[Expr], keys, where, names, query_from, routed=False, zero=True) -> DataFrame:
        """Each fact's aggregates in a union of their rows, then one row for each combination of keys."""
        frames = []
        for fact in facts:
            own = [(p, n) for p, n in zip(parts, names, strict=True) if self.fact_of(p, query_from) == fact]
            for e in [k for k, _ in keys] + ([] if routed else where):
                for c in e.columns():
                    if c.entity != fact and not self._reaches(fact, c):
                        raise errors.DimensionNotShared(f"{c.entity or ''}.{c.name} isn't shared by {fact}")
            conditions = [w for w in where if all(self._reaches(fact, c) for c in w.columns())] if routed else where
            frames.append(self.aggregated(fact, [p for p, _ in own], keys, conditions, [n for _, n in own]))
        kinds = {f.name: f.dataType for df in frames for f in df.schema}
        fold = [n for n in names if n in kinds]
        whole = None
        for df in frames:
            padded = df.select(*[F.col(k) for _, k in keys], *[F.col(n) if n in df.columns else F.lit(None).cast(kinds[n]).alias(n) for n in fold])
            whole = padded if whole is None else whole.unionByName(padded)
        taken = [F.first(n, ignorenulls=True).alias(n) for n in fold]
        out = whole.groupBy(*[k for _, k in keys]).agg(*taken) if keys else whole.agg(*taken)
        return out.withColumns({n: F.coalesce(n, F.lit(0).cast(kinds[n])) for n in fold}) if zero and fold else out

    def _reaches(self, fact: str, c: Col) -> bool:
        try:
            node = self.owner(c, fact)
        except (errors.UnknownField, errors.AmbiguousField):
            return False
        return node == fact or self.graph.is_safe(fact, node)

    # --- the whole query

    def plan(self, query: Query) -> DataFrame:
        keys = self.keys(query.dims)
        where = [expression(w) for w in query.where]
        parts = list(dict.fromkeys(leaf for s in query.select for leaf in leaves(s)))
        names = [f"_m{i}" for i in range(len(parts))]
        facts = self.facts(query, parts)
        if len(facts) == 1:
            df = self.aggregated(facts[0], parts, keys, where, names)
        else:
            df = self.several(facts, parts, keys, where, names, query.from_)
        at: dict[Expr, str] = dict(zip(parts, names, strict=True))
        groups = [n for _, n in keys]
        for s in query.select:
            for calc in calcs(s):
                if calc not in at:
                    name = f"_t{len(at)}"
                    df = df.withColumn(name, self.over_time(calc, at, groups, query.time))
                    at[calc] = name
        outputs = [(output_name(s), s.of if isinstance(s, Named) else s) for s in query.select]
        if len({*groups, *(n for n, _ in outputs)}) < len(groups) + len(outputs):
            raise errors.AmbiguousField("two outputs have one name: give aliases")
        df = df.select(*groups, *[self.value(e, at).alias(n) for n, e in outputs])
        return finish(df, query.having, query.order_by, query.limit, query.offset)

    def value(self, e: Expr, at: dict[Expr, str]) -> Column:
        if e in at:
            return F.col(at[e])
        match e:
            case Binary("/", a, b):
                return quotient(self.value(a, at), self.value(b, at))
            case Binary(op, a, b):
                x, y = self.value(a, at), self.value(b, at)
                return {"+": x.__add__, "-": x.__sub__, "*": x.__mul__}[op](y)
            case Unary(_, a):
                return -self.value(a, at)
            case Lit(v):
                return F.lit(v)
            case Named(of, _):
                return self.value(of, at)
            case Call(name, args):
                return compile(Call(name, tuple(_Ready(self.value(a, at)) if not isinstance(a, Lit) else a for a in args)), lambda c: c.column)
        raise errors.UngroupedColumn(f"neither a measure nor a dimension: {e}")

    def over_time(self, calc: TimeCalc, at: dict[Expr, str], groups: list[str], given: dict[str, str]) -> Column:
        """Series are partitioned by the dimensions that aren't of time; offsets follow the finest grain that is grouped by."""
        grains = {n: given.get(n, n.lower()) for n in groups if given.get(n, n.lower()) in GRAINS}
        if not grains:
            raise errors.InvalidReference(f"{calc.kind} needs a dimension of time")
        others = [n for n in groups if n not in grains]
        order = sorted(grains, key=lambda n: -list(GRAINS).index(grains[n]))  # coarsest first
        finest = min(grains.values(), key=list(GRAINS).index)
        value = self.value(calc.of, at)
        to_date = {"ytd": ("year",), "qtd": ("year", "quarter"), "mtd": ("year", "month")}
        if calc.kind in to_date:
            within = [n for n in order if grains[n] in to_date[calc.kind]]
            if len(within) < len(to_date[calc.kind]):
                raise errors.InvalidReference(f"{calc.kind} needs {' and '.join(to_date[calc.kind])} among the dimensions")
            rest = [n for n in order if n not in within]
            w = Window.partitionBy(*others, *within).orderBy(*(rest or within)).rowsBetween(Window.unboundedPreceding, 0)
            return F.sum(value).over(w)
        w = Window.partitionBy(*others).orderBy(*order)
        if calc.kind.startswith("rolling"):
            function = F.sum if calc.kind == "rolling_sum" else F.avg
            return function(value).over(w.rowsBetween(1 - calc.n, 0))
        back = {"prior_period": calc.n, "prior_year": GRAINS[finest][0], "prior_quarter": GRAINS[finest][1]}[calc.kind]
        if not back:
            raise errors.InvalidReference(f"{calc.kind} needs a grain finer than {finest}")
        return F.lag(value, back).over(w)


@dataclass(frozen=True)
class _Ready(Col):
    """A column that is made already."""

    def __init__(self, column: Column):
        object.__setattr__(self, "column", column)
        object.__setattr__(self, "name", "")
        object.__setattr__(self, "entity", None)


def finish(df: DataFrame, having: list, order_by: list[str], limit: int | None, offset: int) -> DataFrame:
    """having, order, offset and limit over output names."""

    def output(c: Col) -> Column:
        if c.name not in df.columns:
            raise errors.UnknownField(f"no output {c.name}")
        return F.col(f"`{c.name}`")

    for h in having:
        df = df.where(compile(expression(h), output))
    if order_by:
        keys = []
        for o in order_by:
            name, _, way = o.partition(" ")
            keys.append(sorted_by(output(Col(name.rpartition(".")[2])), way.strip().lower() == "desc"))
        df = df.orderBy(*keys)
    if offset:
        df = df.offset(offset)
    return df.limit(limit) if limit is not None else df


# --- reports and pivots -----------------------------------------------------------------------------------------------


@dataclass
class Report:
    """Measures of several facts side by side; each filter applies to the facts that can reach it safely."""

    measures: list[str]
    group_by: list = field(default_factory=list)
    filters: list = field(default_factory=list)
    order_by: list[str] = field(default_factory=list)
    limit: int | None = None
    #: "last_30_days", "last_12_months", ...: of time_column, up to as_of (a date; today if not given), which is included
    time_range: str | None = None
    time_column: str | None = None
    as_of: str | None = None

    def period(self) -> list[Expr]:
        """The time range as filters."""
        if self.time_range is None:
            return []
        found = re.fullmatch(r"last_(\d+)_(day|week|month|quarter|year)s?", self.time_range)
        if not found or not self.time_column:
            raise errors.QueryPlanError(f"a time range is last_<n>_<unit>s of a time_column: {self.time_range}")
        at, end = expression(self.time_column), Cast(Lit(self.as_of), "date") if self.as_of else Call("current_date")
        return [at.gt(end - Interval(int(found[1]), found[2])), at.lte(end)]


#: Formats of a pivot's values by name; others are patterns of printf. A percent is a share times a hundred.
FORMATS = {"currency": lambda c: F.concat(F.when(c < 0, F.lit("-$")).otherwise(F.lit("$")), F.format_number(F.abs(c), 2)), "percent": lambda c: F.format_string("%.1f%%", c.cast("double") * 100)}


def formatted(c: Column, pattern: str) -> Column:
    """As text; null stays null."""
    return F.when(c.isNotNull(), FORMATS[pattern](c) if pattern in FORMATS else F.format_string(pattern, c))


#: Values that a pivot without column_values may find.
MOST_PIVOT_VALUES = 10_000


@dataclass
class Pivot:
    """rows x columns of values (measures). column_values: those to show, else all that occur. totals: any of "rows" (a
    Total_<measure> for each row), "columns" and "grand" (a row of totals, is_total). sort: (measure, descending). formats: by measure, "currency", "percent" or a printf pattern;
    its columns become text."""

    rows: list
    column: str
    values: list[str]
    column_values: list | None = None
    totals: tuple[str, ...] = ()
    filters: list = field(default_factory=list)
    sort: tuple[str, bool] | None = None
    formats: dict[str, str] = field(default_factory=dict)


def plan_report(planner: Planner, report: Report) -> DataFrame:
    parts = [MeasureRef(n) for n in report.measures]
    facts = list(dict.fromkeys(planner.fact_of(p, None) for p in parts))
    names = [f"{planner.fact_of(p, None)}_{p.name.rpartition('.')[2]}" for p in parts]
    keys, where = planner.keys(report.group_by), [expression(f) for f in report.filters] + report.period()
    if len(facts) > 1 and not keys:
        raise errors.QueryPlanError("a report on several facts needs group_by")
    for w in where:
        if not any(all(planner._reaches(f, c) for c in w.columns()) for f in facts):
            raise errors.InvalidReference(f"no fact of the report can be filtered by {w}")
    df = planner.several(facts, parts, keys, where, names, None, routed=True, zero=False)
    return finish(df, [], report.order_by, report.limit, 0)


def plan_pivot(planner: Planner, pivot: Pivot) -> DataFrame:
    """One grouped pass of conditional aggregates: totals are aggregates of their own, so they are right for averages and
    distinct counts too."""
    parts = [MeasureRef(n) for n in pivot.values]
    facts = list(dict.fromkeys(planner.fact_of(p, None) for p in parts))
    if len(facts) != 1:
        raise errors.QueryPlanError("a pivot takes the measures of one fact")
    fact, keys, across = facts[0], planner.keys(pivot.rows), expression(pivot.column)
    where = [expression(f) for f in pivot.filters]
    used = [k for k, _ in keys] + [across] + where
    for p in parts:
        _, of, condition = planner.measure_parts(p, fact)
        used += [of] + ([condition] if condition is not None else [])
    df = planner.joined(fact, used)
    resolve = planner.resolver(fact)
    for w in where:
        df = df.where(compile(w, resolve))
    values = pivot.column_values
    if values is None:
        found = df.select(compile(across, resolve).alias("v")).where("v is not null").distinct().limit(MOST_PIVOT_VALUES + 1).collect()
        if len(found) > MOST_PIVOT_VALUES:
            raise errors.QueryPlanError(f"a pivot over more than {MOST_PIVOT_VALUES} values: name those to show")
        values = sorted(r[0] for r in found)
    short = {p: p.name.rpartition(".")[2] for p in parts}
    columns = [planner.column_of(p, fact, across.eq(v)).alias(f"{v}_{short[p]}") for v in values for p in parts]
    total = [planner.column_of(p, fact).alias(f"Total_{short[p]}") for p in parts]
    wanted = columns + (total if {"rows", "grand"} & set(pivot.totals) or pivot.sort else [])
    grouped = [compile(k, resolve).alias(n) for k, n in keys]
    out = df.groupBy(*grouped).agg(*wanted)
    if {"columns", "grand"} & set(pivot.totals):
        below = df.agg(*wanted)
        below = below.select(*[F.lit(None).cast(out.schema[n].dataType).alias(n) for _, n in keys], *below.columns, F.lit(True).alias("is_total"))
        out = out.withColumn("is_total", F.lit(False)).unionByName(below)
    if pivot.sort:
        name, descending = pivot.sort
        first = [F.col("is_total").asc()] if "is_total" in out.columns else []
        out = out.orderBy(*first, sorted_by(F.col(f"Total_{name.rpartition('.')[2]}"), descending), *[F.col(n) for _, n in keys])
        if not {"rows", "grand"} & set(pivot.totals):
            out = out.drop(*[f"Total_{short[p]}" for p in parts])
    if unknown := set(pivot.formats) - set(pivot.values):
        raise errors.QueryPlanError(f"formats for measures that the pivot doesn't show: {', '.join(sorted(unknown))}")
    texts = {f"{v}_{short[p]}": pivot.formats[p.name] for p in parts if p.name in pivot.formats for v in [*values, "Total"]}
    return out.select(*[formatted(F.col(f"`{n}`"), texts[n]).alias(n) if n in texts else F.col(f"`{n}`") for n in out.columns]) if texts else out


