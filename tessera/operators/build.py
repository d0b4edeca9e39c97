"""The build layer: dedup, tables, facts, dimensions, slowly changing dimensions, incremental and snapshot loads, merge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidModel, UnknownField
from ..expr import Call, Col, Expr, compile, expression, sorted_by
from ..model import Dedup, Dimension, Fact, Model, Source, Table


def order_columns(names: list[str], reverse: bool = False) -> list[Column]:
    """"a", "a desc"; nulls last, or with reverse first."""
    out = []
    for name in names:
        column, _, way = name.partition(" ")
        down = way.strip().lower() == "desc"
        out.append(sorted_by(F.col(column), down != reverse, reverse))
    return out


def dedup(df: DataFrame, spec: Dedup) -> DataFrame:
    """One row of each key: the first in order, or the last."""
    w = Window.partitionBy(*spec.partition_by).orderBy(*order_columns(spec.order_by, spec.keep == "last"))
    return df.withColumn("_row", F.row_number().over(w)).where("_row = 1").drop("_row")


def by_name(df: DataFrame):
    """A resolver of references by column name alone; "entity__column" names win for qualified references."""

    def resolve(c: Col) -> Column:
        if c.entity and f"{c.entity}__{c.name}" in df.columns:
            return F.col(f"`{c.entity}__{c.name}`")
        if c.name in df.columns:
            return F.col(f"`{c.name}`")
        ends = [x for x in df.columns if x.endswith(f"__{c.name}")]
        if len(ends) == 1:
            return F.col(f"`{ends[0]}`")
        raise UnknownField(f"no column {c.entity + '.' if c.entity else ''}{c.name} among {', '.join(df.columns)}")

    return resolve


def source_frame(source: Source, read) -> DataFrame:
    """A source's rows: its table, its filter, its dedup; declared columns first must exist."""
    df = read(source.table)
    if missing := [c for c in source.column_defs if c not in df.columns]:
        raise InvalidModel(f"{source.name}: {source.table} has no column {', '.join(missing)}")
    if source.filter_expr is not None:
        df = df.where(compile(source.filter_expr, by_name(df)))
    if source.dedup_spec is not None:
        df = dedup(df, source.dedup_spec)
    return df


def changes(df: DataFrame, source: Source, since=None) -> DataFrame:
    """Rows to take up, by the source's change tracking: those after ``since``; for cdc the last state of each key, without
    deleted ones (see deletions); all of a full snapshot."""
    t = source.tracking
    if t is None or t.kind == "full_snapshot":
        return df
    if t.kind == "cdc":
        return _last_changes(df, source, since).where(~_DELETED(t.operation))
    return df if since is None else df.where(F.col(t.timestamp) > F.lit(since))


def _DELETED(operation: str) -> Column:
    return F.coalesce(F.lower(F.col(operation)).isin("d", "delete"), F.lit(False))


def _last_changes(df: DataFrame, source: Source, since) -> DataFrame:
    t = source.tracking
    if since is not None:
        df = df.where(F.col(t.timestamp) > F.lit(since))
    return dedup(df, Dedup(source.primary_key, [f"{t.timestamp} desc"]))


def deletions(df: DataFrame, source: Source, since=None) -> DataFrame:
    """The keys whose last change (cdc) deletes them."""
    return _last_changes(df, source, since).where(_DELETED(source.tracking.operation)).select(*source.primary_key)


def apply_changes(target: DataFrame, df: DataFrame, source: Source, since=None) -> DataFrame:
    """The target after a change feed (cdc): deleted keys go, other keys take their last state. The feed's last changes are
    found once; the target meets only their keys."""
    last = _last_changes(df, source, since)
    kept = target.join(last.select(*source.primary_key), source.primary_key, "left_anti").select(target.columns)
    return kept.unionByName(last.where(~_DELETED(source.tracking.operation)).select(target.columns))


def is_aggregate(e: Expr) -> bool:
    from ..functions import AGGREGATES

    return (isinstance(e, Call) and e.name.lower() in AGGREGATES) or (not type(e).__name__ == "Over" and any(is_aggregate(c) for c in e.children()))


def table_frame(table: Table, read) -> DataFrame:
    """from (a union by name, distinct unless all), joins, filter, dedup, group by, columns, window columns."""
    frames = [read(s) for s in table.sources]
    df = reduce(lambda a, b: a.unionByName(b), frames)
    if len(frames) > 1 and not table.union_all:
        df = df.distinct()
    if table.joins:
        df = df.select(*[F.col(c).alias(f"{table.sources[0]}__{c}") for c in df.columns])
        for name, on, how in table.joins:
            other = read(name)
            other = other.select(*[F.col(c).alias(f"{name}__{c}") for c in other.columns])
            names = set(df.columns) | set(other.columns)
            seen = lambda c, names=names, name=name: F.col(f"{c.entity}__{c.name}") if f"{c.entity}__{c.name}" in names else _only(names, c)
            df = df.join(other, compile(on, seen), {"full": "full_outer"}.get(how, how))
    if table.filter_expr is not None:
        df = df.where(compile(table.filter_expr, by_name(df)))
    if table.dedup_spec is not None:
        df = dedup(df, table.dedup_spec)
    resolve = by_name(df)
    if table.column_defs or table.groups:
        named = {n: Col(n) if d is None else d for n, d in table.column_defs.items()}
        if table.groups:
            keys = [compile(g, resolve).alias(g.name if isinstance(g, Col) else f"group_{i}") for i, g in enumerate(table.groups)]
            plain = {g.name for g in table.groups if isinstance(g, Col)}
            sums = [compile(e, resolve).alias(n) for n, e in named.items() if is_aggregate(e)]
            if wrong := [n for n, e in named.items() if not is_aggregate(e) and n not in plain]:
                raise InvalidModel(f"{table.name}: neither grouped nor aggregated: {', '.join(wrong)}")
            df = df.groupBy(*keys).agg(*sums)
        else:
            df = df.select(*[compile(e, resolve).alias(n) for n, e in named.items()])
    return df.select("*", *[compile(e, by_name(df)).alias(n) for n, e in table.windows.items()]) if table.windows else df


def _only(names, c: Col) -> Column:
    found = [n for n in names if n.split("__", 1)[1] == c.name]
    if len(found) != 1:
        raise UnknownField(f"{c.name}: {'ambiguous' if found else 'unknown'} in a join's condition")
    return F.col(found[0])


def dimension_frame(dimension: Dimension, read) -> DataFrame:
    df = read(dimension.source or dimension.name)
    if not dimension.column_defs:
        return df
    return df.select(*[compile(Col(n) if d is None else d, by_name(df)).alias(n) for n, d in dimension.column_defs.items()])


def fact_frame(fact: Fact, model: Model, read, graph) -> DataFrame:
    """A fact's rows at its grain: its origin, the included dimension columns, its own and its window columns."""
    df = read(fact.origin)
    own = df.columns
    for i in fact.includes:
        edge = next((e for e in graph.edges[fact.name] if e.end == i.dimension), None)
        if edge is None:
            raise InvalidModel(f"{fact.name} includes {i.dimension}, which no relationship leads to")
        other = read(graph.entity_of(i.dimension))
        names = [c for c in (i.columns or other.columns) if c not in i.but]
        picked = other.select(F.col(edge.end_column).alias("_key"), *[F.col(c).alias(i.prefix + c) for c in names if i.prefix + c not in own])
        df = df.join(picked, df[edge.start_column] == picked["_key"], "inner").drop("_key")
    df = df.select("*", *[compile(e, by_name(df)).alias(n) for n, e in fact.column_defs.items() if e is not None])
    return df.select("*", *[compile(e, by_name(df)).alias(n) for n, e in fact.windows.items()])


# --- slowly changing dimensions -------------------------------------------------------------------------------------


def _differ(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def scd2(snapshots: DataFrame, key: list[str], tracked: list[str], at: str) -> DataFrame:
    """Versions out of snapshots (key, tracked, time of the snapshot): a row for each change, effective_from (inclusive),
    effective_to (exclusive, null if current), is_current."""
    w = Window.partitionBy(*key).orderBy(at)
    changed = reduce(lambda x, y: x | y, [_differ(F.col(c), F.lag(c).over(w)) for c in tracked])
    versions = snapshots.select(*key, *tracked, at).withColumn("_new", (F.row_number().over(w) == 1) | changed).where("_new")
    nxt = F.lead(at).over(w)
    return versions.select(*key, *tracked, F.col(at).alias("effective_from"), nxt.alias("effective_to"), nxt.isNull().alias("is_current"))


def scd2_merge(current: DataFrame, incoming: DataFrame, key: list[str], tracked: list[str], at) -> DataFrame:
    """A versioned dimension after an incoming state as of ``at``: changed rows are closed and opened anew; keys that don't
    come in stay open."""
    state = incoming.select(*key, *[F.col(c).alias(f"_{c}") for c in tracked], F.lit(True).alias("_in"))
    joined = current.join(state, key, "left")
    changed = F.col("is_current") & F.coalesce("_in", F.lit(False)) & reduce(lambda x, y: x | y, [_differ(F.col(c), F.col(f"_{c}")) for c in tracked])
    columns = [*key, *tracked, "effective_from", "effective_to", "is_current"]
    closed = joined.withColumn("_c", changed).withColumns({"effective_to": F.when(F.col("_c"), F.lit(at)).otherwise(F.col("effective_to")), "is_current": F.col("is_current") & ~F.col("_c")}).select(columns)
    open_now = current.where("is_current").select(*key, *[F.col(c).alias(f"_{c}") for c in tracked], F.lit(True).alias("_had"))
    fresh = incoming.join(open_now, key, "left").where(F.col("_had").isNull() | reduce(lambda x, y: x | y, [_differ(F.col(c), F.col(f"_{c}")) for c in tracked]))
    kind = current.schema["effective_from"].dataType
    fresh = fresh.select(*key, *tracked, F.lit(at).cast(kind).alias("effective_from"), F.lit(None).cast(kind).alias("effective_to"), F.lit(True).alias("is_current"))
    return closed.unionByName(fresh)


def scd0(current: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """What is there stays; new keys come in."""
    return current.unionByName(incoming.join(current, key, "left_anti").select(current.columns))


def scd1(current: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Incoming rows replace those of their key."""
    return upsert(current, incoming, key)


def scd3(current: DataFrame, incoming: DataFrame, key: list[str], tracked: list[str]) -> DataFrame:
    """The present value and the one before, in previous_<column>; a value that didn't change keeps its previous one."""
    had = current.select(*key, *[F.col(c).alias(f"_{c}") for c in tracked], *[F.col(f"previous_{c}").alias(f"_p_{c}") if f"previous_{c}" in current.columns else F.lit(None).alias(f"_p_{c}") for c in tracked], F.lit(True).alias("_had"))
    new = incoming.select(*key, *tracked, F.lit(True).alias("_in"))
    joined = had.join(new, key, "full_outer")
    out = list(key)
    for c in tracked:
        kind = current.schema[c].dataType
        moved = F.col("_had") & F.col("_in") & _differ(F.col(c), F.col(f"_{c}"))
        out += [F.when(F.col("_in"), F.col(c)).otherwise(F.col(f"_{c}")).alias(c), F.when(moved, F.col(f"_{c}")).otherwise(F.col(f"_p_{c}")).cast(kind).alias(f"previous_{c}")]
    return joined.select(*out)


def scd6(snapshots: DataFrame, key: list[str], tracked: list[str], at: str) -> DataFrame:
    """Versions, each with the previous and with the present value: kinds 1, 2 and 3 in one."""
    versions = scd2(snapshots, key, tracked, at)
    w = Window.partitionBy(*key).orderBy("effective_from")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    extra = {f"previous_{c}": F.lag(c).over(w) for c in tracked} | {f"current_{c}": F.last(c).over(whole) for c in tracked}
    return versions.withColumns(extra)


# --- loads and merge ------------------------------------------------------------------------------------------------


def upsert(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows replace those of their key; others are added. Only keys of the incoming side are shuffled against the target."""
    return target.join(rows.select(*key), key, "left_anti").select(target.columns).unionByName(rows.select(target.columns))


def incremental(target: DataFrame, source: DataFrame, unique_key: list[str], incremental_key: str, lookback: str | int = 0) -> DataFrame:
    """The target after taking up the source's rows whose key is beyond the target's greatest, less the lookback (a number,
    or an interval as "3 days" for dates and times)."""
    highest = target.agg(F.max(incremental_key)).collect()[0][0]
    if highest is not None:
        back = F.expr(f"interval {lookback}") if isinstance(lookback, str) else F.lit(lookback) if lookback else None
        limit = F.lit(highest) if back is None else F.lit(highest) - back
        source = source.where(F.col(incremental_key) > limit)
    return upsert(target, source, unique_key)


def snapshot(history: DataFrame | None, rows: DataFrame, unique_key: list[str], updated_at: str) -> DataFrame:
    """A history with valid_from and valid_to after another snapshot, judged by updated_at."""
    kind = rows.schema[updated_at].dataType
    fresh = rows.withColumns({"valid_from": F.col(updated_at), "valid_to": F.lit(None).cast(kind)})
    if history is None:
        return fresh
    incoming = rows.select(*unique_key, F.col(updated_at).alias("_at"))
    newest = history.where("valid_to is null").select(*unique_key, F.col("valid_from").alias("_from"))
    joined = history.join(incoming, unique_key, "left")
    ended = F.col("valid_to").isNull() & (F.col("_at") > F.col("valid_from"))
    closed = joined.withColumn("valid_to", F.when(ended, F.col("_at")).otherwise(F.col("valid_to"))).select(history.columns)
    new = fresh.join(newest, unique_key, "left").where(F.col("_from").isNull() | (F.col(updated_at) > F.col("_from"))).select(history.columns)
    return closed.unionByName(new)


class Merge:
    """MERGE of a target and a source, as a DataFrame: clauses apply in order, the first that fits a row.

    In conditions and values, target columns are t.<name>, source columns s.<name>. A target row that a clause would change
    by several source rows is an error.
    """

    def __init__(self, target: DataFrame, source: DataFrame, on: list[str]):
        self.target, self.source, self.on, self.clauses, self.inserts = target, source, on, [], []

    def when_matched_update(self, values: dict[str, str], condition: str | None = None) -> Merge:
        self.clauses.append(("update", condition, values))
        return self

    def when_matched_delete(self, condition: str | None = None) -> Merge:
        self.clauses.append(("delete", condition, {}))
        return self

    def when_not_matched_insert(self, values: dict[str, str] | None = None, condition: str | None = None) -> Merge:
        self.inserts.append((condition, values or {c: f"s.{c}" for c in self.target.columns if c in self.source.columns}))
        return self

    def frame(self) -> DataFrame:
        t = self.target.select(*[F.col(c).alias(f"t__{c}") for c in self.target.columns], F.lit(True).alias("_t"))
        s = self.source.select(*[F.col(c).alias(f"s__{c}") for c in self.source.columns], F.lit(True).alias("_s"))
        s = s.withColumn("_same", F.count("*").over(Window.partitionBy(*[f"s__{c}" for c in self.on])))
        on = reduce(lambda a, b: a & b, [F.col(f"t__{c}") == F.col(f"s__{c}") for c in self.on])
        joined = t.join(s, on, "full_outer" if self.inserts else "left")
        names = set(joined.columns)

        def value(text) -> Column:
            def resolve(c: Col) -> Column:
                name = f"{c.entity}__{c.name}" if c.entity else next((f"{x}__{c.name}" for x in "ts" if f"{x}__{c.name}" in names), "")
                if name not in names:
                    raise UnknownField(f"no column {c.entity or ''}.{c.name} in a merge")
                return F.col(name)

            return compile(expression(text), resolve)

        both, only_s = F.col("_t").isNotNull() & F.col("_s").isNotNull(), F.col("_t").isNull()
        which, several = F.when(F.lit(False), 0), F.raise_error(F.lit("a target row of a merge matches several source rows")).cast("int")
        for i, (_, condition, _) in enumerate(self.clauses):
            fits = both & (value(condition) if condition else F.lit(True))
            which = which.when(fits & (F.col("_same") > 1), several).when(fits, i)
        for i, (condition, _) in enumerate(self.inserts):
            which = which.when(only_s & (value(condition) if condition else F.lit(True)), 1000 + i)
        joined = joined.withColumn("_clause", F.coalesce(which.otherwise(None), F.when(only_s, F.lit(-2)).otherwise(F.lit(-1))))
        gone = [-2, *(i for i, c in enumerate(self.clauses) if c[0] == "delete")]
        out = []
        for c in self.target.columns:
            column = F.when(F.col("_clause") == -1, F.col(f"t__{c}"))
            for i, (kind, _, values) in enumerate(self.clauses):
                if kind == "update":
                    column = column.when(F.col("_clause") == i, value(values[c]) if c in values else F.col(f"t__{c}"))
            for i, (_, values) in enumerate(self.inserts):
                column = column.when(F.col("_clause") == 1000 + i, value(values[c]) if c in values else F.lit(None))
            out.append(column.cast(self.target.schema[c].dataType).alias(c))
        return joined.where(~F.col("_clause").isin(gone)).select(*out)


def insert(target: DataFrame, rows: DataFrame, on_conflict: str | None = None, key: list[str] | None = None) -> DataFrame:
    """Rows added; on_conflict "nothing" keeps the target's row of a key, "update" takes the new one."""
    if on_conflict == "nothing":
        rows = rows.join(target.select(*key), key, "left_anti")
    elif on_conflict == "update":
        return upsert(target, rows, key)
    return target.unionByName(rows.select(target.columns))


def update(target: DataFrame, values: dict[str, str], where: str | None = None) -> DataFrame:
    resolve = by_name(target)
    hit = compile(expression(where), resolve) if where else F.lit(True)
    return target.select(*[F.when(hit, compile(expression(values[c]), resolve)).otherwise(F.col(c)).cast(target.schema[c].dataType).alias(c) if c in values else F.col(c) for c in target.columns])


def update_from(target: DataFrame, source: DataFrame, on: list[str], values: dict[str, str], where: str | None = None) -> DataFrame:
    """UPDATE ... FROM source: target rows that match a source row take the values (t.<name>, s.<name>); several matches of one
    row are an error."""
    return Merge(target, source, on).when_matched_update(values, where).frame()


def delete(target: DataFrame, where: str | None = None, using: DataFrame | None = None, key: list[str] | None = None) -> DataFrame:
    """Without rows that meet the condition (null is no match), or whose key is in ``using``."""
    if using is not None:
        target = target.join(using.select(*key), key, "left_anti")
    return target.where(~F.coalesce(compile(expression(where), by_name(target)), F.lit(False))) if where else target
