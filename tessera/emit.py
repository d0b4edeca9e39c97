"""Expressions as SQL text, and models as the Python that declares them. What is written reads back as the same tree."""

from __future__ import annotations

import re
from decimal import Decimal

from .errors import InvalidModel
from .expr import Between, Binary, Call, Case, Cast, Col, Expr, In, Interval, IsNull, Like, Lit, Over, Raw, Star, Unary
from .model import ColumnDef, Dedup, Dimension, Entity, Fact, Measure, Model, Source, Table

_PLAIN = re.compile(r"[A-Za-z_]\w*")


def _name(name: str) -> str:
    return name if _PLAIN.fullmatch(name) else f'"{name}"'


def _literal(value) -> str:
    match value:
        case None:
            return "NULL"
        case bool():
            return str(value).upper()
        case str():
            return "'" + value.replace("'", "''") + "'"
        case int() | float() | Decimal():
            return str(value) if value >= 0 else f"({value})"
    raise InvalidModel(f"no SQL text for {value!r}")


def _bound(n: int | None, side: str) -> str:
    if n is None:
        return f"UNBOUNDED {side}"
    return "CURRENT ROW" if n == 0 else f"{abs(n)} {'PRECEDING' if n < 0 else 'FOLLOWING'}"


def sql(e: Expr) -> str:
    """SQL text of an expression; all operations stand in parentheses."""
    match e:
        case Col(name, entity):
            return f"{_name(entity)}.{_name(name)}" if entity else _name(name)
        case Lit(value):
            return _literal(value)
        case Star():
            return "*"
        case Raw(text):
            return text
        case Interval(amount, unit):
            return f"INTERVAL '{amount} {unit}'"
        case Unary(op, x):
            return f"({op.upper()} {sql(x)})"
        case Binary(op, x, y):
            return f"({sql(x)} {op.upper()} {sql(y)})"
        case Like(x, pattern, escape, any_case):
            return f"({sql(x)} {'ILIKE' if any_case else 'LIKE'} {sql(pattern)}{' ESCAPE ' + _literal(escape) if escape else ''})"
        case In(x, items, negated):
            return f"({sql(x)} {'NOT ' if negated else ''}IN ({', '.join(map(sql, items))}))"
        case Between(x, low, high):
            return f"({sql(x)} BETWEEN {sql(low)} AND {sql(high)})"
        case IsNull(x, negated):
            return f"({sql(x)} IS {'NOT ' if negated else ''}NULL)"
        case Case(whens, otherwise, operand):
            parts = ["CASE", *([sql(operand)] if operand is not None else []), *[f"WHEN {sql(a)} THEN {sql(b)}" for a, b in whens]]
            return " ".join([*parts, *([f"ELSE {sql(otherwise)}"] if otherwise is not None else []), "END"])
        case Cast(x, kind, lenient):
            return f"{'TRY_CAST' if lenient else 'CAST'}({sql(x)} AS {kind})"
        case Over(call, partition, order, frame):
            parts = [f"PARTITION BY {', '.join(map(sql, partition))}"] if partition else []
            nulls = {None: "", True: " NULLS FIRST", False: " NULLS LAST"}
            if order:
                parts.append("ORDER BY " + ", ".join(sql(x) + (" DESC" if down else "") + nulls[first] for x, down, first in order))
            if frame:
                parts.append(f"{frame[0].upper()} BETWEEN {_bound(frame[1], 'PRECEDING')} AND {_bound(frame[2], 'FOLLOWING')}")
            return f"{sql(call)} OVER ({' '.join(parts)})"
        case Call(name, args, distinct, where):
            text = f"{name}({'DISTINCT ' if distinct else ''}{', '.join(map(sql, args))})"
            return f"{text} FILTER (WHERE {sql(where)})" if where is not None else text
    raise InvalidModel(f"no SQL text for {e!r}")


def _written(e: Expr) -> str:
    """As the argument of a DSL call."""
    return f"raw({e.text!r})" if isinstance(e, Raw) else repr(sql(e))


def _column(d) -> str:
    if not isinstance(d, ColumnDef):
        return _written(d)
    options = {n: getattr(d, n) for n in ("nullable", "primary_key", "description", "unique") if getattr(d, n) != getattr(ColumnDef(""), n)}
    return f"column({d.type!r}{''.join(f', {n}={v!r}' for n, v in options.items())})"


def _measure(m: Measure) -> str:
    return f"Measure({m.aggregation!r}, {'Star()' if isinstance(m.of, Star) else f'expression({_written(m.of)})'}{f', expression({_written(m.filter)})' if m.filter is not None else ''})"


def _dedup(d: Dedup) -> str:
    return f".dedup({d.partition_by!r}, {d.order_by!r}, {d.keep!r})"


def _entity(x: Entity) -> list[str]:
    """The calls that follow the declaration of an entity."""
    out = []
    if isinstance(x, Source):
        out += [f".from_({x.table!r})"] if x.table != x.name else []
        out += [f".change_tracking({x.tracking.kind!r}, {x.tracking.timestamp!r}, {x.tracking.operation!r})"] if x.tracking else []
    elif isinstance(x, Table):
        out += [f".from_({', '.join(map(repr, x.sources))}, all={x.union_all})"] if x.sources else []
        out += [f".join({s!r}, {_written(on)}, {how!r})" for s, on, how in x.joins]
    elif isinstance(x, Dimension):
        out += [f".from_({x.source!r})"] if x.source else []
        out += [f".scd({x.scd_type})"] if x.scd_type != 1 else []
    elif isinstance(x, Fact):
        out += [f".grain({', '.join(_written(c) for c in x.grain_columns)})"] if x.grain_columns else []
        out += [f".from_({x.base!r})"] if x.base else []
        out += [f".include({i.dimension!r}, {i.columns!r}, {i.but!r}, {i.prefix!r})" for i in x.includes]
    if getattr(x, "filter_expr", None) is not None:
        out.append(f".filter({_written(x.filter_expr)})")
    out += [_dedup(x.dedup_spec)] if getattr(x, "dedup_spec", None) else []
    for n, d in x.column_defs.items():  # one by one, as names and definitions may alternate
        out.append(f".columns({n!r})" if d is None else f".columns(**{{{n!r}: {_column(d)}}})")
    if isinstance(x, Table):
        out += [f".window_columns(**{{{n!r}: {_written(d)}}})" for n, d in x.windows.items()]
        out += [f".group_by({', '.join(map(_written, x.groups))})"] if x.groups else []
    if isinstance(x, Dimension | Table) and x.key:
        out.append(f".primary_key({', '.join(map(repr, x.key))})")
    if isinstance(x, Fact):
        out += [f".window_column({n!r}, {_written(d)})" for n, d in x.windows.items()]
        out += [f".measure({n!r}, {_measure(d)})" for n, d in x.measures.items()]
        out += [f".date_config(**{x.dates!r})"] if x.dates else []
    target = getattr(x, "target_table_name", None) or getattr(x, "target_table", None) if isinstance(x, Fact | Dimension) else None
    out += [f".target({target!r})"] if isinstance(target, str) else []
    out += [".materialized()"] if getattr(x, "is_materialized", False) else []
    out += [f".description({x.description_text!r})"] if x.description_text else []
    return out + ([f".tags({', '.join(map(repr, x.tag_list))})"] if x.tag_list else [])


def python(model: Model, name: str = "model") -> str:
    """Python that declares the model's entities, links and strategies anew. Queries, reports and pivots are values of the
    program that runs them, and aren't written."""
    lines = ["from tessera.expr import Star, expression, raw", "from tessera.model import Measure, Model, Relationship, column", "", f"{name} = Model()"]
    for kind, entities in (("source", model.sources), ("dimension", model.dimensions), ("table", model.tables), ("fact", model.facts)):
        for x in entities.values():
            lines.append(f"{name}.{kind}({x.name!r}){''.join(_entity(x))}")
            if getattr(x, "strategy", None):
                lines.append(f"{name}.{kind}s[{x.name!r}].strategy = {x.strategy!r}")
    lines += [f"{name}.relationships.append({r!r})" for r in model.relationships]
    return "\n".join(lines) + "\n"
