"""The function library: names as the expression language spells them, and their Spark columns.

Scalars take columns, or plain Python values where an argument must be a constant (a unit, a length, a pattern).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidReference

AGGREGATES = {"count", "sum", "avg", "min", "max", "count_distinct", "array_agg", "string_agg", "listagg", "group_concat"}
#: Functions whose first, or third, argument is a unit of time that may be written as a bare word.
UNIT_FIRST = {"date_trunc", "datetrunc", "date_part", "datepart", "extract", "date_diff", "datediff"}
UNIT_LAST = {"date_add", "dateadd", "date_sub", "datesub"}


def aggregate(name: str, column: Column, *rest) -> Column:
    """An aggregate; a name that isn't one of ours is passed through to Spark."""
    match name:
        case "count":
            return F.count(column)
        case "count_distinct":
            return F.countDistinct(column)
        case "array_agg":
            return F.collect_list(column)
        case "string_agg" | "listagg" | "group_concat":
            # values in order, so that the result doesn't depend on how rows are dealt out
            return F.array_join(F.array_sort(F.collect_list(column.cast("string"))), rest[0] if rest else ",")
        case "sum" | "avg" | "min" | "max":
            return getattr(F, name)(column)
    return F.call_function(name, column, *[F.lit(r) for r in rest])


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _unit(x) -> str:
    unit = str(x).lower().rstrip("s")
    if unit not in ("year", "quarter", "month", "week", "day", "hour", "minute", "second"):
        raise InvalidReference(f"no such unit of time: {x}")
    return unit


def date_trunc(unit, date) -> Column:
    """To a date for units of a day or more, else to a timestamp without zone."""
    cut = F.date_trunc(_unit(unit), _c(date))
    return cut.cast("date") if _unit(unit) in ("year", "quarter", "month", "week", "day") else cut.cast("timestamp_ntz")


def date_add(date, n, unit) -> Column:
    return _shift(_c(date), _c(n), _unit(unit))


def _shift(date: Column, n: Column, unit: str) -> Column:
    months = {"year": 12, "quarter": 3, "month": 1}
    if unit in months:
        return date + F.make_ym_interval(F.lit(0), n * months[unit])
    seconds = {"week": 604_800, "day": 86_400, "hour": 3_600, "minute": 60, "second": 1}
    return date + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (n * seconds[unit]).cast("decimal(18,6)"))


def date_diff(unit, start, end) -> Column:
    """Boundaries of the unit between two dates."""
    a, b, unit = _c(start), _c(end), _unit(unit)
    match unit:
        case "year":
            return (F.year(b) - F.year(a)).cast("long")
        case "quarter":
            return (4 * (F.year(b) - F.year(a)) + F.quarter(b) - F.quarter(a)).cast("long")
        case "month":
            return (12 * (F.year(b) - F.year(a)) + F.month(b) - F.month(a)).cast("long")
        case "day":
            return F.datediff(b, a).cast("long")
        case "week":
            return (F.datediff(F.date_trunc("week", b), F.date_trunc("week", a)) / 7).cast("long")
    size = {"hour": 3600, "minute": 60, "second": 1}[unit]
    at = lambda x: F.unix_timestamp(F.date_trunc(unit, x))
    return ((at(b) - at(a)) / size).cast("long")


def truncate(x, digits=0) -> Column:
    scale = 10.0 ** int(digits)
    return F.signum(_c(x)) * F.floor(F.abs(_c(x)) * scale) / scale


def to_char(x, pattern) -> Column:
    return F.date_format(_c(x), pattern)


def to_number(x, pattern=None) -> Column:
    return _c(x).try_cast(T.DoubleType()) if pattern is None else F.to_number(_c(x), F.lit(pattern))


def extract(unit, date) -> Column:
    names = {"dow": F.dayofweek, "dayofweek": F.dayofweek, "doy": F.dayofyear, "dayofyear": F.dayofyear}
    return (names.get(str(unit).lower()) or getattr(F, {"day": "dayofmonth", "week": "weekofyear"}.get(_unit(unit), _unit(unit))))(_c(date))


# The names of each function.
_SCALARS: dict[str, object] = {
    "upper": F.upper, "lower": F.lower, "initcap": F.initcap, "trim": F.trim, "ltrim": F.ltrim, "rtrim": F.rtrim,
    "left": lambda s, n: F.left(_c(s), _c(n)), "right": lambda s, n: F.right(_c(s), _c(n)),
    "substring substr": lambda s, a, n=None: F.substr(_c(s), _c(a), *([_c(n)] if n is not None else [])),
    "length len": F.length, "replace": lambda s, a, b: F.replace(_c(s), _c(a), _c(b)),
    "concat": lambda *a: F.concat(*map(_c, a)), "position": lambda part, s: F.locate(part, _c(s)),
    "split_part": lambda s, d, i: F.split_part(_c(s), _c(d), _c(i)),
    "regexp_replace": lambda s, p, r: F.regexp_replace(_c(s), _c(p), _c(r)),
    "regexp_extract regexp_substr": lambda s, p, g=0: F.regexp_extract(_c(s), p, int(g)),
    "coalesce": lambda *a: F.coalesce(*map(_c, a)), "nullif": lambda a, b: F.nullif(_c(a), _c(b)),
    "ifnull isnull nvl": lambda a, b: F.coalesce(_c(a), _c(b)),
    "date_trunc datetrunc": date_trunc, "date_part datepart extract": extract,
    "date_add dateadd": date_add, "date_sub datesub": lambda d, n, u: _shift(_c(d), -_c(n), _unit(u)),
    "date_diff datediff": date_diff,
    "current_date": F.current_date, "current_timestamp now getdate": F.current_timestamp,
    "to_date date": F.to_date, "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second,
    "dayofweek day_of_week": F.dayofweek, "dayofyear day_of_year": F.dayofyear, "weekofyear week_of_year week": F.weekofyear,
    "quarter": F.quarter, "last_day": F.last_day, "make_date": lambda y, m, d: F.make_date(_c(y), _c(m), _c(d)),
    "make_timestamp": lambda y, mo, d, h, mi, s: F.make_timestamp_ntz(*map(_c, (y, mo, d, h, mi, s))),
    "round": lambda x, d=0: F.round(_c(x), int(d)), "floor": F.floor, "ceil ceiling": F.ceil, "abs": F.abs, "sign": F.signum,
    "power pow": lambda a, b: F.pow(_c(a), _c(b)), "sqrt": F.sqrt, "exp": F.exp, "ln": F.ln,
    "log": lambda a, b=None: F.log10(_c(a)) if b is None else F.ln(_c(b)) / F.ln(_c(a)), "log10": F.log10,
    "mod": lambda a, b: _c(a) % F.nullif(_c(b), F.lit(0)), "truncate trunc": truncate, "random rand": F.rand,
    "if iff iif": lambda c, a, b: F.when(_c(c), _c(a)).otherwise(_c(b)),
    "greatest": lambda *a: F.greatest(*map(_c, a)), "least": lambda *a: F.least(*map(_c, a)),
    "to_char": to_char, "to_number": to_number,
    "md5": F.md5, "sha256 sha2": lambda x, bits=256: F.sha2(_c(x), int(bits)), "sha1": F.sha1,
    "array_length cardinality": F.size,
    "json_extract json_value json_extract_text": lambda j, p: F.get_json_object(_c(j), p if str(p).startswith("$") else f"$.{p}"),
    "json_array_length": F.json_array_length,
}
SCALARS = {name: f for names, f in _SCALARS.items() for name in names.split()}

WINDOWS = {
    "row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank, "percent_rank": F.percent_rank, "cume_dist": F.cume_dist,
    "ntile": F.ntile, "lag": F.lag, "lead": F.lead, "first_value": F.first, "last_value": F.last, "nth_value": F.nth_value,
}


def call(name: str, args: list) -> Column:
    """A scalar function; a name that isn't ours is passed through (registered UDFs are reached that way)."""
    if name in SCALARS:
        f = SCALARS[name]
        plain = getattr(f, "__module__", "").startswith("pyspark")
        return f(*[_c(a) for a in args] if plain else args)
    if name in AGGREGATES:
        return aggregate(name, *args)
    return F.call_function(name, *map(_c, args))
