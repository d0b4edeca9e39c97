"""Expressions: a small tree that is built in Python or parsed from SQL text, walked for column references, and compiled to
Spark columns. A tree needs no parentheses, so grouping is always what was written."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from . import functions as library
from .errors import InvalidReference
from .types import parse_type


class Expr:
    def __add__(self, o):
        return Binary("+", self, wrap(o))

    def __sub__(self, o):
        return Binary("-", self, wrap(o))

    def __mul__(self, o):
        return Binary("*", self, wrap(o))

    def __truediv__(self, o):
        return Binary("/", self, wrap(o))

    def __mod__(self, o):
        return Binary("%", self, wrap(o))

    def __radd__(self, o):
        return Binary("+", wrap(o), self)

    def __rsub__(self, o):
        return Binary("-", wrap(o), self)

    def __rmul__(self, o):
        return Binary("*", wrap(o), self)

    def __rtruediv__(self, o):
        return Binary("/", wrap(o), self)

    def __neg__(self):
        return Unary("-", self)

    def __and__(self, o):
        return Binary("and", self, wrap(o))

    def __or__(self, o):
        return Binary("or", self, wrap(o))

    def __invert__(self):
        return Unary("not", self)

    def eq(self, o):
        return Binary("=", self, wrap(o))

    def ne(self, o):
        return Binary("<>", self, wrap(o))

    def gt(self, o):
        return Binary(">", self, wrap(o))

    def gte(self, o):
        return Binary(">=", self, wrap(o))

    def lt(self, o):
        return Binary("<", self, wrap(o))

    def lte(self, o):
        return Binary("<=", self, wrap(o))

    def like(self, pattern, escape=None):
        return Like(self, wrap(pattern), escape)

    def not_like(self, pattern, escape=None):
        return Unary("not", Like(self, wrap(pattern), escape))

    def ilike(self, pattern):
        return Like(self, wrap(pattern), None, True)

    def is_in(self, values):
        return In(self, tuple(map(wrap, values)))

    def not_in(self, values):
        return In(self, tuple(map(wrap, values)), True)

    def between(self, low, high):
        return Between(self, wrap(low), wrap(high))

    def is_null(self):
        return IsNull(self)

    def is_not_null(self):
        return IsNull(self, True)

    def concat(self, o):
        return Binary("||", self, wrap(o))

    def cast(self, kind):
        return Cast(self, kind)

    def try_cast(self, kind):
        return Cast(self, kind, True)

    def children(self) -> Iterator[Expr]:
        for f in fields(self):
            yield from _inside(getattr(self, f.name))

    def columns(self) -> Iterator[Col]:
        """All column references, in order."""
        if isinstance(self, Col):
            yield self
        for child in self.children():
            yield from child.columns()


def _inside(value) -> Iterator[Expr]:
    if isinstance(value, Expr):
        yield value
    elif isinstance(value, tuple):
        for v in value:
            yield from _inside(v)


def wrap(value) -> Expr:
    return value if isinstance(value, Expr) else Lit(value)


@dataclass(frozen=True)
class Col(Expr):
    name: str
    entity: str | None = None


@dataclass(frozen=True)
class Lit(Expr):
    value: object


@dataclass(frozen=True)
class Star(Expr):
    pass


@dataclass(frozen=True)
class Interval(Expr):
    amount: int
    unit: str


@dataclass(frozen=True)
class Unary(Expr):
    op: str
    operand: Expr


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Like(Expr):
    operand: Expr
    pattern: Expr
    escape: str | None = None
    any_case: bool = False


@dataclass(frozen=True)
class In(Expr):
    operand: Expr
    items: tuple
    negated: bool = False


@dataclass(frozen=True)
class Between(Expr):
    operand: Expr
    low: Expr
    high: Expr


@dataclass(frozen=True)
class IsNull(Expr):
    operand: Expr
    negated: bool = False


@dataclass(frozen=True)
class Case(Expr):
    whens: tuple
    otherwise: Expr | None = None
    operand: Expr | None = None


@dataclass(frozen=True)
class Cast(Expr):
    operand: Expr
    kind: str
    lenient: bool = False


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple = ()
    distinct: bool = False
    where: Expr | None = None


@dataclass(frozen=True)
class Over(Expr):
    call: Call
    partition: tuple = ()
    order: tuple = ()  # (expression, descending, nulls first or None)
    frame: tuple | None = field(default=None)  # (unit, start, end); None is unbounded, 0 the current row


@dataclass(frozen=True)
class Raw(Expr):
    """Spark SQL text as it is, but for references in braces: "{customer.c_name} rlike '^A'"."""

    text: str
    references: tuple


_REFERENCE = re.compile(r"\{([A-Za-z_]\w*)(?:\.([A-Za-z_]\w*))?\}")


def raw(text: str) -> Raw:
    return Raw(text, tuple(Col(m[2], m[1]) if m[2] else Col(m[1]) for m in _REFERENCE.finditer(text)))


def compile_raw(e: Raw, resolve: Resolve) -> Column:
    names = []
    for c in e.references:
        shown = re.fullmatch(r"Column<'([\w.]+)'>", str(resolve(c)))
        if not shown:
            raise InvalidReference(f"raw SQL can't name {c.name}: give the column a plain name")
        names.append(".".join(f"`{part}`" for part in shown[1].split(".")))
    left = iter(names)
    return F.expr(_REFERENCE.sub(lambda _: next(left), e.text))


Resolve = Callable[[Col], Column]


def quotient(a: Column, b: Column) -> Column:
    """Division that gives null for a zero divisor."""
    return a / F.nullif(b, F.lit(0))


_BINARY = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": quotient,
    "%": lambda a, b: a % F.nullif(b, F.lit(0)),
    "||": F.concat,
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "and": lambda a, b: a & b,
    "or": lambda a, b: a | b,
}


def compile(e: Expr, resolve: Resolve) -> Column:
    """The Spark column of an expression; resolve gives the column of a reference."""
    c = lambda x: compile(x, resolve)
    match e:
        case Col():
            return resolve(e)
        case Lit(value):
            return F.lit(value)
        case Star():
            return F.expr("*")
        case Raw():
            return compile_raw(e, resolve)
        case Interval(amount, unit):
            return F.expr(f"interval {int(amount)} {unit}")
        case Unary("not", x):
            return ~c(x)
        case Unary(_, x):
            return -c(x)
        case Binary("+" | "-" as op, x, Interval(amount, unit)):
            return library.call("date_add", [c(x), amount if op == "+" else -amount, unit])
        case Binary(op, x, y):
            return _BINARY[op](c(x), c(y))
        case Like(x, pattern, escape, any_case):
            name = "ilike" if any_case else "like"
            return F.call_function(name, c(x), c(pattern), *([F.lit(escape)] if escape else []))
        case In(x, items, negated):
            if not items:
                return F.lit(negated)
            found = c(x).isin([i.value for i in items]) if all(isinstance(i, Lit) for i in items) else c(x).isin([c(i) for i in items])
            return ~found if negated else found
        case Between(x, low, high):
            return c(x).between(c(low), c(high))
        case IsNull(x, negated):
            return c(x).isNotNull() if negated else c(x).isNull()
        case Case(whens, otherwise, operand):
            out = F
            for condition, value in whens:
                out = out.when(c(condition) if operand is None else c(operand) == c(condition), c(value))
            return out.otherwise(c(otherwise)) if otherwise is not None else out
        case Cast(x, kind, lenient):
            return c(x).try_cast(parse_type(kind)) if lenient else c(x).cast(parse_type(kind))
        case Over(call, partition, order, frame):
            return compile_window(call, [c(p) for p in partition], [sorted_by(c(x), down, first) for x, down, first in order], frame, resolve)
        case Call(name, args, distinct, where):
            return compile_call(name, args, distinct, where, resolve)
    raise InvalidReference(f"no such expression: {e!r}")


def sorted_by(column: Column, descending: bool = False, nulls_first: bool | None = None) -> Column:
    """Explicit null order; by default nulls come last."""
    if descending:
        return column.desc_nulls_first() if nulls_first else column.desc_nulls_last()
    return column.asc_nulls_first() if nulls_first else column.asc_nulls_last()


def compile_call(name: str, args: tuple, distinct: bool, where: Expr | None, resolve: Resolve) -> Column:
    lowered = name.lower()
    if lowered in library.AGGREGATES:
        star = not args or isinstance(args[0], Star)
        column = F.lit(1) if star else compile(args[0], resolve)
        if where is not None:
            column = F.when(compile(where, resolve), column)
        rest = [a.value if isinstance(a, Lit) else compile(a, resolve) for a in args[1:]]
        return library.aggregate("count_distinct" if distinct and lowered == "count" else lowered, column, *rest)
    return library.call(lowered, [a.value if isinstance(a, Lit) else compile(a, resolve) for a in args])


def compile_window(call: Call, partition: list[Column], order: list[Column], frame: tuple | None, resolve: Resolve) -> Column:
    name = call.name.lower()
    if frame and not order:
        raise ValueError("a frame needs ORDER BY")
    w = Window.partitionBy(*partition).orderBy(*order) if order else Window.partitionBy(*partition)
    if frame:
        unit, start, end = frame
        low = Window.unboundedPreceding if start is None else start
        high = Window.unboundedFollowing if end is None else end
        if unit == "groups":
            raise ValueError("GROUPS frames need operators.windows.groups_frame")
        w = w.rowsBetween(low, high) if unit == "rows" else w.rangeBetween(low, high)
    if name in library.WINDOWS:
        return library.WINDOWS[name](*[a.value if isinstance(a, Lit) and i else compile(a, resolve) if isinstance(a, Expr) and not (isinstance(a, Lit) and name == "ntile") else a.value for i, a in enumerate(call.args)]).over(w)
    return compile_call(call.name, call.args, call.distinct, call.where, resolve).over(w)


# --- SQL text -----------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"""\s*(?:(?P<number>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+|\d+(?:[eE][+-]?\d+)?)|'(?P<string>(?:[^']|'')*)'|"(?P<quoted>[^"]+)"|(?P<name>[A-Za-z_][A-Za-z_0-9]*)|(?P<op><>|!=|<=|>=|\|\||->>|->|[-+*/%=<>(),.]))""")


class Parser:
    """Recursive descent over one SQL expression."""

    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise InvalidReference(f"cannot read {text[at:]!r} in {text!r}")
            kind = m.lastgroup
            self.tokens.append((kind, m[kind].replace("''", "'") if kind == "string" else m[kind]))
            at = m.end()
        self.at = 0

    def peek(self, *words: str) -> bool:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        return kind in ("name", "op") and value.lower() in words

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.at += 1
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            raise InvalidReference(f"{word} expected in {self.text!r}")

    def next(self):
        if self.at >= len(self.tokens):
            raise InvalidReference(f"{self.text!r} ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self) -> Expr:
        e = self.either()
        if self.at < len(self.tokens):
            raise InvalidReference(f"unexpected {self.tokens[self.at][1]!r} in {self.text!r}")
        return e

    def either(self) -> Expr:
        e = self.both()
        while self.take("or"):
            e = Binary("or", e, self.both())
        return e

    def both(self) -> Expr:
        e = self.negation()
        while self.take("and"):
            e = Binary("and", e, self.negation())
        return e

    def negation(self) -> Expr:
        return Unary("not", self.negation()) if self.take("not") else self.comparison()

    def comparison(self) -> Expr:
        e = self.sum()
        while True:
            if self.peek("=", "<>", "!=", "<", "<=", ">", ">="):
                op = self.next()[1]
                e = Binary("<>" if op == "!=" else op, e, self.sum())
            elif self.take("is"):
                negated = self.take("not")
                self.need("null")
                e = IsNull(e, negated)
            elif self.peek("not", "in", "between", "like", "ilike"):
                negated = self.take("not")
                if self.take("in"):
                    self.need("(")
                    items = []
                    while not self.take(")"):
                        items.append(self.either())
                        self.take(",")
                    e = In(e, tuple(items), negated)
                    continue
                if self.take("between"):
                    low = self.sum()
                    self.need("and")
                    found = Between(e, low, self.sum())
                else:
                    any_case = self.next()[1].lower() == "ilike"
                    pattern = self.sum()
                    found = Like(e, pattern, self.next()[1] if self.take("escape") else None, any_case)
                e = Unary("not", found) if negated else found
            else:
                return e

    def sum(self) -> Expr:
        e = self.product()
        while self.peek("+", "-", "||"):
            e = Binary(self.next()[1], e, self.product())
        return e

    def product(self) -> Expr:
        e = self.factor()
        while self.peek("*", "/", "%"):
            e = Binary(self.next()[1], e, self.factor())
        return e

    def factor(self) -> Expr:
        if self.take("-"):
            return Unary("-", self.factor())
        e = self.primary()
        while self.peek("->", "->>"):
            name = "json_extract" if self.next()[1] == "->" else "json_extract_text"
            e = Call(name, (e, self.primary()))
        return e

    def primary(self) -> Expr:
        kind, value = self.next()
        if kind == "number":
            return Lit(int(value) if value.isdigit() else float(value))
        if kind == "string":
            return Lit(value)
        if kind == "op" and value == "(":
            e = self.either()
            self.need(")")
            return e
        if kind == "op" and value == "*":
            return Star()
        if kind == "op":
            raise InvalidReference(f"unexpected {value!r} in {self.text!r}")
        word = value.lower() if kind == "name" else ""
        if word in ("null", "true", "false"):
            return Lit({"null": None, "true": True, "false": False}[word])
        if word == "case":
            return self.case()
        if word in ("cast", "try_cast") and self.take("("):
            e = self.either()
            self.need("as")
            name = self.next()[1]
            if self.take("("):
                sizes = []
                while not self.take(")"):
                    sizes.append(self.next()[1])
                    self.take(",")
                name += f"({', '.join(sizes)})"
            self.need(")")
            return Cast(e, name, word == "try_cast")
        if word == "interval":
            amount = self.next()[1]
            parts = str(amount).split()
            return Interval(int(parts[0]), parts[1] if len(parts) > 1 else self.next()[1])
        if word in ("date", "timestamp") and self.at < len(self.tokens) and self.tokens[self.at][0] == "string":
            return Cast(Lit(self.next()[1]), word)
        if word in ("select", "exists"):
            raise InvalidReference("an expression can't hold a subquery")
        if word == "current_date" or word == "current_timestamp":
            if self.take("("):
                self.need(")")
            return Call(word)
        if self.take("("):
            return self.call(value, word)
        if self.take("."):
            return Col(self.next()[1], value)
        return Col(value)

    def call(self, name: str, word: str) -> Expr:
        distinct, args = self.take("distinct"), []
        while not self.take(")"):
            if word == "extract" and not args and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][1].lower() == "from":
                args.append(Lit(self.next()[1]))
                self.need("from")
                continue
            args.append(self.either())
            self.take(",")
        if word in library.UNIT_FIRST and args and isinstance(args[0], Col):
            args[0] = Lit(args[0].name)
        if word in library.UNIT_LAST and len(args) == 3 and isinstance(args[2], Col):
            args[2] = Lit(args[2].name)
        call = Call(name, tuple(args), distinct)
        if self.take("filter"):
            self.need("(")
            self.need("where")
            call = Call(name, tuple(args), distinct, self.either())
            self.need(")")
        return self.over(call) if self.take("over") else call

    def over(self, call: Call) -> Expr:
        if not self.take("("):
            raise InvalidReference("named windows aren't supported")
        partition, order, frame = [], [], None
        if self.take("partition"):
            self.need("by")
            partition.append(self.either())
            while self.take(","):
                partition.append(self.either())
        if self.take("order"):
            self.need("by")
            while True:
                e = self.either()
                descending = self.take("desc") or (self.take("asc") and False)
                first = None
                if self.take("nulls"):
                    first = self.next()[1].lower() == "first"
                order.append((e, descending, first))
                if not self.take(","):
                    break
        if self.peek("rows", "range", "groups"):
            unit = self.next()[1].lower()
            if self.take("between"):
                start = self.bound()
                self.need("and")
                frame = (unit, start, self.bound())
            else:
                frame = (unit, self.bound(), 0)
        self.need(")")
        return Over(call, tuple(partition), tuple(order), frame)

    def bound(self) -> int | None:
        if self.take("unbounded"):
            self.next()
            return None
        if self.take("current"):
            self.need("row")
            return 0
        kind, value = self.next()
        if kind != "number" or not value.isdigit():
            raise ValueError(f"a frame's bound must be a number of rows: {value!r}")
        return -int(value) if self.next()[1].lower() == "preceding" else int(value)

    def case(self) -> Expr:
        operand = None if self.peek("when") else self.either()
        whens = []
        while self.take("when"):
            condition = self.either()
            self.need("then")
            whens.append((condition, self.either()))
        otherwise = self.either() if self.take("else") else None
        self.need("end")
        return Case(tuple(whens), otherwise, operand)


def parse(text: str) -> Expr:
    return Parser(text).whole()


def expression(value: str | Expr) -> Expr:
    return parse(value) if isinstance(value, str) else value
