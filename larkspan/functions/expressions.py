"""Typed expressions over named columns.

An expression is a small tree. Binding it to the fields of a frame checks names and types and yields Spark SQL text, so
unknown columns and mismatched types are errors where the query is built; all evaluation is Catalyst's. Text rather than columns:
a step of a query is one call into the JVM, not one for every operator in it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import date, datetime
from typing import Any

from ..schema import ColumnType

# The operators' names in derived column names.
NAMES = {"+": "add", "-": "sub", "*": "mul", "/": "truediv", "//": "floordiv", "%": "mod", "**": "pow", "=": "eq", "!=": "ne", "<": "lt", "<=": "le", ">": "gt", ">=": "ge", "AND": "and", "OR": "or"}
COMPARISONS = {"=", "!=", "<", "<=", ">", ">="}
NUMERIC = {"integer", "float"}


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class Field:
    """A frame's column: the name that queries use, Spark's name, and the kind."""

    name: str
    inner: str
    kind: str

    def sql(self) -> str:
        return quoted(self.inner)


@dataclass(frozen=True)
class Bound:
    sql: str
    kind: str


def last_part(name: str) -> str:
    return name.rpartition(".")[2]


def find(fields: list[Field], name: str) -> Field:
    """By the full name, else by what follows the last dot where that is unambiguous."""
    exact = [f for f in fields if f.name == name]
    loose = exact or [f for f in fields if last_part(f.name) == name]
    if not loose:
        raise ValueError(f"Unknown column {name!r}; there are {', '.join(f.name for f in fields)}")
    if not exact and len(loose) > 1:
        raise ValueError(f"Ambiguous column {name!r}: {', '.join(f.name for f in loose)}")
    return loose[0]


def wrap(x: Any) -> Expression:
    return x if isinstance(x, Expression) else Lit(x)


class Expression:
    """Operators build larger expressions."""

    def name(self) -> str:
        raise NotImplementedError

    def bind(self, fields: list[Field]) -> Bound:
        raise NotImplementedError

    def parts(self) -> list[Expression]:
        return []

    def aggregates(self) -> bool:
        return any(p.aggregates() for p in self.parts())

    def columns(self) -> list[str]:
        """Names of columns outside of aggregates."""
        return [c for p in self.parts() for c in p.columns()]

    def __add__(self, o: Any) -> Expression:
        return Binary("+", self, wrap(o))

    def __radd__(self, o: Any) -> Expression:
        return Binary("+", wrap(o), self)

    def __sub__(self, o: Any) -> Expression:
        return Binary("-", self, wrap(o))

    def __rsub__(self, o: Any) -> Expression:
        return Binary("-", wrap(o), self)

    def __mul__(self, o: Any) -> Expression:
        return Binary("*", self, wrap(o))

    def __rmul__(self, o: Any) -> Expression:
        return Binary("*", wrap(o), self)

    def __truediv__(self, o: Any) -> Expression:
        return Binary("/", self, wrap(o))

    def __rtruediv__(self, o: Any) -> Expression:
        return Binary("/", wrap(o), self)

    def __floordiv__(self, o: Any) -> Expression:
        return Binary("//", self, wrap(o))

    def __rfloordiv__(self, o: Any) -> Expression:
        return Binary("//", wrap(o), self)

    def __mod__(self, o: Any) -> Expression:
        return Binary("%", self, wrap(o))

    def __rmod__(self, o: Any) -> Expression:
        return Binary("%", wrap(o), self)

    def __pow__(self, o: Any) -> Expression:
        return Binary("**", self, wrap(o))

    def __rpow__(self, o: Any) -> Expression:
        return Binary("**", wrap(o), self)

    def __neg__(self) -> Expression:
        return Binary("-", Lit(0), self)

    def __eq__(self, o: object) -> Expression:  # type: ignore[override]
        return Binary("=", self, wrap(o))

    def __ne__(self, o: object) -> Expression:  # type: ignore[override]
        return Binary("!=", self, wrap(o))

    def __lt__(self, o: Any) -> Expression:
        return Binary("<", self, wrap(o))

    def __le__(self, o: Any) -> Expression:
        return Binary("<=", self, wrap(o))

    def __gt__(self, o: Any) -> Expression:
        return Binary(">", self, wrap(o))

    def __ge__(self, o: Any) -> Expression:
        return Binary(">=", self, wrap(o))

    def __and__(self, o: Any) -> Expression:
        return Binary("AND", self, wrap(o))

    def __or__(self, o: Any) -> Expression:
        return Binary("OR", self, wrap(o))

    def __invert__(self) -> Expression:
        return Not(self)

    __hash__ = object.__hash__

    def __bool__(self) -> bool:
        raise TypeError("an expression has no truth value; use & | ~")

    def alias(self, name: str) -> Expression:
        return Alias(self, name)

    def between(self, low: Any, high: Any) -> Expression:
        return (wrap(low) <= self) & (self <= wrap(high))

    def like(self, pattern: str) -> Expression:
        return Like(self, pattern)

    def is_null(self) -> Expression:
        return IsNull(self)

    def is_in(self, *values: Any) -> Expression:
        return In(self, *map(wrap, values))

    def cast(self, to: str) -> Expression:
        return Cast(self, to)

    def over(self, partition_by: list[Any] | None = None, order_by: list[Any] | None = None, rows: tuple[int | None, int | None] | None = None) -> Expression:
        """An aggregate or ranking of a window; `rows` counts from the current one, None is the partition's end."""
        return Over(self, [named(x) for x in partition_by or []], [named(x) for x in order_by or []], rows)

    def descending(self) -> Expression:
        return Descending(self)


class Col(Expression):
    def __init__(self, name: str) -> None:
        self.of = name

    def name(self) -> str:
        return self.of

    def columns(self) -> list[str]:
        return [self.of]

    def bind(self, fields: list[Field]) -> Bound:
        f = find(fields, self.of)
        return Bound(f.sql(), f.kind)


class Lit(Expression):
    def __init__(self, value: Any) -> None:
        self.value = value

    def name(self) -> str:
        return f"lit_{self.value}"

    def bind(self, fields: list[Field]) -> Bound:
        v = self.value
        if isinstance(v, bool):
            return Bound(str(v).lower(), "boolean")
        if isinstance(v, int):
            return Bound(f"({v})" if -(1 << 31) <= v < 1 << 31 else f"({v}L)", "integer")
        if isinstance(v, float):
            return Bound(f"({v!r}D)" if math.isfinite(v) else f"DOUBLE('{v}')", "float")
        if isinstance(v, str):
            return Bound(text_literal(v), "string")
        if isinstance(v, date):
            return Bound(f"TIMESTAMP_NTZ '{v.isoformat()}'", "timestamp")
        raise TypeError(f"no literal for {type(v).__name__}")


class Alias(Expression):
    def __init__(self, of: Expression, name: str) -> None:
        self.of, self.as_name = of, name

    def name(self) -> str:
        return self.as_name

    def parts(self) -> list[Expression]:
        return [self.of]

    def bind(self, fields: list[Field]) -> Bound:
        return self.of.bind(fields)


class Binary(Expression):
    def __init__(self, op: str, left: Expression, right: Expression) -> None:
        self.op, self.left, self.right = op, left, right

    def name(self) -> str:
        return f"{self.left.name()}_{NAMES[self.op]}_{self.right.name()}"

    def parts(self) -> list[Expression]:
        return [self.left, self.right]

    def sides(self, fields: list[Field]) -> tuple[Bound, Bound]:
        a, b = self.left.bind(fields), self.right.bind(fields)
        for mine, other, e in ((a, b, self.left), (b, a, self.right)):
            if mine.kind == "string" and other.kind == "timestamp" and isinstance(e, Lit):
                at = Lit(datetime.fromisoformat(e.value)).bind(fields)
                return (at, b) if e is self.left else (a, at)
        return a, b

    def bind(self, fields: list[Field]) -> Bound:
        a, b = self.sides(fields)
        both = {a.kind, b.kind}
        if self.op in ("AND", "OR"):
            if both != {"boolean"}:
                raise TypeError(f"Type mismatch in binary operation: {a.kind} {self.op} {b.kind}")
            return Bound(f"({a.sql} {self.op} {b.sql})", "boolean")
        if len(both) > 1 and not both <= NUMERIC:
            raise TypeError(f"Type mismatch in binary operation: {a.kind} {self.op} {b.kind}")
        if self.op in COMPARISONS:
            return Bound(f"({a.sql} {self.op} {b.sql})", "boolean")
        if both == {"string"} and self.op == "+":
            return Bound(f"concat({a.sql}, {b.sql})", "string")
        if not both <= NUMERIC:
            raise TypeError(f"Type mismatch in binary operation: {a.kind} {self.op} {b.kind}")
        wide = "float" if "float" in both else "integer"
        if self.op == "/":
            return Bound(f"(CAST({a.sql} AS DOUBLE) / CAST({b.sql} AS DOUBLE))", "float")
        if self.op == "//":
            return Bound(floor_division(a.sql, b.sql, wide), wide)
        if self.op == "**":
            return Bound(f"power({a.sql}, {b.sql})", "float")
        return Bound(f"({a.sql} {self.op} {b.sql})", wide)


def floor_division(a: str, b: str, wide: str) -> str:
    """Whole numbers are divided as such, as doubles are exact up to 2**53 only."""
    if wide == "float":
        return f"CAST(floor(CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE)) AS DOUBLE)"
    return f"(({a} div {b}) - CASE WHEN {a} % {b} <> 0 AND ({a} % {b} < 0) <> ({b} < 0) THEN 1L ELSE 0L END)"


class Not(Expression):
    def __init__(self, of: Expression) -> None:
        self.of = of

    def name(self) -> str:
        return f"not_{self.of.name()}"

    def parts(self) -> list[Expression]:
        return [self.of]

    def bind(self, fields: list[Field]) -> Bound:
        x = self.of.bind(fields)
        if x.kind != "boolean":
            raise TypeError(f"NOT needs a condition, not {x.kind}")
        return Bound(f"(NOT {x.sql})", "boolean")


class IsNull(Expression):
    def __init__(self, of: Expression) -> None:
        self.of = of

    def name(self) -> str:
        return f"{self.of.name()}_is_null"

    def parts(self) -> list[Expression]:
        return [self.of]

    def bind(self, fields: list[Field]) -> Bound:
        return Bound(f"({self.of.bind(fields).sql} IS NULL)", "boolean")


class Like(Expression):
    """% and _ are wildcards; there is no escape character."""

    def __init__(self, of: Expression, pattern: str) -> None:
        self.of, self.pattern = of, pattern

    def name(self) -> str:
        return f"{self.of.name()}_like_{self.pattern}"

    def parts(self) -> list[Expression]:
        return [self.of]

    def bind(self, fields: list[Field]) -> Bound:
        x = self.of.bind(fields)
        if x.kind != "string":
            raise TypeError(f"LIKE needs a string, not {x.kind}")
        return Bound("(" + x.sql + " LIKE " + text_literal(self.pattern.replace("\\", "\\\\")) + ")", "boolean")


class In(Expression):
    def __init__(self, of: Expression, *values: Expression) -> None:
        self.of = (of, *values)

    def name(self) -> str:
        return "_".join([self.of[0].name(), "in", *(x.name() for x in self.of[1:])])

    def parts(self) -> list[Expression]:
        return list(self.of)

    def bind(self, fields: list[Field]) -> Bound:
        first, *rest = self.of
        return Bound("(" + " OR ".join(Binary("=", first, x).bind(fields).sql for x in rest) + ")", "boolean")


CASTS = {"INTEGER": ("integer", "BIGINT"), "INT": ("integer", "INT"), "BIGINT": ("integer", "BIGINT"), "FLOAT": ("float", "DOUBLE"), "DOUBLE": ("float", "DOUBLE"), "STRING": ("string", "STRING"), "VARCHAR": ("string", "STRING"), "TIMESTAMP": ("timestamp", "TIMESTAMP_NTZ"), "BOOLEAN": ("boolean", "BOOLEAN")}


class Cast(Expression):
    def __init__(self, of: Expression, to: str | ColumnType) -> None:
        self.of, self.to = of, (to.value if isinstance(to, ColumnType) else to).upper()

    def name(self) -> str:
        return f"{self.of.name()}_as_{self.to.lower()}"

    def parts(self) -> list[Expression]:
        return [self.of]

    def bind(self, fields: list[Field]) -> Bound:
        if self.to not in CASTS:
            raise ValueError(f"no type {self.to}; there are {', '.join(CASTS)}")
        kind, to = CASTS[self.to]
        return Bound(f"CAST({self.of.bind(fields).sql} AS {to})", kind)


def one_kind(kinds: list[str], what: str) -> str:
    found = {k for k in kinds if k != "void"}
    if len(found) > 1 and not found <= NUMERIC:
        raise TypeError(f"{what} needs values of one type, not {', '.join(sorted(found))}")
    return "float" if len(found) > 1 else next(iter(found), "void")


class Null(Expression):
    def name(self) -> str:
        return "null"

    def bind(self, fields: list[Field]) -> Bound:
        return Bound("NULL", "void")


class Case(Expression):
    """CASE WHEN condition THEN value .. [ELSE value] END: `of` holds conditions and values in turn, then the last value."""

    def __init__(self, *of: Expression) -> None:
        self.of = of

    def name(self) -> str:
        return "_".join(["case", *(x.name() for x in self.of)])

    def parts(self) -> list[Expression]:
        return list(self.of)

    def when(self, condition: Expression, value: Any) -> Case:
        return Case(*self.of[:-1], condition, wrap(value), self.of[-1])

    def otherwise(self, value: Any) -> Case:
        return Case(*self.of[:-1], wrap(value))

    def bind(self, fields: list[Field]) -> Bound:
        bound = [x.bind(fields) for x in self.of]
        if any(b.kind != "boolean" for b in bound[:-1:2]):
            raise TypeError("WHEN needs a condition")
        kind = one_kind([b.kind for b in [*bound[1::2], bound[-1]]], "CASE")
        arms = " ".join(f"WHEN {c.sql} THEN {v.sql}" for c, v in zip(bound[:-1:2], bound[1::2], strict=True))
        return Bound(f"(CASE {arms} ELSE {bound[-1].sql} END)", kind)


# Aggregates: the kind of their results, None for their argument's, and whether they need numbers.
AGGREGATES = {"sum": (None, True), "avg": ("float", True), "min": (None, False), "max": (None, False), "count": ("integer", False), "stddev": ("float", True), "variance": ("float", True), "median": ("float", True), "first": (None, False), "last": (None, False)}
RANKINGS = {"row_number", "rank", "dense_rank"}


class Aggregate(Expression):
    def __init__(self, function: str, of: Expression | None = None, distinct: bool = False) -> None:
        self.function, self.of, self.distinct = function, of, distinct

    def name(self) -> str:
        return "_".join([self.function, *["distinct"] * self.distinct, *([] if self.of is None else [self.of.name()])])

    def parts(self) -> list[Expression]:
        return [] if self.of is None else [self.of]

    def aggregates(self) -> bool:
        return True

    def columns(self) -> list[str]:
        return []

    def bind(self, fields: list[Field]) -> Bound:
        if self.of is None:
            return Bound("count(1)", "integer")
        if self.of.aggregates():
            raise ValueError("an aggregate of an aggregate")
        x = self.of.bind(fields)
        kind, numbers = AGGREGATES[self.function]
        if numbers and x.kind not in NUMERIC:
            raise TypeError(f"{self.function} needs numbers, not {x.kind}")
        return Bound(f"{self.function}({'DISTINCT ' * self.distinct}{x.sql})", kind or x.kind)


class Ranking(Expression):
    def __init__(self, function: str) -> None:
        self.function = function

    def name(self) -> str:
        return self.function

    def bind(self, fields: list[Field]) -> Bound:
        raise ValueError(f"{self.function} needs a window")


class Descending(Expression):
    def __init__(self, of: Expression) -> None:
        self.of = of

    def name(self) -> str:
        return f"{self.of.name()}_desc"

    def parts(self) -> list[Expression]:
        return [self.of]

    def bind(self, fields: list[Field]) -> Bound:
        x = self.of.bind(fields)
        return Bound(f"{x.sql} DESC", x.kind)


class Over(Expression):
    def __init__(self, of: Expression, partition: list[Expression], order: list[Expression], rows: tuple[int | None, int | None] | None) -> None:
        if not isinstance(of, (Aggregate, Ranking)):
            raise TypeError("only aggregates and rankings have windows")
        self.what, self.partition, self.order, self.rows = of, partition, order, rows

    def name(self) -> str:
        return f"{self.what.name()}_over"

    def parts(self) -> list[Expression]:
        return [*self.what.parts(), *self.partition, *self.order]

    def bind(self, fields: list[Field]) -> Bound:
        x = Bound(f"{self.what.function}()", "integer") if isinstance(self.what, Ranking) else self.what.bind(fields)
        each = lambda xs: ", ".join(e.bind(fields).sql for e in xs)
        window = [f"PARTITION BY {each(self.partition)}"] * bool(self.partition) + [f"ORDER BY {each(self.order)}"] * bool(self.order)
        if self.rows:
            ends = [("UNBOUNDED " + side) if n is None else "CURRENT ROW" if not n else f"{abs(n)} {'PRECEDING' if n < 0 else 'FOLLOWING'}" for n, side in zip(self.rows, ("PRECEDING", "FOLLOWING"), strict=True)]
            window.append(f"ROWS BETWEEN {ends[0]} AND {ends[1]}")
        return Bound(f"{x.sql} OVER ({' '.join(window)})", x.kind)


# Functions of values: Spark's name, the kinds of the arguments (the last one's for further ones), the result's kind (None: the arguments').
CALLS = {
    "concat": ("concat", ["string"], "string", 1, 99), "upper": ("upper", ["string"], "string", 1, 1), "lower": ("lower", ["string"], "string", 1, 1), "trim": ("trim", ["string"], "string", 1, 1),
    "length": ("length", ["string"], "integer", 1, 1), "substring": ("substring", ["string", "integer"], "string", 2, 3), "replace": ("replace", ["string"], "string", 3, 3), "round": ("round", ["number", "integer"], None, 2, 2),
    "abs": ("abs", ["number"], None, 1, 1), "sqrt": ("sqrt", ["number"], "float", 1, 1), "exp": ("exp", ["number"], "float", 1, 1), "ln": ("ln", ["number"], "float", 1, 1),
    "floor": ("floor", ["number"], "integer", 1, 1), "ceil": ("ceil", ["number"], "integer", 1, 1), "year": ("year", ["timestamp"], "integer", 1, 1), "month": ("month", ["timestamp"], "integer", 1, 1),
    "day": ("day", ["timestamp"], "integer", 1, 1), "hour": ("hour", ["timestamp"], "integer", 1, 1), "coalesce": ("coalesce", ["any"], None, 1, 99), "nullif": ("nullif", ["any"], None, 2, 2),
    "json_value": ("get_json_object", ["string"], "string", 2, 2), "size": ("size", ["array"], "integer", 1, 1), "date_trunc": ("date_trunc", ["string", "timestamp"], "timestamp", 2, 2),
    "greatest": ("greatest", ["any"], None, 2, 99), "least": ("least", ["any"], None, 2, 99),
}


class Call(Expression):
    def __init__(self, function: str, *of: Expression) -> None:
        self.function, self.of = function, of

    def name(self) -> str:
        return "_".join([self.function, *(x.name() for x in self.of)])

    def parts(self) -> list[Expression]:
        return list(self.of)

    def bind(self, fields: list[Field]) -> Bound:
        spark, kinds, result, least, most = CALLS[self.function]
        if not least <= len(self.of) <= most:
            raise ValueError(f"{self.function} takes {least} to {most} arguments, not {len(self.of)}")
        bound = [x.bind(fields) for x in self.of]
        wanted = kinds + kinds[-1:] * (len(bound) - len(kinds))
        for b, want in zip(bound, wanted, strict=False):
            if b.kind not in (NUMERIC if want == "number" else {want, "void"}) and want != "any":
                raise TypeError(f"{self.function.upper()} needs {want}s, not {b.kind}")
        same = bound[:1] if self.function == "round" else bound
        return Bound(f"{spark}({', '.join(b.sql for b in bound)})", result or one_kind([b.kind for b in same], self.function.upper()))


def named(x: Any) -> Expression:
    return Col(x) if isinstance(x, str) else x


class F:
    """The functions: aggregates, rankings, and those of CALLS by their names."""

    @staticmethod
    def sum(x: Any, distinct: bool = False) -> Expression:
        return Aggregate("sum", wrap(x), distinct)

    @staticmethod
    def min(x: Any) -> Expression:
        return Aggregate("min", wrap(x))

    @staticmethod
    def max(x: Any) -> Expression:
        return Aggregate("max", wrap(x))

    @staticmethod
    def avg(x: Any, distinct: bool = False) -> Expression:
        return Aggregate("avg", wrap(x), distinct)

    @staticmethod
    def count(x: Any = None, distinct: bool = False) -> Expression:
        return Aggregate("count", None if x is None else wrap(x), distinct and x is not None)

    @staticmethod
    def aggregate(function: str, x: Any) -> Expression:
        """stddev, variance, median, first or last; the last two are of any row unless rows are ordered."""
        return Aggregate(function, wrap(x))

    @staticmethod
    def row_number() -> Expression:
        return Ranking("row_number")

    @staticmethod
    def rank() -> Expression:
        return Ranking("rank")

    @staticmethod
    def dense_rank() -> Expression:
        return Ranking("dense_rank")

    @staticmethod
    def when(condition: Expression, value: Any) -> Case:
        return Case(condition, wrap(value), Null())

    @staticmethod
    def concat(*x: Any) -> Expression:
        return Call("concat", *map(wrap, x))

    @staticmethod
    def round(x: Any, digits: int = 0) -> Expression:
        return Call("round", wrap(x), Lit(digits))

    @staticmethod
    def call(function: str, *x: Any) -> Expression:
        if function not in CALLS:
            raise ValueError(f"unknown function {function}; there are {', '.join(CALLS)}")
        return Call(function, *map(wrap, x))


def floor_mod(a: Any, b: Any) -> Expression:
    """The remainder with the divisor's sign; `%` has the dividend's."""
    return wrap(a) - wrap(b) * (wrap(a) // wrap(b))
