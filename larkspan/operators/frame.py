"""The frame: an immutable plan that checks names and types as it grows, and leaves the rest to Spark."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as SF

from ..errors import GroupByError
from ..functions.expressions import Aggregate, Alias, Binary, Bound, Col, Expression, Field, Lit, Over, find, last_part, quoted
from ..schema import kind
from ..sources import read_table

JOINS = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "full": "full", "semi": "left_semi", "anti": "left_anti"}


def listed(bound: list[tuple[str, Bound]]) -> list[str]:
    return [f"{b.sql} AS {quoted(n)}" for n, b in bound]


class Frame:
    def __init__(self, df: DataFrame, fields: list[Field] | None = None) -> None:
        self.df = df
        self.fields = fields if fields is not None else [Field(f.name, f.name, kind(f.dataType)) for f in df.schema]

    @staticmethod
    def table(spark: SparkSession, path: str) -> Frame:
        return Frame(read_table(spark, path))

    @property
    def schema(self) -> list[tuple[str, str]]:
        return [(f.name, f.kind) for f in self.fields]

    def alias(self, name: str) -> Frame:
        """Every column becomes `name.column`; the bare name still works where it is unambiguous."""
        return Frame(self.df, [Field(f"{name}.{last_part(f.name)}", f.inner, f.kind) for f in self.fields])

    def expand(self, columns: tuple[Any, ...]) -> list[Expression]:
        out: list[Expression] = []
        for c in columns:
            e = Col(c) if isinstance(c, str) else c
            if isinstance(e, Col) and e.of == "*":
                out += [Col(f.name) for f in self.fields]
            else:
                out.append(e)
        return out

    def select(self, *columns: Any) -> Frame:
        """Columns, `*` any number of times, expressions; aggregates without a grouping are of all rows."""
        items = self.expand(columns)
        if any(e.aggregates() for e in items) and (left := [c for e in items for c in e.columns()]):
            raise GroupByError(f"column {left[0]!r} is neither grouped by nor aggregated")
        bound = [(e.name(), e.bind(self.fields)) for e in items]
        inner = [f"c{i}" for i in range(len(bound))] if len({n for n, _ in bound}) < len(bound) else [n for n, _ in bound]
        df = self.df.selectExpr(*listed([(i, b) for (_, b), i in zip(bound, inner, strict=True)]))
        return Frame(df, [Field(n, i, b.kind) for (n, b), i in zip(bound, inner, strict=True)])

    def filter(self, condition: Expression) -> Frame:
        if not isinstance(condition, Expression):
            raise TypeError("a filter needs a condition")
        bound = condition.bind(self.fields)
        if bound.kind != "boolean":
            raise TypeError(f"a filter needs a condition, not {bound.kind}")
        return Frame(self.df.filter(bound.sql), self.fields)

    where = filter

    def group_by(self, *keys: Any) -> Grouped:
        return Grouped(self, [Col(k) if isinstance(k, str) else k for k in keys])

    def rollup(self, *keys: Any) -> Grouped:
        """Groups by all keys, by all but the last, and so on to one group of all rows; left-out keys are null."""
        return Grouped(self, [Col(k) if isinstance(k, str) else k for k in keys], "rollup")

    def cube(self, *keys: Any) -> Grouped:
        """Groups by each subset of the keys."""
        return Grouped(self, [Col(k) if isinstance(k, str) else k for k in keys], "cube")

    def explode(self, column: str, name: str) -> Frame:
        """A row for each item of an array, as `name`; rows without items go."""
        df = self.df.withColumn(name, SF.explode(SF.expr(find(self.fields, column).sql())))
        return Frame(df, [*self.fields, Field(name, name, kind(df.schema[name].dataType))])

    def join(self, other: Frame, on: Expression | list[str] | str, how: str = "inner") -> Frame:
        """Any condition, or names that both sides have, which then come once (from the side that has all rows).

        Equalities of columns become hash or merge joins, as Spark sees fit. `semi` and `anti` keep this frame's columns alone.
        """
        if how not in JOINS:
            raise ValueError(f"unknown join {how!r}; there are {', '.join(JOINS)}")
        taken = {f.inner for f in self.fields}
        new, free = {}, 0
        for f in other.fields:
            inner = f.inner
            while inner in taken:
                free += 1
                inner = f"{f.inner}#{free}"
            taken.add(inner)
            new[f.inner] = inner
        moved = [Field(f.name, new[f.inner], f.kind) for f in other.fields]
        right = other.df.selectExpr(*listed([(new[f.inner], Bound(f.sql(), f.kind)) for f in other.fields]))
        shared = [on] if isinstance(on, str) else on if isinstance(on, list) else []
        if shared:
            pairs = [(find(self.fields, n), find(moved, n)) for n in shared]
            if odd := [n for n, (x, y) in zip(shared, pairs, strict=True) if x.kind != y.kind]:
                raise TypeError(f"column {odd[0]!r} has different types")
            condition = " AND ".join(f"{x.sql()} = {y.sql()}" for x, y in pairs)
        else:
            bound = on.bind(self.fields + moved)
            if bound.kind != "boolean":
                raise TypeError(f"a join needs a condition, not {bound.kind}")
            condition = bound.sql
        df = self.df.join(right, SF.expr(condition), JOINS[how])
        if how in ("semi", "anti"):
            return Frame(df, self.fields)
        if not shared:
            return Frame(df, self.fields + moved)
        once = {x.inner: Bound(f"coalesce({x.sql()}, {y.sql()})", x.kind) for x, y in pairs}
        dropped = {y.inner for _, y in pairs}
        fields = self.fields + [f for f in moved if f.inner not in dropped]
        return Frame(df.selectExpr(*listed([(f.inner, once.get(f.inner, Bound(f.sql(), f.kind))) for f in fields])), fields)

    def asof_join(self, other: Frame, time: tuple[str, str], by: list[tuple[str, str]]) -> Frame:
        """Each row with the other's latest row of its keys that is no later than it, or nulls. `time` and `by` name columns of either side.

        Both sides are sorted together by key and time and swept once: there is no join, and no pair is made that isn't kept.
        """
        taken = {f.inner for f in self.fields}
        moved = [Field(f.name, f"{f.inner}#of" if f.inner in taken else f.inner, f.kind) for f in other.fields]
        key = lambda f, names: [find(f.fields, n).sql() for n in names]
        own_keys, other_keys = key(self, [x for x, _ in by]), key(other, [y for _, y in by])
        keys = [f"`key#{i}`" for i in range(len(by))]
        struct = lambda fields: "struct(" + ", ".join(f.sql() for f in fields) + ")"
        left = self.df.selectExpr(*[f"{k} AS {n}" for k, n in zip(own_keys, keys, strict=True)], f"{find(self.fields, time[0]).sql()} AS `at#`", "1 AS `side#`", f"{struct(self.fields)} AS `own#`")
        right = other.df.selectExpr(*[f"{k} AS {n}" for k, n in zip(other_keys, keys, strict=True)], f"{find(other.fields, time[1]).sql()} AS `at#`", "0 AS `side#`", f"{struct(other.fields)} AS `of#`")
        both = left.unionByName(right.filter("`at#` IS NOT NULL"), allowMissingColumns=True)
        window = f"PARTITION BY {', '.join(keys)} ORDER BY `at#`, `side#` ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW" if keys else "ORDER BY `at#`, `side#` ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
        none = " OR ".join([f"{k} IS NULL" for k in [*keys, "`at#`"]])
        swept = both.selectExpr("*", f"CASE WHEN NOT ({none}) THEN last(`of#`, true) OVER ({window}) END AS `last#`").filter("`side#` = 1")
        out = [f"`own#`.{f.sql()} AS {f.sql()}" for f in self.fields] + [f"`last#`.{f.sql()} AS {quoted(m.inner)}" for f, m in zip(other.fields, moved, strict=True)]
        return Frame(swept.selectExpr(*out), self.fields + moved)

    def cross_join(self, other: Frame) -> Frame:
        return self.join(other, Lit(True))

    def order_by(self, *columns: Any, descending: bool = False) -> Frame:
        keys = [SF.expr(e.bind(self.fields).sql) for e in self.expand(columns)]
        return Frame(self.df.orderBy(*[k.desc() if descending else k.asc() for k in keys]), self.fields)

    def limit(self, n: int) -> Frame:
        return Frame(self.df.limit(n), self.fields)

    def distinct(self) -> Frame:
        return Frame(self.df.distinct(), self.fields)

    def matching(self, other: Frame) -> DataFrame:
        """The other frame's columns under this one's names, if their names and types agree, in whatever order."""
        own, others = ({last_part(n): k for n, k in f.schema} for f in (self, other))
        if own != others or len(self.fields) != len(other.fields):
            raise TypeError(f"columns differ: {self.schema} and {other.schema}")
        by_name = {last_part(f.name): f for f in other.fields}
        return other.df.selectExpr(*listed([(f.inner, Bound(by_name[last_part(f.name)].sql(), f.kind)) for f in self.fields]))

    def union(self, other: Frame) -> Frame:
        """All rows of both, by name; `distinct()` drops repeated ones."""
        return Frame(self.df.unionByName(self.matching(other)), self.fields)

    def intersect(self, other: Frame) -> Frame:
        return Frame(self.df.intersect(self.matching(other)), self.fields)

    def minus(self, other: Frame) -> Frame:
        return Frame(self.df.subtract(self.matching(other)), self.fields)

    def with_udf(self, name: str, function: Callable[..., Any], result: str, *columns: Any) -> Frame:
        """A column from a Python function of pandas Series (Arrow batches, not rows); `result` is a type of Spark's."""
        bound = [SF.expr(e.bind(self.fields).sql) for e in self.expand(columns)]
        df = self.df.withColumn(name, SF.pandas_udf(function, result, SF.PandasUDFType.SCALAR)(*bound))
        return Frame(df, [*[f for f in self.fields if f.inner != name], Field(name, name, kind(df.schema[name].dataType))])

    def to_df(self) -> DataFrame:
        """Spark's DataFrame, its columns named by what follows the last dot; where names would be equal, by their full names."""
        short = [last_part(f.name) for f in self.fields]
        names = [n if short.count(n) == 1 else f.name for f, n in zip(self.fields, short, strict=True)]
        if twice := [n for n in names if names.count(n) > 1]:
            raise ValueError(f"several columns are named {twice[0]!r}; give the tables or columns aliases")
        return self.df.selectExpr(*listed([(n, Bound(f.sql(), f.kind)) for f, n in zip(self.fields, names, strict=True)]))

    def collect(self) -> list[dict[str, Any]]:
        return [r.asDict() for r in self.to_df().collect()]

    def show(self, n: int = 10) -> int:
        """Prints up to `n` rows; returns how many."""
        df = self.to_df()
        rows = [[str(v) for v in r] for r in df.limit(n).collect()]
        widths = [max(len(x) for x in column) for column in zip(df.columns, *rows, strict=True)]
        line = lambda left, mid, right: left + mid.join("─" * (w + 2) for w in widths) + right
        cells = lambda r: "│" + "│".join(f" {v:<{w}} " for v, w in zip(r, widths, strict=True)) + "│"
        print("\n".join([line("╭", "┬", "╮"), cells(df.columns), line("├", "┼", "┤"), *map(cells, rows), line("╰", "┴", "╯")]))
        return len(rows)

    def debug(self, label: str, n: int = 10) -> Frame:
        """Prints the schema and up to `n` rows at this step of a query; returns the frame, so steps may go on behind it."""
        print(f"{label}: {', '.join(f'{name} {k}' for name, k in self.schema)}")
        self.show(n)
        return self

    def explain(self, full: bool = False) -> None:
        self.to_df().explain(mode="extended" if full else "formatted")


class Grouped:
    def __init__(self, frame: Frame, keys: list[Expression], how: str = "groupBy") -> None:
        self.frame, self.keys, self.how = frame, keys, how

    def agg(self, *columns: Any) -> Frame:
        """The keys, then the aggregates; no aggregates give the distinct keys."""
        frame = self.frame
        keys = [(k.name(), k.bind(frame.fields)) for k in self.keys]
        results = [(e.name(), e.bind(frame.fields)) for e in columns]
        outer = [n for n, _ in keys + results]
        inner = outer if len(set(outer)) == len(outer) else [f"c{i}" for i in range(len(outer))]
        column = [SF.expr(f"{b.sql} AS {quoted(n)}") for n, (_, b) in zip(inner, keys + results, strict=True)]
        by, made = column[: len(keys)], column[len(keys) :]
        df = getattr(frame.df, self.how)(*by).agg(*made) if results else frame.df.select(*by).distinct()
        return Frame(df, [Field(n, i, b.kind) for (n, b), i in zip(keys + results, inner, strict=True)])


def replace(e: Expression, found: Callable[[Expression], Expression | None]) -> Expression:
    """A copy of the expression with parts replaced."""
    if (r := found(e)) is not None:
        return r
    if isinstance(e, Binary):
        return Binary(e.op, replace(e.left, found), replace(e.right, found))
    if isinstance(e, Alias):
        return Alias(replace(e.of, found), e.as_name)
    if isinstance(e, Over):
        return Over(replace(e.what, lambda x: None if x is e.what else found(x)), [replace(x, found) for x in e.partition], [replace(x, found) for x in e.order], e.rows)
    copy = object.__new__(type(e))
    copy.__dict__.update(e.__dict__)
    if isinstance(of := e.__dict__.get("of"), Expression):
        copy.of = replace(of, found)
    elif isinstance(of, tuple):
        copy.of = tuple(replace(x, found) for x in of)
    return copy


def grouped_select(frame: Frame, keys: list[Expression], items: list[Expression], having: Expression | None) -> Frame:
    """SELECT items GROUP BY keys HAVING: aggregates wherever they stand are computed once, filtered on, and dropped."""
    found: dict[str, Expression] = {}
    names = {f"key_{i}": k for i, k in enumerate(keys)}
    plain = {find(frame.fields, k.of).name: n for n, k in names.items() if isinstance(k, Col)}
    shapes = {k.name(): n for n, k in names.items() if not isinstance(k, Col)}
    aliases = {e.as_name: e.of for e in items if isinstance(e, Alias)}

    def after(e: Expression) -> Expression | None:
        if isinstance(e, Aggregate):
            return Col(next((n for n, a in found.items() if a.name() == e.name()), None) or store(e))
        if not isinstance(e, (Col, Lit, Alias)) and e.name() in shapes:
            return Col(shapes[e.name()])
        if isinstance(e, Col):
            try:
                name = find(frame.fields, e.of).name
            except ValueError:
                name = None
            if name in plain:
                return Col(plain[name])
            if name is None and e.of in aliases:
                return replace(aliases[e.of], after)
            if name is None:
                raise ValueError(f"Unknown column {e.of!r}; there are {', '.join(f.name for f in frame.fields)}")
            raise GroupByError(f"column {e.of!r} is neither grouped by nor aggregated")
        return None

    def store(e: Expression) -> str:
        n = f"agg_{len(found)}"
        found[n] = e
        return n

    listed = [Alias(replace(e, after), e.name()) for e in items]
    condition = replace(having, after) if having is not None else None
    out = Grouped(frame, [Alias(k, n) for n, k in names.items()]).agg(*[Alias(a, n) for n, a in found.items()]) if keys else frame.select(*[Alias(a, n) for n, a in found.items()])
    if condition is not None:
        out = out.filter(condition)
    return out.select(*listed)


__all__ = ["Frame", "Grouped", "grouped_select"]
