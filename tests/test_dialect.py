"""Random statements of the dialect's grammar over random tables: Spark's results are DuckDB's."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import duckdb
import pytest

from larkspan.engine import Engine
from larkspan.schema import ColumnType as C
from larkspan.sources import write_rows

COLUMNS = {"one": [("k", C.INTEGER), ("n", C.INTEGER), ("x", C.FLOAT), ("s", C.STRING), ("t", C.TIMESTAMP)], "two": [("k", C.INTEGER), ("m", C.INTEGER), ("y", C.FLOAT), ("r", C.STRING)]}
START = datetime(2021, 3, 1)


def table(name: str, rows: int, seed: int) -> list[tuple]:
    r = random.Random(seed)
    value = {C.INTEGER: lambda: r.randrange(-6, 12), C.FLOAT: lambda: r.randrange(-40, 40) / 8, C.STRING: lambda: "".join(r.choice("abc%_") for _ in range(r.randrange(4))), C.TIMESTAMP: lambda: START + timedelta(hours=r.randrange(2000))}
    return [tuple(value[k]() for _, k in COLUMNS[name]) for _ in range(rows)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at, con = tmp_path_factory.mktemp("random"), duckdb.connect()
    for seed, (name, columns) in enumerate(COLUMNS.items()):
        write_rows(spark, f"{at}/{name}", table(name, 40, seed), columns)
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{at}/{name}/*.parquet'")
    return at, con


class Grammar:
    """Makes statements as (dialect, SQL) pairs of one meaning: they differ in COUNT(), // and paths alone."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def number(self, columns: list[str], deep: int = 2) -> str:
        r = self.r
        if not deep or r.random() < 0.3:
            return r.choice([*columns, *columns, str(r.randrange(9)), f"{r.randrange(20) / 4}"])
        a, b = self.number(columns, deep - 1), self.number(columns, deep - 1)
        return r.choice([f"{a} + {b}", f"({a} - {b})", f"{a} * {b}", f"-{a}" if not a.startswith("-") else a, f"ABS({a})", f"{a} / {r.randrange(2, 5)}", f"CASE WHEN {a} < {b} THEN {a} ELSE {b} END", f"GREATEST({a}, {b})"])

    def condition(self, numbers: list[str], texts: list[str], deep: int = 2) -> str:
        r = self.r
        if deep and r.random() < 0.6:
            a, b = self.condition(numbers, texts, deep - 1), self.condition(numbers, texts, deep - 1)
            return r.choice([f"{a} AND {b}", f"{a} OR {b}", f"NOT ({a})", f"({a} OR {b}) AND {a}"])
        x, t = self.number(numbers, 1), r.choice(texts)
        text = "".join(r.choice("abc") for _ in range(r.randrange(1, 3)))
        return r.choice([f"{x} {r.choice(['=', '!=', '<>', '<', '<=', '>', '>='])} {self.number(numbers, 1)}", f"{x} BETWEEN {r.randrange(-5, 3)} AND {r.randrange(3, 9)}", f"{t} LIKE '{r.choice(['', '%', '_'])}{text}{r.choice(['', '%', '_'])}'", f"{t} NOT LIKE '%{text}%'", f"{t} {r.choice(['=', '<', '>='])} '{text}'", f"{x} IN (1, 2, {r.randrange(9)})", f"{t} IS NOT NULL", f"LENGTH({t}) > 1"])

    def aggregate(self, numbers: list[str], texts: list[str]) -> str:
        x = self.number(numbers, 1)
        return self.r.choice([f"ROUND(SUM({x} * 1.0), 6)", f"ROUND(AVG({x} * 1.0), 6)", f"MIN({x})", f"MAX({self.r.choice(texts)})", "COUNT()", f"COUNT(DISTINCT {self.r.choice(texts)})", f"ROUND(SUM({x} * 1.0) / COUNT(), 6)"])

    def statement(self) -> str:
        r = self.r
        joined = r.random() < 0.4
        source = "{one} AS a" + (f" {r.choice(['JOIN', 'INNER JOIN', 'LEFT JOIN', 'RIGHT JOIN', 'FULL JOIN'])} {{two}} AS b ON {r.choice(['a.k = b.k', 'a.k = b.k AND a.n < b.m', 'b.k = a.n AND b.y > 0'])}" if joined else "")
        numbers, texts = ["a.k", "a.n", "a.x"] + ["b.m", "b.y"] * joined, ["a.s"] + ["b.r"] * joined
        where = f" WHERE {self.condition(numbers, texts)}" * (r.random() < 0.7)
        if r.random() < 0.5:
            keys = r.sample([*texts, "a.k", "a.n"], r.randrange(1, 3))
            items = [f"{k} AS key_{i}" for i, k in enumerate(keys)] + [f"{self.aggregate(numbers, texts)} AS agg_{i}" for i in range(r.randrange(1, 4))]
            having = f" HAVING COUNT() > {r.randrange(3)}" * (r.random() < 0.4)
            return f"SELECT {', '.join(items)} FROM {source}{where} GROUP BY {', '.join(keys)}{having}"
        items = [f"{self.number(numbers)} AS num_{i}" for i in range(r.randrange(1, 4))] + [f"{r.choice(texts)} AS text"]
        distinct = "DISTINCT " * (r.random() < 0.2)
        plain = f"SELECT {distinct}{', '.join(items)} FROM {source}{where}"
        if r.random() < 0.2:
            return f"SELECT a.s AS v FROM {{one}} AS a{where if not joined else ''} {r.choice(['UNION ALL', 'UNION', 'INTERSECT', 'EXCEPT'])} SELECT b.r AS v FROM {{two}} AS b"
        return plain


def norm(rows):
    """A whole number and an equal float are one value: what a CASE of both gives is the engines' choice."""
    one = lambda v: v if v is None or isinstance(v, (str, datetime)) else float(f"{float(v):.9g}") + 0.0
    return sorted((tuple(map(one, r)) for r in rows), key=repr)


@pytest.mark.parametrize("seed", range(60))
def test_statement(spark, tables, seed):
    at, con = tables
    text = Grammar(seed).statement()
    got = Engine(spark).sql(text.format(one=f"'{at}/one'", two=f"'{at}/two'") + ";").to_df()
    wanted = con.execute(text.format(one="one", two="two").replace("COUNT()", "COUNT(*)"))
    assert got.columns == [d[0] for d in wanted.description]
    assert norm(map(tuple, got.collect())) == norm(wanted.fetchall()), text
