"""Frames, expressions, the dialect's errors, sources, plans, the shell and streams."""

from __future__ import annotations

import math
import os
import subprocess
import sys
from datetime import datetime

import pytest
from pyspark.sql import functions as SF

from larkspan.engine import Engine
from larkspan.errors import GroupByError, ParseError, SemanticError
from larkspan.functions import Col, F, Lit, floor_mod
from larkspan.operators import Frame
from larkspan.plans import parse
from larkspan.schema import ColumnType as C
from larkspan.sources import append_block_file, append_rows, import_csv, merge_tables, read_table, write_rows
from larkspan.sources.blocks import block_offsets, describe, read_header, write_block_file
from larkspan.shell import format_duration, main, read_statement, run_statement

from .conftest import assert_rows

# 24 readings by a rule: a station, a level and a sort, such that groups differ in size and no level is in one group alone.
READINGS = [(f"st{i * i % 7}", (i * 5 + 3) % 13, f"sort{i % 4}") for i in range(24)]
STATIONS = sorted({r[0] for r in READINGS})


@pytest.fixture(scope="module")
def readings(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("readings") / "table")
    write_rows(spark, at, READINGS, [("station", C.STRING), ("level", C.INTEGER), ("sort", C.STRING)])
    return at


@pytest.fixture
def frame(spark, readings):
    return Frame.table(spark, readings)


def levels(station):
    return [v for s, v, _ in READINGS if s == station]


def test_select_star_twice_and_names(frame):
    out = frame.select(Col("sort").alias("x"), "*", Col("level") + 3)
    assert [n for n, _ in out.schema] == ["x", "station", "level", "sort", "level_add_lit_3"]
    assert all(r["level_add_lit_3"] == r["level"] + 3 and r["x"] == r["sort"] for r in out.collect())


def test_frames_do_not_change(frame):
    frame.filter(Col("level") > 4)
    assert len(frame.collect()) == len(READINGS)


@pytest.mark.parametrize(("condition", "holds"), [
    ((Col("level") > 2) & (Col("level") < 9), lambda s, v, k: 2 < v < 9),
    ((Col("station") == "st1") | (Col("sort") == "sort3"), lambda s, v, k: s == "st1" or k == "sort3"),
    (~Col("station").like("%1"), lambda s, v, k: not s.endswith("1")),
    (Col("level").between(3, Lit(5) + 2), lambda s, v, k: 3 <= v <= 7),
    (Lit(4) <= Col("level"), lambda s, v, k: v >= 4),
    (Col("sort").like("_ort2"), lambda s, v, k: k == "sort2"),
    (Col("sort").like("sort\\%"), lambda s, v, k: False),
    (Col("level").is_in(1, 5, 12), lambda s, v, k: v in (1, 5, 12)),
    (Col("station").is_null(), lambda s, v, k: False),
])
def test_filters(frame, condition, holds):
    assert len(frame.filter(condition).collect()) == sum(holds(*r) for r in READINGS)


def test_arithmetic(spark):
    """Division, floors and remainders as Python has them, but for the sign of %."""
    numbers = [(a, b) for a in (-9, -7, -1, 0, 1, 7, 9, 2**53 + 1, -(2**53) - 1) for b in (-4, -2, 1, 3)]
    f = Frame(spark.createDataFrame(numbers, "a long, b long"))
    a, b = Col("a"), Col("b")
    for r in f.select("a", "b", (a // b).alias("f"), (a % b).alias("m"), floor_mod(a, b).alias("p"), (a / b).alias("d"), (2 * a - b).alias("x"), (b**2).alias("q"), (17 // b).alias("g"), (2**b).alias("h")).collect():
        assert (r["f"], r["p"], r["d"], r["x"], r["q"], r["g"], r["h"]) == (r["a"] // r["b"], r["a"] % r["b"], float(r["a"]) / r["b"], 2 * r["a"] - r["b"], r["b"] ** 2, 17 // r["b"], 2.0 ** r["b"])
        assert r["m"] == int(math.fmod(r["a"], r["b"])) or abs(r["a"]) > 2**53
    halves = Frame(spark.sql("SELECT -7.5D AS a"))
    assert halves.select((Col("a") // 2).alias("f")).collect() == [{"f": -4.0}]


def test_overflow(spark):
    big = Frame(spark.sql("SELECT 2147483647 AS a"))
    with pytest.raises(Exception, match="OVERFLOW"):
        big.select(Col("a") + Col("a")).collect()
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        assert big.select((Col("a") + Col("a")).alias("s")).collect() == [{"s": -2}]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")


def test_grouping(frame):
    got = frame.group_by("station").agg(F.sum(Col("level")), F.count(), F.avg(Col("level")).alias("a"), F.count(Col("sort"), distinct=True))
    sorts = {s: len({k for t, _, k in READINGS if t == s}) for s in STATIONS}
    assert_rows(got.collect(), [{"station": s, "sum_level": sum(levels(s)), "count": len(levels(s)), "a": sum(levels(s)) / len(levels(s)), "count_distinct_sort": sorts[s]} for s in STATIONS])
    assert len(frame.group_by("station", "sort").agg().collect()) == len({(s, k) for s, _, k in READINGS})
    assert frame.select(F.max(Col("level")), F.count()).collect() == [{"max_level": max(v for _, v, _ in READINGS), "count": len(READINGS)}]


def test_joins(frame):
    left, right = frame.alias("l"), frame.filter(Col("level") > 8).alias("r")
    high = [r for r in READINGS if r[1] > 8]
    got = left.join(right, Col("l.station") == Col("r.station")).select("l.sort", Col("r.level").alias("q"))
    assert len(got.collect()) == sum(a[0] == b[0] for a in READINGS for b in high) and [n for n, _ in got.schema] == ["l.sort", "q"]
    assert set(got.collect()[0]) == {"sort", "q"}
    met = {s for s, *_ in high}
    assert len(left.join(right, Col("l.station") == Col("r.station"), "semi").collect()) == sum(s in met for s, *_ in READINGS)
    assert len(left.join(right, Col("l.station") == Col("r.station"), "anti").collect()) == sum(s not in met for s, *_ in READINGS)
    assert len(left.cross_join(right).collect()) == len(READINGS) * len(high)
    counts = frame.group_by("station").agg(F.count().alias("n"))
    both = frame.join(counts, ["station"], "full")
    assert [n for n, _ in both.schema] == ["station", "level", "sort", "n"] and all(r["n"] == len(levels(r["station"])) for r in both.collect())


def test_equal_names_keep_their_data(spark):
    """Neither side of an outer join loses columns; names that can't be told apart are refused."""
    l, r = (Frame(spark.sql(f"SELECT * FROM VALUES {rows} AS t(id, v)")) for rows in ("(1, 'a'), (2, 'b')", "(2, 'c'), (3, 'd')"))
    got = l.alias("l").join(r.alias("r"), Col("l.id") == Col("r.id"), "full").select("*").collect()
    assert_rows(got, [{"l.id": 1, "l.v": "a", "r.id": None, "r.v": None}, {"l.id": 2, "l.v": "b", "r.id": 2, "r.v": "c"}, {"l.id": None, "l.v": None, "r.id": 3, "r.v": "d"}])
    with pytest.raises(ValueError, match="aliases"):
        l.join(r, Lit(True)).collect()


def test_asof(spark):
    """Against comparing all pairs; with ties, nulls and keys that the other side lacks."""
    left = [(1, 5), (1, 2), (1, 0), (2, 9), (3, 1), (None, 4), (1, None)]
    right = [(1, 2, "a"), (1, 4, "b"), (2, 10, "c"), (2, 1, "d"), (None, 1, "e"), (3, None, "f")]
    l, r = Frame(spark.createDataFrame(left, "k int, t int")).alias("l"), Frame(spark.createDataFrame(right, "k int, t int, v string")).alias("r")
    got = l.asof_join(r, ("l.t", "r.t"), [("l.k", "r.k")]).select("l.k", "l.t", "r.v").collect()
    wanted = []
    for k, t in left:
        fit = [(u, v) for j, u, v in right if None not in (k, t, j, u) and j == k and u <= t]
        wanted.append({"k": k, "t": t, "v": max(fit)[1] if fit else None})
    assert_rows(got, wanted)


def test_debug(frame, capsys):
    assert frame.filter(Col("level") > 5).debug("high", 2).select("level").collect()
    assert "high: station string, level integer" in capsys.readouterr().out


def test_sets(frame, spark):
    low, high = frame.filter(Col("level") < 8).select("station"), frame.filter(Col("level") > 4).select("station")
    a, b = ({s for s, v, _ in READINGS if test(v)} for test in (lambda v: v < 8, lambda v: v > 4))
    names = lambda f: sorted(r["station"] for r in f.collect())
    assert names(low.union(high).distinct()) == sorted(a | b) and names(low.intersect(high)) == sorted(a & b) and names(low.minus(high)) == sorted(a - b)
    turned = frame.select("sort", "level", "station")
    assert sorted(r["station"] for r in frame.union(turned).collect()) == sorted(2 * [s for s, *_ in READINGS])
    with pytest.raises(TypeError, match="differ"):
        frame.union(low)


def test_windows_and_udfs(frame):
    place = F.row_number().over(["station"], [Col("level").descending(), "sort"])
    total = F.sum(Col("level")).over(["station"], ["level", "sort"], (None, 0))
    got = frame.select("station", "level", place.alias("place"), total.alias("so_far")).collect()
    for s in STATIONS:
        own = sorted((r for r in got if r["station"] == s), key=lambda r: r["place"])
        assert [r["level"] for r in own] == sorted(levels(s), reverse=True) and max(r["so_far"] for r in own) == sum(levels(s))

    import pandas as pd

    def double(x: pd.Series) -> pd.Series:
        return x * 2

    assert all(r["twice"] == 2 * r["level"] for r in frame.with_udf("twice", double, "long", "level").collect())


def test_errors(frame, spark):
    for wrong, kind, text in (
        (lambda: frame.select("nothing"), ValueError, "Unknown column"),
        (lambda: frame.filter(Col("level") == "a"), TypeError, "Type mismatch"),
        (lambda: frame.filter(Col("level") + 1), TypeError, "needs a condition"),
        (lambda: frame.select(Col("level").like("a")), TypeError, "LIKE"),
        (lambda: frame.group_by("station").agg(F.sum(Col("sort"))), TypeError, "numbers"),
        (lambda: frame.select("station", F.count()), GroupByError, "neither"),
        (lambda: frame.join(frame, Col("station") == Col("station"), "sideways"), ValueError, "unknown join"),
        (lambda: frame.alias("a").join(frame.alias("b"), Col("station") == Col("b.station")), ValueError, "Ambiguous"),
        (lambda: bool(Col("a") == 1), TypeError, "truth"),
        (lambda: parse("SELECT a"), ParseError, "FROM"),
        (lambda: parse("SELECT a FROM 't' WHERE a LIKE 3;"), ParseError, "pattern"),
        (lambda: parse("SELECT MODE(a) FROM 't';"), SemanticError, "unknown function"),
        (lambda: parse("SELECT ? FROM t"), ParseError, "unexpected"),
    ):
        with pytest.raises(kind, match=text):
            wrong()


def test_group_errors(spark, readings):
    sql = Engine(spark).sql
    with pytest.raises(GroupByError):
        sql(f"SELECT sort, COUNT() FROM '{readings}' GROUP BY station;")
    with pytest.raises(ValueError, match="Unknown column"):
        sql(f"SELECT station FROM '{readings}' GROUP BY station HAVING nothing > 1;")
    with pytest.raises(TypeError, match="condition"):
        sql(f"SELECT station FROM '{readings}' WHERE 'station';")


def test_precedence_and_case(spark, readings):
    got = Engine(spark).sql(f"select level * (1 + 2) - -1 as x, -level ** 2 as y from '{readings}' where sort = 'sort0' or sort = 'sort1' and level > 5")
    wanted = [(v * 3 + 1, -(v**2)) for _, v, k in READINGS if k == "sort0" or k == "sort1" and v > 5]
    assert sorted((r["x"], r["y"]) for r in got.collect()) == sorted(wanted)


def test_views(spark, readings):
    e = Engine(spark)
    e.view("measured", readings)
    assert e.sql("SELECT COUNT() AS n FROM measured AS m WHERE m.level > 3;").collect() == [{"n": sum(v > 3 for _, v, _ in READINGS)}]
    assert e.spark_sql("SELECT max(level) AS m FROM measured").first()["m"] == max(v for _, v, _ in READINGS)


def test_plan_reads_only_what_it_needs(spark, readings, capsys):
    Engine(spark).sql(f"SELECT station, SUM(level) AS s FROM '{readings}' WHERE level > 2 GROUP BY station;").explain()
    plan = capsys.readouterr().out
    assert "GreaterThan(level,2)" in plan and "ReadSchema: struct<station:string,level:int>" in plan and "partial_sum" in plan


def test_show(frame, capsys):
    assert frame.show(2) == 2 and "level" in capsys.readouterr().out
    assert frame.filter(Col("level") > 99).show() == 0


ROWS = [(1, "a", 1.5, datetime(2024, 1, 2, 3, 4, 5, 6)), (-7, "zwölf", -0.25, datetime(1969, 12, 31)), (0, "", 0.0, datetime(2000, 1, 1))]
SCHEMA = [("i", C.INTEGER), ("s", C.STRING), ("f", C.FLOAT), ("t", C.TIMESTAMP)]


def test_storage(spark, tmp_path):
    at, other = str(tmp_path / "a"), str(tmp_path / "b")
    write_rows(spark, at, ROWS, SCHEMA)
    append_rows(spark, at, [{"i": 5, "s": "x", "f": 2.0, "t": "2024-02-03"}], SCHEMA)
    assert read_table(spark, at).count() == 4
    write_rows(spark, other, ROWS, SCHEMA)
    merge_tables(spark, [at, other], str(tmp_path / "c"))
    assert read_table(spark, str(tmp_path / "c")).count() == 7
    write_rows(spark, other, [(1,)], [("i", C.INTEGER)])
    with pytest.raises(ValueError, match="different schemas"):
        merge_tables(spark, [at, other], str(tmp_path / "d"))


def test_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("i,s,f,t\n1,a,1.5,2024-01-02\n2,\"b,c\",2,2024-01-03T04:05:06\n")
    import_csv(spark, str(tmp_path / "x.csv"), str(tmp_path / "out"), SCHEMA)
    got = sorted(map(tuple, read_table(spark, str(tmp_path / "out")).collect()))
    assert got == [(1, "a", 1.5, datetime(2024, 1, 2)), (2, "b,c", 2.0, datetime(2024, 1, 3, 4, 5, 6))]
    with pytest.raises(Exception, match="exists"):
        import_csv(spark, str(tmp_path / "x.csv"), str(tmp_path / "out"), SCHEMA)


def test_block_files(spark, tmp_path):
    at = str(tmp_path / "t.bin")
    write_rows(spark, str(tmp_path / "p"), ROWS, SCHEMA)
    write_block_file(read_table(spark, str(tmp_path / "p")), at, rows_per_block=2)
    assert len(block_offsets(at)) == 2 and read_header(at) == SCHEMA
    assert sorted(map(tuple, read_table(spark, at).collect())) == sorted(ROWS)
    assert Engine(spark).sql(f"SELECT COUNT() AS n FROM '{at}' WHERE i < 1;").collect() == [{"n": 2}]
    assert describe(at).startswith("3 rows")
    write_block_file(read_table(spark, str(tmp_path / "p")).limit(0), at)
    assert read_table(spark, at).count() == 0


def test_block_files_grow(spark, tmp_path):
    """Appending fills a last block that isn't full; chosen columns are read in the order asked for."""
    at = str(tmp_path / "t.bin")
    part = lambda lo, hi: spark.range(lo, hi).select(SF.col("id").cast("int").alias("i"), SF.concat(SF.lit("s"), "id").alias("s"), (SF.col("id") / 4).alias("f"))
    write_block_file(part(0, 0), at, 5)
    for lo, hi in ((0, 3), (3, 5), (5, 12), (12, 13)):
        append_block_file(part(lo, hi), at, 5)
    assert len(block_offsets(at)) == 3 and describe(at).startswith("13 rows")
    got = read_table(spark, at, ["f", "i"])
    assert got.columns == ["f", "i"] and sorted(r.i for r in got.collect()) == list(range(13)) and all(r.f == r.i / 4 for r in got.collect())
    with pytest.raises(Exception, match="Unknown column"):
        read_table(spark, at, ["z"]).collect()
    with pytest.raises(ValueError, match="differ"):
        append_block_file(part(0, 1).drop("f"), at)


def test_events_are_logged(tmp_path):
    """In a process of its own, as a session's event log is settled when it starts."""
    code = f"from larkspan.session import build_session\ns = build_session(master='local[1]', events='file://{tmp_path}', **{{'spark.eventLog.compress': 'false'}})\ns.range(5).count()\ns.stop()"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, capture_output=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    logged = "".join(p.read_text() for p in tmp_path.rglob("*") if p.is_file() and not p.name.endswith(".crc"))
    assert "SparkListenerStageCompleted" in logged and "SparkListenerSQLExecutionStart" in logged


def test_no_folder_that_machines_do_not_share(spark, monkeypatch):
    from larkspan import session

    class Far:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077", "getConf": staticmethod(lambda: Far.conf)})

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        session.shared_folder(Far)
    at = session.new_path(spark, "test")
    spark.range(3).write.parquet(at)
    session.remove(spark, at)
    assert not os.path.exists(at.removeprefix("file://"))


def test_shell(spark, readings, capsys, monkeypatch, tmp_path):
    assert [format_duration(s) for s in (0.0015, 2, 61.5, 7322)] == ["1.50 ms", "2.00 s", "1 min 1.50 s", "2 h 2 min 2.00 s"]
    lines = iter(["SELECT station", f"FROM '{readings}';"])
    text = read_statement(lambda _: next(lines))
    run_statement(Engine(spark), text)
    run_statement(Engine(spark), "SELECT;")
    out = capsys.readouterr().out
    assert f"{len(READINGS)} rows in" in out and "ParseError" in out
    monkeypatch.setattr("larkspan.shell.Engine", lambda: Engine(spark))
    monkeypatch.setattr("larkspan.shell.HISTORY", tmp_path / "history")
    main(lambda _: "quit;")


def test_streams(spark, readings, tmp_path):
    from larkspan.streaming import grouped, read_stream, run_to_table, tumbling

    stream = read_stream(spark, readings, read_table(spark, readings).schema)
    out = grouped(stream.filter(Col("level") > 2), ["station"], F.sum(Col("level")).alias("s"))
    got = run_to_table(out.to_df(), f"{tmp_path}/out", f"{tmp_path}/state", "complete")
    assert {tuple(r) for r in got.collect()} == {(s, sum(v for v in levels(s) if v > 2)) for s in STATIONS if max(levels(s)) > 2}
    at = str(tmp_path / "times")
    write_rows(spark, at, [(1, "2024-01-01T00:00:10"), (2, "2024-01-01T00:00:50"), (3, "2024-01-01T00:01:10"), (4, "2024-01-01T00:09:00")], [("v", C.INTEGER), ("t", C.TIMESTAMP)])
    windows = tumbling(read_stream(spark, at, read_table(spark, at).schema), "t", "1 minute", "10 seconds", [], F.sum(Col("v")).alias("s"))
    final = run_to_table(windows, f"{tmp_path}/final", f"{tmp_path}/final_state")
    assert sorted(r["s"] for r in final.collect()) == [3, 3]  # the last window may still get rows


def test_entry_without_what_the_operators_need():
    """A module that they import and that isn't there takes none of the other queries along."""
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; n = e.queries(); assert 'q1_returnflag' in n and not any(k.startswith('op') and k[2].isdigit() for k in n) and set(e.oracle_sql()) <= set(n)"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=60, capture_output=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
