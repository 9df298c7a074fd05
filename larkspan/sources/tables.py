"""Reading, writing, appending and merging tables; a path is a table."""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as SF

from ..schema import ColumnType, kind, struct
from .blocks import FORMAT, BlockFiles

BLOCK_SUFFIX = ".bin"


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet, or a block file where the path ends with .bin; all columns or the named ones."""
    if path.endswith(BLOCK_SUFFIX):
        spark.dataSource.register(BlockFiles)
        blocks = spark.read.format(FORMAT)
        return (blocks.option("columns", json.dumps(columns)) if columns else blocks).load(path)
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def rows_frame(spark: SparkSession, rows: Iterable[dict[str, Any] | tuple], schema: list[tuple[str, ColumnType]]) -> DataFrame:
    """Rows as dicts or tuples; ISO strings stand for timestamps."""
    names = [n for n, _ in schema]
    listed = [tuple(r[n] for n in names) if isinstance(r, dict) else tuple(r) for r in rows]
    texts = {i for i, (_, t) in enumerate(schema) if t is ColumnType.TIMESTAMP and any(isinstance(r[i], str) for r in listed)}
    if not texts:
        return spark.createDataFrame(listed, struct(schema))
    as_text = [(n, ColumnType.STRING if i in texts else t) for i, (n, t) in enumerate(schema)]
    df = spark.createDataFrame(listed, struct(as_text))
    return df.select(*[SF.to_timestamp_ntz(SF.col(n)).alias(n) if i in texts else SF.col(n) for i, n in enumerate(names)])


def write_rows(spark: SparkSession, path: str, rows: Iterable[dict[str, Any] | tuple], schema: list[tuple[str, ColumnType]]) -> None:
    rows_frame(spark, rows, schema).write.mode("overwrite").parquet(path)


def append_rows(spark: SparkSession, path: str, rows: Iterable[dict[str, Any] | tuple], schema: list[tuple[str, ColumnType]]) -> None:
    rows_frame(spark, rows, schema).write.mode("append").parquet(path)


def merge_tables(spark: SparkSession, paths: list[str], out: str) -> None:
    """Tables of one schema, as one."""
    frames = [read_table(spark, p) for p in paths]
    shapes = {tuple((f.name, kind(f.dataType)) for f in d.schema) for d in frames}
    if len(shapes) != 1:
        raise ValueError(f"tables have different schemas: {', '.join(map(str, shapes))}")
    merged = frames[0]
    for d in frames[1:]:
        merged = merged.unionByName(d)
    merged.write.mode("errorifexists").parquet(out)


def import_csv(spark: SparkSession, csv: str, out: str, schema: list[tuple[str, ColumnType]]) -> None:
    """A CSV file with a header into a table that doesn't exist yet; cells that don't fit their type are errors."""
    df = spark.read.schema(struct(schema)).option("header", True).option("mode", "FAILFAST").csv(csv)
    df.write.mode("errorifexists").parquet(out)
