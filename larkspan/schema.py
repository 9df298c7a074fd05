"""The four column types, and how they map to Spark's."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import types as T


class ColumnType(Enum):
    INTEGER = "INTEGER"
    STRING = "STRING"
    FLOAT = "FLOAT"
    TIMESTAMP = "TIMESTAMP"

    def spark(self) -> T.DataType:
        return SPARK_TYPES[self]


SPARK_TYPES = {
    ColumnType.INTEGER: T.IntegerType(),
    ColumnType.STRING: T.StringType(),
    ColumnType.FLOAT: T.DoubleType(),
    ColumnType.TIMESTAMP: T.TimestampNTZType(),
}


def struct(schema: list[tuple[str, ColumnType]]) -> T.StructType:
    return T.StructType([T.StructField(n, t.spark(), False) for n, t in schema])


def kind(t: T.DataType) -> str:
    """What the type rules tell apart: integer, float, string, timestamp, boolean or the type's own name."""
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(t, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "timestamp"
    return "boolean" if isinstance(t, T.BooleanType) else t.typeName()


def column_type(t: T.DataType) -> ColumnType:
    try:
        return ColumnType[kind(t).upper()]
    except KeyError:
        raise TypeError(f"no column type for {t.simpleString()}") from None
