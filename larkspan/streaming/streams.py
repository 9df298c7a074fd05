"""Tables that grow, read as streams; filters, projections and groupings are the frame's own."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as SF
from pyspark.sql import types as T

from ..operators import Frame


def read_stream(spark: SparkSession, path: str, schema: T.StructType) -> Frame:
    return Frame(spark.readStream.schema(schema).parquet(path))


def grouped(stream: Frame, keys: list[Any], *aggregates: Any) -> Frame:
    """Running aggregates, for the output modes `complete` and `update`."""
    return stream.group_by(*keys).agg(*aggregates)


def windowed(stream: Frame, time: str, late: str, window: Column, keys: list[str], aggregates: tuple[Any, ...]) -> DataFrame:
    moved = stream.df.withColumn(time, SF.col(time).cast("timestamp_ltz")).withWatermark(time, late)
    bound = [SF.expr(e.bind(stream.fields).sql).alias(e.name()) for e in aggregates]
    return moved.groupBy(window.alias("window"), *keys).agg(*bound)


def tumbling(stream: Frame, time: str, width: str, late: str, keys: list[str], *aggregates: Any) -> DataFrame:
    """Aggregates a window and key, final once the watermark (`late` behind the latest time) has passed the window."""
    return windowed(stream, time, late, SF.window(time, width), keys, aggregates)


def sliding(stream: Frame, time: str, width: str, every: str, late: str, keys: list[str], *aggregates: Any) -> DataFrame:
    """Windows of a width that begin at each multiple of `every`."""
    return windowed(stream, time, late, SF.window(time, width, every), keys, aggregates)


def sessions(stream: Frame, time: str, gap: str, late: str, keys: list[str], *aggregates: Any) -> DataFrame:
    """Windows that go on while a key's rows are at most `gap` apart."""
    return windowed(stream, time, late, SF.session_window(time, gap), keys, aggregates)


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Reads all that is there and stops; complete results replace the table. What has been written, as a table."""
    spark = df.sparkSession
    if mode == "append":
        query = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
    else:
        query = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
    return spark.read.parquet(path)
