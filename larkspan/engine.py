"""The engine: a Spark session that runs the dialect and full Spark SQL."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .operators import Frame
from .plans import run
from .session import build_session


class Engine:
    def __init__(self, spark: SparkSession | None = None, profile: str = "ansi") -> None:
        self.spark = spark or build_session(profile)
        self.owned = spark is None

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_: Any) -> None:
        if self.owned:
            self.spark.stop()

    def table(self, path: str) -> Frame:
        return Frame.table(self.spark, path)

    def view(self, name: str, path: str) -> Frame:
        """Names a table, for FROM name."""
        f = self.table(path)
        f.df.createOrReplaceTempView(name)
        return f

    def sql(self, text: str) -> Frame:
        return run(self.spark, text)

    def spark_sql(self, text: str) -> DataFrame:
        """Everything that Spark SQL has."""
        return self.spark.sql(text)
