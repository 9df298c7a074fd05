"""What the operators share: cutting lineage, word hashing, small column helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_path, remove, remove_at_exit

ROWS_A_FILE = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

def cut(df: DataFrame, name: str, most_rows: int | None = None) -> DataFrame:
    """Writes `df` into the shared folder and reads it again: lineage ends there, and lost executors lose nothing.

    With `most_rows`, a bound of its rows, it is written by one task for every ROWS_A_FILE of them: for narrow results.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    if most_rows is not None:
        df = df.coalesce(1 + most_rows // ROWS_A_FILE)
    df.write.parquet(path)
    remove_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Deletes tables of cut() that nothing will read again."""
    for f in frames:
        remove(f.sparkSession, f.cut_path)


def give_back_memory() -> None:
    """What Python and Arrow have freed, to the system, where its allocator can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def by_groups(df: DataFrame, keys: list[str], apply: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """apply() to the rows of each key, as one stream a partition: for very many small groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun: list[pa.RecordBatch] = []  # of the group that may go on in the next batch
        last: tuple | None = None
        for b in batches:
            if not b.num_rows:
                continue
            at = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
            new = np.zeros(b.num_rows, bool)
            for x in at:
                new[1:] |= x[1:] != x[:-1]
            first = tuple(x[0] for x in at)
            starts = [0, *np.nonzero(new)[0].tolist()]
            for i, j in zip(starts, [*starts[1:], b.num_rows], strict=True):
                if begun and (i or first != last):
                    yield from apply(pa.Table.from_batches(begun)).to_batches()
                    begun = []
                begun.append(b.slice(i, j - i))
            last = tuple(x[-1] for x in at)
        if begun:
            yield from apply(pa.Table.from_batches(begun)).to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z only; other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


class WordHashes(dict):
    """bytes -> 64-bit hash, with a memory bound."""

    MOST = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


class WordNumbers(dict):
    """bytes -> number of the word, by which low() and high() have the halves of its 128-bit hash; the dictionary is bounded."""

    MOST = 150_000

    def __init__(self) -> None:
        super().__init__()
        self.halves = array("Q"), array("Q")

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        h, n = xxhash.xxh3_128_intdigest(word), len(self.halves[0])
        self.halves[0].append(h & 0xFFFFFFFFFFFFFFFF)
        self.halves[1].append(h >> 64)
        self[word] = n
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int32, count=len(words))

    def low(self, numbers: np.ndarray) -> np.ndarray:
        return np.array(self.halves[0], np.uint64)[numbers]

    def high(self, numbers: np.ndarray) -> np.ndarray:
        return np.array(self.halves[1], np.uint64)[numbers]


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; of numpy's ways, sorting is many times as fast for integers as the table that np.unique() uses."""
    x = np.sort(x)
    return x[np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]])]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads low and high bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))
