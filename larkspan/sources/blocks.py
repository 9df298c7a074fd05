"""The single-file block format, as a Spark data source with one partition a block.

Layout, little-endian. Header: one byte with the number of columns; for each its type (one byte), its name's length (one
byte) and name. Blocks: the number of rows (4 bytes); for each column the size of its data (8 bytes) and the data.
Integers take 4 bytes, floats 4, timestamps 8 (microseconds), strings a byte of length each and then all bytes. Footer: 8
bytes for each block's offset, then 4 bytes with the number of blocks.

Files are opened by path, so on a cluster they must lie on a file system that all machines mount. For data at scale use
Parquet; this is for exchange with programs that know the format.
"""

from __future__ import annotations

import json
import struct as pack
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from typing import BinaryIO

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import ColumnType, column_type, struct

FORMAT = "larkspan_blocks"
# The types' codes, bytes a value, and rows a block.
CODES = {ColumnType.INTEGER: 0, ColumnType.STRING: 1, ColumnType.FLOAT: 2, ColumnType.TIMESTAMP: 3}
WIDTHS = {ColumnType.INTEGER: ("i", 4), ColumnType.FLOAT: ("f", 4), ColumnType.TIMESTAMP: ("q", 8)}
ROWS_PER_BLOCK = 2 * 1024 * 1024
EPOCH = datetime(1970, 1, 1)


def local(path: str) -> str:
    return path.removeprefix("file://")


def read_header(path: str) -> list[tuple[str, ColumnType]]:
    kinds = {code: t for t, code in CODES.items()}
    with open(local(path), "rb") as f:
        out = []
        for _ in range(f.read(1)[0]):
            code, length = f.read(2)
            out.append((f.read(length).decode(), kinds[code]))
        return out


def block_offsets(path: str) -> list[int]:
    with open(local(path), "rb") as f:
        f.seek(-4, 2)
        (n,) = pack.unpack("<I", f.read(4))
        f.seek(-4 - 8 * n, 2)
        return list(pack.unpack(f"<{n}Q", f.read(8 * n)))


def decode(data: bytes, kind: ColumnType, rows: int) -> list:
    if kind is ColumnType.STRING:
        out, at = [], rows
        for n in data[:rows]:
            out.append(data[at : at + n].decode())
            at += n
        return out
    code, _ = WIDTHS[kind]
    values = pack.unpack(f"<{rows}{code}", data)
    return [EPOCH + timedelta(microseconds=v) for v in values] if kind is ColumnType.TIMESTAMP else list(values)


def encode(values: list, kind: ColumnType) -> bytes:
    if kind is ColumnType.STRING:
        raw = [v.encode() for v in values]
        if any(len(r) > 255 for r in raw):
            raise ValueError("the block format holds strings of up to 255 bytes")
        return bytes(map(len, raw)) + b"".join(raw)
    if kind is ColumnType.TIMESTAMP:
        values = [(v - EPOCH) // timedelta(microseconds=1) for v in values]
    code, _ = WIDTHS[kind]
    return pack.pack(f"<{len(values)}{code}", *values)


@dataclass
class Block(InputPartition):
    path: str
    offset: int


def chosen(path: str, columns: list[str] | None) -> list[tuple[str, ColumnType]]:
    """The file's columns, or those of the given names, in the given order."""
    every = read_header(path)
    if columns is None:
        return every
    kinds = dict(every)
    if missing := [c for c in columns if c not in kinds]:
        raise ValueError(f"Unknown column {missing[0]!r}; there are {', '.join(kinds)}")
    return [(c, kinds[c]) for c in columns]


class BlockReader(DataSourceReader):
    """Reads chosen columns of each block; others are skipped by their sizes."""

    def __init__(self, path: str, columns: list[str] | None = None) -> None:
        self.path, self.columns = path, columns

    def partitions(self) -> list[InputPartition]:
        return [Block(self.path, o) for o in block_offsets(self.path)] or [Block(self.path, -1)]

    def read(self, partition: Block) -> Iterator[tuple]:  # type: ignore[override]
        if partition.offset < 0:
            return
        wanted = [n for n, _ in chosen(partition.path, self.columns)]
        found = {}
        with open(local(partition.path), "rb") as f:
            f.seek(partition.offset)
            (rows,) = pack.unpack("<I", f.read(4))
            for name, kind in read_header(partition.path):
                (size,) = pack.unpack("<Q", f.read(8))
                if name in wanted:
                    found[name] = decode(f.read(size), kind, rows)
                else:
                    f.seek(size, 1)
        yield from zip(*[found[n] for n in wanted], strict=True)


class BlockFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        return struct(chosen(self.options["path"], self.columns()))

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return BlockReader(self.options["path"], self.columns())

    def columns(self) -> list[str] | None:
        """Of the option `columns`, a JSON list of names."""
        return json.loads(self.options["columns"]) if "columns" in self.options else None


class BlockWriter:
    """Puts rows into blocks from where the file stands, and the footer behind them."""

    def __init__(self, f: BinaryIO, schema: list[tuple[str, ColumnType]], offsets: list[int], rows_per_block: int) -> None:
        self.f, self.schema, self.offsets, self.rows_per_block = f, schema, offsets, rows_per_block
        self.rows: list[tuple] = []

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        if len(self.rows) == self.rows_per_block:
            self.put()

    def put(self) -> None:
        self.offsets.append(self.f.tell())
        self.f.write(pack.pack("<I", len(self.rows)))
        for values, (_, kind) in zip(zip(*self.rows, strict=True), self.schema, strict=True):
            data = encode(list(values), kind)
            self.f.write(pack.pack("<Q", len(data)) + data)
        self.rows = []

    def end(self) -> None:
        if self.rows:
            self.put()
        self.f.write(pack.pack(f"<{len(self.offsets)}Q", *self.offsets) + pack.pack("<I", len(self.offsets)))
        self.f.truncate()


def write_block_file(df: DataFrame, path: str, rows_per_block: int = ROWS_PER_BLOCK) -> None:
    """One file, written by the driver from one partition after another: for exchange, not for scale."""
    schema = [(f.name, column_type(f.dataType)) for f in df.schema]
    with open(local(path), "wb") as f:
        f.write(bytes([len(schema)]))
        for name, kind in schema:
            f.write(bytes([CODES[kind], len(name.encode())]) + name.encode())
        writer = BlockWriter(f, schema, [], rows_per_block)
        for r in df.toLocalIterator():
            writer.add(tuple(r))
        writer.end()


def append_block_file(df: DataFrame, path: str, rows_per_block: int = ROWS_PER_BLOCK) -> None:
    """Adds rows of the file's columns: a last block that isn't full is filled up first."""
    schema, offsets = read_header(path), block_offsets(path)
    given = [(f.name, column_type(f.dataType)) for f in df.schema]
    if given != schema:
        raise ValueError(f"columns differ: the file has {schema}, the rows have {given}")
    last = list(BlockReader(path).read(Block(path, offsets[-1]))) if offsets else []
    full = len(last) >= rows_per_block
    with open(local(path), "r+b") as f:
        f.seek(offsets[-1] if offsets and not full else -4 - 8 * len(offsets), 0 if offsets and not full else 2)
        writer = BlockWriter(f, schema, offsets if full or not offsets else offsets[:-1], rows_per_block)
        for r in [] if full else last:
            writer.add(r)
        for r in df.toLocalIterator():
            writer.add(tuple(r))
        writer.end()


def describe(path: str, limit: int = 100) -> str:
    """The number of rows and the first ones."""
    offsets, shown, total = block_offsets(path), [], 0
    for o in offsets:
        with open(local(path), "rb") as f:
            f.seek(o)
            total += pack.unpack("<I", f.read(4))[0]
        if len(shown) < limit:
            shown += list(BlockReader(path).read(Block(path, o)))[: limit - len(shown)]
    return "\n".join([f"{total} rows", *map(str, shown)])
