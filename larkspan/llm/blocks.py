"""Exchanges of 64-bit keys between chunks of documents, through routers and buckets of the key space.

Documents are dealt into chunks of about CHUNK_BYTES of text. Each chunk sends its distinct keys, sorted and packed as
byte planes of their differences, one message for each of FAN ranges of the key space that it has keys in. Up to FAN
chunks meet in buckets directly. Beyond, the messages of FAN chunks for one range meet in a router, which merges them and
sends them on, as a chunk would, by the keys' next bits; and so on, until a range's messages are few enough for a bucket. Answers
take the same way back. So a chunk sends FAN messages a level at most, whatever their number: messages grow with the
input (times its logarithm to the base FAN), a key costs a few bytes a level instead of a row, a key that is everywhere is
one entry a chunk, and no task holds more than about a chunk.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

CHUNK_BYTES = 12 << 20
LEAST_CHUNKS = 16
FAN = 256
MOST_BROADCAST = 500_000  # integers
COPIES_AT_ONCE = 10_000


def chunks_for(text_bytes: int) -> int:
    return max(LEAST_CHUNKS, -(-text_bytes // CHUNK_BYTES))


@dataclass(frozen=True)
class Levels:
    """How many levels of routers and buckets there are, and by how many bits of the keys each one deals."""

    count: int
    bits: int

    @staticmethod
    def of(chunks: int) -> Levels:
        bits = (FAN - 1).bit_length()
        return Levels(max(1, -(-(chunks - 1).bit_length() // bits)), bits)


def chunk_of(docs: DataFrame, chunks: int) -> Column:
    return F.pmod(F.xxhash64(docs["doc_id"], docs["text"]), F.lit(chunks)).cast("int")


def folded(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs: doc_id, text and others that depend on them. Adds `copies`, rows that agree in all being one; and whether there are any.

    Only repeated rows are grouped, with sums before the shuffle, so one row that fills the table is no task's burden.
    """
    keyed = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    repeated = cut(keyed.select("_row").groupBy("_row").agg(F.count("*").alias("n")).filter("n > 1").select("_row"), "repeated")
    n = repeated.count()
    if not n:
        return docs.withColumn("copies", F.lit(1).cast("long")), False
    named = F.broadcast(repeated) if n <= MOST_BROADCAST else repeated
    alone = keyed.join(named, "_row", "left_anti").drop("_row").withColumn("copies", F.lit(1).cast("long"))
    return alone.unionByName(keyed.join(named, "_row", "left_semi").drop("_row").groupBy(*docs.columns).agg(F.count("*").alias("copies"))), True


def unfolded(rows: DataFrame, any_copies: bool) -> DataFrame:
    """Each row as often as its `copies` say, without them."""
    if not any_copies:
        return rows.drop("copies")
    some = rows.withColumn("_from", F.explode(F.sequence(F.lit(1).cast("long"), "copies", F.lit(COPIES_AT_ONCE).cast("long"))))
    return some.withColumn("_copy", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + (COPIES_AT_ONCE - 1), F.col("copies"))))).drop("copies", "_from", "_copy")


def pack_ints(values: np.ndarray) -> bytes:
    """Unsigned integers as the byte planes that the largest needs."""
    most = int(values.max()) if len(values) else 0
    k = max(1, (most.bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values, dtype="<u8").view(np.uint8).reshape(-1, 8)[:, :k].T
    return bytes([k]) + np.ascontiguousarray(planes).tobytes()


def unpack_ints(data: bytes) -> np.ndarray:
    k = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(k, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :k] = planes.T
    return out.view("<u8").ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted unsigned keys: the first one, then differences."""
    if not len(keys):
        return b""
    return int(keys[0]).to_bytes(8, "little") + pack_ints(np.diff(keys))


def unpack_keys(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, np.uint64)
    steps = unpack_ints(data[8:])
    out = np.empty(len(steps) + 1, np.uint64)
    out[0] = int.from_bytes(data[:8], "little")
    out[1:] = steps
    return np.cumsum(out, dtype=np.uint64)


def ranges(keys: np.ndarray, levels: Levels, level: int) -> np.ndarray:
    """Where each range of a level begins in sorted keys that share the bits before; one more entry for the end."""
    shift, n = np.uint64(64 - levels.bits * (level + 1)), 1 << levels.bits
    part = (keys >> shift) & np.uint64(n - 1)
    return np.searchsorted(part, np.arange(n + 1, dtype=np.uint64))


class Traffic:
    """What an exchange carries. A part is a tuple of arrays that belong to sorted keys; so is an answer. Both are packed for messages."""

    def split(self, part: tuple, levels: Levels, level: int) -> list[tuple]:
        """The part's pieces by range, None for empty ones."""
        raise NotImplementedError

    def merge(self, parts: list[tuple]) -> tuple:
        raise NotImplementedError

    def settle(self, merged: tuple) -> tuple:
        """A bucket's answer to all that it has got, merged."""
        raise NotImplementedError

    def join(self, answers: list[tuple]) -> tuple:
        """Of the answers to a part's pieces, in their order, the answer to the part."""
        raise NotImplementedError

    def reply(self, k: int, part: tuple, merged: tuple, answer: tuple) -> tuple | None:
        """What of the answer to `merged` concerns the k-th part of those that were merged last."""
        raise NotImplementedError

    def pack(self, part: tuple) -> tuple[bytes, bytes, bytes]:
        raise NotImplementedError

    def unpack(self, packed: tuple[bytes, bytes, bytes]) -> tuple:
        raise NotImplementedError

    def pack_answer(self, answer: tuple) -> tuple[bytes, bytes, bytes]:
        raise NotImplementedError

    def unpack_answer(self, packed: tuple[bytes, bytes, bytes]) -> tuple:
        raise NotImplementedError


MESSAGE = "bucket long, source int, x binary, y binary, z binary"
_KINDS = [("bucket", pa.int64()), ("source", pa.int32()), ("x", pa.binary()), ("y", pa.binary()), ("z", pa.binary())]


def messages(rows: list[tuple]) -> pa.Table:
    return pa.table({k: pa.array([r[i] for r in rows], kind) for i, (k, kind) in enumerate(_KINDS)})


def packed(t: pa.Table) -> list[tuple[bytes, bytes, bytes]]:
    return list(zip(*(t.column(c).to_pylist() for c in "xyz"), strict=True))


def sent(part: tuple, traffic: Traffic, source: int, levels: Levels, level: int = 0, bucket: int = 0) -> pa.Table:
    """Messages (bucket, source, ..) of a chunk's or router's part."""
    first = bucket << levels.bits
    return messages([(first + k, source, *traffic.pack(p)) for k, p in enumerate(traffic.split(part, levels, level)) if p is not None])


def answers_to(t: pa.Table, parts: list[tuple], merged: tuple, answer: tuple, traffic: Traffic) -> pa.Table:
    replies = [(b, s, traffic.reply(k, p, merged, answer)) for k, (b, s, p) in enumerate(zip(t.column("bucket").to_pylist(), t.column("source").to_pylist(), parts, strict=True))]
    return messages([(b, s, *traffic.pack_answer(r)) for b, s, r in replies if r is not None])


def joined_answer(t: pa.Table, traffic: Traffic) -> tuple:
    """Of one source's answers."""
    return traffic.join([traffic.unpack_answer(p) for p in packed(t.sort_by("bucket"))])


def exchange(rows: DataFrame, traffic: Traffic, levels: Levels, level: int = 1) -> DataFrame:
    """rows: messages of a level. Answers (bucket, source, ..) to them; a message without an answer has none."""

    def in_bucket(t: pa.Table) -> pa.Table:
        parts = [traffic.unpack(p) for p in packed(t)]
        merged = traffic.merge(parts)
        return answers_to(t, parts, merged, traffic.settle(merged), traffic)

    if level == levels.count:
        return rows.groupBy("bucket").applyInArrow(lambda t: in_bucket(t), MESSAGE)

    def up(t: pa.Table) -> pa.Table:
        merged = traffic.merge([traffic.unpack(p) for p in packed(t)])
        return sent(merged, traffic, t.column("source")[0].as_py() >> levels.bits, levels, level, t.column("bucket")[0].as_py())

    def down(t: pa.Table, back: pa.Table) -> pa.Table:
        parts = [traffic.unpack(p) for p in packed(t)]
        return answers_to(t, parts, traffic.merge(parts), joined_answer(back, traffic), traffic) if parts else messages([])

    router = ["bucket", F.shiftright("source", levels.bits).alias("router")]
    answers = exchange(rows.groupBy(*router).applyInArrow(lambda t: up(t), MESSAGE), traffic, levels, level + 1)
    back = answers.groupBy(F.shiftright("bucket", levels.bits).alias("bucket"), F.col("source").alias("router"))
    return rows.groupBy(*router).cogroup(back).applyInArrow(lambda t, b: down(t, b), MESSAGE)


class Among:
    """Membership in a set of keys: a table of the keys' leading bits rules most others out before the exact look-up."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.sort(keys)
        self.shift = np.uint64(64 - min(25, max(10, (16 * len(keys)).bit_length())))
        self.leads = np.zeros(1 << (64 - int(self.shift)), bool)
        self.leads[(self.keys >> self.shift).astype(np.int64)] = True

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = self.leads[(keys >> self.shift).astype(np.int64)]
        maybe = np.nonzero(out)[0]
        if len(maybe):
            wanted = keys[maybe]
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            out[maybe] = self.keys[at] == wanted
        return out
