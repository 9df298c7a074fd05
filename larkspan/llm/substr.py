"""Operator 8: removal of long word sequences that repeat across documents, found by fixed-block anchors.

A repeat of `window` words contains, wherever it lies, one whole block of window/2 words at a multiple of window/2.
So every document's non-overlapping blocks are indexed by hash, and every rolling window of block length probes the
index. A hit marks the words around it; the windows of full length over marked words are extended to exact repeats: their
hashes (128 bits, from both halves of 128-bit hashes of the words) meet in buckets that find the smallest doc_id of each, and a
document loses the words of those windows that also start in a document with a smaller id. Windows that overlap join, so
what goes is the maximal repeat, word for word.

Documents that equal one with a smaller id are settled first, on a hash of their text (every window of theirs is one of
the other's), and take no part in index or probes. All exchanges are packed and routed (see blocks): a passage that any number
of documents share is one entry a chunk, no pairs are made, and messages grow with the input.

Words are runs of other than ASCII white space. Defined results: a null text has no words; texts shorter than a window
lose nothing; a very long text is one row of its chunk, which holds some thirty bytes for each of its words; null ids count
as larger than all others; rows that agree in id don't remove from each other, repeated rows and ties among them; kept words
are joined by one space; empty tables give empty results. Other columns are never read by the query.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import MESSAGE, Among, Levels, Traffic, chunk_of, chunks_for, exchange, folded, joined_answer, pack_ints, pack_keys, ranges, sent, unfolded, unpack_ints, unpack_keys
from .common import WordNumbers, distinct, mix, table

WINDOW = 50
BASE_A, BASE_B = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
NO_ID = (1 << 63) - 1
ANCHORS, WINDOWS, COPY = 0, 1, 2  # kinds of what comes back to a chunk
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, copies long"


class Rolling:
    """Hashes of all windows of a length, from prefix sums of powers modulo 2**64."""

    def __init__(self, h: np.ndarray, base: int) -> None:
        up, self.down = (np.full(len(h), b, np.uint64) for b in (base, pow(base, -1, 1 << 64)))
        for powers in (up, self.down):
            powers[:1] = 1
            np.cumprod(powers, dtype=np.uint64, out=powers)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up, dtype=np.uint64)])

    def every(self, width: int) -> np.ndarray:
        n = max(0, len(self.down) - width + 1)
        return mix((self.sums[width : width + n] - self.sums[:n]) * self.down[:n])

    def at(self, starts: np.ndarray, width: int) -> np.ndarray:
        return mix((self.sums[starts + width] - self.sums[starts]) * self.down[starts])


def none() -> np.ndarray:
    return np.empty(0, np.uint64)


class Chunk:
    """The words of a chunk's documents that are long enough and no copies, hashed, one document after the other."""

    def __init__(self, docs: pa.Table, back: pa.Table, window: int) -> None:
        self.window, self.block = window, window // 2
        self.copies = set(back.column("copy").drop_null().to_pylist())
        self.known, parts = WordNumbers(), []
        self.first_word: dict[int, int] = {}  # row of `docs` -> place of its first word
        sizes, ids, n = [], [], 0
        for i, (row, doc_id, text) in enumerate(zip(docs.column("row"), docs.column("doc_id"), docs.column("text"), strict=True)):
            if row.as_py() in self.copies or (raw := text.as_py()) is None:
                continue
            words = raw.split()
            if len(words) >= window:
                parts.append(self.known.of(words))
                self.first_word[i] = n
                sizes.append(len(words))
                ids.append(NO_ID if (one := doc_id.as_py()) is None else one)
                n += len(words)
        self.words = np.concatenate(parts or [np.empty(0, np.int32)])
        self.h = self.known.low(self.words)
        self.sizes = np.array(sizes, np.int64)
        self.place = np.arange(n, dtype=np.int32) - np.repeat((np.cumsum(self.sizes) - self.sizes).astype(np.int32), self.sizes)
        self.left = np.repeat(self.sizes.astype(np.int32), self.sizes) - self.place
        self.ids = np.repeat(np.array(ids, np.int64), self.sizes)
        self.rolling = Rolling(self.h, BASE_A)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of block length, and which of them lie in one document."""
        r = self.rolling.every(self.block)
        return r, self.left[: len(r)] >= self.block

    def candidates(self, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the windows start that have a hit inside, and their two hashes."""
        n = max(0, len(self.h) - self.window + 1)
        if not n or not len(hits):
            return np.empty(0, np.int64), none(), none()
        r, inside = self.anchors()
        so_far = np.concatenate([[0], np.cumsum(Among(hits).has(r) & inside, dtype=np.int64)])
        reach = self.window - self.block + 1
        starts = np.nonzero((so_far[reach : reach + n] > so_far[:n]) & (self.left[:n] >= self.window))[0]
        return starts, self.rolling.at(starts, self.window), Rolling(self.known.high(self.words), BASE_B).at(starts, self.window)


class Anchors(Traffic):
    """Parts: hashes of blocks, whether each comes once or more, and hashes of the other rolling windows. Answers: which of either are hits:
    blocks that occur as blocks again, and other windows that equal a block."""

    held: tuple | None = None  # an answer and its look-up tables, for all parts that it is for

    def split(self, part: tuple, levels: Levels, level: int) -> list[tuple]:
        own, n, probe = part
        at, to = ranges(own, levels, level), ranges(probe, levels, level)
        pieces = [(own[at[k] : at[k + 1]], n[at[k] : at[k + 1]], probe[to[k] : to[k + 1]]) for k in range(len(at) - 1)]
        return [p if len(p[0]) or len(p[2]) else None for p in pieces]

    def merge(self, parts: list[tuple]) -> tuple:
        own, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        n = np.bincount(at, np.concatenate([p[1] for p in parts]), len(own))
        return own, np.minimum(n, 2).astype(np.uint64), distinct(np.concatenate([p[2] for p in parts]))

    def settle(self, merged: tuple) -> tuple:
        own, n, probe = merged
        return own[n >= 2], probe[Among(own).has(probe)] if len(own) else none()

    def join(self, answers: list[tuple]) -> tuple:
        return tuple(np.concatenate([none(), *[a[i] for a in answers]]) for i in (0, 1))

    def reply(self, k: int, part: tuple, merged: tuple, answer: tuple) -> tuple | None:
        if self.held is None or self.held[0] is not answer:
            self.held = answer, [Among(y) if len(y) else None for y in answer]
        again, met = (x[y.has(x)] if y else none() for x, y in zip((part[0], part[2]), self.held[1], strict=True))
        return (again, met) if len(again) or len(met) else None

    def pack(self, part: tuple) -> tuple[bytes, bytes, bytes]:
        return pack_keys(part[0]), pack_ints(part[1]), pack_keys(part[2])

    def unpack(self, packed: tuple[bytes, bytes, bytes]) -> tuple:
        own = unpack_keys(packed[0])
        return own, unpack_ints(packed[1])[: len(own)], unpack_keys(packed[2])

    def pack_answer(self, answer: tuple) -> tuple[bytes, bytes, bytes]:
        return pack_keys(answer[0]), pack_keys(answer[1]), b""

    def unpack_answer(self, packed: tuple[bytes, bytes, bytes]) -> tuple:
        return unpack_keys(packed[0]), unpack_keys(packed[1])


def distinct_windows(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows, sorted by both hashes, the smallest id of each, and which of them each given window is."""
    order = np.lexsort((ids, b, a))
    sa, sb = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])
    which = np.empty(len(a), np.int64)
    which[order] = np.cumsum(new) - 1
    return sa[new], sb[new], ids[order][new], which


def pack_ids(ids: np.ndarray) -> bytes:
    flip = np.uint64(1 << 63) if len(ids) and ids.min() < 0 else np.uint64(0)
    return bytes([int(flip != 0)]) + pack_ints(ids.astype(np.uint64) ^ flip)


def unpack_ids(data: bytes) -> np.ndarray:
    return (unpack_ints(data[1:]) ^ np.uint64(data[0] << 63)).astype(np.int64)


def places(a: np.ndarray, b: np.ndarray, wanted: tuple) -> np.ndarray:
    """Where the wanted windows are in a list sorted by both hashes that has them all."""
    at = np.searchsorted(a, wanted[0])
    while (off := (a[at] == wanted[0]) & (b[at] != wanted[1])).any():
        at[off] += 1
    return at


class Windows(Traffic):
    """Parts: both hashes of windows and the smallest doc_id that each starts in. Answers: windows that start in a smaller one, and which."""

    def split(self, part: tuple, levels: Levels, level: int) -> list[tuple]:
        at = ranges(part[0], levels, level)
        return [tuple(x[i:j] for x in part) if i < j else None for i, j in zip(at[:-1], at[1:], strict=True)]

    def merge(self, parts: list[tuple]) -> tuple:
        *merged, self.which = distinct_windows(*(np.concatenate([p[i] for p in parts]) for i in range(3)))
        self.ends = np.cumsum([0] + [len(p[0]) for p in parts])
        return tuple(merged)

    def settle(self, merged: tuple) -> tuple:
        return none(), none(), np.empty(0, np.int64)

    def join(self, answers: list[tuple]) -> tuple:
        every = [self.settle(()), *answers]
        return tuple(np.concatenate([a[i] for a in every]) for i in range(3))

    def reply(self, k: int, part: tuple, merged: tuple, answer: tuple) -> tuple | None:
        a, b, least = merged
        if len(answer[0]):
            least = least.copy()
            least[places(a, b, answer)] = answer[2]
        best = least[self.which[self.ends[k] : self.ends[k + 1]]]
        lost = best < part[2]
        return (part[0][lost], part[1][lost], best[lost]) if lost.any() else None

    def pack(self, part: tuple) -> tuple[bytes, bytes, bytes]:
        return pack_keys(part[0]), pack_ints(part[1]), pack_ids(part[2])

    def unpack(self, packed: tuple[bytes, bytes, bytes]) -> tuple:
        keys = unpack_keys(packed[0])
        return keys, unpack_ints(packed[1])[: len(keys)], unpack_ids(packed[2])[: len(keys)]

    pack_answer, unpack_answer = pack, unpack


def of_kind(back: pa.Table, kind: int) -> pa.Table:
    return back.filter(pa.array([k == kind for k in back.column("kind").to_pylist()], pa.bool_()))


def hits_of(back: pa.Table) -> np.ndarray:
    again, met = joined_answer(of_kind(back, ANCHORS), Anchors())
    return distinct(np.concatenate([again, met]))


def send_anchors(docs: pa.Table, copies: pa.Table, chunk: int, window: int, levels: Levels) -> pa.Table:
    c = Chunk(docs, copies, window)
    r, inside = c.anchors()
    own = c.place[: len(r)] % c.block == 0
    keys, n = np.unique(r[inside & own], return_counts=True)
    return sent((keys, np.minimum(n, 2).astype(np.uint64), distinct(r[inside & ~own])), Anchors(), chunk, levels)


def send_windows(docs: pa.Table, back: pa.Table, chunk: int, window: int, levels: Levels) -> pa.Table:
    c = Chunk(docs, back, window)
    starts, h1, h2 = c.candidates(hits_of(back))
    return sent(distinct_windows(h1, h2, c.ids[starts])[:3], Windows(), chunk, levels)


def gone_words(c: Chunk, back: pa.Table) -> np.ndarray:
    """Which words of the chunk go."""
    starts, h1, h2 = c.candidates(hits_of(back))
    a, b, least, which = distinct_windows(h1, h2, c.ids[starts])
    answer = joined_answer(of_kind(back, WINDOWS), Windows())
    if len(answer[0]):
        least[places(a, b, answer)] = answer[2]
    lost = starts[least[which] < c.ids[starts]]
    change = np.zeros(len(c.h) + 1, np.int32)
    change[lost] = 1
    change[: len(c.h)] = np.cumsum(change[: len(c.h)])  # windows begun so far
    done = np.zeros(len(c.h), np.int32)
    done[c.window :] = change[: max(0, len(c.h) - c.window)]
    return change[: len(c.h)] > done


def judge(docs: pa.Table, back: pa.Table, window: int, texts: bool) -> pa.Table:
    c = Chunk(docs, back, window)
    gone = gone_words(c, back)
    out = []
    for i, (row, doc_id, text) in enumerate(zip(docs.column("row"), docs.column("doc_id"), docs.column("text"), strict=True)):
        words = (text.as_py() or b"").split()
        n, removed, kept = len(words), 0, words
        if i in c.first_word:
            own = gone[c.first_word[i] : c.first_word[i] + n]
            if removed := int(own.sum()):
                kept = [w for w, g in zip(words, own.tolist(), strict=True) if not g]
        elif n >= window and row.as_py() in c.copies:
            removed, kept = n, []
        kept = b" ".join(kept)
        out.append((doc_id.as_py(), n, removed, kept if texts else hashlib.sha256(kept).hexdigest()))
    kinds = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary()) if texts else ("kept_sha256", pa.string())]
    return pa.table({k: pa.array([r[i] for r in out], kind) for i, (k, kind) in enumerate(kinds)} | {"copies": docs.column("copies")})


def remove_repeats(docs: DataFrame, window: int = WINDOW, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document; with `texts`, the kept text instead of its hash."""
    total = docs.agg(F.sum(F.octet_length(docs["text"]))).first()[0] or 0
    chunks = chunks_for(total)
    levels = Levels.of(chunks)
    docs, any_copies = folded(docs.select(docs["doc_id"], docs["text"]))
    key, source = F.xxhash64("doc_id", "text"), chunk_of(docs, chunks)
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), "copies", key.alias("row"), source.alias("source"))
    names = docs.select("doc_id", key.alias("row"), source.alias("source"), F.sha2("text", 256).alias("sha"), F.octet_length("text").alias("n_bytes")).filter("sha IS NOT NULL")
    own = F.coalesce("doc_id", F.lit(NO_ID))
    # The join has a key more than the grouping: so both of its sides are dealt anew, and Spark can split a large group.
    firsts = names.groupBy("sha").agg(F.max("n_bytes").alias("n_bytes"), F.min(own).alias("least"), F.count("*").alias("n")).filter("n > 1").select("sha", "n_bytes", "least")
    nothing = [F.lit(None).cast("binary").alias(c) for c in "xyz"]
    copies = names.join(firsts, ["sha", "n_bytes"]).filter(own > F.col("least")).select("source", F.lit(COPY).alias("kind"), F.lit(None).cast("long").alias("bucket"), F.col("row").alias("copy"), *nothing)
    answers = lambda a, kind: a.select("source", F.lit(kind).alias("kind"), "bucket", F.lit(None).cast("long").alias("copy"), *"xyz")
    asked = rows.groupBy("source").cogroup(copies.groupBy("source")).applyInArrow(lambda k, t, c: send_anchors(t, c, key_of(k), window, levels), MESSAGE)
    hits = copies.unionByName(answers(exchange(asked, Anchors(), levels), ANCHORS))
    again = rows.groupBy("source").cogroup(hits.groupBy("source")).applyInArrow(lambda k, t, h: send_windows(t, h, key_of(k), window, levels), MESSAGE)
    lost = hits.unionByName(answers(exchange(again, Windows(), levels), WINDOWS))
    result = RESULT.replace("kept_sha256 string", "kept binary") if texts else RESULT
    out = unfolded(rows.groupBy("source").cogroup(lost.groupBy("source")).applyInArrow(lambda t, h: judge(t, h, window, texts), result), any_copies)
    return out.withColumn("kept", F.col("kept").cast("string")) if texts else out


def key_of(key: tuple) -> int:
    return key[0].as_py()


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT s, min(doc_id) AS first FROM p GROUP BY s HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM p JOIN f USING (s) WHERE doc_id > first),
k AS (SELECT doc_id, list(j) AS gone FROM g GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, len(coalesce(gone, []))::BIGINT AS n_removed,
    sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE [x for x, i in w if NOT list_contains(gone, i)] END, ' ')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
