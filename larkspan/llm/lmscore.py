"""Operator 3: cross-entropy difference under matched target and background language models.

Both are bigram models over one vocabulary (all words of the corpus, and a document's end), smoothed alike: bigrams
towards the model's words, words towards the corpus's words, each with a Dirichlet prior. The background model counts
every document, the target model those that the caller marks. A document's score is its target loss less its background
loss, in nats a token: the lower, the more it looks like the target. A document is judged by the others: its own counts are
left out of both models (the prior over the vocabulary keeps them), so marked documents don't look good by construction.

Counts are summed over all documents without a cap. Chunks of documents send their distinct words and bigrams, with
counts, to buckets of the key space (see blocks); the buckets' sums go back to the chunks that asked, which score their
documents. So one corpus-sized exchange of packed counts serves both counting and scoring, and no model is collected,
broadcast or held in one place.

Words are runs of other than ASCII white space, A-Z lower-cased. Defined results: null texts and texts without words
have no tokens and null losses and aren't counted; a very long text is one row of its chunk, which holds a few times its
bytes; rows that repeat in id and text are counted each, left out and scored together; ties can't arise; without target
documents the target model is the shared prior; empty tables give empty results. Other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import MESSAGE, MOST_BROADCAST, Levels, Traffic, chunk_of, chunks_for, exchange, folded, joined_answer, pack_ints, pack_keys, ranges, sent, unfolded, unpack_ints, unpack_keys
from .common import WordHashes, distinct, mix, table
from .mixing import tokens_of

PRIOR_WORD = 1000.0
PRIOR_PAIR = 10.0
DIGITS = 6
END = np.uint64(0xC2B2AE3D27D4EB4F)
A, B = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double, score double, copies long"


def word_key(h: np.ndarray) -> np.ndarray:
    return mix(h * A + B)


def pair_key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(u * B + A) + w * A)


def tokens(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all documents' words, END after each document that has words; and how many of them are each document's."""
    known, parts, sizes = WordHashes(), [], []
    for text in rows.column("text"):
        words = (text.as_py() or b"").lower().split()
        if words:
            words.append(b"")  # no word is empty: the end's place
        parts.append(known.of(words))
        sizes.append(len(words))
    h = np.concatenate(parts or [np.empty(0, np.uint64)])
    sizes = np.array(sizes, np.int64)
    h[np.cumsum(sizes)[sizes > 0] - 1] = END
    return h, sizes


def pairs_of(h: np.ndarray) -> np.ndarray:
    """Keys of each token with the one before it; before a document's first is an end, its own or the last one's."""
    return pair_key(np.concatenate([np.full(min(1, len(h)), END), h[:-1]]), h)


class Counts(Traffic):
    """Parts: keys, background counts, target counts. Answers: both counts' sums, for the part's keys."""

    def split(self, part: tuple, levels: Levels, level: int) -> list[tuple]:
        at = ranges(part[0], levels, level)
        return [tuple(x[i:j] for x in part) if i < j else None for i, j in zip(at[:-1], at[1:], strict=True)]

    def merge(self, parts: list[tuple]) -> tuple:
        keys, self.at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        self.ends = np.cumsum([0] + [len(p[0]) for p in parts])
        sums = (np.bincount(self.at, np.concatenate([p[i] for p in parts]).astype(float), len(keys)).astype(np.uint64) for i in (1, 2))
        return keys, *sums

    def settle(self, merged: tuple) -> tuple:
        return merged[1:]

    def join(self, answers: list[tuple]) -> tuple:
        return tuple(np.concatenate([np.empty(0, np.uint64), *[a[i] for a in answers]]) for i in (0, 1))

    def reply(self, k: int, part: tuple, merged: tuple, answer: tuple) -> tuple:
        at = self.at[self.ends[k] : self.ends[k + 1]]
        return answer[0][at], answer[1][at]

    def pack(self, part: tuple) -> tuple[bytes, bytes, bytes]:
        return pack_keys(part[0]), pack_ints(part[1]), pack_ints(part[2])

    def unpack(self, packed: tuple[bytes, bytes, bytes]) -> tuple:
        return unpack_keys(packed[0]), unpack_ints(packed[1]), unpack_ints(packed[2])

    def pack_answer(self, answer: tuple) -> tuple[bytes, bytes, bytes]:
        return pack_ints(answer[0]), pack_ints(answer[1]), b""

    def unpack_answer(self, packed: tuple[bytes, bytes, bytes]) -> tuple:
        return unpack_ints(packed[0]), unpack_ints(packed[1])


def counted(rows: pa.Table) -> tuple:
    """The chunk's words and bigrams with their counts."""
    h, sizes = tokens(rows)
    copies = np.repeat(rows.column("copies").to_numpy(), sizes).astype(float)
    marked = np.repeat(np.array(rows.column("target").to_pylist(), bool), sizes)
    words, pairs = word_key(h), pairs_of(h)
    keys, at = np.unique(np.concatenate([words, pairs]), return_inverse=True)
    twice = np.concatenate([copies, copies])
    return keys, *(np.bincount(at, w, len(keys)).astype(np.uint64) for w in (twice, twice * np.concatenate([marked, marked])))


def own_counts(doc: np.ndarray, token: np.ndarray, n: int) -> np.ndarray:
    """How often each token occurs in its document."""
    _, at, times = np.unique(doc * n + token, return_inverse=True, return_counts=True)
    return times[at]


def losses(rows: pa.Table, answers: pa.Table, n_all: int, n_target: int) -> pa.Table:
    h, sizes = tokens(rows)
    copies = rows.column("copies").to_numpy()
    marked = np.array(rows.column("target").to_pylist(), bool)
    words, w = np.unique(word_key(h), return_inverse=True)
    pairs, uw = np.unique(pairs_of(h), return_inverse=True)
    keys = distinct(np.concatenate([words, pairs]))
    at_words, at_pairs = np.searchsorted(keys, words), np.searchsorted(keys, pairs)
    del keys
    sums = dict(zip(("background", "target"), joined_answer(answers, Counts()), strict=True))
    end = np.searchsorted(words, word_key(np.array([END])))
    before = np.concatenate([end[: min(1, len(w))], w[:-1]])
    base = sums["background"][at_words] / max(n_all, 1)
    full = sizes > 0
    starts = (np.cumsum(sizes) - sizes)[full]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    own_word, own_pair = own_counts(doc, w, max(1, len(words))), own_counts(doc, uw, max(1, len(pairs)))
    own_before = np.concatenate([own_word[:1], own_word[:-1]])
    own_before[starts] = 1  # a document has one end
    out = {}
    for name, n in (("target", n_target), ("background", n_all)):
        times = np.where(marked, copies, 0) if name == "target" else copies
        left_out = times[doc]
        of_word = sums[name][at_words].astype(float)
        one = of_word[w] - left_out * own_word
        prior = PRIOR_PAIR * (one + PRIOR_WORD * base[w]) / ((n - times * sizes)[doc] + PRIOR_WORD)
        odds = (sums[name][at_pairs].astype(float)[uw] - left_out * own_pair + prior) / (of_word[before] - left_out * own_before + PRIOR_PAIR)
        loss = np.full(len(sizes), np.nan)
        if full.any():
            loss[full] = np.add.reduceat(-np.log(odds), starts) / sizes[full]
        out[name] = loss
    as_column = lambda x: pa.array(x, pa.float64(), mask=~full)
    return pa.table({"doc_id": rows.column("doc_id"), "n_tokens": pa.array(np.maximum(sizes - 1, 0)), "target_loss": as_column(out["target"]), "background_loss": as_column(out["background"]), "score": as_column(out["target"] - out["background"]), "copies": pa.array(copies)})


def cross_entropy_difference(docs: DataFrame, target: Column) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score of each document; `target` marks the target's documents."""
    marked = docs.select(docs["doc_id"], docs["text"], F.coalesce(target, F.lit(False)).alias("target"))
    full = tokens_of(F.col("text")) > 0
    sums = marked.select(F.octet_length("text").alias("b"), "target", tokens_of(F.col("text")).alias("n"), full.alias("full")).groupBy("target").agg(F.sum("b").alias("b"), F.sum(F.col("n") + F.col("full").cast("int")).alias("n")).collect()
    n_all, n_target = sum(r["n"] or 0 for r in sums), sum(r["n"] or 0 for r in sums if r["target"])
    chunks = chunks_for(sum(r["b"] or 0 for r in sums))
    levels = Levels.of(chunks)
    rows, any_copies = folded(marked)
    dealt = rows.select("doc_id", F.col("text").cast("binary").alias("text"), "target", "copies", chunk_of(rows, chunks).alias("source"))
    asked = dealt.groupBy("source").applyInArrow(lambda key, t: sent(counted(t), Counts(), key[0].as_py(), levels), MESSAGE)
    answers = exchange(asked, Counts(), levels)
    scored = dealt.groupBy("source").cogroup(answers.groupBy("source")).applyInArrow(lambda t, a: losses(t, a, n_all, n_target), SCORES)
    return unfolded(scored, any_copies)


def marked_by(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Column]:
    """The documents, and whether a label calls each of good quality."""
    good = labels.filter("quality = 1").select(F.col("doc_id").alias("_good")).dropna().distinct()
    if labels.count() <= MOST_BROADCAST:
        good = F.broadcast(good)
    joined = docs.select("doc_id", "text").join(good, F.col("doc_id") == F.col("_good"), "left")
    return joined, joined["_good"].isNotNull()


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, good = marked_by(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    out = cross_entropy_difference(docs, good)
    return out.select("doc_id", "n_tokens", *[F.round(c, DIGITS).alias(c) for c in ("target_loss", "background_loss", "score")])


OP3_SQL = rf"""
WITH d AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+'), []) AS w FROM documents),
t AS (SELECT doc_id, good, unnest(list_prepend('', w)) AS u, unnest(list_append(w, '')) AS x FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, good, u, x, count(*)::DOUBLE AS n FROM t GROUP BY ALL),
o AS (SELECT doc_id, good, x, sum(n) AS n FROM p GROUP BY ALL),
z AS (SELECT doc_id, sum(n) AS size FROM o GROUP BY doc_id),
cp AS (SELECT u, x, sum(n) AS b, coalesce(sum(n) FILTER (good), 0) AS t FROM p GROUP BY u, x),
cw AS (SELECT x, sum(n) AS b, coalesce(sum(n) FILTER (good), 0) AS t FROM o GROUP BY x),
s AS (SELECT sum(b) AS b, sum(t) AS t FROM cw),
k AS (SELECT p.doc_id, p.n AS times, size, own.n AS own_x, coalesce(prev.n, 1) AS own_u, p.n AS own_p, if(p.good, 1, 0) AS g, cp.b AS pb, cp.t AS pt, wx.b AS xb, wx.t AS xt, wu.b AS ub, wu.t AS ut
    FROM p JOIN z USING (doc_id) JOIN o own ON p.doc_id = own.doc_id AND p.x = own.x JOIN o prev ON p.doc_id = prev.doc_id AND p.u = prev.x
    JOIN cp ON p.u = cp.u AND p.x = cp.x JOIN cw wx ON p.x = wx.x JOIN cw wu ON p.u = wu.x),
l AS (SELECT doc_id, any_value(size) AS size,
    sum(times * -ln((pt - g * own_p + {PRIOR_PAIR} * (xt - g * own_x + {PRIOR_WORD} * xb / s.b) / (s.t - g * size + {PRIOR_WORD})) / (ut - g * own_u + {PRIOR_PAIR}))) AS target_loss,
    sum(times * -ln((pb - own_p + {PRIOR_PAIR} * (xb - own_x + {PRIOR_WORD} * xb / s.b) / (s.b - size + {PRIOR_WORD})) / (ub - own_u + {PRIOR_PAIR}))) AS background_loss
    FROM k, s GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_tokens, round(target_loss / size, {DIGITS}) AS target_loss, round(background_loss / size, {DIGITS}) AS background_loss,
    round(target_loss / size - background_loss / size, {DIGITS}) AS score
FROM d LEFT JOIN l USING (doc_id)
"""
