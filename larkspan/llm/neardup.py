"""Operator 10: MinHash near-duplicates with sequential Bayesian verification.

Sets are the distinct `width`-word shingles of a whole text. Rows with equal sets form a class, a node; nodes are numbered
in the order of their smallest doc_id and get a signature of ROWS minima a band. Nodes that agree in a band share
a bucket. Candidates are compared a batch of signature bytes at a time: with a uniform prior on the similarity, a pair
is dropped once the posterior probability of reaching the threshold is below `miss`; survivors are confirmed on full sets.

No bucket is expanded into its pairs up front:
1. each member is compared with its bucket's smallest node; every node keeps its best such partner, those pairs are
   confirmed exactly, and confirmed links are joined to components;
2. only in buckets that then still hold several components are the remaining pairs compared, across components: strays
   against all members, in blocks bounded by members and by shingles; survivors are confirmed exactly where they are
   compared, so no pairs are listed, and the components joined again.
A pair that is skipped has both ends in one component already, so components are those of all links among candidates.
A bucket with more than MOST_STRAYS strays (pages of one template that aren't copies) isn't compared by blocks as it is:
its members are dealt anew by their rarest shingles. Sets that reach the threshold share one of their prefixes, the
shingles of which they have (1 - threshold) of all and one more, rarest first, so no link is lost, and members that have
only the template in common never meet.
Components come from rounds of contraction to the smallest neighbour, chains of names followed to their ends by doubling:
two rounds halve the names that still have links, so their number is logarithmic. Spent tables are deleted.

A pair at the threshold is in no common bucket with probability (1 - threshold**6)**bands, at most MISS_BUCKET: that takes 28
bands at 0.85 and 44 at 0.8. `miss` is 1e-6 a batch.

Words are runs of other than ASCII white space, A-Z lower-cased. Defined results: null texts and texts without words
have no shingles and are alone, whatever other rows of their id hold; a text with fewer words than `width` has its whole sequence as one. Very long texts are
taken whole: a task holds one text and its shingles' hashes (8 bytes each), and blocks hold fewer of them. Ties (equal sets,
equal matches) go to the smallest doc_id. In near_duplicates() null ids are alone and keep a null component, and rows that
agree in id share a component, each compared with its own set. one_of_each() goes by rows instead: of a group of near
copies the row with the smallest doc_id stays (null ids last), once, and a row isn't judged by its namesakes. Empty tables
give empty results. Other columns, whatever their names, are never read by the query and are kept by one_of_each().
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, by_groups, cut, distinct, drop, mix, table

WIDTH = 3
THRESHOLD = (85, 100)
ROWS = 6
MISS_BUCKET = 2e-6
BATCH = 24
MISS = 1e-6
BLOCK = 400
BLOCK_SHINGLES = 2_000_000
MOST_STRAYS = 2_000
HUB_SHARE = 200
MOST_BROADCAST = 500_000  # rows of three integers
SEED = 20_240_607


def shingles(text: bytes | None, known: WordHashes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = known.of(words)
    span = min(width, len(h))
    out = np.full(len(h) - span + 1, span, np.uint64)
    for k in range(span):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - span + 1 + k])
    return distinct(out)


def bands_for(threshold: tuple[int, int]) -> int:
    """The fewest bands by which a pair at the threshold shares no bucket with probability MISS_BUCKET at most."""
    s = min(threshold[0] / threshold[1], 1 - 1e-9)
    return max(1, math.ceil(math.log(MISS_BUCKET) / math.log1p(-(s**ROWS))))


BANDS = bands_for(THRESHOLD)


def permutations(n: int = BANDS * ROWS) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(SEED)
    return r.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), r.integers(0, 1 << 32, n, dtype=np.uint32)


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of a family of bijections of 32-bit halves of the hashes."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    step = max(1, (1 << 16) // len(a))
    for i in range(0, len(x), step):
        y = x[i : i + step, None] ^ b
        y *= a
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        out = np.minimum(out, y.min(axis=0))
    return out


def least_matches(threshold: float, miss: float = MISS, n: int = BANDS * ROWS) -> list[tuple[int, int]]:
    """(hashes compared, fewest matches to go on) after each batch: one matching byte has odds s + (1 - s) / 256."""
    q = threshold + (1 - threshold) / 256
    out = []
    for k in range(BATCH, n + 1, BATCH):
        below, m = 0.0, 0
        while m <= k:  # the posterior mass at or above q after m of k matches, under a uniform prior
            below += math.comb(k + 1, m) * q**m * (1 - q) ** (k + 1 - m)
            if below >= miss:
                break
            m += 1
        out.append((k, m))
    return out


SIGNED = "doc_id long, text_key long, n_shingles long, set_a long, set_b long, bytes binary, bands array<long>"


def signed(docs: DataFrame, width: int, n_bands: int = BANDS) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = permutations(n_bands * ROWS)
        known = WordHashes()
        odd = np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
        for batch in batches:
            n, sa, sb, sig, bands = [], [], [], [], []
            for text in batch.column("text"):
                s = shingles(text.as_py(), known, width)
                n.append(len(s))
                sa.append(int(s.sum(dtype=np.uint64).astype(np.int64)))
                sb.append(int(mix(s).sum(dtype=np.uint64).astype(np.int64)))
                v = signature(s, a, b)
                sig.append((v & np.uint32(0xFF)).astype(np.uint8).tobytes() if len(s) else b"")
                keys = mix((mix(v.reshape(n_bands, ROWS).astype(np.uint64) * odd)).sum(axis=1, dtype=np.uint64) + np.arange(n_bands, dtype=np.uint64))
                bands.append(keys.astype(np.int64) if len(s) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(sa, pa.int64()), pa.array(sb, pa.int64()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "text_key", "n_shingles", "set_a", "set_b", "bytes", "bands"])

    return docs.select(docs["doc_id"], F.xxhash64(docs["text"]).alias("text_key"), docs["text"].cast("binary").alias("text")).mapInArrow(sign, SIGNED)


def survives(x: np.ndarray, y: np.ndarray, least: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """For rows of signature bytes, which pairs pass every batch; and their matches."""
    alive, matches, at = np.arange(len(x)), np.zeros(len(x), np.int64), 0
    for k, m in least:
        matches[alive] += (x[alive, at:k] == y[alive, at:k]).sum(axis=1)
        alive, at = alive[matches[alive] >= m], k
    ok = np.zeros(len(x), bool)
    ok[alive] = True
    return ok, matches


def as_rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def compared(pairs: DataFrame, least: list[tuple[int, int]]) -> DataFrame:
    """pairs: a, b and their bytes x, y. Those that survive, with `matches`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if t.num_rows:
                ok, m = survives(as_rows(t.column("x")), as_rows(t.column("y")), least)
                keep = pa.array(ok)
                yield pa.RecordBatch.from_arrays([t.column("a").filter(keep), t.column("b").filter(keep), pa.array(m[ok], pa.int64())], names=["a", "b", "matches"])

    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, matches long")


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MOST_BROADCAST else df


def texts_of(ids: DataFrame, nodes: Nodes, most: int) -> DataFrame:
    """(id, text) of the nodes `id`, of which there are `most` at most; other texts aren't moved."""
    ids = cut(ids.distinct().join(nodes.classes.select(F.col("node").alias("id"), "rep", "rep_key"), "id"), "ids", most)
    docs, named = nodes.docs, small(ids, ids.count())
    own = docs.select(docs["doc_id"], F.xxhash64(docs["text"]).alias("text_key"), docs["text"].cast("binary").alias("text"))
    return own.join(named, (F.col("text_key") == F.col("rep_key")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("id", "text").dropDuplicates(["id"])


def reaches(x: np.ndarray, y: np.ndarray, threshold: tuple[int, int]) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common > 0 and threshold[1] * common >= threshold[0] * (len(x) + len(y) - common)


def confirmed(pairs: DataFrame, nodes: Nodes, threshold: tuple[int, int], width: int, most: int) -> DataFrame:
    """pairs (a, b) whose full sets reach the threshold; there is one for each of `most` nodes at most."""
    pairs = cut(pairs.select("a", "b"), "pairs", most)
    texts = texts_of(pairs.select(F.col("a").alias("id")).union(pairs.select("b")), nodes, most)
    # A node that is many others' partner is dealt, with copies of its text, into shares of HUB_SHARE pairs.
    shares = cut(pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_SHARE).alias("shares")).filter("shares > 1"), "hubs", 1 + most // HUB_SHARE)
    n = F.coalesce("shares", F.lit(1).cast("long"))
    hubs = texts.withColumnRenamed("id", "a").join(shares, "a", "left").select("a", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("share"), F.col("text").alias("x"))
    dealt = pairs.join(shares, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), n).alias("share"))
    both = dealt.join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b").join(hubs, ["a", "share"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        last, last_set = None, np.empty(0, np.uint64)
        for t in batches:
            keep = []
            for a, x, y in zip(t.column("a").to_pylist(), t.column("x"), t.column("y"), strict=True):
                if a != last:
                    last, last_set = a, shingles(x.as_py(), known, width)
                keep.append(reaches(last_set, shingles(y.as_py(), known, width), threshold))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([t.column("a").filter(keep), t.column("b").filter(keep)], names=["a", "b"])

    return cut(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")


def roots(to: DataFrame, most: int) -> DataFrame:
    """(old, new), each name's smaller one or itself -> the same with the ends of all chains, found by doubling."""
    while True:
        up = to.select(F.col("old").alias("mid"), F.col("new").alias("top"))
        far = cut(to.join(up, F.col("new") == F.col("mid")).select("old", F.col("top").alias("new"), (F.col("top") != F.col("new")).alias("moved")), "to", most)
        moved = not far.filter("moved").isEmpty()
        drop(to)
        to = far
        if not moved:
            return to


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (id, component), the smallest id that each linked id reaches.

    Every round renames each id to its smallest neighbour's root and drops links within a name; names stay linked,
    and the smallest id of a component keeps its own, so when no links are left all ids of a component bear its name.
    """
    n = links.count()
    edges = cut(links.filter("a <> b").distinct(), "edges", n)
    names = cut(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().withColumn("component", F.col("id")), "names", 2 * n)
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = roots(cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("old"), F.least("a", "m").alias("new")), "to", 2 * n), 2 * n).select("old", "new")
        renamed = cut(names.join(to, F.col("component") == F.col("old"), "left").select("id", F.coalesce("new", "component").alias("component")), "names", 2 * n)
        left = edges.join(to, F.col("a") == F.col("old")).select(F.col("new").alias("a"), "b").join(to, F.col("b") == F.col("old")).select("a", F.col("new").alias("b"))
        fewer = cut(left.filter("a <> b").distinct(), "edges", n)
        drop(names, edges)
        names, edges = renamed, fewer
    return names


def of_similar_size(x, y, threshold: tuple[int, int]):
    """Whether sets of these sizes can reach the threshold; for columns and for arrays."""
    return (threshold[1] * x >= threshold[0] * y) & (threshold[1] * y >= threshold[0] * x)


def block_pairs(t: pa.Table, least: list[tuple[int, int]], threshold: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of surviving pairs of a block, and their matches; in a bucket, a pair counts in the first band that it shares."""
    x, (side, node, name, n) = as_rows(t.column("bytes")), (t.column(c).to_numpy() for c in ("side", "node", "component", "n"))
    stray = np.array(t.column("stray").to_pylist(), bool)
    bands = np.array(t.column("bands").to_pylist(), np.int64).reshape(t.num_rows, -1)
    key, right = t.column("key")[0].as_py(), np.nonzero(side == 1)[0]
    by_band = t.column("band")[0].as_py()
    first, other, matches = [], [], []
    for k in np.nonzero(side == 0)[0]:
        at = right[(name[right] != name[k]) & (~stray[right] | (node[right] > node[k])) & of_similar_size(n[right], n[k], threshold)]
        if len(at):
            if by_band:
                at = at[bands[k][(bands[at] == bands[k]).argmax(axis=1)] == key]
            ok, m = survives(np.broadcast_to(x[k], (len(at), x.shape[1])), x[at], least)
            first.append(np.full(int(ok.sum()), k))
            other.append(at[ok])
            matches.append(m[ok])
    none = [np.empty(0, np.int64)]
    return tuple(np.concatenate(p or none) for p in (first, other, matches))


PLACED = ["key", "band", "i", "j", "side", "node", "component", "stray"]
PLACED_TYPES = "key long, band boolean, i int, j int, side int, node long, component long, stray boolean"


def by_rarest(pool: DataFrame, nodes: Nodes, threshold: tuple[int, int], width: int) -> DataFrame:
    """(key, node): the shingles in the prefix of each node of the pool that other nodes of the pool have, too.

    The order is by frequency in the pool. A shingle that only one node has comes first in its prefix and is left out:
    it can't be shared.
    """
    texts = texts_of(pool.select(F.col("node").alias("id")), nodes, pool.count())

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for t in batches:
            yield pa.RecordBatch.from_arrays([t.column("id"), pa.array([shingles(x.as_py(), known, width).astype(np.int64) for x in t.column("text")], pa.list_(pa.int64()))], names=["node", "set"])

    held = cut(texts.select("id", "text").mapInArrow(sets, "node long, set array<long>"), "sets")
    each = held.select("node", F.size("set").alias("n"), F.explode("set").alias("key"))
    often = cut(each.groupBy("key").agg(F.count("*").alias("f")).filter("f > 1"), "often")
    common = each.join(often, "key").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("f", "key"))).alias("common"))
    prefix = F.col("n") - F.ceil(F.col("n") * threshold[0] / threshold[1]) + 1
    take = F.greatest(prefix - (F.col("n") - F.size("common")), F.lit(0)).cast("int")
    return common.select("node", F.explode(F.slice("common", F.lit(1), take)["key"]).alias("key"))


def with_strays(members: DataFrame) -> DataFrame:
    """members: key, node, component, n. Adds `stray`: whether a member is outside the component of the key's smallest node."""
    main = cut(members.groupBy("key").agg(F.min_by("component", "node").alias("main"), F.count("*").alias("members")).filter("members > 1").select("key", "main"), "main")
    return members.join(main, "key").select("key", "node", "component", "n", (F.col("component") != F.col("main")).alias("stray"))


def remaining_links(members: DataFrame, names: DataFrame, nodes: Nodes, least: list[tuple[int, int]], threshold: tuple[int, int], width: int, most: int) -> DataFrame:
    """Confirmed links across components within a bucket.

    Strays (members outside the component of the bucket's smallest node) meet all members, both dealt into blocks: what
    is moved grows with members plus strays times blocks, and members of the main component never meet each other.
    A first pass over signatures finds the members with surviving pairs; only their texts are dealt to the second, which
    confirms pairs on full sets, most alike first, and leaves out those whose ends its own links join already.
    """
    own = names.select(F.col("id").alias("node"), "component")
    main = names.select(F.col("id").alias("hub"), F.col("component").alias("main"))
    named = members.join(own, "node", "left").join(main, "hub", "left")
    named = named.select("key", "node", F.coalesce("component", "node").alias("component"), "n", (F.coalesce("component", "node") != F.coalesce("main", "hub")).alias("stray"))

    def open_keys(rows: DataFrame, most_keys: int) -> DataFrame:
        counts = rows.groupBy("key").agg(F.count("*").alias("n"), F.count_if("stray").alias("s"), F.sum("n").alias("size"), F.sum(F.when(F.col("stray"), F.col("n"))).alias("own_size"))
        blocks = lambda n, size: F.ceil(F.greatest(F.col(n) / BLOCK, F.col(size) / BLOCK_SHINGLES)).cast("int")
        return cut(counts.filter("s > 0").select("key", "s", blocks("s", "own_size").alias("lefts"), blocks("n", "size").alias("rights")), "open", most_keys)

    keys = open_keys(named, members.count())
    rows = named.join(keys.filter(F.col("s") <= MOST_STRAYS), "key").withColumn("band", F.lit(True))
    wide = keys.filter(F.col("s") > MOST_STRAYS)
    if not wide.isEmpty():
        pool = cut(named.join(wide.select("key"), "key", "left_semi").select("node", "component", "n").distinct(), "pool", most)
        dealt = cut(with_strays(by_rarest(pool, nodes, threshold, width).join(pool, "node")), "dealt")
        rows = rows.unionByName(dealt.join(open_keys(dealt, dealt.count()), "key").withColumn("band", F.lit(False)))
    facts = nodes.signatures.select("node", "bytes", "bands")
    rows = cut(rows.drop("s"), "rows", members.count()).join(facts, "node")
    at = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.filter("stray").withColumn("i", at("lefts")).withColumn("j", every("rights")).withColumn("side", F.lit(0))
    right = rows.withColumn("j", at("rights")).withColumn("i", every("lefts")).withColumn("side", F.lit(1))
    wanted = [*PLACED, "bytes", "bands", "n"]

    def with_survivors(t: pa.Table) -> pa.Table:
        first, other, _ = block_pairs(t, least, threshold)
        return t.select([*PLACED, "n"]).take(pa.array(distinct(np.concatenate([first, other]))))

    def link(t: pa.Table) -> pa.Table:
        node, name, text = t.column("node").to_pylist(), t.column("component").to_pylist(), t.column("text")
        first, other, matches = block_pairs(t, least, threshold)
        known, sets, joined, out = WordHashes(), {}, {}, []

        def top(c: int) -> int:
            while c in joined:
                c = joined[c]
            return c

        def set_of(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = shingles(text[k].as_py(), known, width)
            return sets[k]

        for k in np.argsort(-matches, kind="stable"):
            x, y = int(first[k]), int(other[k])
            a, b = top(name[x]), top(name[y])
            if a != b and reaches(set_of(x), set_of(y), threshold):
                joined[max(a, b)] = min(a, b)
                out.append((min(node[x], node[y]), max(node[x], node[y])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    alive = cut(by_groups(left.select(*wanted).union(right.select(*wanted)), ["key", "band", "i", "j"], with_survivors, PLACED_TYPES + ", n long"), "alive")
    texts = texts_of(alive.select(F.col("node").alias("id")), nodes, most).withColumnRenamed("id", "node")
    full = alive.join(facts, "node").join(texts, "node").select(*wanted, "text")
    return cut(by_groups(full, ["key", "band", "i", "j"], link, "a long, b long"), "links")


@dataclass
class Nodes:
    docs: DataFrame
    rows: DataFrame  # doc_id, text_key, n_shingles, set_a, set_b, of every row
    classes: DataFrame  # node, set_a, set_b, n_shingles, and rep, rep_key of the row whose text stands for it
    signatures: DataFrame  # node, n, bytes, bands


SET = ["set_a", "set_b", "n_shingles"]


def nodes_of(docs: DataFrame, width: int, n_bands: int, with_null_ids: bool) -> Nodes:
    rows = cut(signed(docs, width, n_bands), "signatures")
    total = rows.count()
    full = rows.filter("n_shingles > 0" if with_null_ids else "n_shingles > 0 AND doc_id IS NOT NULL")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first")
    classes = full.groupBy(*SET).agg(first).select(*SET, F.col("first.no_id").alias("no_id"), F.col("first.doc_id").alias("rep"), F.col("first.text_key").alias("rep_key"))
    order = ["no_id", "rep", "set_a", "set_b"]
    # Numbers that rise with `rep`, from the places in ranges; they are written before anything reads them.
    classes = cut(classes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("node", F.monotonically_increasing_id()).drop("no_id"), "classes", total)
    own = full.join(classes, SET).filter((F.col("text_key") == F.col("rep_key")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    signatures = cut(own.select("node", F.col("n_shingles").alias("n"), "bytes", "bands").dropDuplicates(["node"]), "reps", 8 * total)
    return Nodes(docs, rows.select("doc_id", "text_key", *SET), classes, signatures)


def links_of_namesakes(nodes: Nodes) -> DataFrame:
    """(a, b): links among the nodes of the rows that agree in id, for ids with several sets."""
    ids = nodes.rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    one = F.struct(*SET)
    several = cut(ids.groupBy("doc_id").agg(F.min(one).alias("lo"), F.max(one).alias("hi")).filter("lo <> hi").select("doc_id"), "namesakes", nodes.classes.count())
    if several.isEmpty():
        return several.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"))
    of = cut(ids.join(several, "doc_id", "left_semi").join(nodes.classes, SET).select("doc_id", "node").distinct(), "namesakes")
    return of.join(of.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").select("a", F.col("node").alias("b")).filter("a <> b")


def node_components(nodes: Nodes, threshold: tuple[int, int], width: int, miss: float, n_bands: int, more: DataFrame | None = None) -> DataFrame:
    """(id, component) of the nodes that have links; `more` are links known beforehand."""
    least = least_matches(threshold[0] / threshold[1], miss, n_bands * ROWS)
    most, signatures = nodes.classes.count(), nodes.signatures
    banded = signatures.select("node", "n", F.explode("bands").alias("key"))
    shared = cut(banded.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("members")).filter("members > 1").select("key", "hub"), "shared", most * n_bands // 2)
    members = cut(banded.join(shared, "key"), "members", most * n_bands)
    drop(shared)
    stars = members.filter("hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    end = lambda i, x, n: signatures.select(F.col("node").alias(i), F.col("bytes").alias(x), F.col("n").alias(n))
    with_bytes = stars.join(end("a", "x", "na"), "a").join(end("b", "y", "nb"), "b").filter(of_similar_size(F.col("na"), F.col("nb"), threshold))
    best = compared(with_bytes, least).groupBy("b").agg(F.max_by("a", F.struct("matches", -F.col("a"))).alias("a")).select("a", "b")
    links = confirmed(best, nodes, threshold, width, most)
    if more is not None:
        links = links.union(more)
    names = components(links)
    rest = remaining_links(members, names, nodes, least, threshold, width, most)
    return names if rest.isEmpty() else components(links.union(rest))


def near_duplicates(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, width: int = WIDTH, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    n_bands = bands_for(threshold)
    nodes = nodes_of(docs, width, n_bands, False)
    names = node_components(nodes, threshold, width, miss, n_bands, links_of_namesakes(nodes))
    first = nodes.classes.select(F.col("node").alias("component"), F.col("rep").alias("name"))
    renamed = names.join(first, "component").select(F.col("id").alias("node"), "name")
    joined = nodes.classes.join(renamed, "node", "left").select(*SET, F.coalesce("name", "rep").alias("component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = nodes.rows.join(joined, SET, "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def one_of_each(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, width: int = WIDTH, miss: float = MISS) -> DataFrame:
    """The columns of `docs`, for one row of each group of near copies."""
    n_bands = bands_for(threshold)
    nodes = nodes_of(docs, width, n_bands, True)
    names = node_components(nodes, threshold, width, miss, n_bands)
    stays = nodes.classes.join(names.filter("id <> component").select(F.col("id").alias("node")), "node", "left_anti")
    placed = nodes.rows.filter("n_shingles > 0").join(stays.select(*SET, "rep", "rep_key", F.lit(True).alias("stays")), SET, "left")
    own = F.coalesce(F.col("stays") & (F.col("text_key") == F.col("rep_key")) & F.col("doc_id").eqNullSafe(F.col("rep")), F.lit(False))
    keys = placed.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), own.alias("_own")).groupBy("_id", "_key").agg(F.max("_own").alias("_own"), F.count("*").alias("_n")).filter("NOT _own OR _n > 1")
    keys = cut(keys, "gone")
    n = keys.count()
    same = lambda k: docs["doc_id"].eqNullSafe(k["_id"]) & (F.xxhash64(docs["text"]) == k["_key"])
    rest = docs.join(small(keys, n), same(keys), "left_anti")
    repeated = keys.filter("_own").drop("_own", "_n")
    if repeated.isEmpty():
        return rest
    again = docs.join(small(repeated, n), same(repeated)).select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), repeated["_id"], repeated["_key"])
    once = again.groupBy("_id", "_key").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return rest.unionByName(once.select("row.*"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT r, doc_id, array_to_string(w[i:i + least(len(w), 3) - 1], ' ') AS g
    FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - least(len(w), 3) + 2)) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT x.r AS a, y.r AS b, any_value(x.doc_id) AS id_a, any_value(y.doc_id) AS id_b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.r, y.r),
l AS (SELECT DISTINCT id_a AS a, id_b AS b FROM p JOIN n na ON a = na.r JOIN n nb ON b = nb.r WHERE 100 * c >= 85 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
k(doc_id, c) AS (SELECT DISTINCT doc_id, doc_id FROM t WHERE doc_id IS NOT NULL UNION SELECT e.b, k.c FROM k JOIN e ON k.doc_id = e.a WHERE k.c < e.b),
m AS (SELECT doc_id, min(c) AS component_id FROM k GROUP BY doc_id)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, CASE WHEN n.n IS NULL THEN t.doc_id ELSE m.component_id END AS component_id,
    coalesce(n.n IS NULL OR m.component_id = t.doc_id, true) AS kept
FROM t LEFT JOIN m USING (doc_id) LEFT JOIN n USING (r)
"""
