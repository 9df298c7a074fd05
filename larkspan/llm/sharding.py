"""Operator 1: shards of near equal bytes, as leaves of a K-d tree over metadata.

The tree splits at weighted medians (the weighted k/n-quantile where a node must yield an odd number of leaves)
along the node's widest dimension, widths being measured against the root's. Categories are dimensions by the rank of
their value among all values, numbers as they are. Rows that agree in a coordinate are ordered by a hash of id and CRC.

A level of the tree is split at once. Its medians are found exactly and without a sort: rounds of histograms of BINS bins
a node narrow down, for every node, the interval in which its bytes reach the goal, down to one row. Histograms, split
points and the rows' nodes stay in tables; the driver gets three numbers and the root's extents, however many leaves there
are. Each row goes to the side that leaves the split nearest to its goal, so a split is off by half a row's size at most.

Rows that agree in everything are one row with a number of copies, which a split may divide: a group of repeated rows of any
size is spread over as many shards as its bytes take. Copies of a text with different ids may lie in different shards, too.

Defined results: a null text has no bytes (its CRC is 0, that of no bytes) and length 0; a null category comes before all
others; a very long text weighs what it weighs, and its shard may be heavier than the others by it; ties, as said, are in the
order of a hash; repeated rows are placed one by one; an empty table gives an empty result; fewer rows than shards leave
some shards empty. Other columns are never read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, drop, table

BINS = 256
SLOT_GROUP = 20_000  # rows that one task numbers at once
MOST_BROADCAST_NODES = 100_000
MOST_BROADCAST_BYTES = 32 << 20
COPIES_AT_ONCE = 10_000
TIE_BITS = 60
SHARDS = 24


def with_ranks(rows: DataFrame, name: str) -> DataFrame:
    """`name` replaced by its dense rank among the distinct values, nulls first; the values are sorted by ranges."""
    spread = rows.select(F.col(name).alias("value")).distinct().repartitionByRange("value").sortWithinPartitions("value")
    values = cut(spread.select("value", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "values")
    parts = values.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    starts = parts.select("part", "first", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranks = values.join(F.broadcast(starts), "part").select("value", (F.col("before") + F.col("at") - F.col("first")).alias("rank"))
    if (values.agg(F.sum(F.coalesce(F.octet_length("value"), F.lit(0)) + 64)).first()[0] or 0) <= MOST_BROADCAST_BYTES:
        ranks = F.broadcast(ranks)
    return rows.join(ranks, rows[name].eqNullSafe(ranks["value"])).drop("value").withColumn(name, F.col("rank")).drop("rank")


def default_dims(docs: DataFrame) -> dict[str, Column]:
    return {"source": docs["source"], "lang": docs["lang"], "length": F.coalesce(F.char_length(docs["text"]), F.lit(0)).cast("long")}


def weighed_rows(docs: DataFrame, dims: dict[str, Column]) -> tuple[DataFrame, list[str]]:
    """Distinct rows: doc_id, size, text_crc32, tie, their number n, and a coordinate for each dimension; and the coordinates' names."""
    text = F.coalesce(docs["text"], F.lit("")).cast("binary")
    facts = {"doc_id": docs["doc_id"], "size": (F.octet_length(text) + 8).cast("long"), "text_crc32": F.crc32(text)}
    at = {f"dim_{i}": c for i, c in enumerate(dims.values())}
    named = docs.select(*[c.alias(n) for n, c in (facts | at).items()])
    rows = cut(named.groupBy(*named.columns).agg(F.count("*").alias("n")), "kd")
    first = rows
    for d in at:
        if isinstance(rows.schema[d].dataType, T.StringType):
            rows = with_ranks(rows, d)
    digits = F.substring(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text_crc32").cast("string"))), 1, TIE_BITS // 4)
    out = cut(rows.withColumn("tie", F.conv(digits, 16, 10).cast("long")), "kd")
    drop(first)
    return out, list(at)


def share(total: Column, k: Column, n: Column) -> Column:
    """total * k / n without overflow, rounded down."""
    return F.floor(total / n).cast("long") * k + F.floor((total - F.floor(total / n).cast("long") * n) * k / n).cast("long")


def along(dims: list[str]) -> Column:
    """A row's coordinate in its node's dimension."""
    out = F.col(dims[0])
    for i, d in enumerate(dims[1:], 1):
        out = F.when(F.col("dim") == i, F.col(d)).otherwise(out)
    return out


def begun(rows: DataFrame, dims: list[str], widths: list[int]) -> DataFrame:
    """For every node of several shards: the dimension to split, the bytes that go left, and where to look for the place."""
    ends = [f(d).alias(f"{f.__name__}_{d}") for d in dims for f in (F.min, F.max)]
    nodes = rows.filter("shards > 1").groupBy("node", "shards").agg(F.sum(F.col("size") * F.col("n")).alias("total"), *ends)
    spans = [(F.col(f"max_{d}") - F.col(f"min_{d}")) / F.lit(float(w)) for d, w in zip(dims, widths, strict=True)]
    nodes = nodes.withColumn("dim", F.array_position(F.array(*spans), F.array_max(F.array(*spans))).cast("int") - 1)
    pick = lambda end: F.element_at(F.array(*[F.col(f"{end}_{d}") for d in dims]), F.col("dim") + 1)
    return nodes.select("node", "shards", "dim", share(F.col("total"), F.floor(F.col("shards") / 2).cast("long"), F.col("shards")).alias("goal"), F.lit(0).alias("step"), pick("min").alias("lo"), pick("max").alias("hi"), F.lit(0).cast("long").alias("below"), F.lit(None).cast("long").alias("c"), F.lit(None).cast("long").alias("t"), F.lit(0).cast("long").alias("copies"))


def narrowed(rows: DataFrame, state: DataFrame, dims: list[str], few: bool) -> DataFrame:
    """One round: every open node's interval (of coordinates at step 0, of ties at step 1) becomes the bin that crosses its goal."""
    open_nodes = state.filter("step < 2").drop("shards")
    here = rows.join(F.broadcast(open_nodes) if few else open_nodes, "node").withColumn("at", along(dims))
    v = F.when(F.col("step") == 0, F.col("at")).otherwise(F.col("tie"))
    here = here.withColumn("v", v).filter(F.col("v").between(F.col("lo"), F.col("hi")) & ((F.col("step") == 0) | (F.col("at") == F.col("c"))))
    wide = F.floor((F.col("hi") - F.col("lo")) / F.lit(BINS)).cast("long") + 1
    bins = here.groupBy("node", F.floor((F.col("v") - F.col("lo")) / wide).cast("long").alias("bin")).agg(F.sum(F.col("size") * F.col("n")).alias("bytes"), F.min("v").alias("vlo"), F.max("v").alias("vhi"), F.sum("n").alias("rows"), F.max("size").alias("one"))
    sums = bins.join(F.broadcast(open_nodes) if few else open_nodes, "node").withColumn("upto", F.col("below") + F.sum("bytes").over(Window.partitionBy("node").orderBy("bin")))
    hit = sums.filter("upto >= goal").groupBy("node").agg(F.min_by(F.struct("upto", "bytes", "vlo", "vhi", "rows", "one"), "bin").alias("h")).select(F.col("node").alias("_node"), "h")
    both = state.join(hit, F.col("node") == F.col("_node"), "left")
    found, single, step = F.col("h").isNotNull(), F.col("h.vlo") == F.col("h.vhi"), F.col("step")
    below = F.col("h.upto") - F.col("h.bytes")
    ties, done = found & single & (step == 0), found & single & (step == 1)
    left = F.least(F.greatest(F.floor((F.col("goal") - below) / F.col("h.one") + 0.5).cast("long"), F.lit(0)), F.col("h.rows"))
    new = {
        "step": F.when(ties | done, step + 1).otherwise(step),
        "lo": F.when(ties, F.lit(0)).when(found, F.col("h.vlo")).otherwise(F.col("lo")),
        "hi": F.when(ties, F.lit((1 << TIE_BITS) - 1)).when(found, F.col("h.vhi")).otherwise(F.col("hi")),
        "below": F.when(found, below).otherwise(F.col("below")),
        "c": F.when(ties, F.col("h.vlo")).otherwise(F.col("c")),
        "t": F.when(done, F.col("h.vlo")).otherwise(F.col("t")),
        "copies": F.when(done, left).otherwise(F.col("copies")),
    }
    return both.select(*[new.get(c, F.col(c)).alias(c) for c in state.columns])


def split(rows: DataFrame, dims: list[str], widths: list[int], nodes: int) -> DataFrame:
    """The rows in the next level's nodes; `nodes` is a bound of this level's."""
    few = nodes <= MOST_BROADCAST_NODES
    state = cut(begun(rows, dims, widths), "nodes", nodes)
    while not state.filter("step < 2").isEmpty():
        nearer = cut(narrowed(rows, state, dims, few), "nodes", nodes)
        drop(state)
        state = nearer
    points = state.select(F.col("node").alias("_node"), "dim", "c", "t", F.col("copies").alias("first"))
    both = rows.join(F.broadcast(points) if few else points, F.col("node") == F.col("_node"), "left")
    c, tie = along(dims), F.col("tie")
    before = (c < F.col("c")) | ((c == F.col("c")) & (tie < F.col("t")))
    left = F.when(before, F.col("n")).when((c == F.col("c")) & (tie == F.col("t")), F.least("n", "first")).otherwise(F.lit(0).cast("long"))
    half = F.floor(F.col("shards") / 2).cast("int")
    part = lambda node, shards, n: F.struct(node.cast("int").alias("node"), shards.cast("int").alias("shards"), n.cast("long").alias("n"))
    sides = F.array(part(F.col("node"), half, left), part(F.col("node") + half, F.col("shards") - half, F.col("n") - left))
    placed = F.when(F.col("_node").isNull(), F.array(part(F.col("node"), F.col("shards"), F.col("n")))).otherwise(F.filter(sides, lambda p: p["n"] > 0))
    kept = [c for c in rows.columns if c not in ("node", "shards", "n")]
    out = cut(both.select(*kept, F.explode(placed).alias("p")).select(*kept, "p.*"), "kd")
    drop(state, rows)
    return out


def kd_shards(docs: DataFrame, n_shards: int | None = SHARDS, target_bytes: int | None = None, dims: dict[str, Column] | None = None) -> DataFrame:
    """Per row doc_id, size, text_crc32, shard and slot; leaves are `n_shards`, or as many as reach `target_bytes`.

    dims: by default source, language and length; strings count by rank, integers as they are.
    """
    rows, names = weighed_rows(docs, dims or default_dims(docs))
    ends = rows.agg(F.sum("n"), F.sum(F.col("size") * F.col("n")), *[f(d) for d in names for f in (F.min, F.max)]).first()
    count, total = ends[0] or 0, ends[1] or 0
    shards = n_shards or max(1, -(-total // target_bytes))
    widths = [max(1, (ends[3 + 2 * i] or 0) - (ends[2 + 2 * i] or 0)) for i in range(len(names))]
    weighed = rows
    rows = cut(weighed.withColumns({"node": F.lit(0), "shards": F.lit(shards)}), "kd")
    drop(weighed)
    for level in range((shards - 1).bit_length() if count else 0):
        rows = split(rows, names, widths, 1 << level)
    return with_slots(rows, max(0, (count // shards // SLOT_GROUP).bit_length()))


def with_slots(rows: DataFrame, bits: int) -> DataFrame:
    """Numbers each shard's rows from 0 in the order of their ties, in 2**bits parts of the ties' range."""
    placed = rows.select("doc_id", "size", "text_crc32", "tie", "n", F.col("node").alias("shard"), F.shiftright("tie", TIE_BITS - bits).alias("part"))
    sizes = placed.groupBy("shard", "part").agg(F.sum("n").alias("rows"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "part", F.coalesce(F.sum("rows").over(before(Window.partitionBy("shard").orderBy("part"))), F.lit(0)).alias("start"))
    own = F.coalesce(F.sum("n").over(before(Window.partitionBy("shard", "part").orderBy("tie", "doc_id", "text_crc32"))), F.lit(0))
    at = placed.withColumn("own", own).join(starts, ["shard", "part"]).withColumn("first", F.col("start") + F.col("own"))
    several = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES_AT_ONCE).cast("long")))
    some = at.withColumn("from", several)
    copy = F.explode(F.sequence(F.col("from"), F.least(F.col("from") + COPIES_AT_ONCE, F.col("n")) - 1))
    return some.withColumn("copy", copy).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("copy")).alias("slot"))


def shards_query(docs: DataFrame) -> DataFrame:
    return kd_shards(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards_query(table(spark, sf_dir, "documents"))


def op1_sql(shards: int = SHARDS) -> str:
    """The same tree with a sort a level; for tables whose rows differ in id or text."""
    steps, last = [], "l0"
    for k in range((shards - 1).bit_length()):
        span = [f"(max(d{i}) - min(d{i})) / (SELECT w{i} FROM x)" for i in range(3)]
        steps.append(f"""
a{k} AS (SELECT node, [{", ".join(span)}] AS spans FROM {last} GROUP BY node),
b{k} AS (SELECT {last}.*, CASE list_position(spans, list_max(spans)) WHEN 1 THEN d0 WHEN 2 THEN d1 ELSE d2 END AS v FROM {last} JOIN a{k} USING (node)),
c{k} AS (SELECT *, sum(size) OVER (PARTITION BY node ORDER BY v, tie ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER (PARTITION BY node) * (shards // 2) // shards AS goal FROM b{k}),
e{k} AS (SELECT *, shards = 1 OR upto < goal OR (upto - size < goal AND 2 * (goal - upto + size) >= size) AS is_left FROM c{k}),
l{k + 1} AS (SELECT doc_id, size, crc, tie, d0, d1, d2, CASE WHEN is_left THEN node ELSE node + shards // 2 END AS node,
    CASE WHEN shards = 1 THEN 1 WHEN is_left THEN shards // 2 ELSE shards - shards // 2 END AS shards FROM e{k})""")
        last = f"l{k + 1}"
    return f"""
WITH t AS (SELECT list(c ORDER BY i) AS crcs FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, n: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
h AS (SELECT *, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda b: ('0x' || b)::BIGINT) AS bytes FROM documents),
f AS (SELECT doc_id, source, lang, coalesce(length(text), 0) AS chars, len(bytes) + 8 AS size,
    xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM h, t),
l0 AS (SELECT doc_id, size, crc, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '|' || crc), 1, {TIE_BITS // 4}))::BIGINT AS tie,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS d0, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS d1, chars AS d2, 0 AS node, {shards} AS shards FROM f),
x AS (SELECT {", ".join(f"greatest(1, max(d{i}) - min(d{i}))::DOUBLE AS w{i}" for i in range(3))} FROM l0),{",".join(steps)}
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'bytes' AS law, node::INTEGER AS shard,
    row_number() OVER (PARTITION BY node ORDER BY tie, doc_id, crc) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM {last}
"""
