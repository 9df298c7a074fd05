"""Operator 2 [native]: benchmark decontamination by a broadcast hash set of word n-grams.

Windows of `width` consecutive words of each benchmark item (an item with fewer words is one window) are hashed and
broadcast. One pass over the documents hashes each word once and every window by its words' hashes, and looks the windows up
in the join's hash table. The same pass emits one marker row a document, so documents without hits need no second
look; its only shuffle deals hits and markers, without words, by document. Hits are then verified word by word on the texts that
have some; texts are read again for that, and moved only where the hits are too many to be broadcast to them.

Broadcasts are bounded by bytes: up to MOST_BROADCAST_BYTES of hashes go out as they are. Beyond, the hash set that goes
out is a table of bits, 2**MOST_BITS of them (32 MB) at most: the same pass drops all windows but those whose bit is set, and only their
hashes are shuffled to the n-grams' hashes. Hits are verified likewise, and results are the same.

Defined results: a null or wordless text has no words, no hits, and the hash of the empty string for its items; null
item ids don't count as items; a very long text is taken whole, as one row with its words; ties can't arise; rows repeated in
id and text give repeated rows; an empty benchmark hits nothing. Other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut, table

BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
MOST_BROADCAST_BYTES = 64 << 20
MOST_HITS_BYTES = 8 << 20  # of hits that are broadcast to the texts: they pass through the driver
MOST_BITS = 28
WORDS_A_ROW = 512  # 64-bit words of the table of bits
MARK = -1


def words_of(text: Column) -> Column:
    """What lies between separators; splitting there is several times as fast as extracting matches."""
    parts = F.array_remove(F.split(ascii_lower(text), BETWEEN_WORDS), "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def hashes_of(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def hash_at(hashes: Column, i: Column | int, width: int) -> Column:
    """Of up to `width` words from place i on. slice() would copy the whole array for every window, get() doesn't."""
    return F.xxhash64(*[F.get(hashes, F.lit(k) + i) for k in range(width)])


def words_at(words: Column, i: Column, n: Column, width: int) -> Column:
    return F.slice(F.array(*[F.get(words, i + k) for k in range(width)]), F.lit(1), n)


def window_hashes(hashes: Column, width: int) -> Column:
    """Of each `width` consecutive words, in order; none of fewer words."""
    found = F.transform(F.sequence(F.lit(0), F.size(hashes) - width), lambda i: hash_at(hashes, i, width))
    return F.when(F.size(hashes) >= width, found).otherwise(F.array().cast("array<long>"))


def item_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """Distinct windows: h, len, gram (words) and the items that have them."""
    items = benchmark.select(benchmark["item_id"].cast("string").alias("item"), words_of(benchmark["text"]).alias("words")).filter(F.size("words") > 0)
    n = F.least(F.size("words"), F.lit(width))
    grams = F.transform(F.sequence(F.lit(0), F.size("words") - n), lambda i: words_at(F.col("words"), i, n, width))
    return (items.select("item", F.explode(grams).alias("gram")).groupBy("gram").agg(F.collect_set("item").alias("items"))
            .withColumn("hashes", hashes_of(F.col("gram"))).select(hash_at(F.col("hashes"), 0, width).alias("h"), F.size("gram").alias("len"), "gram", "items"))


def table_of_bits(grams: DataFrame, n: int) -> tuple[DataFrame, int]:
    """(row, bits): the set of the hashes' first k bits, and k: 16 bits an n-gram where that many are allowed."""
    k = min(MOST_BITS, max(15, (16 * n).bit_length()))
    at = F.shiftrightunsigned("h", 64 - k)
    own = grams.select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - k}) & 63 AS int))").alias("bits"))
    every = own.unionByName(grams.sparkSession.range(1 << (k - 6)).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits")))
    words = every.groupBy("word").agg(F.bit_or("bits").alias("bits"))
    rows = words.groupBy(F.floor(F.col("word") / WORDS_A_ROW).cast("long").alias("row")).agg(F.sort_array(F.collect_list(F.struct("word", "bits")))["bits"].alias("bits"))
    return cut(rows, "bits"), k


def held(bits: DataFrame, k: int, h: Column) -> tuple[Column, Column]:
    """For a join with a table of bits: which of its rows a hash belongs to, and whether its bit is set there."""
    at = F.shiftrightunsigned(h, 64 - k)
    word = F.element_at(bits["bits"], (F.shiftright(at, 6) % WORDS_A_ROW).cast("int") + 1)
    return F.floor(F.shiftright(at, 6) / WORDS_A_ROW).cast("long") == bits["row"], F.getbit(word, at.bitwiseAND(F.lit(63)).cast("int")) == 1


def among(docs: DataFrame, keys: DataFrame, key: str, size: int, most: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """To join documents with `keys`, whose column `key` has hashes of texts: the documents that may have one, the keys, and the other documents.

    Keys of up to `most` bytes are broadcast to all documents, and there are no others. Beyond, a table of bits is, and the texts that
    are shuffled are those whose bit is set.
    """
    if size <= most:
        return docs, F.broadcast(keys), None
    bits, k = table_of_bits(keys.select(F.col(key).alias("h")), keys.count())
    bits = F.broadcast(bits)
    on, is_set = held(bits, k, F.xxhash64(docs["text"]))
    both = docs.join(bits, on)
    mine = [docs[c] for c in docs.columns]
    return both.filter(is_set).select(*mine), keys, both.filter(~is_set).select(*mine)


BYTES_A_HASH = 64


def small(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= MOST_HITS_BYTES else df


def looked_up(docs: DataFrame, grams: DataFrame, width: int) -> DataFrame:
    """Per distinct (doc_id, text): doc_id, text_key, n_words, copies, and found [(s, len, h)], its windows with an n-gram's hash."""
    spark = docs.sparkSession
    sizes = {r["len"]: r["n"] for r in grams.groupBy("len").agg(F.countDistinct("h").alias("n")).collect()}
    lens = sorted(sizes) or [width]
    texts = docs.select(docs["doc_id"], F.xxhash64(docs["text"]).alias("text_key"), words_of(docs["text"]).alias("words"))
    texts = texts.select("doc_id", "text_key", F.size("words").alias("n"), hashes_of(F.col("words")).alias("hashes"))
    before, n = F.lit(0), F.col("n")
    start, length = F.lit(0), F.lit(0)  # of the window that `at` numbers among all lengths' windows; the marker's length is 0
    for one in lens:
        after = before + F.greatest(n - (one - 1), F.lit(0))
        here = (F.col("at") >= before) & (F.col("at") < after)
        start, length, before = F.when(here, F.col("at") - before).otherwise(start), F.when(here, F.lit(one)).otherwise(length), after
    every = F.concat(*[window_hashes(F.col("hashes"), one) for one in lens], F.array(F.lit(MARK).cast("long")))
    # The words stay behind: each window's row would carry all of them.
    rows = texts.select("doc_id", "text_key", "n", F.posexplode(every).alias("at", "h"))
    columns = ["doc_id", "text_key", "n", start.alias("s"), length.alias("len"), "h"]
    hashes = grams.select(F.col("h").alias("gram_h"), F.col("len").alias("gram_len")).distinct()
    same = (F.col("h") == F.col("gram_h")) & (F.col("len") == F.col("gram_len"))
    if BYTES_A_HASH * sum(sizes.values()) <= MOST_BROADCAST_BYTES:
        index = hashes.unionByName(spark.sql(f"SELECT {MARK}L AS gram_h, 0 AS gram_len"))
        hits = rows.select(*columns).join(F.broadcast(index), same)
    else:
        bits, k = table_of_bits(grams, sum(sizes.values()))
        bits = F.broadcast(bits)
        on, is_set = held(bits, k, F.col("h"))
        kept = rows.select(*columns).join(bits, on & ((F.col("len") == 0) | is_set)).drop("row", "bits")
        hits = kept.filter("len > 0").join(cut(hashes, "hashes"), same).drop("gram_h", "gram_len").unionByName(kept.filter("len = 0"))
    found = F.collect_set(F.when(F.col("len") > 0, F.struct("s", "len", "h"))).alias("found")
    return hits.groupBy("doc_id", "text_key", F.col("n").cast("long").alias("n_words")).agg(F.count_if(F.col("len") == 0).alias("copies"), found)


def spans_of(docs: DataFrame, benchmark: DataFrame, width: int = 13) -> DataFrame:
    """Per distinct (doc_id, text): doc_id, text_key, n_words, copies, spans [(s, e) of word positions] and items."""
    grams = cut(item_windows(benchmark, width), "grams")
    each = cut(looked_up(docs, grams, width), "looked_up")
    hits = each.filter(F.size("found") > 0).select("doc_id", "text_key", F.explode("found").alias("f")).select("doc_id", "text_key", "f.*")
    tried = hits.join(grams, ["h", "len"]).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("s", "len", "gram", "items")).alias("tried"))
    tried = cut(tried.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "tried"), "tried")
    size = tried.agg(F.sum(64 + F.size("tried") * (60 + 24 * width))).first()[0] or 0
    docs, tried, _ = among(docs.select("doc_id", "text"), tried, "_key", size, MOST_HITS_BYTES)
    of = docs["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_key"))
    # The words go into the inner function as one value: as a column of their own they would be split again for every word compared.
    right = F.flatten(F.transform(F.array(words_of(docs["text"])), lambda w: F.filter("tried", lambda x: words_at(w, x["s"], x["len"], width) == x["gram"])))
    right = docs.join(tried, of).select("_id", "_key", right.alias("right")).groupBy("_id", "_key").agg(F.first("right").alias("right"))
    spans = F.array_sort(F.array_distinct(F.transform("right", lambda x: F.struct(x["s"].alias("s"), (x["s"] + x["len"]).alias("e")))))
    facts = right.select("_id", "_key", spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten("right.items"))).alias("items"))
    facts = cut(facts.filter(F.size("spans") > 0), "facts")
    size = facts.agg(F.sum(64 + 16 * F.size("spans") + F.octet_length(F.array_join("items", "")) + 40 * F.size("items"))).first()[0] or 0
    out = each.drop("found").join(small(facts, size), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    none = F.array().cast(facts.schema["spans"].dataType), F.array().cast("array<string>")
    return out.select("doc_id", "text_key", "n_words", "copies", F.coalesce("spans", none[0]).alias("spans"), F.coalesce("items", none[1]).alias("items"))


def covered(spans: Column) -> Column:
    """Words inside any of the sorted spans."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["reach"]))).alias("n"), F.greatest(a["reach"], x["e"]).alias("reach"))
    return F.aggregate(spans, zero, step, lambda a: a["n"])


def judged(docs: DataFrame, benchmark: DataFrame, width: int = 13) -> DataFrame:
    """One row a document: the counts and the verdict; `spans` are its hit word ranges."""
    one = spans_of(docs, benchmark, width).withColumn("n_hit", covered(F.col("spans")).cast("long"))
    rows = one.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select("doc_id", "text_key", F.col("n_words").cast("long").alias("n_words"), "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).alias("contaminated"), "spans")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 13, spans: bool = False) -> DataFrame:
    """The columns of `docs`, without contaminated documents; with `spans`, contaminated texts lose their hit words instead."""
    keys = [F.col("doc_id").alias("_hit_id"), F.col("text_key").alias("_hit_key")] + ([F.col("spans").alias("_hit_spans")] if spans else [])
    found = cut(judged(docs, benchmark, width).filter("contaminated").select(*keys).dropDuplicates(["_hit_id", "_hit_key"]), "hits")
    size = found.agg(F.sum(F.lit(BYTES_A_HASH) + (24 * F.size("_hit_spans") if spans else F.lit(0)))).first()[0] or 0
    every = docs
    docs, found, others = among(docs, found, "_hit_key", size, MOST_BROADCAST_BYTES)
    on = docs["doc_id"].eqNullSafe(found["_hit_id"]) & (F.xxhash64(docs["text"]) == found["_hit_key"])
    whole = lambda df: df if others is None else df.union(others)
    if not spans:
        return whole(docs.join(found, on, "left_anti").select(*[docs[c] for c in every.columns]))
    out = docs.join(found, on, "left")
    text = docs["text"]
    pieces = F.regexp_extract_all(text, F.lit(f"{ANY_CASE}[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*"), F.lit(0))
    kept = F.filter(pieces, lambda p, i: ~F.exists(found["_hit_spans"], lambda s: (s["s"] <= i) & (i < s["e"])))
    cleaned = F.when(found["_hit_spans"].isNull(), text).otherwise(F.array_join(kept, ""))
    return whole(out.select(*[cleaned.alias("text") if c == "text" else docs[c] for c in every.columns]))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key", "spans")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 13) AS l, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS s
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') AS s
    FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM g) WHERE len(w) >= l)),
h AS (SELECT p.doc_id, p.i, p.l, g.item_id FROM p JOIN g USING (l, s)),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS pos FROM (SELECT DISTINCT doc_id, i, l FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
