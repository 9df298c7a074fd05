"""Sharding, decontamination, URL rules, mixing, WARC and media against brute force."""

from __future__ import annotations

import base64
import gzip
import hashlib
import os
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from larkspan.llm import decontam, media, mixing, sharding, urlfilter, warc


def kd_tree(rows, shards):
    """{(id, CRC): shard} by sorting each node along its widest dimension; rows: (id, size, CRC, tie, coordinates)."""
    widths = [max(1, max(r[4][k] for r in rows) - min(r[4][k] for r in rows)) for k in range(len(rows[0][4]))]

    def placed(own, first, n):
        if n == 1 or not own:
            return [(r[0], r[2], first) for r in own]
        spans = [(max(r[4][k] for r in own) - min(r[4][k] for r in own)) / w for k, w in enumerate(widths)]
        d = spans.index(max(spans))
        own = sorted(own, key=lambda r: (r[4][d], r[3]))
        half, below, at = n // 2, 0, 0
        goal = sum(r[1] for r in own) * half // n
        while below + own[at][1] < goal:
            below += own[at][1]
            at += 1
        at += 2 * (goal - below) >= own[at][1]
        return placed(own[:at], first, half) + placed(own[at:], first + half, n - half)

    return Counter(placed(rows, 0, shards))


def coordinates(rows):
    """Of (id, text, lang, source) rows; missing categories rank first."""
    ranks = [{v: i for i, v in enumerate(sorted({r[k] for r in rows}, key=lambda v: (v is not None, (v or "").encode())))} for k in (3, 2)]
    out = []
    for i, t, lang, source, *_ in rows:
        raw = (t or "").encode()
        crc = zlib.crc32(raw)
        tie = int(hashlib.md5(f"{'null' if i is None else i}|{crc}".encode()).hexdigest()[:15], 16)
        out.append((i, len(raw) + 8, crc, tie, (ranks[0][source], ranks[1][lang], len(t or ""))))
    return out


def test_shards(docs, rows):
    got = sharding.shards_query(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert all(r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 24 for r in got)
    for s in range(24):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))


@pytest.mark.parametrize("shards", [2, 7, 24])
def test_shards_are_those_of_the_tree(spark, shards):
    """Also where hundreds of sources have one long prefix."""
    r = random.Random(shards)
    rows = [(i, "x" * r.randrange(900), r.choice(["en", "de", None]), f"https://common-crawl/{r.randrange(300)}" if i % 3 else r.choice(["a", None]), 0) for i in range(900)]
    rows += [(900, "é漢" * 2_000_000, "en", "a", 0), (901, None, None, None, None), (902, "", "en", "b", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = Counter((x.doc_id, x.text_crc32, x.shard) for x in sharding.kd_shards(df, shards).collect())
    assert got == kd_tree(coordinates(rows), shards)


def test_shards_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "MOST_BROADCAST_NODES", 0)
    monkeypatch.setattr(sharding, "MOST_BROADCAST_BYTES", 0)
    rows = [(i, "x" * (i % 70), "en", f"s{i % 13}", 0) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert Counter((x.doc_id, x.text_crc32, x.shard) for x in sharding.kd_shards(df, 5).collect()) == kd_tree(coordinates(rows), 5)


def test_repeated_rows_are_spread(spark):
    """One row, repeated, that is half of the table: its copies fill whole shards."""
    same = spark.range(0, 3000, 1, 4).select(F.lit(7).cast("long").alias("doc_id"), F.lit("y" * 92).alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"))
    rest = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("z" * 92).alias("text"), F.lit("de").alias("lang"), (F.col("id") % 5).cast("string").alias("source"))
    got = sharding.kd_shards(same.union(rest), 24).collect()
    assert {n for n in Counter(r.shard for r in got).values()} == {250} and len({r.shard for r in got if r.doc_id == 7}) >= 12
    assert sorted(r.slot for r in got if r.shard == 3) == list(range(250))


def test_shards_are_even(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.expr("repeat('x', cast(10 + id % 90 as int))").alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 11).cast("string"))).alias("source"))
    for shards in (1, 24):
        sizes = {r.shard: r.s for r in sharding.kd_shards(df, shards).groupBy("shard").agg(F.sum("size").alias("s")).collect()}
        mean = sum(sizes.values()) / shards
        assert len(sizes) == shards and all(abs(s - mean) < 300 for s in sizes.values())
    assert sharding.kd_shards(df, None, target_bytes=50_000).agg(F.max("shard")).first()[0] == 7


def test_no_shards(no_docs):
    assert sharding.shards_query(no_docs).collect() == []


BENCH = [(1, " ".join(f"w{i}" for i in range(20))), (2, "One Two"), (3, None), (4, "?!"), (None, "w1 w2 w3"), (5, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17 w18"), (5, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17 w18"), (10, "ünïcode wörter")]
LEAKS = [(1, "a b " + " ".join(f"W{i}" for i in range(13)) + " end"), (2, "zero one,two three"), (3, None), (4, ""), (5, "w1 w2 w3 w1 w2 w3"), (6, " ".join(f"w{i}" for i in range(12))), (7, "x " * 300 + " ".join(f"w{i}" for i in range(13))), (7, "x " * 300 + " ".join(f"w{i}" for i in range(13))), (None, "one two"), (8, "Ünïcode wörter ünïcode wörter"), (9, "one two " + " ".join(f"w{i}" for i in range(3, 20)))]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def contamination(text, bench):
    w = WORD.findall(lower(text))
    hit, items = set(), set()
    for item, b in bench:
        v = WORD.findall(lower(b))
        n = min(13, len(v))
        for j in range(len(v) - n + 1) if v else ():
            for i in range(len(w) - n + 1):
                if w[i : i + n] == v[j : j + n]:
                    hit.update(range(i, i + n))
                    items |= {str(item)} if item is not None else set()
    return len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("bound", [1 << 26, 0])
def test_decontamination(spark, monkeypatch, bound):
    monkeypatch.setattr(decontam, "MOST_BROADCAST_BYTES", bound)
    monkeypatch.setattr(decontam, "MOST_HITS_BYTES", bound)
    b = spark.createDataFrame(BENCH, "item_id long, text string").withColumn("h", F.lit(1)).withColumn("gram", F.lit(1))
    d = spark.createDataFrame(LEAKS, "doc_id long, text string").withColumn("len", F.lit(1)).withColumn("items", F.lit(1)).withColumn("words", F.lit(1))
    wanted = Counter((i, *contamination(t, BENCH)) for i, t in LEAKS)
    got = decontam.judged(d, b).drop("text_key", "spans").collect()
    assert Counter(tuple(r) for r in got) == wanted
    kept = decontam.decontaminate(d, b)
    assert kept.columns == d.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((i, t) for i, t in LEAKS if not contamination(t, BENCH)[-1])


@pytest.mark.parametrize("bound", [1 << 26, 0])
def test_hits_are_verified(spark, monkeypatch, bound):
    """Windows whose hashes agree with an n-gram's are no hits where their words differ; full tables of bits change nothing."""
    monkeypatch.setattr(decontam, "MOST_BROADCAST_BYTES", bound)
    monkeypatch.setattr(decontam, "MOST_BITS", 15)
    monkeypatch.setattr(decontam, "hashes_of", lambda words: F.transform(words, lambda w: F.length(w).cast("long")))
    b = spark.createDataFrame([(1, "aa bb cc"), (2, " ".join(f"word{i:03}" for i in range(30)))], "item_id long, text string")
    texts = [(1, "xx aa bb cc yy"), (2, "xx yy zz"), (3, " ".join(f"word{i:03}" for i in range(5, 25))), (4, " ".join(f"term{i:03}" for i in range(25)))]
    got = decontam.judged(spark.createDataFrame(texts, "doc_id long, text string"), b).drop("text_key", "spans").collect()
    assert Counter(map(tuple, got)) == Counter((i, *contamination(t, [(1, "aa bb cc"), (2, " ".join(f"word{i:03}" for i in range(30)))])) for i, t in texts)


def test_very_long_contaminated_text(spark):
    b = spark.createDataFrame(BENCH[:1], "item_id long, text string")
    text = "filler " * 900_000 + " ".join(f"w{i}" for i in range(15)) + " é" * 900_000
    got = decontam.judged(spark.createDataFrame([(1, text)], "doc_id long, text string"), b).first()
    assert (got.n_words, got.n_hit, got.n_items, got.contaminated) == (1_800_015, 15, 1, False)


def test_removed_spans(spark, monkeypatch):
    b = spark.createDataFrame(BENCH, "item_id long, text string")
    d = spark.createDataFrame([(1, "Well, zero; one two three! ONE two"), (2, "nothing here"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in decontam.decontaminate(d, b, spans=True).collect()}
    monkeypatch.setattr(decontam, "MOST_BROADCAST_BYTES", 0)
    assert got == {r.doc_id: r.text for r in decontam.decontaminate(d, b, spans=True).collect()}
    assert got == {1: "zero; three! ", 2: "nothing here", 3: None} or got == {1: "Well, zero; three! ", 2: "nothing here", 3: None}


def test_empty_decontamination(spark, docs, no_docs, rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.judged(no_docs, none).collect() == []
    got = decontam.judged(docs, none).collect()
    assert len(got) == len(rows) and not any(r.n_hit or r.contaminated for r in got)


URLS = ["http://a.net/x", "HTTP://A.Example.NET/en/1?x=/de/", "https://example.com/de/", "https://www.example.com/de", "x://org/fr/#a", "x://b.org/fr?y", "http://c.net", "http://c.net?q", "http://c.net#q", "nothing", "", None, "http://notexample.com/de/x", "a://b://c.net/", "://net/", "http://example.net/en/", "http://example.net/fr/", "http://net:80/", "http://x.Example.COM/de/y", "http://.net/", "http://a.net/x"]
RULES = [*urlfilter.RULES, ("block", "deep.com", "/a"), ("allow", "deep.com", "/a/b"), ("block", "deep.com", "/a/b/c"), ("allow", "x.deep.com", "/a"), ("allow", "both.org", "/"), ("block", "both.org", "/")]


def verdict(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (lower(m[1]), m[2]) if m else ("", "")
    fit = [(len(h + p), len(h), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best[2] if best else None, best[3] if best else "allow"


@pytest.mark.parametrize("ranges", [1, 9])
def test_urls(spark, ranges):
    """In several ranges, most have no rule of their own and inherit a stack."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(ranges == 1).lower())
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        check_urls(spark)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def check_urls(spark):
    deep = [f"http://{h}deep.com{p}" for h in ("", "x.", "y.x.") for p in ("/a", "/a/b", "/a/bc", "/a/b/c/d", "/b", "/ab", "")] + ["http://z.both.org/1"]
    urls = list(enumerate(URLS + deep + [f"http://h{i}.deep.com/a/{i % 7}" for i in range(60)] + ["http://a.net/" + "x" * 300_000])) + [(None, "http://a.net/")]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumn("key", F.lit(1)).withColumn("rule", F.lit(1))
    got = urlfilter.filter_urls(pages, urlfilter.rules_frame(spark, RULES)).collect()
    assert Counter(tuple(r) for r in got) == Counter((i, *verdict(u, RULES)) for i, u in urls)


def test_no_urls(spark):
    rules = urlfilter.rules_frame(spark, RULES)
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert urlfilter.filter_urls(pages.limit(0), rules).collect() == []
    assert [r.verdict for r in urlfilter.filter_urls(pages, rules.limit(0), "block").collect()] == ["block"]


def fitted(cells, goals, sweeps=300):
    w = dict(cells)
    for _ in range(sweeps):
        for d in range(3):
            have = Counter()
            for k, v in w.items():
                have[k[d]] += v
            w = {k: v * goals[d][k[d]] / have[k[d]] if have[k[d]] else 0.0 for k, v in w.items()}
    return w


def topic(text):
    return next((t for t, p in mixing.TOPICS if text is not None and re.search(p, text, re.ASCII)), mixing.OTHER)


def odds(rows):
    """{(source, lang, topic): probability} of default mixing, by raking in Python."""
    cells = Counter()
    for _, t, lang, source, *_ in rows:
        cells[(source, lang, topic(t))] += len((t or "").encode().split())
    raised = {k: n * min((max(cells.values()) / n) ** (1 - mixing.TEMPER), mixing.MOST_UPWEIGHT) if n else 0.0 for k, n in cells.items()}
    goals = []
    for d in range(3):
        g = Counter()
        for k, v in raised.items():
            g[k[d]] += v
        goals.append({k: v / sum(g.values()) * sum(cells.values()) for k, v in g.items()})
    w = fitted(cells, goals)
    ratio = {k: w[k] / v for k, v in cells.items() if v}
    return {k: ratio[k] / max(ratio.values()) if k in ratio else 1.0 for k in cells}


def drawn(i, p):
    return int(hashlib.md5(f"1|{i}".encode()).hexdigest()[:13], 16) / 16**13 < p


def test_mixing(docs, rows):
    p = odds(rows)
    got = mixing.mix_report(docs).collect()
    assert len(got) == len(rows)
    by_id = {i: (s, lang, topic(t)) for i, t, lang, s, _ in rows if i is not None}
    for r in got:
        if r.doc_id is not None:
            assert abs(r.probability - p[by_id[r.doc_id]]) < 2e-6
            assert r.kept == drawn(r.doc_id, p[by_id[r.doc_id]])
    kept = mixing.mix(docs)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)


def test_given_targets(spark):
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("source"), F.lit("en").alias("lang"), F.lit(0).alias("n_chars"))
    even = spark.createDataFrame([("hot", 1.0), ("cold", 1.0), ("absent", 5.0)], "value string, weight double")
    got = Counter(r.source for r in mixing.mix(d, {"source": even}).collect())
    assert got["cold"] == 1334 and abs(got["hot"] - 1333) < 120
    only = spark.createDataFrame([("cold", 1.0)], "value string, weight double")
    assert {r.source for r in mixing.mix(d, {"source": only}).collect()} == {"cold"}


@pytest.mark.parametrize("bound", [0, 1 << 25])
def test_targets_that_cannot_be_met(spark, monkeypatch, bound):
    """A source that determines its language: their targets contradict each other, which is said; equal ones are met."""
    monkeypatch.setattr(mixing, "PATIENCE", 3)
    monkeypatch.setattr(mixing, "MOST_BROADCAST_BYTES", bound)
    cells = spark.createDataFrame([("a", "en", "t", 10), ("b", "de", "t", 10), (None, "de", "t", 4)], "source string, lang string, topic string, n long")
    goal = lambda *rows: spark.createDataFrame(rows, "value string, goal double")
    off = {"source": goal(("a", 18.0), ("b", 4.0), (None, 2.0)), "lang": goal(("en", 6.0), ("de", 18.0))}
    with pytest.raises(mixing.MarginsNotMet):
        mixing.rake(cells, off)
    with pytest.warns(UserWarning, match="miss their targets"):
        assert min(r.error for r in mixing.rake(cells, off, strict=False).collect()) > 0.1
    met = {r.source: (r.w, r.error) for r in mixing.rake(cells, off | {"lang": goal(("en", 18.0), ("de", 6.0))}).collect()}
    assert all(abs(met[k][0] - w) < 1e-6 and met[k][1] <= 1e-9 for k, w in (("a", 18), ("b", 4), (None, 2)))


def test_very_long_texts_are_weighed(spark):
    rows = [(1, "a b " * 2_000_000 + "mail@x", "en", "s", 0), (2, "a b c", "en", "s", 0), (3, "a", "de", "t", 0)]
    got = {r.doc_id: r for r in mixing.mix_report(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    p = odds(rows)
    assert got[1].tokens == 4_000_001 and got[1].topic == "contact"
    assert all(abs(got[i].probability - p[(source, lang, topic(t))]) < 2e-6 for i, t, lang, source, _ in rows)


def test_rare_cells_do_not_thin_the_rest(spark):
    """One word in a source and language of its own; sources determine languages otherwise, too."""
    big = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a b c d e f").alias("text"), F.when(F.col("id") % 4 == 0, "x").otherwise("y").alias("source"), F.when(F.col("id") % 4 == 0, "en").otherwise("de").alias("lang"))
    rare = spark.createDataFrame([(9999, "one", "z", "xx")], "doc_id long, text string, source string, lang string")
    assert mixing.mix(big.union(rare)).count() > 0.75 * 2000


def test_no_mixing(no_docs):
    assert mixing.mix(no_docs).collect() == [] and mixing.mix_report(no_docs).collect() == []


PAGES = [(3, "http://a", "<p>same</p>"), (1, "http://b\r\n", "<p>same</p>"), (2, None, "<p>other é</p>"), (4, "u", None), (5, "u", ""), (6, "u", "x" * 300_000), (7, "u", "WARC/1.1\r\n\x1f\x8b"), (7, "u", "WARC/1.1\r\n\x1f\x8b"), (None, "u", "<p>same</p>"), (8, "u", "\r\n\r\n")]


def wanted_records(pages):
    out, seen = [], set()
    for i, u, h in sorted(pages, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        first = min((j for j, _, o in pages if (o or "") == (h or "") and j is not None), default=None)
        fresh = digest not in seen
        seen.add(digest)
        out.append((i, len(raw), digest, "response" if fresh else "revisit", None if fresh else first))
    return Counter(out)


def test_warc(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("sha", F.lit(1)).withColumn("n", F.lit(1)).repartition(3)
    got = warc.through_archives(pages).collect()
    assert not [r for r in got if r.kind == "gap"]
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == wanted_records(PAGES)
    assert {(r.page_id, r.url) for r in got} == {(i, u) for i, u, _ in PAGES}
    assert {(r.page_id, bytes(r.payload)) for r in got if r.payload is not None} == {(1, b"<p>same</p>"), (2, "<p>other é</p>".encode()), (4, b""), (6, b"x" * 300_000), (7, "WARC/1.1\r\n\x1f\x8b".encode()), (8, b"\r\n\r\n")}
    assert warc.through_archives(pages.limit(0)).collect() == []
    small = warc.through_archives(pages, smallest=12).filter("record_type = 'revisit'").collect()
    assert [r.page_id for r in small] == [7]


def test_very_long_payload(spark):
    html = "é<p>x" * 2_000_000
    got = warc.through_archives(spark.createDataFrame([(1, "u", html), (2, "u", html)], "page_id long, url string, html string")).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == wanted_records([(1, "u", html), (2, "u", html)])


def records(n, plain=()):
    out = []
    for i in range(n):
        body = f"<p>{i}</p>".encode() * (i + 1)
        raw = warc.make_record(i, "u", body, warc.base32_sha1(body), len(body), None)
        out.append(raw if i in plain else warc.member(raw))
    return out


def test_salvage():
    parts = records(6, plain={3})
    whole = b"".join(parts)
    found, gaps = warc.salvage(whole)
    assert len(found) == 6 and not gaps
    at = [sum(map(len, parts[:i])) for i in range(7)]
    for broken in range(6):
        data = bytearray(whole)
        middle = (at[broken] + at[broken + 1]) // 2
        data[middle] ^= 0xFF
        found, gaps = warc.salvage(bytes(data))
        assert [warc.page_of(r["warc-record-id"]) for r in found] == [i for i in range(6) if i != broken]
        assert [g[:2] for g in gaps] == [(at[broken], at[broken + 1])]
    found, gaps = warc.salvage(b"rubbish" + whole[: at[5] + 9])
    assert len(found) == 5 and [g[:2] for g in gaps] == [(0, 7), (7 + at[5], 7 + at[5] + 9)]
    assert warc.salvage(b"") == ([], [])
    assert warc.salvage(b"no archive")[0] == []


def ids_of(found):
    return [warc.page_of(r["warc-record-id"]) for r in found]


def many(n):
    """Records as they are, with payloads that don't compress."""
    bodies = [b"".join(hashlib.sha256(f"{i} {k}".encode()).digest() for k in range(40)) for i in range(n)]
    return [warc.make_record(i, "u", b, warc.base32_sha1(b), len(b), None) for i, b in enumerate(bodies)]


def test_salvage_within_a_member():
    raw, alone = many(3), warc.member(many(5)[4])
    whole = b"".join(raw)
    at = [0, len(raw[0]), len(raw[0] + raw[1]), len(whole)]
    broken = bytearray(whole)
    broken[at[2] - 100] ^= 0xFF
    one = warc.member(bytes(broken))
    found, gaps = warc.salvage(alone + one + alone)
    assert ids_of(found) == [4, 0, 2, 4] and not any("unsound" in r for r in found)
    assert gaps == [(len(alone), len(alone + one), f"inflated bytes {at[1]} to {at[2]}: block digest differs")]
    no_line = bytes(broken[: at[1]]) + b"X" + whole[at[1] + 1 :]
    assert ids_of(warc.salvage(warc.member(no_line))[0]) == [0, 2]


@pytest.mark.parametrize("level", [0, 6])
def test_salvage_of_damaged_members(level):
    raw, alone = many(3), warc.member(many(5)[4])
    sound = gzip.compress(b"".join(raw), compresslevel=level, mtime=0)
    for size in (len(sound) * 5 // 6, len(sound) - 4):
        found, gaps = warc.salvage(alone + sound[:size])
        assert ids_of(found) == [4, 0, 1, 2][: 3 if size < len(sound) - 4 else 4]
        assert [r.get("unsound") for r in found] == [None] + ["member is cut off"] * (len(found) - 1)
        assert gaps[0][0] == len(alone) and gaps[-1][1] == len(alone) + size
    hit = bytearray(sound)
    hit[len(sound) // 2] ^= 0xFF
    found, gaps = warc.salvage(alone + bytes(hit) + alone)
    assert ids_of(found)[:2] == [4, 0] and ids_of(found)[-1] == 4 and 1 not in ids_of(found) and len(found) == len({*ids_of(found)}) + 1
    assert gaps[0][0] == len(alone) and gaps[-1][1] == len(alone + sound)


def test_salvage_of_overlapping_damage():
    one, two = (gzip.compress(b"".join(x), compresslevel=0, mtime=0)[:-4] for x in (many(3), many(6)[3:]))
    found, gaps = warc.salvage(one + two)
    assert ids_of(found) == [0, 1, 2, 3, 4, 5] and all("unsound" in r for r in found)
    assert gaps[0][0] == 0 and gaps[-1][1] == len(one + two)


def test_damaged_archives_are_read(spark, tmp_path):
    raw = many(3)
    broken = bytearray(b"".join(raw))
    broken[len(raw[0] + raw[1]) - 100] ^= 0xFF
    broken[broken.index(b"URI: u") + 5] = 0x5C
    (tmp_path / "part-0.gz").write_bytes(warc.member(bytes(broken)))
    (tmp_path / "part-1.gz").write_bytes(gzip.compress(b"".join(raw), mtime=0)[:-4])
    got = warc.read_archives(spark, f"{tmp_path}").collect()
    assert Counter((r.file[-4:], r.page_id, r.url, r.reason) for r in got if r.kind == "record") == Counter([("0.gz", 0, "\\", None), ("0.gz", 2, "u", None)] + [("1.gz", i, "u", "member is cut off") for i in range(3)])
    assert sorted(r.file[-4:] for r in got if r.kind == "gap") == ["0.gz", "1.gz"]


def test_media(docs, rows):
    got = media.documents_as_media(docs).filter("kind = 'media'").collect()
    assert len(got) == len(rows)
    texts = Counter((t or "") for _, t, *_ in rows)
    values = {}
    for t in texts:
        raw = t.encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        stored = f"P5\n64 {len(payload) // 64}\n255\n".encode() + payload
        values[t] = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), media.feature_of(payload))
    wanted = Counter((i, *values[t or ""]) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) for r in got) == wanted
    assert all(r.caption == f"{r.n_bytes} bytes" and r.pos == 1 for r in got)


def test_no_media(no_docs):
    assert media.documents_as_media(no_docs).collect() == []


def test_interleaved(spark):
    store = spark.createDataFrame([("d1", b"P5\n64 1\n255\n" + bytes(64))], "digest string, media binary")
    html = "<title>T</title><script>var x='<p>'</script><p>One <b>two</b></p><figure><img src='sha256:d1'><figcaption>a caption</figcaption></figure>tail<img src='sha256:d2' alt='lost'><img src='x.png'>"
    pages = spark.createDataFrame([(1, html), (2, None), (3, ""), (1, html), (None, "<p>x</p>")], "page_id long, html string")
    got = {r.page_id: r.elements for r in media.interleaved(pages, media.media_facts(store)).collect()}
    assert [(e.pos, e.kind, e.text if e.kind == "text" else e.digest, e.caption, e.payload_bytes) for e in got[1]] == [(0, "text", "T", None, None), (1, "text", "One two", None, None), (2, "media", "d1", "a caption", 64), (3, "text", "tail", None, None), (4, "media", "d2", "lost", None), (5, "media", None, None, None)]
    assert got[2] == [] and got[3] == [] and got[None][0].text == "x"


def elements(html, base=None):
    return [(e["kind"], e["text"] if e["kind"] == "text" else e["text"] or e["digest"], e["caption"]) for e in media.parse_html(html, base)]


def test_html_as_it_is_written():
    assert elements("<h4>Title</h4>Text<section>One</section><blockquote>two</blockquote><pre>three</pre>") == [("text", t, None) for t in ("Title", "Text", "One", "two", "three")]
    assert elements("<table><tr><th>a</th><td>b<i>c</i></td></tr></table><dl><dt>d</dt><dd>e</dd></dl>f<br>g") == [("text", t, None) for t in ("a", "bc", "d", "e", "f", "g")]
    assert elements("<figure><figcaption>before</figcaption><img src=a alt=x><img src=b></figure>") == [("media", "a", "before"), ("media", "b", "before")]
    assert elements("<figure><p>t</p><figcaption>only <b>words</b></figcaption><pre>code</pre></figure>z") == [("text", t, None) for t in ("t", "only words", "code", "z")]
    assert elements("<video poster=p><source src=v1><source src=v2>no player</video><audio src=s></audio>") == [("media", "v1", None), ("media", "s", None)]
    assert elements("<picture><source srcset='l.webp 2x, m.webp'><img src=i.jpg alt='an image'></picture><img data-src=lazy>") == [("media", "i.jpg", "an image"), ("media", "lazy", None)]
    assert elements("<picture><source srcset='l.webp 2x, m.webp'></picture>tail") == [("media", "l.webp", None), ("text", "tail", None)]
    assert elements("<template>no</template><style>no</style>&amp; yes<p>open<figure><figcaption>cap") == [("text", "& yes", None), ("text", "open", None), ("text", "cap", None)]
    assert elements("<img src=../p/q.png>", "http://h/x/y/z") == [("media", "http://h/x/p/q.png", None)]
    assert elements("<figure><figure><img src=in><figcaption>inner</figcaption></figure><img src=out></figure>") == [("media", "in", "inner"), ("media", "out", None)]


def test_addresses_are_resolved(spark):
    store = spark.createDataFrame([("d1", b"P5\n64 1\n255\n" + bytes(64))], "digest string, media binary")
    pages = spark.createDataFrame([(1, "http://h/a/", "x<img src=one.png>y<img src=two.png>"), (2, None, "<img src='http://h/a/one.png'>")], "page_id long, url string, html string")
    known = spark.createDataFrame([("http://h/a/one.png", "d1"), (None, "d1"), ("x", None)], "address string, digest string")
    got = {r.page_id: [(e.text, e.digest, e.payload_bytes) for e in r.elements] for r in media.interleaved(pages, media.media_facts(store), base="url", addresses=known).collect()}
    assert got == {1: [("x", None, None), ("http://h/a/one.png", "d1", 64), ("y", None, None), ("http://h/a/two.png", None, None)], 2: [("http://h/a/one.png", "d1", 64)]}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_given_pages_keep_their_words(spark):
    """Every page's shown words are in its elements, in order and once."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html")
    for r in media.with_elements(pages).collect():
        html = pages.filter(F.col("page_id") == r.page_id).first().html if r.page_id < 3 else None
        assert [e.pos for e in r.elements] == list(range(len(r.elements)))
        if html:
            shown = re.sub(r"(?s)<!--.*?-->|<(script|style)\b.*?</\1>", " ", html)
            plain = Counter(re.findall(r"\w+", re.sub("<[^>]*>", " ", shown)))
            assert not Counter(w for e in r.elements if e.kind == "text" for w in re.findall(r"\w+", e.text)) - plain


def test_very_long_media(spark):
    text = "é漢x" * 1_700_000
    got = media.documents_as_media(spark.createDataFrame([(1, text)], "doc_id long, text string")).filter("kind = 'media'").first()
    raw = text.encode()
    assert (got.n_bytes, got.payload_sha256) == (len(raw), hashlib.sha256(raw + bytes(-len(raw) % 64)).hexdigest())


def test_native_plans(spark, docs, capsys):
    """No Python runs on executors for the operators that must do without."""
    b = spark.createDataFrame(BENCH, "item_id long, text string")
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    for df in (decontam.decontaminate(docs, b), urlfilter.filter_urls(pages, urlfilter.rules_frame(spark, RULES)), mixing.mix(docs)):
        df.explain()
        plan = capsys.readouterr().out
        assert "Scan" in plan and not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
