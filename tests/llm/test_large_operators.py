"""Language-model scores, toxicity, repeats and near duplicates against brute force and held-out labels."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.llm import blocks, lmscore, neardup, substr, toxicity

from .conftest import words


@pytest.fixture(autouse=True)
def few_chunks(monkeypatch):
    monkeypatch.setattr(blocks, "LEAST_CHUNKS", 5)


def test_packing():
    r = np.random.default_rng(1)
    for keys in (np.empty(0, np.uint64), np.array([2**64 - 1], np.uint64), np.unique(r.integers(0, 2**64, 5000, dtype=np.uint64)), np.array([0, 0, 1, 2**63], np.uint64)):
        assert (blocks.unpack_keys(blocks.pack_keys(keys)) == keys).all()
        assert (blocks.unpack_ints(blocks.pack_ints(keys)) == keys).all()
        for bits in (1, 3, 8):
            at = blocks.ranges(keys, blocks.Levels(2, bits), 0)
            assert len(at) == (1 << bits) + 1 and at[0] == 0 and at[-1] == len(keys)
            assert all((keys[at[b] : at[b + 1]] >> np.uint64(64 - bits) == b).all() for b in range(1 << bits))
        some = np.concatenate([keys[::2], r.integers(0, 2**64, 100, dtype=np.uint64)])
        assert (blocks.Among(keys).has(some) == np.isin(some, keys)).all()


def lm_scores(rows, good):
    """Every document judged by counts over the rows that differ from it in id or text."""
    texts = [(i, (t or "").encode().lower().split(), i in good, (i, t)) for i, t in rows]
    count = lambda w: (Counter([*w, "END"]), Counter(zip(["END", *w], [*w, "END"], strict=True)), len(w) + 1)
    one, two, total = [Counter(), Counter()], [Counter(), Counter()], [0, 0]
    for _, w, is_good, _ in texts:
        for m in (0, 1) if is_good else (0,):
            if w:
                for sums, more in zip((one[m], two[m]), count(w)[:2], strict=True):
                    sums.update(more)
                total[m] += len(w) + 1
    copies = Counter(k for *_, k in texts)
    out = []
    for i, w, is_good, k in texts:
        loss = [0.0, 0.0]
        own = count(w)
        for u, x in zip(["END", *w], [*w, "END"], strict=True) if w else ():
            for m in (0, 1):
                c = copies[k] if is_good or not m else 0
                p = (one[m][x] - c * own[0][x] + lmscore.PRIOR_WORD * one[0][x] / total[0]) / (total[m] - c * own[2] + lmscore.PRIOR_WORD)
                loss[m] -= math.log((two[m][u, x] - c * own[1][u, x] + lmscore.PRIOR_PAIR * p) / (one[m][u] - c * own[0][u] + lmscore.PRIOR_PAIR)) / (len(w) + 1)
        out.append((i, len(w), *((round(loss[1], 9), round(loss[0], 9), round(loss[1] - loss[0], 8)) if w else (None,) * 3)))
    return Counter(out)


@pytest.mark.parametrize("good", [{1, 4, 13, 101, 102}, set()])
def test_scores(spark, docs, rows, good):
    labels = spark.createDataFrame([(i, 1, 0) for i in good] + [(2, 0, 0), (None, 1, 1), (3, None, 0), (1, 1, 0)], "doc_id long, quality int, toxic int").filter(F.lit(bool(good)))
    marked, target = lmscore.marked_by(docs, labels)
    got = lmscore.cross_entropy_difference(marked, target).collect()
    assert Counter((r.doc_id, r.n_tokens, *(None if x is None else round(x, d) for x, d in ((r.target_loss, 9), (r.background_loss, 9), (r.score, 8)))) for r in got) == lm_scores([(i, t) for i, t, *_ in rows], good)


def test_no_scores(spark, no_docs):
    assert lmscore.cross_entropy_difference(no_docs, F.lit(True)).collect() == []


def test_marked_documents_are_judged_by_others(spark):
    """Two documents of the target that share nothing with it score as strangers do."""
    rows = [(i, words(40 + i % 3, 50)) for i in range(12)] + [(20, words(45, 50, 9000)), (21, words(46, 50, 9000))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in lmscore.cross_entropy_difference(df, F.col("doc_id").isin(0, 3, 6, 20)).collect()}
    assert got[0] < got[1] and abs(got[20] - got[21]) < 0.1 < abs(got[0] - got[20])


@pytest.mark.parametrize("chunks", [16, 128])
def test_routed_exchange(spark, monkeypatch, chunks):
    """Through several levels, results are those of one; messages grow with the chunks, not with their square."""
    monkeypatch.setattr(blocks, "FAN", 4)
    monkeypatch.setattr(blocks, "LEAST_CHUNKS", chunks)
    levels = blocks.Levels.of(chunks)
    assert levels.count == (2 if chunks == 16 else 4) and levels.bits == 2
    rows = [(i, words(500 + i // 3, 40, 300)) for i in range(3 * chunks)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("copies", F.lit(1).cast("long")).withColumn("target", F.col("doc_id") % 2 == 0)
    dealt = df.select("doc_id", F.col("text").cast("binary").alias("text"), "target", "copies", blocks.chunk_of(df, chunks).alias("source"))
    asked = dealt.groupBy("source").applyInArrow(lambda k, t: blocks.sent(lmscore.counted(t), lmscore.Counts(), k[0].as_py(), levels), blocks.MESSAGE).cache()
    sources = asked.select("source").distinct().count()
    assert asked.count() <= 4 * sources
    made = [asked.count()]
    plain = blocks.exchange

    def watched(rows, traffic, levels, level=1):
        if level > 1:
            made.append(rows.count())
        return plain(rows, traffic, levels, level)

    monkeypatch.setattr(blocks, "exchange", watched)
    answers = watched(asked, lmscore.Counts(), levels)
    assert answers.count() == made[0]
    assert len(made) == levels.count and sum(made) <= 4 * chunks * levels.count
    target = [i for i, _ in rows if i % 2 == 0]
    got = lmscore.cross_entropy_difference(df, F.col("target")).collect()
    assert Counter((r.doc_id, r.n_tokens, *(round(x, d) for x, d in ((r.target_loss, 9), (r.background_loss, 9), (r.score, 8)))) for r in got) == lm_scores(rows, set(target))


@pytest.mark.parametrize("fan", [2, 4])
def test_routed_repeats(spark, monkeypatch, fan):
    monkeypatch.setattr(blocks, "FAN", fan)
    r = random.Random(fan)
    shared = [[f"p{r.randrange(3)}" for _ in range(r.randrange(4, 30))] for _ in range(6)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(r.randrange(5)):
            w += r.choice(shared)[r.randrange(4) :] if r.random() < 0.6 else [f"q{r.randrange(60)}" for _ in range(r.randrange(12))]
        rows.append((r.randrange(-20, 60), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert blocks.Levels.of(5).count > 1
    assert Counter(tuple(x) for x in substr.remove_repeats(df, 8).collect()) == repeats(rows, 8)


def test_one_row_that_fills_the_table(spark):
    """Repeated rows are folded before the chunks, in which they would meet."""
    text = words(81, 70)
    rows = [(5, text)] * 700 + [(None, None)] * 700 + [(1, "a b " + text), (6, text), (7, words(82, 60))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    held, any_copies = blocks.folded(df)
    assert any_copies and held.count() == 5
    assert Counter(tuple(x) for x in substr.remove_repeats(df).collect()) == repeats(rows, 50)
    got = lmscore.cross_entropy_difference(df, F.col("doc_id") == 5).collect()
    assert Counter((r.doc_id, r.n_tokens, *(None if x is None else round(x, d) for x, d in ((r.target_loss, 9), (r.background_loss, 9), (r.score, 8)))) for r in got) == lm_scores(rows, {5})


def test_very_long_texts_are_counted(spark):
    long = words(91, 700_000, 300_000)
    rows = [(1, long), (2, words(84, 50)), (3, words(84, 40) + " more")]
    got = lmscore.cross_entropy_difference(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") > 1).collect()
    assert Counter((r.doc_id, r.n_tokens, *(round(x, d) for x, d in ((r.target_loss, 9), (r.background_loss, 9), (r.score, 8)))) for r in got) == lm_scores(rows, {2, 3})


def test_very_long_repeats(spark):
    long = words(91, 1_000_000, 300_000)
    rows = [(1, long), (2, "start " + long), (3, words(83, 100))]
    assert Counter(tuple(x) for x in substr.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == Counter([(1, 1_000_000, 0, hashlib.sha256(long.encode()).hexdigest()), (2, 1_000_001, 1_000_000, hashlib.sha256(b"start").hexdigest()), (3, 100, 0, hashlib.sha256(words(83, 100).encode()).hexdigest())])


def repeats(rows, n):
    texts = [(math.inf if i is None else i, i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for k, _, w in texts:
        for j in range(len(w) - n + 1):
            s = tuple(w[j : j + n])
            first[s] = min(first.get(s, math.inf), k)
    out = []
    for k, i, w in texts:
        gone = set()
        for j in range(len(w) - n + 1):
            if first[tuple(w[j : j + n])] < k:
                gone.update(range(j, j + n))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return Counter(out)


def test_repeats(docs, rows):
    got = substr.remove_repeats(docs).collect()
    assert Counter(tuple(r) for r in got) == repeats([(i, t) for i, t, *_ in rows], 50)


@pytest.mark.parametrize("seed", range(3))
def test_random_repeats(spark, seed):
    r = random.Random(seed)
    shared = [[f"p{r.randrange(3)}" for _ in range(r.randrange(4, 30))] for _ in range(6)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(r.randrange(5)):
            w += r.choice(shared)[r.randrange(4) :] if r.random() < 0.6 else [f"q{r.randrange(60)}" for _ in range(r.randrange(12))]
        rows.append((r.randrange(-20, 60), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (8, 9):
        assert Counter(tuple(x) for x in substr.remove_repeats(df, n).collect()) == repeats(rows, n)


def test_kept_texts(spark, no_docs):
    df = spark.createDataFrame([(1, "a b c d e"), (2, "x a b c  d y"), (3, None)], "doc_id long, text string")
    assert {(r.doc_id, r.kept) for r in substr.remove_repeats(df, 4, texts=True).collect()} == {(1, "a b c d e"), (2, "x y"), (3, "")}
    assert substr.remove_repeats(no_docs).collect() == []


def shingle_set(t):
    w = (t or "").encode().lower().split()
    n = min(3, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def linked(rows):
    """{id: component} by comparing all pairs of rows; rows that agree in id are in one component."""
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    name = {i: i for i, _ in sets}

    def top(i):
        while name[i] != i:
            i = name[i]
        return i

    for k, (a, x) in enumerate(sets):
        for b, y in sets[k + 1 :]:
            if x and y and top(a) != top(b) and 100 * len(x & y) >= 85 * len(x | y):
                p, q = sorted((top(a), top(b)))
                name[q] = p
    return {i: top(i) for i in name}


def check_links(df, rows):
    wanted = linked(rows)
    got = neardup.near_duplicates(df).collect()
    name = [wanted[i] if i is not None and shingle_set(t) else i for i, t in rows]
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == Counter((i, len(shingle_set(t)), n, n == i) for n, (i, t) in zip(name, rows, strict=True))


def test_near_duplicates(docs, rows):
    check_links(docs, [(i, t) for i, t, *_ in rows])
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and not {2, 3, 15} & set(ids) and {4, 5, 6, 7, 8, 9, 10, 12} <= set(ids) and ids.count(None) == 2


def test_rows_that_share_an_id(spark, tmp_path):
    """Every text of an id is compared; the rows of one id are one component, but only near copies go."""
    a, b, c = words(71, 60), words(72, 60), words(73, 60)
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, c), (4, c), (4, ""), (5, c + " z"), (6, ""), (6, words(74, 60)), (None, c), (None, words(75, 60)), (None, words(75, 60)), (-9, words(74, 60))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("x")).withColumn("rep", F.lit(1)).withColumn("_id", F.lit(2)).repartition(4)
    check_links(df, rows)
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect() if r.n_shingles} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: -9, -9: -9, None: None}
    left = neardup.one_of_each(df)
    assert left.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter([(1, a), (1, b), (4, c), (4, ""), (6, ""), (None, words(75, 60)), (-9, words(74, 60))])
    duckdb = pytest.importorskip("duckdb")
    df.select("doc_id", "text").coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    assert Counter(con.execute(neardup.OP10_SQL).fetchall()) == Counter(tuple(r) for r in neardup.near_duplicates(df).collect())


def test_very_long_near_copies(spark):
    long = words(91, 1_200_000, 300_000)
    rows = [(1, long), (2, long.upper() + " end"), (3, words(92, 900_000, 300_000)), (4, "a short one")]
    assert len(long) > 8_000_000
    check_links(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_many_pages_of_one_template(spark, monkeypatch):
    """Buckets of pages that share a template: members are dealt by rare shingles, and what links is still found."""
    monkeypatch.setattr(neardup, "MOST_STRAYS", 5)
    monkeypatch.setattr(neardup, "BLOCK", 20)
    r = random.Random(11)
    template = words(60, 140).split()
    rows = []
    for k in range(120):
        own = [f"p{k}x{j}" for j in range(16)]
        rows.append((k, " ".join(template[:70] + own + template[70:])))
        if k % 10 == 0:
            rows.append((1000 + k, " ".join(template[:70] + own + template[70:] + ["more"])))
            rows.append((2000 + k, " ".join(template[:60] + [f"e{r.randrange(9)}"] + template[61:70] + own + template[70:])))
    called = []
    plain = neardup.by_rarest
    monkeypatch.setattr(neardup, "by_rarest", lambda *a: called.append(1) or plain(*a))
    check_links(spark.createDataFrame(rows, "doc_id long, text string"), rows)
    assert called


@pytest.mark.parametrize("block", [2000, 7])
def test_groups_of_near_copies(spark, monkeypatch, block):
    """Chains of edits: similarities from 0.5 to 1 in one group, so buckets hold several components."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "HUB_SHARE", 3)
    r = random.Random(5)
    rows = []
    for g in range(3):
        base = words(50 + g, 150).split()
        for k in range(50):
            w = list(base)
            for _ in range(r.choice([0, 1, 2, 4, 6, 9, 14])):
                w[r.randrange(len(w))] = f"e{r.randrange(9)}"
            rows.append((r.randrange(10**6), " ".join(w)))
    rows += [(10**7 + i, words(900 + i, 60)) for i in range(40)]
    check_links(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_components(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100, 100)] + [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(90)]
    got = {x.id: x.component for x in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    name = {i: i for e in links for i in e}
    for _ in range(300):
        for a, b in links:
            name[a] = name[b] = min(name[a], name[b])
    assert got == {i: n for i, n in name.items() if i != 100}


@pytest.mark.parametrize("order", ["rising", "mixed"])
def test_rounds_of_components(spark, monkeypatch, order):
    """A path of 1,000 links, which took a round a link by neighbours' names alone."""
    ids = list(range(1001))
    if order == "mixed":
        random.Random(2).shuffle(ids)
    tables = []
    plain = neardup.cut
    monkeypatch.setattr(neardup, "cut", lambda df, name, *a: tables.append(name) or plain(df, name, *a))
    got = neardup.components(spark.createDataFrame(list(zip(ids[:-1], ids[1:], strict=True)), "a long, b long")).collect()
    assert {(x.id, x.component) for x in got} == {(i, 0) for i in ids}
    assert tables.count("edges") - 1 <= 7 and tables.count("to") - tables.count("edges") + 1 <= 15


def test_bounds_of_verification():
    """No pair at the threshold is likely to be pruned: the chance of too few matches is small after each batch."""
    q = 0.85 + 0.15 / 256
    for k, m in neardup.least_matches(0.85):
        assert 0 < m <= k
        assert sum(math.comb(k, i) * q**i * (1 - q) ** (k - i) for i in range(m)) < 2e-5


def test_no_near_duplicates(no_docs):
    assert neardup.near_duplicates(no_docs).collect() == [] and neardup.one_of_each(no_docs).collect() == []


def labelled_rows(n, seed):
    r = random.Random(seed)
    bad = ["vile", "nasty", "rotten", "foul"]
    out = []
    for i in range(n):
        w = [f"n{chr(97 + r.randrange(26))}{chr(97 + r.randrange(26))}" for _ in range(r.randrange(20, 60))]
        toxic, junk = r.random() < 0.3, r.random() < 0.3
        if toxic:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(bad) + ("ness" if r.random() < 0.3 else ""))
        if junk:
            w += ["click", "here"] * 2
        out.append((i, " ".join(w), int(not junk), int(toxic)))
    return out


def test_models_are_fitted_on_all_that_pass():
    """1,200 features pass the test, and weights are where the penalised likelihood has no slope."""
    r = np.random.default_rng(3)
    y = (np.arange(1500) % 2).astype(float)
    hits = r.random((1500, 1200)) < np.where(y[:, None] == np.arange(1200) % 2, 0.2, 0.05)
    earlier = r.random((1500, 1))
    m = toxicity.fit([np.nonzero(h)[0] for h in hits], earlier, y)
    x = np.concatenate([hits[:, m.ids], earlier, np.ones((1500, 1))], axis=1)
    w = np.append(m.weights, m.bias)
    ridge = np.full(len(w), toxicity.RIDGE)
    ridge[-1] = 1e-3
    assert len(m.ids) > 1150
    assert np.abs(x.T @ (toxicity.sigmoid(x @ w) - y) + ridge * w).max() < 1e-3


@pytest.fixture(scope="module")
def labelled(spark):
    rows = labelled_rows(900, 1)
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t, _, _ in rows] + [(9001, None, None, None, None), (9002, "", "en", "a", 0), (9003, "?!", "en", "a", 2)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows[:500]] + [(0, rows[0][2], rows[0][3]), (None, 1, 1), (7777, 1, 1), (501, None, 1), (9001, 1, 0)], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_toxicity(labelled):
    rows, docs, labels = labelled
    chain = toxicity.learn(docs, labels)
    assert chain.categories == ["low_quality", "toxic"]
    got = {r.doc_id: r for r in toxicity.score(docs, chain).collect()}
    assert len(got) == len(rows) + 3 and not any(got[i].rejected for i in (9001, 9002, 9003))
    held = rows[500:]
    caught = sum(got[i].rejected for i, _, _, x in held if x) / sum(x for *_, x in held)
    wrong = sum(got[i].rejected for i, _, _, x in held if not x)
    assert caught > 0.97 and wrong <= 2
    assert sum((got[i].p_low_quality > 0.5) == (q == 0) for i, _, q, _ in held) > 0.95 * len(held)
    left = toxicity.score(docs, chain, keep=True)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, r in got.items() if not r.rejected}


def dense_fit(x, earlier, y):
    """Ridge logistic regression on all columns whose shares differ, by plain Newton steps. Returns what predicts."""
    if y.min() == y.max():
        return lambda x, e: np.full(len(x), 1 / (1 + math.exp(30.0 if not y[0] else -30.0)))
    n1, n0 = y.sum(), (1 - y).sum()
    share = x.mean(axis=0)
    with np.errstate(invalid="ignore", divide="ignore"):
        z = np.abs(x[y == 1].mean(axis=0) - x[y == 0].mean(axis=0)) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
    own = np.nonzero((x.sum(axis=0) >= toxicity.LEAST_DOCS) & (z >= toxicity.LEAST_Z))[0]
    design = lambda x, e: np.concatenate([x[:, own], e, np.ones((len(x), 1))], axis=1)
    a = design(x, earlier)
    ridge = np.full(a.shape[1], toxicity.RIDGE)
    ridge[-1] = 1e-3
    w = np.zeros(a.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + np.diag(ridge), a.T @ (p - y) + ridge * w)
    return lambda x, e: 1 / (1 + np.exp(-design(x, e) @ w))


def test_chain_against_brute_force(spark, labelled):
    """Features, folds, both categories' models, the link and the threshold, worked out densely from the texts."""
    rows, docs, labels = labelled
    words_of = lambda t: {k for w in toxicity.WORDS.findall((t or "").lower()) for k in ["=" + w] + ["^" + w[:n] for n in toxicity.BEGINNINGS if len(w) > n]}
    known = {i: (q, x) for i, _, q, x in rows[:500]}
    texts = {i: t for i, t, *_ in rows}
    order = [r.id for r in spark.range(500).orderBy(F.xxhash64("id"), "id").collect()]
    features = {f: k for k, f in enumerate(sorted(set().union(*(words_of(t) for t in texts.values()))))}
    matrix = np.zeros((len(texts), len(features)))
    for i, t in texts.items():
        matrix[i, [features[f] for f in words_of(t)]] = 1
    # Label 9001 is a text without words; it is trained on, too.
    ids = [r.id for r in spark.createDataFrame([(i,) for i in [*order, 9001]], "id long").orderBy(F.xxhash64("id"), "id").collect()]
    x = np.stack([matrix[i] if i < 9000 else np.zeros(len(features)) for i in ids])
    y = np.array([[1 - known[i][0], known[i][1]] if i < 9000 else [0, 0] for i in ids], float)
    fold = np.arange(len(ids)) % toxicity.FOLDS
    out, finals = np.zeros(y.shape), []
    for k in (0, 1):
        for f in range(toxicity.FOLDS):
            model = dense_fit(x[fold != f], out[fold != f, :k], y[fold != f, k])
            out[fold == f, k] = model(x[fold == f], out[fold == f, :k])
        finals.append(dense_fit(x, out[:, :k], y[:, k]))
    first = finals[0](matrix, np.zeros((len(texts), 0)))
    second = finals[1](matrix, first[:, None])
    good = [t for t in sorted(out[:, 1]) if t >= toxicity.LEAST_P and y[out[:, 1] >= t, 1].mean() >= toxicity.PRECISION]
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect()}
    assert max(abs(got[i].p_low_quality - first[i]) for i in texts) < 2e-6
    assert max(abs(got[i].p_toxic - second[i]) for i in texts) < 2e-6
    assert {i for i in texts if got[i].rejected} == {i for i in texts if second[i] >= good[0]}


def test_training_is_the_same_in_every_run(spark, labelled):
    """Also where labelled ids have several texts, whatever the order of rows."""
    _, docs, labels = labelled
    more = docs.union(docs.filter("doc_id < 100").withColumn("text", F.concat(F.col("text"), F.lit(" other nasty words"))))
    one, two = (toxicity.learn(more.repartition(n).orderBy(F.rand(n)), labels) for n in (2, 7))
    assert all((a.ids == b.ids).all() and (a.weights == b.weights).all() for a, b in zip(one.models, two.models, strict=True)) and one.threshold == two.threshold


def test_very_long_texts_are_scored(spark, labelled):
    _, docs, labels = labelled
    long = words(95, 1_500_000, 300_000)
    got = toxicity.score(spark.createDataFrame([(1, long + " vile nasty rotten"), (2, long)], "doc_id long, text string"), toxicity.learn(docs, labels)).collect()
    assert {r.doc_id: r.rejected for r in got} == {1: True, 2: False}


def test_chain_uses_earlier_categories():
    """The second category is the first one's, but for noise features: the link to it must carry."""
    r = np.random.default_rng(2)
    first = r.random(600) < 0.5
    rows = [np.sort(np.unique(np.concatenate([r.integers(10, 500, 6), [1] if x else [2]]))) for x in first]
    chain = toxicity.train(rows, np.stack([first, first], axis=1).astype(int), ["a", "b"])
    assert ((chain.predict(rows)[:, 1] > 0.5) == first).mean() > 0.99
    assert chain.models[1].weights[-1] > 0


def test_odd_labels(spark, labelled, docs, no_docs):
    _, own, labels = labelled
    for none in (labels.limit(0), labels.filter("toxic = 0"), spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")):
        assert not any(r.rejected for r in toxicity.score(own, toxicity.learn(own, none)).collect())
    chain = toxicity.learn(own, labels)
    assert toxicity.score(no_docs, chain).collect() == [] and toxicity.score(docs, chain, keep=True).columns == docs.columns
    empty = toxicity.learn(no_docs, labels)
    assert not any(r.rejected for r in toxicity.score(own, empty).collect())
