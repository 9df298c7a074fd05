"""Operator 6 [native]: mixing sources to target weights by iterative proportional fitting.

Token counts of (source, lang, topic) cells are raked until their margins meet the targets of every source, language
and topic; documents are then kept with probability weight / tokens of their cell, scaled so that the largest is 1.
So expected tokens have the target margins (to `tolerance`), no document is repeated, and no probability is cut off.

Raking keeps a factor for each value of a margin; a cell's weight is its tokens times its values' factors. A sweep is one
query: for one margin after the other, the cells are summed by value under the others' factors, with map-side sums, so no
task holds all cells of a value. Factors go to the cells by broadcast where their bytes allow it. The table of cells has one
row for each combination that occurs. The driver receives counts, bytes and the largest error.

Targets: tables (value, weight) for the margins named; margins without a table stay free. A target for a value without
tokens is left out. Targets that contradict each other in the cells that occur can't be met by any weights: raking
ends once the error no longer falls and raises MarginsNotMet, which tells the error (`strict=False` warns instead).
Without `targets`, all three margins are those of the cells' tokens n, each times (largest n / n)**(1 - temper), at most
MOST_UPWEIGHT: a slight flattening that some weights meet by construction, and in which a rare cell, however small,
doesn't thin the rest of the corpus: probabilities are near 1 / MOST_UPWEIGHT or above.

Defined results: null categories and texts: a null category is a category of its own; a null text has no tokens and
the topic of no rule, and is kept with its cell's probability; cells without tokens get the probability 1; a very long text
is one draw, so margins of few documents vary by it; rows that agree in id share their draw (repeated rows and ties alike);
empty tables give empty results. Other columns are never read by the query.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, table

TEMPER = 0.9
MOST_UPWEIGHT = 1.25
TOLERANCE = 1e-9
PATIENCE = 20  # sweeps in which the error must fall by a hundredth
MOST_BROADCAST_BYTES = 32 << 20
DIMS = ["source", "lang", "topic"]
# Topics by the first pattern that a text contains.
TOPICS = [("licence", r"(?i)licensed? under|copyright"), ("contact", r"[\w.]@\w"), ("table", r" \| "), ("symbols", r"[$%#&]{3}")]
OTHER = "prose"


class MarginsNotMet(ValueError):
    """The targets contradict each other in the cells that occur."""


def topic_of(text: Column) -> Column:
    out = F.lit(OTHER)
    for name, pattern in reversed(TOPICS):
        out = F.when(F.rlike(text, F.lit(pattern)), name).otherwise(out)
    return out


def tokens_of(text: Column) -> Column:
    parts = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(parts)).cast("long")


def draw_of(key: Column, seed: int) -> Column:
    """Uniform in [0, 1), from the key alone: a task that runs again draws the same."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**13))


def cells_of(docs: DataFrame) -> DataFrame:
    cells = docs.select(docs["source"], docs["lang"], topic_of(docs["text"]).alias("topic"), tokens_of(docs["text"]).alias("n"))
    return cells.groupBy(*DIMS).agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


def bytes_of(df: DataFrame, texts: list[str]) -> int:
    """A bound of what a broadcast of it takes: its strings and 100 bytes a row."""
    return df.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(100)))).first()[0] or 0


def goals_of(cells: DataFrame, targets: dict[str, DataFrame] | None, temper: float) -> dict[str, DataFrame]:
    """For each margin that is to be raked, its values with tokens and their goals, which add up to all tokens."""
    tokens, most = cells.agg(F.sum("n"), F.max("n")).first()
    tokens = float(tokens or 0)
    n = F.col("n").cast("double")
    raised = F.when(F.col("n") > 0, n * F.least(F.pow(F.lit(float(most or 1)) / n, F.lit(1 - temper)), F.lit(MOST_UPWEIGHT))).otherwise(F.lit(0.0))
    out = {}
    for d in DIMS:
        own = cells.groupBy(F.col(d).alias("value")).agg(F.sum("n").alias("have"), F.sum(raised).alias("goal")).filter("have > 0")
        if targets is not None:
            if d not in targets:
                continue
            want = targets[d].select(F.col("value").alias("named"), F.col("weight").cast("double").alias("weight"))
            own = own.join(want, F.col("value").eqNullSafe(F.col("named")), "left").select("value", F.coalesce("weight", F.lit(0.0)).alias("goal"))
        own = cut(own.select("value", "goal"), "goals")
        total = own.agg(F.sum("goal")).first()[0] or 1.0
        out[d] = own.select("value", (F.col("goal") * F.lit(tokens / total)).alias("goal"))
    return out


def with_factors(cells: DataFrame, factors: dict[str, DataFrame], few: bool) -> DataFrame:
    """The cells, with w, their tokens times the given margins' factors; other values have none."""
    w = F.col("n").cast("double")
    for d, f in factors.items():
        own = f.select(F.col("value").alias(f"value_{d}"), F.col("factor").alias(f"factor_{d}"))
        cells = cells.join(F.broadcast(own) if few else own, F.col(d).eqNullSafe(F.col(f"value_{d}")), "left")
        w = w * F.coalesce(f"factor_{d}", F.lit(0.0))
    return cells.withColumn("w", w)


def rake(cells: DataFrame, goals: dict[str, DataFrame], tolerance: float = TOLERANCE, strict: bool = True) -> DataFrame:
    """cells: DIMS and n; goals: (value, goal) by margin. Adds `w`, whose margins are the goals, and `ratio`, w over n."""
    few = sum(bytes_of(g, ["value"]) for g in goals.values()) <= MOST_BROADCAST_BYTES
    factors = {d: g.select("value", "goal", F.lit(1.0).alias("factor")) for d, g in goals.items()}
    held, errors = None, []
    while factors:
        now = dict(factors)
        for d in factors:
            others = {o: f for o, f in now.items() if o != d}
            sums = with_factors(cells, others, few).groupBy(F.col(d).alias("of")).agg(F.sum("w").alias("sum"))
            new = F.when(F.col("sum") > 0, F.col("goal") / F.col("sum")).otherwise(F.lit(0.0))
            off = F.when((F.col("sum") > 0) & (F.col("goal") > 0), F.abs(F.col("factor") * F.col("sum") / F.col("goal") - 1)).otherwise((F.col("goal") > 0).cast("double"))
            now[d] = factors[d].join(sums, F.col("value").eqNullSafe(F.col("of")), "left").select("value", "goal", new.alias("factor"), F.coalesce(off, F.lit(0.0)).alias("off"))
        swept = [f.withColumn("margin", F.lit(d)) for d, f in now.items()]
        before, held = held, cut(reduce(DataFrame.unionByName, swept), "factors")
        if before is not None:
            drop(before)
        factors = {d: held.filter(F.col("margin") == d).select("value", "goal", "factor") for d in factors}
        errors.append(held.agg(F.max("off")).first()[0] or 0.0)
        if errors[-1] <= tolerance:
            break
        if len(errors) > PATIENCE and min(errors[-PATIENCE:]) > 0.99 * min(errors[:-PATIENCE]):
            if strict:
                raise MarginsNotMet(f"no weights meet the targets: margins miss them by up to {errors[-1]:.2g} of them after {len(errors)} sweeps")
            warnings.warn(f"margins miss their targets by up to {errors[-1]:.2g} of them after {len(errors)} sweeps", stacklevel=2)
            break
    raked = with_factors(cells, factors, few).select(*cells.columns, "w")
    return raked.withColumn("error", F.lit(errors[-1] if errors else 0.0)).withColumn("ratio", F.when(F.col("n") > 0, F.col("w") / F.col("n")))


def cell_probabilities(docs: DataFrame, targets: dict[str, DataFrame] | None = None, temper: float = TEMPER, strict: bool = True) -> DataFrame:
    """_source, _lang, _topic and their _p, as a broadcast where their bytes allow one."""
    counts = cut(cells_of(docs), "counts")
    cells = cut(rake(counts, goals_of(counts, targets, temper), strict=strict), "cells")
    top = cells.agg(F.max("ratio")).first()[0]
    out = cells.select(*[F.col(d).alias(f"_{d}") for d in DIMS], F.coalesce(F.col("ratio") / F.lit(top or 1.0), F.lit(1.0)).alias("_p"))
    return F.broadcast(out) if bytes_of(cells, DIMS) <= MOST_BROADCAST_BYTES else out


def with_probability(docs: DataFrame, targets: dict[str, DataFrame] | None = None, temper: float = TEMPER, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """The documents joined with their cells, and the cells: columns are told apart by frame, whatever their names."""
    p = cell_probabilities(docs, targets, temper, strict)
    return docs.join(p, docs["source"].eqNullSafe(p["_source"]) & docs["lang"].eqNullSafe(p["_lang"]) & (topic_of(docs["text"]) == p["_topic"])), p


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, temper: float = TEMPER, seed: int = 1, strict: bool = True) -> DataFrame:
    """The documents that are drawn, with the columns of `docs`."""
    rows, p = with_probability(docs, targets, temper, strict)
    return rows.filter(draw_of(docs["doc_id"], seed) < p["_p"]).select(*[docs[c] for c in docs.columns])


def mix_report(docs: DataFrame, targets: dict[str, DataFrame] | None = None, temper: float = TEMPER, seed: int = 1, strict: bool = True) -> DataFrame:
    rows, p = with_probability(docs, targets, temper, strict)
    return rows.select(docs["doc_id"], p["_topic"].alias("topic"), tokens_of(docs["text"]).alias("tokens"), F.round(p["_p"], 6).alias("probability"), (draw_of(docs["doc_id"], seed) < p["_p"]).alias("kept"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


def op6_sql(sweeps: int = 40) -> str:
    topic = " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{t}'" for t, p in TOPICS)
    steps, last = [], "g"
    for i, d in enumerate(DIMS * sweeps):
        steps.append(f"s{i} AS (SELECT * REPLACE (w * goal_{d} / sum(w) OVER (PARTITION BY {d}) AS w) FROM {last})")
        last = f"s{i}"
    goals = ", ".join(f"sum(t) OVER (PARTITION BY {d}) / sum(t) OVER () * sum(n) OVER () AS goal_{d}" for d in DIMS)
    return f"""
WITH d AS (SELECT doc_id, source, lang, CASE {topic} ELSE '{OTHER}' END AS topic, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS tokens FROM documents),
c AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS n FROM d GROUP BY ALL),
h AS (SELECT *, n * least((max(n) OVER () / n) ^ {1 - TEMPER}, {MOST_UPWEIGHT}) AS t FROM c WHERE n > 0),
g AS (SELECT source, lang, topic, n, n AS w, {goals} FROM h),
{", ".join(steps)},
p AS (SELECT source, lang, topic, w / n / max(w / n) OVER () AS p FROM {last})
SELECT doc_id, d.topic, tokens, round(coalesce(p, 1), 6) AS probability, ('0x' || substr(md5('1|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / (16.0 ^ 13) < coalesce(p, 1) AS kept
FROM d LEFT JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.lang IS NOT DISTINCT FROM p.lang AND d.topic = p.topic
"""
