"""Operator 5 [native]: URL rules as a sort-merge range join.

A rule (action, host, path) fits its host and all subdomains if the URL's path starts with the rule's. A host's canonical
key is its labels reversed, each with a dot behind it: a host's subdomains are the keys that start with its own, so each host with rules
is an interval of keys, and such intervals nest or are disjoint. Distinct URLs and rules are sorted together by key and swept
once. The sweep keeps the stack of nested rules: the one that was open when the last interval began. Whichever of
these still hold a URL's key and path are its rules, for an interval that holds the key encloses the last one begun before it or is that one.

The sort is by ranges of keys and paths, one task a range, so a hot host is as many ranges as its URLs take; what a range
inherits is the last stack of the ranges before it, one row a range. URLs that pages share are settled once.

Defined results: a null URL or one without `://` has empty host and path and gets the method's verdict (`default`); an
empty path fits no rule whose path is not empty; of rules that fit, the longest (host and path together) wins, then
the one with the longer host; of equal rules with different actions, block wins; very long URLs are keys like others;
repeated pages give repeated rows; empty tables give empty results. Other columns are never read. A URL's cost grows with the number
of rules of the hosts that it lies in, as their paths are tried one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, table

# The rules of the registered query.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    q = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    values = ", ".join("(" + ", ".join(map(q, r)) + ")" for r in rules)
    return spark.sql(f"SELECT * FROM VALUES {values} AS rules(action, host, path)")


def stacks(rules: DataFrame) -> DataFrame:
    """For each host with rules, its key and the rules that are open where its interval begins: its own and those of the hosts above it."""
    one = rules.groupBy("host", "path").agg(F.max("action").alias("action")).withColumn("key", canonical(F.col("host")))
    hosts = one.groupBy("key").agg(F.collect_list(F.struct("key", "path", "host", "action")).alias("own"))
    labels = F.split("key", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.concat(F.array_join(F.slice(labels, F.lit(1), i), "."), F.lit(".")))
    each = hosts.select("key", F.explode(above).alias("up"))
    return each.join(hosts.select(F.col("key").alias("up"), "own"), "up").groupBy("key").agg(F.flatten(F.collect_list("own")).alias("stack"))


def judge(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls: distinct (host, path). Those that a rule fits, with `rule` and `verdict`."""
    begins = stacks(rules)
    none = F.lit(None).cast(begins.schema["stack"].dataType)
    points = urls.select(canonical(F.col("host")).alias("key"), F.lit(1).alias("kind"), "path", "host", none.alias("stack"))
    events = begins.select("key", F.lit(0).alias("kind"), F.lit("").alias("path"), F.lit("").alias("host"), "stack").union(points)
    order = ["key", "kind", "path"]
    swept = cut(events.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "sweep")
    lasts = swept.groupBy("part").agg(F.max_by("stack", F.when(F.col("kind") == 0, F.col("key"))).alias("last"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inherited = lasts.select("part", F.last("last", ignorenulls=True).over(earlier).alias("inherited"))
    so_far = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = swept.withColumn("top", F.last("stack", ignorenulls=True).over(so_far)).filter("kind = 1").join(F.broadcast(inherited), "part")
    fit = F.filter(F.coalesce("top", "inherited"), lambda r: F.startswith(F.col("key"), r["key"]) & F.startswith(F.col("path"), r["path"]))
    ranked = F.transform(fit, lambda r: F.struct(F.length(F.concat(r["host"], r["path"])).alias("n"), F.length(r["host"]).alias("m"), F.concat(r["host"], r["path"]).alias("rule"), r["action"].alias("verdict")))
    best = at.select("host", "path", F.array_max(ranked).alias("b")).filter("b IS NOT NULL")
    return best.select("host", "path", "b.rule", "b.verdict")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    u = pages.select(pages["page_id"], host_of(pages["url"]).alias("host"), path_of(pages["url"]).alias("path"))
    judged = judge(u.select("host", "path").distinct(), rules).withColumn("length", F.length("path"))
    # The length is a key more than judge() grouped by: both sides are dealt anew, and Spark can split a hot URL's pages.
    return u.withColumn("length", F.length("path")).join(judged, ["host", "path", "length"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), rules_frame(spark, RULES))


OP5_SQL = """
WITH u AS (SELECT page_id,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r(action, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
d AS (SELECT DISTINCT host, path FROM u),
m AS (SELECT host, path, max(struct_pack(n := length(h || p), m := length(h), rule := h || p, action := action)) AS b
    FROM d JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)
SELECT page_id, u.host, u.path, b.rule AS rule, coalesce(b.action, 'allow') AS verdict
FROM u LEFT JOIN m ON u.host = m.host AND u.path = m.path
"""
