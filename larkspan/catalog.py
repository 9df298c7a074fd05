"""Named queries over the driver's tables, each with the SQL that an independent engine answers alike.

A query is dialect text; `{name}` stands for a table's path. Sums and averages of floats are rounded on both sides, as
their last digits depend on the order of the rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as SF

from .functions import Col, F, floor_mod
from .operators import Frame
from .plans import run
from .session import new_path, remove_at_exit
from .sources import append_block_file, append_rows, import_csv, merge_tables, read_table, write_block_file
from .streaming import read_stream, run_to_table, sessions, sliding, tumbling

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

# The text of q1_returnflag is a fixed value: the published benchmark query.
# name: (dialect, SQL or None where the dialect's text is SQL but for paths and COUNT())
TEXTS: dict[str, tuple[str, str | None]] = {
    "q1_returnflag": (
        """SELECT l_returnflag, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice), 2) AS sum_base_price,
        ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, ROUND(SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
        ROUND(AVG(l_quantity), 4) AS avg_qty, ROUND(AVG(l_extendedprice), 4) AS avg_price, ROUND(AVG(l_discount), 4) AS avg_disc, COUNT() AS count_order
        FROM {lineitem} WHERE l_shipdate <= '1998-12-01' GROUP BY l_returnflag;""", None),
    "scan_all": ("SELECT * FROM {nation};", None),
    "star_plus_cols": ("SELECT n_name AS start, *, n_regionkey AS again FROM {nation};", None),
    "project_cols": ("SELECT c_custkey, c_name FROM {customer};", None),
    "project_alias": ("SELECT c.c_custkey AS id, c.c_acctbal AS balance FROM {customer} AS c;", None),
    "literals": ("SELECT r_name, 'x' AS letter, 7 AS seven, -3 AS minus_three, 0.5 AS half FROM {region};", "SELECT r_name, 'x' AS letter, 7 AS seven, -3 AS minus_three, 0.5::DOUBLE AS half FROM region"),
    "expr_add_lit": ("SELECT p_partkey, p_size + 5 AS bigger FROM {part};", None),
    "expr_sub": ("SELECT p_partkey, p_retailprice - p_size AS less FROM {part};", None),
    "expr_mul_cols": ("SELECT l_orderkey, l_linenumber, l_extendedprice * l_discount AS cut FROM {lineitem};", None),
    "expr_precedence": ("SELECT l_orderkey, l_linenumber, 1 + l_quantity * 2 - l_tax AS a, (1 + l_quantity) * (2 - l_tax) AS b FROM {lineitem};", None),
    "expr_div": ("SELECT p_partkey, p_size / 7 AS part FROM {part};", None),
    "expr_mod": ("SELECT o_orderkey, o_custkey % 7 AS rest FROM {orders};", None),
    "expr_floordiv": ("SELECT o_orderkey, o_custkey // 7 AS whole FROM {orders};", "SELECT o_orderkey, CAST(floor(o_custkey / 7) AS BIGINT) AS whole FROM orders"),
    "expr_negative": ("SELECT p_partkey, -p_size AS minus, -5 * p_size AS fivefold FROM {part};", None),
    "concat_strings": ("SELECT p_partkey, p_brand + ' ' + p_type AS label FROM {part};", "SELECT p_partkey, p_brand || ' ' || p_type AS label FROM part"),
    "concat_function": ("SELECT p_partkey, CONCAT(p_brand, '/', p_type) AS label FROM {part};", None),
    "filter_eq_str": ("SELECT * FROM {customer} WHERE c_mktsegment = 'BUILDING';", None),
    "filter_ne": ("SELECT c_custkey FROM {customer} WHERE c_mktsegment != 'BUILDING';", None),
    "filter_lt_le_gt_ge": ("SELECT p_partkey FROM {part} WHERE p_size > 10 AND p_size <= 30 AND p_retailprice >= 950 AND p_partkey < 1500;", None),
    "filter_col_col": ("SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_discount < l_tax;", None),
    "filter_lit_col": ("SELECT p_partkey FROM {part} WHERE 25 <= p_size;", None),
    "filter_and_or": ("SELECT p_partkey, p_size FROM {part} WHERE p_size = 1 OR p_size = 2 AND p_retailprice > 950;", None),
    "filter_parentheses": ("SELECT p_partkey, p_size FROM {part} WHERE (p_size = 1 OR p_size = 2) AND p_retailprice > 950;", None),
    "filter_mixed_types": ("SELECT c_custkey FROM {customer} WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 1000 AND c_nationkey < 10;", None),
    "filter_not": ("SELECT p_partkey FROM {part} WHERE NOT (p_size > 10 OR p_size = 5);", None),
    "filter_string_order": ("SELECT n_name FROM {nation} WHERE n_name < 'NATION_2';", None),
    "between_dates": ("SELECT o_orderkey, o_orderdate FROM {orders} WHERE o_orderdate BETWEEN '1996-01-01' AND '1996-06-30';", None),
    "between_numbers": ("SELECT p_partkey FROM {part} WHERE p_size BETWEEN 5 AND 9;", None),
    "between_cols": ("SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_discount BETWEEN l_tax AND 0.08;", None),
    "like_contains": ("SELECT p_partkey, p_name FROM {part} WHERE p_name LIKE '%ring%';", None),
    "like_prefix": ("SELECT p_partkey FROM {part} WHERE p_brand LIKE 'Brand#1%';", None),
    "like_underscore": ("SELECT p_partkey FROM {part} WHERE p_brand LIKE 'Brand#_2';", None),
    "like_not": ("SELECT p_partkey FROM {part} WHERE p_brand NOT LIKE 'Brand#1%';", None),
    "like_two": ("SELECT p_partkey FROM {part} WHERE p_brand LIKE '%1%' AND p_type LIKE '%E%';", None),
    "group_count": ("SELECT o_orderstatus, COUNT() AS n FROM {orders} GROUP BY o_orderstatus;", None),
    "group_count_forms": ("SELECT o_orderstatus, COUNT(*) AS n, COUNT(o_custkey) AS m FROM {orders} GROUP BY o_orderstatus;", None),
    "group_sum_expr": ("SELECT l_returnflag, ROUND(SUM(l_quantity * l_extendedprice), 2) AS total FROM {lineitem} GROUP BY l_returnflag;", None),
    "group_sum_int": ("SELECT p_brand, SUM(p_size) AS sizes FROM {part} GROUP BY p_brand;", "SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS sizes FROM part GROUP BY p_brand"),
    "group_avg_float": ("SELECT p_brand, ROUND(AVG(p_retailprice), 4) AS mean FROM {part} GROUP BY p_brand;", None),
    "group_avg_int": ("SELECT p_brand, ROUND(AVG(p_size), 6) AS mean FROM {part} GROUP BY p_brand;", None),
    "group_min_max": ("SELECT o_orderpriority, MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi, MIN(o_orderdate) AS first, MAX(o_orderstatus) AS last FROM {orders} GROUP BY o_orderpriority;", None),
    "group_multi_agg": ("SELECT o_orderstatus, COUNT() AS n, ROUND(SUM(o_totalprice), 2) AS total, ROUND(AVG(o_totalprice), 4) AS mean, MAX(o_totalprice) AS top FROM {orders} GROUP BY o_orderstatus;", None),
    "group_key_omitted": ("SELECT COUNT() AS n FROM {orders} GROUP BY o_orderstatus;", None),
    "group_select_order": ("SELECT COUNT() AS n, o_orderstatus FROM {orders} GROUP BY o_orderstatus;", None),
    "group_multi_key": ("SELECT l_returnflag, l_linestatus, COUNT() AS n, ROUND(SUM(l_quantity), 2) AS quantity FROM {lineitem} GROUP BY l_returnflag, l_linestatus;", None),
    "group_key_only": ("SELECT l_returnflag FROM {lineitem} GROUP BY l_returnflag;", None),
    "group_key_alias": ("SELECT l_returnflag AS flag, COUNT() AS n FROM {lineitem} GROUP BY l_returnflag;", None),
    "group_expr_key": ("SELECT p_size % 5 AS rest, COUNT() AS n FROM {part} GROUP BY p_size % 5;", None),
    "global_agg": ("SELECT COUNT() AS n, ROUND(SUM(o_totalprice), 2) AS total, MIN(o_orderdate) AS first FROM {orders};", None),
    "global_agg_empty": ("SELECT COUNT() AS n, MAX(o_totalprice) AS top FROM {orders} WHERE o_totalprice < 0;", None),
    "agg_arith": ("SELECT l_returnflag, ROUND(SUM(l_extendedprice) / SUM(l_quantity), 6) AS price, COUNT() + 1 AS n FROM {lineitem} GROUP BY l_returnflag;", None),
    "having_count": ("SELECT o_custkey, COUNT() AS n FROM {orders} GROUP BY o_custkey HAVING COUNT() > 12;", None),
    "having_sum_hidden": ("SELECT o_custkey FROM {orders} GROUP BY o_custkey HAVING SUM(o_totalprice) > 2000000;", None),
    "having_alias": ("SELECT o_custkey, COUNT() AS n FROM {orders} GROUP BY o_custkey HAVING n > 12 AND o_custkey < 1000;", None),
    "having_min_max_avg": ("SELECT o_custkey, COUNT() AS n FROM {orders} GROUP BY o_custkey HAVING MIN(o_totalprice) > 20000 AND MAX(o_totalprice) < 400000 AND AVG(o_totalprice) > 150000;", None),
    "join_inner": ("SELECT c.c_name, o.o_orderkey FROM {customer} AS c JOIN {orders} AS o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 300000;", None),
    "join_operands_swapped": ("SELECT c.c_name, o.o_orderkey FROM {customer} AS c INNER JOIN {orders} AS o ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 300000;", None),
    "join_unaliased": ("SELECT n_name, r_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey;", None),
    "join_group_count": ("SELECT c.c_mktsegment, COUNT() AS n FROM {customer} AS c JOIN {orders} AS o ON c.c_custkey = o.o_custkey GROUP BY c.c_mktsegment;", None),
    "join_group_sum": ("SELECT c.c_nationkey, ROUND(SUM(o.o_totalprice), 2) AS total FROM {customer} AS c JOIN {orders} AS o ON c.c_custkey = o.o_custkey GROUP BY c.c_nationkey;", None),
    "join_having": ("SELECT c.c_nationkey, COUNT() AS n FROM {customer} AS c JOIN {orders} AS o ON c.c_custkey = o.o_custkey GROUP BY c.c_nationkey HAVING SUM(o.o_totalprice) > 100000000;", None),
    "join_left": ("SELECT c.c_custkey, o.o_orderkey FROM {customer} AS c LEFT JOIN {orders} AS o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 400000;", None),
    "join_right": ("SELECT s.s_suppkey, n.n_name FROM {supplier} AS s RIGHT JOIN {nation} AS n ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000;", None),
    "join_full": ("SELECT s.s_suppkey, c.c_custkey FROM {supplier} AS s FULL JOIN {customer} AS c ON s.s_suppkey = c.c_custkey;", None),
    "join_left_missing": ("SELECT c.c_custkey FROM {customer} AS c LEFT JOIN {orders} AS o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 400000 WHERE o.o_orderkey IS NULL;", None),
    "join_chain": ("SELECT n.n_name, COUNT() AS n_lines FROM {lineitem} AS l JOIN {orders} AS o ON l.l_orderkey = o.o_orderkey JOIN {customer} AS c ON o.o_custkey = c.c_custkey JOIN {nation} AS n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name;", None),
    "join_self": ("SELECT a.n_name AS one, b.n_name AS other FROM {nation} AS a JOIN {nation} AS b ON a.n_regionkey = b.n_regionkey;", None),
    "join_composite": ("SELECT a.l_orderkey, a.l_linenumber, b.l_quantity FROM {lineitem} AS a JOIN {lineitem} AS b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber;", None),
    "join_theta": ("SELECT a.n_name AS one, b.n_name AS other FROM {nation} AS a JOIN {nation} AS b ON a.n_nationkey < b.n_nationkey;", None),
    "join_theta_sizes": ("SELECT a.s_suppkey AS one, b.s_suppkey AS other FROM {supplier} AS a JOIN {supplier} AS b ON a.s_acctbal < b.s_acctbal AND a.s_acctbal + 300 > b.s_acctbal;", None),
    "join_full_star": ("SELECT * FROM {nation} AS a FULL JOIN {region} AS b ON a.n_nationkey = b.r_regionkey;", None),
    "join_star_same_names": ("SELECT * FROM {nation} AS a FULL JOIN {nation} AS b ON a.n_nationkey = b.n_regionkey + 20;", "SELECT a.n_nationkey AS \"a.n_nationkey\", a.n_name AS \"a.n_name\", a.n_regionkey AS \"a.n_regionkey\", b.n_nationkey AS \"b.n_nationkey\", b.n_name AS \"b.n_name\", b.n_regionkey AS \"b.n_regionkey\" FROM nation a FULL JOIN nation b ON a.n_nationkey = b.n_regionkey + 20"),
    "join_string_key": ("SELECT a.n_nationkey AS one, b.n_nationkey AS other FROM {nation} AS a JOIN {nation} AS b ON a.n_name = b.n_name;", None),
    "join_float_key": ("SELECT COUNT() AS n FROM {part} AS a JOIN {part} AS b ON a.p_retailprice = b.p_retailprice;", None),
    "join_timestamp_key": ("SELECT o.o_orderstatus, COUNT() AS n FROM {orders} AS o JOIN {lineitem} AS l ON o.o_orderdate = l.l_shipdate GROUP BY o.o_orderstatus;", None),
    "join_semi": ("SELECT c.c_custkey FROM {customer} AS c SEMI JOIN {orders} AS o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 400000;", "SELECT c_custkey FROM customer SEMI JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey"),
    "join_anti": ("SELECT c.c_custkey FROM {customer} AS c ANTI JOIN {orders} AS o ON c.c_custkey = o.o_custkey;", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey"),
    "join_cross": ("SELECT r_name, n_name FROM {region} CROSS JOIN {nation};", None),
    "join_using": ("SELECT n_name, n_regionkey, n_nationkey FROM {nation} JOIN {nation} AS b USING (n_nationkey);", "SELECT a.n_name, a.n_regionkey, a.n_nationkey FROM nation a JOIN nation b USING (n_nationkey)"),
    "expr_power": ("SELECT p_partkey, p_size ** 2 AS squared, -p_size ** 2 AS less, ROUND(2 ** (p_size / 10), 9) AS raised FROM {part};", "SELECT p_partkey, p_size::DOUBLE ** 2 AS squared, -(p_size::DOUBLE ** 2) AS less, round(2 ** (p_size / 10), 9) AS raised FROM part"),
    "expr_floordiv_big": ("SELECT o_orderkey, (o_orderkey + 9007199254740993) // 7 AS whole, (o_orderkey - 9007199254740993) // 7 AS below, (9007199254740993 - o_orderkey) // -3 AS turned FROM {orders};", "SELECT o_orderkey, (o_orderkey + 9007199254740993) // 7 AS whole, ((o_orderkey - 9007199254740993) - (((o_orderkey - 9007199254740993) % 7 + 7) % 7)) // 7 AS below, ((9007199254740993 - o_orderkey) + ((3 - (9007199254740993 - o_orderkey) % 3) % 3)) // -3 AS turned FROM orders"),
    "case_when": ("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS class, CASE WHEN p_size > 25 THEN p_retailprice END AS price FROM {part};", None),
    "case_in_sum": ("SELECT o_orderpriority, SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS done FROM {orders} GROUP BY o_orderpriority;", "SELECT o_orderpriority, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS done FROM orders GROUP BY o_orderpriority"),
    "cast_values": ("SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, CAST(p_partkey AS STRING) AS key FROM {part};", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, CAST(p_partkey AS VARCHAR) AS key FROM part"),
    "in_list": ("SELECT p_partkey FROM {part} WHERE p_size IN (1, 5, 9) AND p_type NOT IN ('ECONOMY', 'PROMO');", None),
    "coalesce_outer": ("SELECT c.c_custkey, COALESCE(o.o_orderkey, -1) AS first FROM {customer} AS c LEFT JOIN {orders} AS o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 400000;", None),
    "string_functions": ("SELECT p_partkey, UPPER(p_name) AS u, LENGTH(p_type) AS n, SUBSTRING(p_brand, 1, 3) AS b, REPLACE(p_name, ' ', '-') AS r FROM {part};", None),
    "number_functions": ("SELECT p_partkey, ABS(p_size - 25) AS a, ROUND(SQRT(p_retailprice), 6) AS s, FLOOR(p_retailprice) AS f, CEIL(p_retailprice) AS c, GREATEST(p_size, 20) AS g FROM {part};", "SELECT p_partkey, abs(p_size - 25) AS a, round(sqrt(p_retailprice), 6) AS s, CAST(floor(p_retailprice) AS BIGINT) AS f, CAST(ceil(p_retailprice) AS BIGINT) AS c, greatest(p_size, 20) AS g FROM part"),
    "date_functions": ("SELECT YEAR(o_orderdate) AS y, MONTH(o_orderdate) AS m, COUNT() AS n FROM {orders} GROUP BY YEAR(o_orderdate), MONTH(o_orderdate);", "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, count(*) AS n FROM orders GROUP BY ALL"),
    "count_distinct": ("SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS customers, COUNT(o_custkey) AS n FROM {orders} GROUP BY o_orderstatus;", None),
    "stddev_group": ("SELECT p_brand, ROUND(STDDEV(p_retailprice), 6) AS s, ROUND(VARIANCE(p_size), 6) AS v, MEDIAN(p_size) AS m FROM {part} GROUP BY p_brand;", "SELECT p_brand, round(stddev(p_retailprice), 6) AS s, round(variance(p_size), 6) AS v, CAST(median(p_size) AS DOUBLE) AS m FROM part GROUP BY p_brand"),
    "group_float_key": ("SELECT l_discount, COUNT() AS n FROM {lineitem} GROUP BY l_discount;", None),
    "group_timestamp_key": ("SELECT o_orderdate, COUNT() AS n FROM {orders} GROUP BY o_orderdate;", None),
    "window_rank": ("SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS place, RANK() OVER (ORDER BY o_orderpriority) AS r, SUM(o_totalprice) OVER (PARTITION BY o_custkey) > 1000000 AS large FROM {orders};", None),
    "window_share": ("SELECT p_partkey, ROUND(p_retailprice / SUM(p_retailprice) OVER (PARTITION BY p_brand), 9) AS share, MAX(p_size) OVER (PARTITION BY p_type) AS top FROM {part};", None),
    "json_values": ("SELECT event_id, CAST(JSON_VALUE(props, '$.k') AS INTEGER) AS k FROM {events};", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events"),
    "array_sizes": ("SELECT label, COUNT() AS n, MAX(SIZE(embedding)) AS size FROM {embeddings} GROUP BY label;", "SELECT label, count(*) AS n, CAST(max(len(embedding)) AS INTEGER) AS size FROM embeddings GROUP BY label"),
    "union_all_sql": ("SELECT n_name AS name FROM {nation} UNION ALL SELECT r_name AS name FROM {region};", None),
    "union_sql": ("SELECT n_regionkey AS k FROM {nation} UNION SELECT r_regionkey AS k FROM {region} ORDER BY k DESC LIMIT 3;", None),
    "intersect_sql": ("SELECT c_nationkey AS k FROM {customer} WHERE c_acctbal > 9900 INTERSECT SELECT s_nationkey AS k FROM {supplier};", None),
    "except_sql": ("SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey AS k FROM {orders};", None),
    "events_ts_filter": ("SELECT event_id, ts FROM {events} WHERE ts > '2024-01-15';", None),
    "events_group": ("SELECT event_type, COUNT() AS n, ROUND(SUM(value), 2) AS total FROM {events} GROUP BY event_type;", None),
    "order_limit": ("SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20;", None),
    "distinct_pairs": ("SELECT DISTINCT l_returnflag, l_linestatus FROM {lineitem};", None),
}


def dialect(text: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = {t: f"'{sf_dir}/{t}.parquet'" for t in TABLES}
    return run(spark, text.format(**paths)).to_df()


def as_sql(text: str) -> str:
    plain = text.format(**{t: t for t in TABLES}).rstrip(" ;")
    return re.sub(r"COUNT\(\)", "COUNT(*)", plain)


def frame(spark: SparkSession, sf_dir: str, name: str) -> Frame:
    return Frame(read_table(spark, f"{sf_dir}/{name}.parquet"))


def reaggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = frame(spark, sf_dir, "orders").group_by("o_custkey").agg(F.count().alias("n"))
    return each.group_by("n").agg(F.count().alias("customers")).to_df()


def agg_then_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = frame(spark, sf_dir, "orders").group_by("o_custkey").agg(F.count().alias("n"))
    both = each.join(frame(spark, sf_dir, "customer"), Col("o_custkey") == Col("c_custkey"))
    return both.group_by("c_mktsegment").agg(F.sum(Col("n")).alias("orders")).to_df()


def floor_mod_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "part").select("p_partkey", floor_mod(Col("p_size") - 25, 7).alias("rest")).to_df()


def grouping_sets(how: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count().alias("n")
    f = frame(spark, sf_dir, "orders")
    return (f.rollup if how == "rollup" else f.cube)("o_orderstatus", "o_orderpriority").agg(n, F.max(Col("o_totalprice")).alias("top")).to_df()


def asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frame(spark, sf_dir, "events")
    errors, clicks = f.filter(Col("event_type") == "error").alias("e"), f.filter(Col("event_type") == "click").alias("c")
    return errors.asof_join(clicks, ("e.ts", "c.ts"), [("e.user_id", "c.user_id")]).select(Col("e.event_id").alias("error"), Col("c.event_id").alias("click"), Col("c.ts").alias("at")).to_df()


def exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frame(spark, sf_dir, "embeddings").explode("embedding", "x")
    return f.group_by("label").agg(F.count().alias("n"), F.max(Col("x")).alias("top")).to_df()


def floor_mod_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "orders").select("o_orderkey", floor_mod(Col("o_orderkey") - 9007199254740993, 7).alias("rest")).to_df()


def derived_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "part").group_by("p_brand").agg(F.count(), F.max(Col("p_size")), F.max(Col("p_size") + 1)).to_df()


def union_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = frame(spark, sf_dir, "nation")
    return n.filter(Col("n_regionkey") == 0).select("n_name").union(n.filter(Col("n_regionkey") >= 3).select("n_name")).to_df()


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .schema import ColumnType as C

    at = new_path(spark, "csv")
    read_table(spark, f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate").write.option("header", True).csv(f"{at}/in")
    import_csv(spark, f"{at}/in", f"{at}/out", [("o_orderkey", C.INTEGER), ("o_orderstatus", C.STRING), ("o_totalprice", C.FLOAT), ("o_orderdate", C.TIMESTAMP)])
    remove_at_exit(spark, at)
    return read_table(spark, f"{at}/out").withColumn("o_orderkey", SF.col("o_orderkey").cast("long"))


def append_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .schema import ColumnType as C

    at = new_path(spark, "append")
    read_table(spark, f"{sf_dir}/region.parquet").write.parquet(at)
    append_rows(spark, at, [{"r_regionkey": 99, "r_name": "NOWHERE"}], [("r_regionkey", C.INTEGER), ("r_name", C.STRING)])
    remove_at_exit(spark, at)
    return read_table(spark, at)


def merge_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = new_path(spark, "merge")
    n = read_table(spark, f"{sf_dir}/nation.parquet")
    n.filter("n_regionkey < 2").write.parquet(f"{at}/a")
    n.filter("n_regionkey >= 2").write.parquet(f"{at}/b")
    merge_tables(spark, [f"{at}/a", f"{at}/b"], f"{at}/all")
    remove_at_exit(spark, at)
    return read_table(spark, f"{at}/all")


def block_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writes into one block file, read back by chosen columns; the file lies on the driver's machine, as block files do."""
    import os
    import tempfile

    n = read_table(spark, f"{sf_dir}/nation.parquet")
    at = os.path.join(tempfile.mkdtemp(prefix="larkspan-"), "nation.bin")
    write_block_file(n.filter("n_regionkey < 3"), at, 4)
    append_block_file(n.filter("n_regionkey >= 3"), at, 4)
    return read_table(spark, at, ["n_name", "n_nationkey"])


def join_api(how: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = frame(spark, sf_dir, "supplier").filter(Col("s_acctbal") > 2000), frame(spark, sf_dir, "nation")
    return n.join(r, Col("s_nationkey") == Col("n_nationkey"), how).select("s_suppkey", "n_name").to_df()


def reflected(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Col("p_size")
    return frame(spark, sf_dir, "part").select("p_partkey", (1000 // x).alias("whole"), (1000 % x).alias("rest"), F.round(2 ** (x / 10), 9).alias("raised"), (7 - x).alias("less"), (3 * x + 1).alias("more"), (100 / x).alias("part")).to_df()


def event_windows(kind: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream: read to the end, in windows, into a table."""
    path = f"{sf_dir}/events.parquet"
    at = new_path(spark, "events")
    parts = read_table(spark, path)
    if not spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)).isDirectory():
        parts.write.parquet(f"{at}/in")  # a stream reads a folder
        path = f"{at}/in"
    stream = read_stream(spark, path, parts.schema)
    n = F.count().alias("n")
    if kind == "tumbling":
        df = tumbling(stream, "ts", "1 day", "1 hour", ["event_type"], n)
    elif kind == "sliding":
        df = sliding(stream, "ts", "2 days", "1 day", "1 hour", ["event_type"], n)
    else:
        df = sessions(stream, "ts", "6 hours", "1 hour", ["user_id"], n)
    out = run_to_table(df, f"{at}/out", f"{at}/state", "complete")
    remove_at_exit(spark, at)
    rest = [c for c in out.columns if c != "window"]
    return out.select(SF.col("window.start").cast("timestamp_ntz").alias("start"), *rest)


BUILT: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "reaggregate": (reaggregate, "SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) GROUP BY n"),
    "agg_then_join": (agg_then_join, "SELECT c_mktsegment, CAST(sum(n) AS BIGINT) AS orders FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"),
    "expr_floor_mod": (floor_mod_query, "SELECT p_partkey, CAST((p_size - 25) - 7 * floor((p_size - 25) / 7) AS BIGINT) AS rest FROM part"),
    "derived_names": (derived_names, "SELECT p_brand, count(*) AS count, max(p_size) AS max_p_size, max(p_size + 1) AS max_p_size_add_lit_1 FROM part GROUP BY p_brand"),
    "union_frames": (union_query, "SELECT n_name FROM nation WHERE n_regionkey = 0 UNION ALL SELECT n_name FROM nation WHERE n_regionkey >= 3"),
    "csv_roundtrip": (csv_roundtrip, "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders"),
    "append_roundtrip": (append_roundtrip, "SELECT * FROM region UNION ALL SELECT 99, 'NOWHERE'"),
    "group_rollup": (partial(grouping_sets, "rollup"), "SELECT o_orderstatus, o_orderpriority, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"),
    "group_cube": (partial(grouping_sets, "cube"), "SELECT o_orderstatus, o_orderpriority, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"),
    "join_asof": (asof, "SELECT e.event_id AS error, c.event_id AS click, c.ts AS at FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON e.user_id = c.user_id AND e.ts >= c.ts"),
    "explode_arrays": (exploded, "SELECT label, count(*) AS n, max(x) AS top FROM (SELECT label, unnest(embedding) AS x FROM embeddings) GROUP BY label"),
    "merge_roundtrip": (merge_roundtrip, "SELECT * FROM nation"),
    "block_roundtrip": (block_roundtrip, "SELECT n_name, n_nationkey FROM nation"),
    **{f"join_api_{how}": (partial(join_api, how), f"SELECT s_suppkey, n_name FROM (SELECT * FROM supplier WHERE s_acctbal > 2000) {sql} JOIN nation ON s_nationkey = n_nationkey") for how, sql in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("outer", "FULL"))},
    "expr_reflected": (reflected, "SELECT p_partkey, CAST(1000 // p_size AS BIGINT) AS whole, 1000 % p_size AS rest, round(2 ** (p_size / 10), 9) AS raised, 7 - p_size AS less, 3 * p_size + 1 AS more, 100 / p_size AS part FROM part"),
    "expr_floor_mod_big": (floor_mod_big, "SELECT o_orderkey, (((o_orderkey - 9007199254740993) % 7) + 7) % 7 AS rest FROM orders"),
    "stream_tumbling": (partial(event_windows, "tumbling"), "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL"),
    "stream_sliding": (partial(event_windows, "sliding"), "SELECT start, event_type, count(*) AS n FROM (SELECT date_trunc('day', ts)::TIMESTAMP - INTERVAL (d) DAY AS start, event_type FROM events, range(2) r(d)) GROUP BY ALL"),
    "stream_sessions": (partial(event_windows, "sessions"), "SELECT min(ts) AS start, user_id, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: partial(dialect, t) for n, (t, _) in TEXTS.items()} | {n: q for n, (q, _) in BUILT.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s or as_sql(t) for n, (t, s) in TEXTS.items()} | {n: s for n, (_, s) in BUILT.items()}
